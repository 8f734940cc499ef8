"""Prepared tables in buckets by document: rules read them where they lie, and find what they found."""

import re

from lectern.plans import stage
from lectern.plans.audit import CO_PARTITION, FINDINGS, rule_parts
from lectern.sources import load


def test_rules_join_buckets_without_dealing_them_out(spark, tmp_path):
    sf = tmp_path / "sf0.001"
    sf.symlink_to("/root/testdata/sf0.001")
    corpus = load.prepared_corpus(spark, str(sf))
    rules = ["PDFUA-TREE-002", "PDFUA-CONTENT-005", "QUAL-HEAD-001"]
    keys = (CO_PARTITION, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    was = [spark.conf.get(k) for k in keys]
    found = corpus.audited(f"file://{tmp_path}/f", rules=rules, threads=3, adaptive=False, bucketed=True)
    assert [spark.conf.get(k) for k in keys] == was
    rows = lambda df: sorted(map(str, df.select(*FINDINGS.split(", ")).collect()))
    assert rows(found) == sorted(x for r in rules for x in rows(corpus.rule(r)))
    with stage.held(spark, dict(zip(keys, ("false", "-1", "false")))):
        for text in (t for r in rules for t in rule_parts(corpus.dialect, r)):
            plan = corpus.sql(text)._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and not re.search(r"\bExchange |BroadcastExchange ", plan)


def test_tables_stand_in_buckets_by_document(spark, tmp_path):
    sf = tmp_path / "sf0.001"
    sf.symlink_to("/root/testdata/sf0.001")
    corpus = load.prepared_corpus(spark, str(sf))
    assert corpus.frames["documents"].count() > 0
    path, made = load._prepared(spark, str(sf))
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {made['documents']}").collect()}
    assert described["Num Buckets"] == str(load._BUCKETS[path]) and load._BUCKETS[path] >= spark.sparkContext.defaultParallelism
    assert described["Bucket Columns"] == "[`doc_id`]"
