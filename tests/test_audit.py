"""How the audit goes about its jobs: what is long is several, nothing is lost, garbage goes after each."""

from lectern.functions.sql import Spark
from lectern.operators.base import COLUMNS
from lectern.plans import audit
from lectern.plans.audit import EVALUATORS, FINDINGS, rule_parts
from test_rules import corpus


def test_long_rules_are_several_jobs_with_all_branches():
    d = Spark()
    for check_id, evaluate in EVALUATORS.items():
        parts, selects = rule_parts(d, check_id), evaluate(d) or []
        assert sum(p.count(f"SELECT {COLUMNS} FROM (") for p in parts) == len(selects) >= len(parts)
        assert all(sum(s in p for p in parts) >= 1 for s in selects)
    assert len(rule_parts(d, "PDFUA-TREE-001")) == 4 and len(rule_parts(d, "PDFUA-META-001")) == 1


def test_audit_in_parts_finds_what_the_whole_rule_finds(spark, tmp_path, monkeypatch):
    c = corpus(spark, {1: {"tree": ["H1", "P"]}, 2: {"tree": []}})
    rules, seen = ["WCAG-1.3", "PDFUA-TREE-002", "PDFUA-META-001"], []
    released = audit.released
    monkeypatch.setattr(audit, "released", lambda s: (seen.append(s.conf.get("spark.sql.adaptive.enabled")), released(s)))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    found = c.audited(f"file://{tmp_path}/f", rules=rules, threads=2, adaptive=False)
    assert spark.conf.get("spark.sql.adaptive.enabled") == was and set(seen) == {"false"}
    assert len(seen) == sum(len(rule_parts(c.dialect, r)) for r in rules) > len(rules)
    cols = FINDINGS.split(", ")
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(found) == sorted(x for r in rules for x in rows(c.rule(r)))
