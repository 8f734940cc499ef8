"""Reports over hand-built findings: fonts of engine and oracle, categories, drill-down, evidence, inventory, failing rules."""

import json

import pytest

from lectern import sinks
from lectern.plans import report
from lectern.plans.audit import FINDINGS_SCHEMA, _of_the_rule
from test_rules import corpus


def findings(spark, c, rows):
    """rows: doc_id, check_id, standard, category, status and more by name."""
    names = [x.split()[0] for x in FINDINGS_SCHEMA.split(", ")]
    base = {"rule_ord": 1, "name": "n", "branch": 0, "severity": "HIGH", "items_count": 1, "confidence": 1.0, "machine_testable": True, "manual_review_required": False, "message": "m"}
    made = [{**base, "pos": k, **dict(zip(("doc_id", "check_id", "standard", "category", "status"), r[:5])), **(r[5] if len(r) > 5 else {})} for k, r in enumerate(rows)]
    c.frames["findings"] = spark.createDataFrame([tuple(m.get(n) for n in names) for m in made], FINDINGS_SCHEMA)
    return c


def test_font_match(spark):
    """Each of the five classes, statuses of either side apart from those of the other."""
    font = lambda d, s: (d, "PDFUA-FONT-001", "PDF/UA", "Fonts", s)
    other = lambda d, s: (d, "PDFUA-META-001", "PDF/UA", "Metadata", s)
    engine = [font(1, "FAIL"), font(1, "ERROR"), font(1, "PASS"), font(2, "FAIL"), font(2, "FAIL"), font(2, "FAIL"), font(3, "FAIL"), font(4, "FAIL"), font(5, "FAIL"), font(5, "WARNING"), other(6, "PASS"), other(6, "FAIL"), font(8, "WARNING")]
    oracle = [(1, "FAIL"), (1, "FAIL"), (2, "FAIL"), (3, "FAIL"), (3, "FAIL"), (3, "INFO"), (4, "PASS"), (4, "MANUAL REVIEW"), (5, "INFO"), (7, "PASS")]
    rows = [(d, "Fonts", "Font Embedding", s) for d, s in oracle] + [(1, "Document", "Title", "FAIL"), (1, "Fonts", "Other", "WARNING")]
    c = findings(spark, corpus(spark, {d: {"page_count": d} for d in range(1, 9)}), engine)
    spark.createDataFrame(rows, "doc_id long, category string, check_name string, status string").createOrReplaceTempView("said_of_fonts")
    got = {r.doc_id: r for r in c.sql(report.font_match("SELECT * FROM said_of_fonts")).collect()}
    # 8: the engine warns where the oracle says nothing; nothing failed on either side.
    assert {d: r.font_match for d, r in got.items()} == {1: "MATCH", 2: "ENGINE_FOUND_ADDITIONAL_OCCURRENCES", 3: "ENGINE_MISSED_FAILURES", 4: "STATUS_DISAGREEMENT", 5: "EVALUATION_DIFFERENCE", 6: "MATCH", 7: "MATCH", 8: "EVALUATION_DIFFERENCE"}
    r = got[1]
    assert (r.oracle_total, r.oracle_failed, r.oracle_warned, r.oracle_font_total, r.oracle_font_failed, r.engine_font_records, r.engine_font_failed, r.engine_font_passed) == (4, 3, 1, 2, 2, 3, 2, 1)
    assert (got[3].oracle_info, got[4].oracle_font_info, got[6].engine_font_records, got[6].findings_count, got[6].items_failed, got[6].compliance_score) == (1, 1, 0, 2, 1, 50.0)


def test_merged_categories(spark):
    c = findings(spark, corpus(spark, {1: {}, 2: {}}), [(1, "PDFUA-META-001", "PDF/UA", "Metadata", "PASS", {"items_count": 3}), (1, "WCAG-3.1", "WCAG", "3.1 Readable", "FAIL"), (1, "QUAL-HEAD-001", "Quality", "x", "WARNING"), (1, "AI-READ-001", "AI", "Cognitive Accessibility", "MANUAL REVIEW")])
    got = {(r.doc_id, r.category): (r.passed, r.warned, r.failed, r.manual) for r in c.sql(report.merged_categories()).collect()}
    assert got[1, "Metadata"] == (3, 0, 0, 0) and got[1, "3.1 Readable"] == (0, 0, 1, 0) and got[1, "Presence of headings"] == (0, 1, 0, 0) and got[1, "Unrecognized structural elements"] == (0, 0, 0, 1)
    assert len(got) == 2 * (11 + 13 + 16 + 3) and all(v == (0, 0, 0, 0) for (d, _), v in got.items() if d == 2)


def test_drilldown_takes_the_categories_of_the_matrix(spark):
    rows = [(1, "PDFUA-TABLE-001", "PDF/UA", "Tables", "FAIL"), (1, "PDFUA-FORM-001", "PDF/UA", "Forms", "PASS"), (1, "PDFUA-ANNOT-002", "PDF/UA", "Annotations", "FAIL"), (1, "PDFUA-ANNOT-001", "PDF/UA", "Annotations", "FAIL"), (1, "PDFUA-UNICODE-001", "PDF/UA", "x", "WARNING"), (1, "QUAL-TABLE-001", "Quality", "Tables", "FAIL"), (1, "PDFUA-STRUCT-001", "PDF/UA", "Structure elements", "PASS")]
    c = findings(spark, corpus(spark, {1: {}}), rows)
    ids = lambda category, standard="pdf/ua": sorted(r.check_id for r in c.sql(report.search(standard=standard, category=category)).collect())
    assert ids("Structure elements") == ["PDFUA-FORM-001", "PDFUA-STRUCT-001", "PDFUA-TABLE-001"] and ids("document settings") == ["PDFUA-ANNOT-002"]
    assert ids("Content") == ["PDFUA-ANNOT-001"] and ids("Natural language") == ["PDFUA-UNICODE-001"] and ids("Tables", "") == ["PDFUA-TABLE-001", "QUAL-TABLE-001"]
    counts = {r.category: (r.findings, r.problems, r["items"]) for r in c.sql(report.drilldown_counts()).collect()}
    assert counts["Structure elements"] == (3, 1, 3) and counts["Fonts"] == (0, 0, 0) and len(counts) == 11


def test_evidence_remediation_and_boxes(spark, tmp_path):
    tree = [("H1", {"page": 1}), ("H3", {"page": 1}), ("P", {"page": 1, "text_content": "  "}), ("Figure", {"page": 1, "alt_text": "scan.png"})]
    mark = {"doc_id": 1, "page_number": 1, "ord": 0, "mcid": 0}
    span = {"doc_id": 1, "page_number": 1, "ord": 0, "block": 0, "text": "x", "x0": 10.0, "y0": 20.0, "x1": 30.0, "y1": 40.0}
    c = corpus(spark, {1: {"tree": tree}}, spans=[span], page_mcids=[mark], node_mcids=[{"doc_id": 1, "node_id": "node_4", "ord": 0, "mcid": 0, "is_entry": True}])
    found = c.audited(f"file://{tmp_path}/f", rules=["QUAL-HEAD-001", "QUAL-WHITE-001", "QUAL-ALT-001", "QUAL-LIST-001", "PDFUA-META-001"])
    by = {(r.check_id, r.status): r for r in found.collect()}
    assert by["QUAL-HEAD-001", "WARNING"].evidence == "Level 3 after level 1" and by["QUAL-ALT-001", "WARNING"].evidence == 'Alternative text: "scan.png"'
    assert by["PDFUA-META-001", "PASS"].evidence == "Items: 1" and by["PDFUA-META-001", "PASS"].remediation is None and by["QUAL-WHITE-001", "WARNING"].remediation
    figure = by["QUAL-ALT-001", "WARNING"]
    assert (figure.x0, figure.y0, figure.x1, figure.y1) == (10, 20, 30, 40) and by["QUAL-WHITE-001", "WARNING"].x0 is None
    c.frames["findings"] = found
    c._views.pop("findings", None)
    assert [r.check_id for r in c.sql(report.search("SCAN.PNG")).collect()] == ["QUAL-ALT-001"]
    data = json.loads(sinks.json_reports(c, found).first().report)
    boxed = [f for f in data["findings"] if f.get("bounding_box")]
    assert [f["bounding_box"] for f in boxed] == [[10.0, 20.0, 30.0, 40.0]] and all(f["evidence"] for f in data["findings"])


def test_inventory(spark):
    c = corpus(spark, {1: {"tree": ["H1", "H2", "P"], "page_count": 4, "bookmarks_count": 3}, 2: {}}, links=[{"doc_id": 1, "ord": 0, "text": "a", "uri": "u"}], fonts=[{"doc_id": 1, "ord": 0, "name": "F", "is_embedded": True, "has_tounicode": False, "encoding": "E"}], font_pages=[{"doc_id": 1, "font_ord": 0, "idx": i, "page": i + 1} for i in range(11)])
    got = {(r.doc_id, r.kind): r.n for r in c.sql(report.inventory()).collect()}
    assert {k: n for (d, k), n in got.items() if d == 1} == {"Pages": 4, "Fonts": 1, "Images": 0, "Tables": 0, "Links": 1, "Form Fields": 0, "Headings": 2, "Bookmarks": 3} and got[2, "Headings"] == 0
    rows = {r.kind: (r.name, r.shown) for r in c.sql(report.elements(c.dialect)).collect()}
    assert rows == {"Fonts": ("F", "Yes | No | E | 1, 2, 3, 4, 5, 6, 7, 8"), "Links": ("a", "u")}


def test_what_fails_a_rule_and_what_fails_the_audit(spark, tmp_path):
    c = corpus(spark, {1: {}, 2: {}})
    broken = {"C-1": lambda c: c.sql("SELECT no_such_column FROM $documents"), "C-2": lambda c: c.sql("SELECT 1 / 0 AS x FROM $documents"), "C-3": lambda c: 1 / 0}
    found = c.audited(f"file://{tmp_path}/f", rules=["PDFUA-META-001"], custom=broken)
    assert {(r.check_id, r.status): r["count"] for r in found.groupBy("check_id", "status").count().collect()} == {("PDFUA-META-001", "PASS"): 2, ("C-1", "ERROR"): 2, ("C-2", "ERROR"): 2, ("C-3", "ERROR"): 2}

    def full(c):
        raise OSError("No space left on device")

    with pytest.raises(OSError):
        c.audited(f"file://{tmp_path}/g", rules=[], custom={"C-4": full})
    assert not _of_the_rule(MemoryError()) and not _of_the_rule(RuntimeError("ExecutorLostFailure (executor 3 exited)"))
