import io
import json
import zipfile

from lectern import sinks
from lectern.operators import reading
from lectern.sources.oracle import sheet_rows
from test_rules import corpus


def test_reading(spark):
    c = corpus(spark, {1: {"tree": [("L", ("LI", ("Lbl", {"text_content": "1."}), ("P", {"text_content": "Body"}), ("Figure", {"alt_text": "A bridge"})))]}, 2: {"tree": [("H1", {"text_content": "a"}), ("H2", {"text_content": "b"}), ("H3", {"text_content": "c"})]}, 3: {"is_tagged": False, "tree": ["P"]}})
    items = reading.reading(c)
    t = {r.doc_id: r for r in reading.totals(items).collect()}
    assert t[1].lists == 1 and t[1].figures == 1 and t[1].paragraphs == 1 and t[2].headings == 3
    said = {r.doc_id: r.transcript for r in reading.transcript(items).collect()}
    assert "LIST ITEM 1." in said[1] and "A bridge" in said[1] and "HEADING LEVEL 3: c" in said[2] and "untagged" in said[3]


def test_reading_cases(spark):
    c = corpus(spark, {
        1: {"tree": [("H", {"text_content": "bare"}), ("L", ("LI", ("LBody", ("H", {"text_content": "inner"}))))]},
        2: {"tree": [("P", {"text_content": "x", "is_artifact": True}, ("Span", {"text_content": "gone"})), ("Sect", {"is_artifact": True}, ("P", {"text_content": "kept"})), ("MATH", {"alt_text": " "}), ("Figure", {"is_artifact": True})]},
        3: {"tree": [("L", ("LI", {"text_content": "1. own words"})), ("Table", {"title": "T"}, ("Caption", {"text_content": "Cap"}), ("TR", ("TH", {"text_content": "a"}), ("TD", {"text_content": "b"})))]},
        4: {"tree": [("P", {"text_content": "same"}, ("Span", {"text_content": "same"}), ("Span", {"text_content": "more"}))]},
        5: {"tree": [("P", {"text_content": "lead"}, ("Figure", {"alt_text": "fig"}))]},
    })
    got = {}
    for r in reading.reading(c).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.depth, r.text))
    assert got[1] == [("heading1", 0, "bare"), ("list", 0, "1"), ("list_item", 1, ""), ("heading3", 2, "inner")]
    assert [k for k, _, _ in got[2]] == ["artifact", "paragraph", "formula_empty", "figure_artifact"] and got[2][1][2] == "kept"
    assert got[3] == [("list", 0, "1"), ("list_item", 1, ""), ("body", 2, "1. own words"), ("table", 0, "Cap"), ("header_cell", 1, "a"), ("cell", 1, "b")]
    assert got[4] == [("paragraph", 0, "same more")]
    assert got[5] == [("paragraph", 0, ""), ("figure", 0, "fig")]


def test_sinks(spark, tmp_path):
    c = corpus(spark, {1: {"tree": ["H1"]}, 2: {"tree": []}})
    found = c.audited(f"file://{tmp_path}/f", rules=["QUAL-HEAD-001", "PDFUA-META-001"])
    reports = {r.doc_id: json.loads(r.report) for r in sinks.json_reports(c, found).collect()}
    assert len(reports) == 2 and reports[1]["summary"]["total_checks"] == len(reports[1]["findings"]) == 2
    sinks.write_csv(found, f"file://{tmp_path}/csv")
    text = "".join(p.read_text() for p in tmp_path.glob("csv/*.csv"))
    assert text.startswith("﻿") and ",Doc," in text
    assert sinks.html_rows(found).count() == 2


def test_more_sinks(spark, tmp_path):
    from lectern.plans import compare
    from lectern.sources import pdf

    c = corpus(spark, {1: {"tree": ["H1"]}, 2: {"tree": [], "xmp_metadata_present": False}}, pages=[{"doc_id": 1, "page_number": 1}], page_mcids=[{"doc_id": 1, "page_number": 1, "ord": i, "mcid": i} for i in range(30)])
    found = c.audited(f"file://{tmp_path}/f", rules=["QUAL-HEAD-001", "PDFUA-META-001"])
    data = {r.doc_id: json.loads(r.report) for r in sinks.json_reports(c, found).collect()}
    cells = {x["category"]: x for x in data[2]["category_breakdown"]["PDF/UA"]}
    assert list(data[2]["category_breakdown"]) == ["PDF/UA", "WCAG", "Quality", "AI"] and len(cells) == 11 and cells["Metadata"]["failed"] == 1
    dump = {r.doc_id: json.loads(r.dump) for r in sinks.diagnostics(c).collect()}
    assert dump[1]["structure"]["total_elements"] == 2 and dump[1]["pages"][0]["mcids"] == list(range(20))
    files = {r.doc_id: bytes(r.content) for r in sinks.pdf_reports(c, found).collect()}
    text = pdf.rows_of(files[2], 2, "r.pdf")["pages"][0]["text"]
    assert "Audit of a.pdf" in text and "PDFUA-META-001" in text and "PDFUA-META-001" not in pdf.rows_of(files[1], 1, "r.pdf")["pages"][0]["text"]
    side = "doc_id long, category string, check_name string, page int, status string, ord int"
    made = compare.compared(spark.createDataFrame([(1, "Fonts", "F", 1, "FAIL", 1), (1, "Own", "O", 1, "PASS", 2)], side), spark.createDataFrame([(1, "Fonts", "F", 1, "PASS", 1)], side))
    whole, said = sinks.regression_report(made)
    assert json.loads(whole)["totals"] == {"ENGINE_ONLY": 1, "STATUS_MISMATCH": 1} and "| 1 | 1 | F | STATUS_MISMATCH | PASS | FAIL |" in said
    assert "show('WARNING')" in sinks.html_rows(found).first().html


def test_stream_of_documents(spark, tmp_path):
    from lectern.schema import ENTITIES
    from lectern.streaming.incremental import audit_stream

    c = corpus(spark, {1: {"tree": ["H1"]}, 2: {"tree": ["H2"]}})
    for name in ENTITIES:
        c.frames[name].write.parquet(f"file://{tmp_path}/in/{name}")
    go = lambda: audit_stream(spark, f"file://{tmp_path}/in/documents", f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", ["QUAL-HEAD-001"]).awaitTermination()
    go()
    go()  # nothing new: nothing again
    got = spark.read.parquet(*[f"file://{p}" for p in tmp_path.glob("out/batch=*/*")]).collect()
    assert sorted((r.doc_id, r.status) for r in got) == [(1, "PASS"), (2, "WARNING")]


def test_sheet():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>A</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3</v></c></row></sheetData></worksheet>')
    assert sheet_rows(f.getvalue()) == [["id"], ["A", "", "3"]]
