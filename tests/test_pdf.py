"""The PDF reader on hand-built files, against what they were made of."""

import zlib

from lectern.sources import pdf, pdf_writer


def build(objects, extra=b""):
    out = b"%PDF-1.7\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R /Size 99 %s>>\n%%%%EOF" % extra


def stream(d, data, flate=False):
    if flate:
        data = zlib.compress(data)
        d += b" /Filter /FlateDecode"
    return b"<< %s /Length %d >>\nstream\n" % (d, len(data)) + data + b"\nendstream"


CONTENT = b"/H1 <</MCID 0>> BDC BT /F1 12 Tf (He\\154lo \\(x\\)) Tj ET EMC /Artifact BMC (Page 3) Tj EMC /P <</MCID 1>> BDC [(a) -20 <62>] TJ EMC 0 0 10 10 re f /Fm1 Do"
OBJECTS = {1:b"<< /Type /Catalog /Pages 2 0 R /Lang (en-US) /MarkInfo << /Marked true >> /StructTreeRoot 5 0 R /ViewerPreferences << /DisplayDocTitle true >> /Outlines 20 0 R /Metadata 22 0 R >>",
2:b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
3:b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /StructParents 0 /Tabs /S /Resources << /Font << /F1 10 0 R >> /XObject << /Fm1 11 0 R /Im1 12 0 R >> >> /Annots [ << /Subtype /Link /A << /URI (https://x.org) >> >> << /Subtype /Widget /T (name) /TU (Your name) /StructParent 4 >> ] >>",
4:stream(b"", CONTENT, True),
5:b"<< /Type /StructTreeRoot /K [6 0 R 7 0 R] /RoleMap << /Title /H1 >> /ParentTree << /Nums [0 [6 0 R 7 0 R]] >> >>",
6:b"<< /Type /StructElem /S /Title /P 5 0 R /Pg 3 0 R /K 0 >>",
7:b"<< /Type /StructElem /S /Figure /P 5 0 R /Pg 3 0 R /Alt (A bridge) /K [<< /Type /MCR /MCID 1 /Pg 3 0 R >>] /A << /O /Layout /BBox [0 0 10 10] /Placement /Block >> >>",
10:b"<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Arial /Encoding /WinAnsiEncoding /FontDescriptor << /FontFile2 99 0 R >> >>",
11:stream(b"/Subtype /Form /BBox [0 0 1 1]",b"0 0 1 1 re f"),12:stream(b"/Subtype /Image /Width 1 /Height 1",b"x"),
20:b"<< /First 21 0 R >>",21:b"<< /Title (One) /First << /Title (One.One) >> /Next << /Title <FEFF00540077006F> >> >>",
22:stream(b"",b"<x:xmpmeta><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>My title</rdf:li></rdf:Alt></dc:title><pdfuaid:part>1</pdfuaid:part></x:xmpmeta>")}


def test_reads_all_entities():
    r = pdf.rows_of(build(OBJECTS), 7, "a.pdf")
    doc = r["documents"][0]
    assert (doc["title"], doc["language"], doc["is_tagged"], doc["pdfua_part"], doc["bookmarks_count"], doc["stream_text_strings"]) == ("My title", "en-US", True, 1, 3, 4)
    assert [(n["tag"], n["standard_tag"], n["page"], n["text_content"], n["subtree_end"]) for n in r["nodes"]] == [("StructTreeRoot", "StructTreeRoot", None, "", 2), ("Title", "H1", 1, "Hello (x)", 1), ("Figure", "Figure", 1, "ab", 2)]
    assert (r["nodes"][2]["alt_text"], r["nodes"][2]["bbox_state"], r["nodes"][2]["attr_placement"]) == ("A bridge", "valid", "/Block")
    page = r["pages"][0]
    # The path painted outside all marks and the form that paints without marks are unmarked.
    assert (page["tagged_ops"], page["artifact_ops"], page["unmarked"], page["tab_order_mode"], page["width"]) == (2, 1, 2, "S", 612.0)
    assert [(m["mcid"], m["text"]) for m in r["page_mcids"]] == [(0, "Hello (x)"), (1, "ab")]
    assert [(a["text_snippet"], a["is_inside_tagged"]) for a in r["artifacts"]] == [("Page 3", False)]
    assert (r["fonts"][0]["name"], r["fonts"][0]["is_embedded"], r["fonts"][0]["is_used"]) == ("Arial", True, True)
    assert (r["images"][0]["image_id"], r["images"][0]["alt_text"]) == ("img_p1_12", "A bridge")
    assert (r["links"][0]["uri"], r["form_fields"][0]["tooltip"]) == ("https://x.org", "Your name")
    assert [(a["subtype"], a["is_tagged"]) for a in r["annotations"]] == [("Link", False), ("Widget", True)]
    assert [(e["idx"], e["target_obj"]) for e in r["parent_tree"]] == [(0, 6), (1, 7)]
    assert [(b["level"], b["title"], b["parent"]) for b in r["bookmarks"]] == [(1, "One", None), (2, "One.One", 0), (1, "Two", None)]


def test_object_streams_and_number_trees():
    packed = b"5 0 6 %d " % len(b"<< /Type /StructTreeRoot /K 6 0 R /ParentTree << /Kids [<< /Nums [0 [6 0 R]] >>] >> >> ")
    inner = packed + b"<< /Type /StructTreeRoot /K 6 0 R /ParentTree << /Kids [<< /Nums [0 [6 0 R]] >>] >> >> << /S /P /P 5 0 R >>"
    objects = {k: v for k, v in OBJECTS.items() if k not in (5, 6, 7)} | {30: stream(b"/Type /ObjStm /N 2 /First %d" % len(packed), inner, True)}
    r = pdf.rows_of(build(objects), 1, "a.pdf")
    # The entry's marked content, which the tree does not name, is filled in from the parent tree.
    assert [n["tag"] for n in r["nodes"]] == ["StructTreeRoot", "P"] and [(m["node_id"], m["mcid"], m["explicit_page"]) for m in r["node_mcids"]] == [("node_1", 0, 1)]
    assert r["nodes"][1]["text_content"] == "Hello (x)"


def test_box_states_and_roles():
    assert [pdf.bbox_state(x) for x in (None, [], [0, 0, 1, 1], [0, 0, 1], [0, 0, 1, True], [0, 0, 1, "1"], [0, 0, 1, float("inf")])] == ["none", "none", "valid", "invalid", "invalid", "invalid", "invalid"]
    chain = {f"A{i}": f"A{i + 1}" for i in range(200)} | {"A200": "P", "X": "Y", "Y": "X"}
    assert [pdf.resolved(t, chain) for t in ("A0", "X", "H1", "Odd")] == ["P", "Y", "H1", "Odd"]
    said = pdf.xmp("<dc:title>plain</dc:title> ISO 14289")
    assert (said["title"], said["part"]) == ("plain", 1)


def test_folder_scan(spark, tmp_path):
    (tmp_path / "good.PDF").write_bytes(build(OBJECTS))
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    (tmp_path / "locked.pdf").write_bytes(build(OBJECTS, b"/Encrypt 9 0 R "))
    (tmp_path / "deep.pdf").write_bytes(build(OBJECTS | {4: stream(b"", b"[" * 3000 + b"/P <</MCID 0>> BDC EMC EMC EMC")}))
    (tmp_path / "report.pdf").write_bytes(pdf_writer.report("Findings", [f"line {i} — ünïcode" for i in range(200)]))
    (tmp_path / "no.txt").write_bytes(b"x")
    corpus, errors = pdf.pdf_corpus(spark, f"file://{tmp_path}")
    assert {r.filename: r.kind for r in errors.collect()} == {"bad.pdf": "ValueError", "locked.pdf": "PermissionError"}
    pages = {r.filename: r.page_count for r in corpus.frames["documents"].collect()}
    assert pages == {"good.PDF": 1, "deep.pdf": 1, "report.pdf": 4}
    assert any("line 199 — ünïcode" in r.text for r in corpus.frames["pages"].collect())
    corpus.frames["findings"] = corpus.audited(f"file://{tmp_path}/f", rules=["PDFUA-META-001", "PDFUA-LANG-001"])
    from lectern.plans import report

    rows = {r.filename: r.status for r in corpus.sql(report.batch_summary()).collect()}
    assert rows == {"good.PDF": "Success", "deep.pdf": "Success", "report.pdf": "Success", "bad.pdf": "Error: not a PDF file", "locked.pdf": "Error: encrypted"}
