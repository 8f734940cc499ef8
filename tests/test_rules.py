"""Rules on hand-built documents, each with the outcome its definition asks for."""

import os

import pytest
from pyspark.sql import types as T

from lectern.plans import report
from lectern.plans.audit import Corpus
from lectern.schema import ENTITIES, RULES

DOC = {"is_tagged": True, "has_structure_tree": True, "is_encrypted": False, "allows_extraction": True, "display_doc_title": True, "has_suspects": False, "xmp_metadata_present": True, "pdfua_identifier_present": True, "has_parent_tree": True, "parent_tree_valid": True, "bookmarks_count": 0, "page_count": 1, "filename": "a.pdf", "pdf_version": "1.7", "embedded_files_count": 0, "stream_text_strings": 0}
NODE = {"struct_bbox_valid": False, "has_area": False, "has_explicit_bbox": False, "has_pg_attr": False, "is_artifact": False, "text_content": "", "bbox_state": "none", "row_span": 1, "col_span": 1}


def corpus(spark, docs, **tables):
    """docs: doc_id -> overrides, or a nested tree (tag, {attributes}, children...) under "tree"."""
    rows = {name: [] for name in ENTITIES}
    for doc_id, spec in docs.items():
        rows["documents"].append({"doc_id": doc_id, **DOC, **{k: v for k, v in spec.items() if k != "tree"}})
        if "tree" in spec:
            count = [0]

            def walk(item, parent, depth, doc_id=doc_id, count=count):
                tag, *rest = (item,) if isinstance(item, str) else item
                attrs = rest.pop(0) if rest and isinstance(rest[0], dict) else {}
                pos = count[0]
                count[0] += 1
                name = "root" if parent is None else f"node_{pos}"
                row = {"doc_id": doc_id, "node_id": name, "parent_id": parent, "pos": pos, "depth": depth, "tag": tag, "standard_tag": tag, **NODE, **attrs}
                rows["nodes"].append(row)
                for child in rest:
                    walk(child, name, depth + 1)
                row["subtree_end"] = count[0] - 1

            walk(("StructTreeRoot", *spec["tree"]), None, 0)
    for name, extra in tables.items():
        rows[name] += extra
    frames = {}
    for name, schema in ENTITIES.items():
        st = T._parse_datatype_string(schema)
        frames[name] = spark.createDataFrame([tuple(r.get(f.name) for f in st) for r in rows[name]], st)
    return Corpus(spark, frames)


def outcome(c, check_id):
    got = {}
    for r in c.rule(check_id).orderBy("doc_id", "branch", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.status, r.items_count))
    return got


def test_headings(spark):
    c = corpus(spark, {1: {"tree": ["H1", "H2", "H3"]}, 2: {"tree": ["H2", "H3"]}, 3: {"tree": ["H1", "H3"]}, 4: {"tree": []}, 5: {"has_structure_tree": False}, 6: {"tree": ["H1", *["H3", "H1"] * 7]}})
    got = outcome(c, "QUAL-HEAD-001")
    assert got[1] == [("PASS", 1)] and got[2] == [("WARNING", 1)] and got[3] == [("WARNING", 1)] and got[4] == [("WARNING", 1)] and 5 not in got
    assert got[6] == [("WARNING", 1)] * 5 + [("WARNING", 2)]
    assert c.rule("QUAL-HEAD-001").where("doc_id = 4").first().confidence == 0.8


def test_fonts(spark):
    font = {"is_embedded": False, "is_used": True, "has_tounicode": True, "has_standard_encoding": False, "name": "F"}
    c = corpus(
        spark, {1: {}, 2: {}, 3: {}, 4: {}},
        fonts=[{"doc_id": 1, "ord": 0, **font}, {"doc_id": 2, "ord": 0, **font}, {"doc_id": 2, "ord": 1, **font}, {"doc_id": 2, "ord": 2, **font, "is_embedded": True}, {"doc_id": 3, "ord": 0, **font, "is_used": False}],
        font_pages=[{"doc_id": 1, "font_ord": 0, "idx": i, "page": i + 1} for i in range(4)] + [{"doc_id": 2, "font_ord": 0, "idx": i, "page": i + 1} for i in range(2)] + [{"doc_id": 2, "font_ord": 1, "idx": i, "page": i + 1} for i in range(3)],
    )
    got = outcome(c, "PDFUA-FONT-001")
    assert [s for s, _ in got[1]] == ["FAIL"] * 4 and sum(n for _, n in got[1]) == 1
    assert [s for s, _ in got[2]] == ["FAIL"] * 5 + ["PASS"] and got[2][-1] == ("PASS", 1)
    assert got[3] == [("PASS", 1)] and 4 not in got


def test_fonts_without_pages_and_mappings(spark):
    font = {"is_embedded": True, "is_used": True, "has_tounicode": False, "has_standard_encoding": False, "name": "F"}
    kinds = [{"has_tounicode": True}, {"encoding": "/WinAnsiEncoding"}, {"encoding": "MacRomanEncoding", "is_embedded": False}, {"encoding": "MacExpertEncoding"}, {"is_used": False}, {"has_standard_encoding": True}, {"encoding": "PDFDocEncoding"}]
    c = corpus(
        spark, {1: {}, 2: {}, 3: {}},
        fonts=[{"doc_id": 1, "ord": i, **font, **k} for i, k in enumerate(kinds)] + [{"doc_id": 2, "ord": 0, **font, "is_used": False}, {"doc_id": 3, "ord": 0, **font}],
        font_pages=[{"doc_id": 3, "font_ord": 0, "idx": i, "page": p} for i, p in enumerate((6, 8))],
    )
    # A font whose pages are not known counts for the first page.
    assert [(r.status, r.items_count, r.page) for r in c.rule("PDFUA-FONT-001").where("doc_id = 1").orderBy("branch", "pos").collect()] == [("FAIL", 1, 1), ("PASS", 6, None)]
    assert outcome(c, "PDFUA-FONT-002") == {1: [("WARNING", 1), ("PASS", 4)], 3: [("WARNING", 1)]}
    assert [r.page for r in c.rule("PDFUA-FONT-002").where("status = 'WARNING'").orderBy("doc_id").collect()] == [1, 6]


def test_alternative_text(spark):
    fig = lambda **k: ("Figure", k)
    c = corpus(
        spark, {
            1: {"tree": [fig(alt_text="A red barn at dusk"), fig(alt_text="", actual_text="described"), fig(page=3), fig(alt_text="IMG_1.png"), fig(alt_text=" Photo "), fig(alt_text="ab"), ("Formula", {"alt_text": " "})]},
            2: {"tree": ["P"]}, 3: {"is_tagged": False, "tree": [fig()]}, 4: {"tree": ["P"]}, 5: {"tree": ["P"]},
        },
        images=[{"doc_id": 4, "ord": i, "image_id": f"i{i}", "page": 1, "is_artifact": i == 0, "has_alt": i == 1, "structure_element_id": "n" if i == 2 else None} for i in range(10)] + [{"doc_id": 5, "ord": 0, "image_id": "z", "page": 1, "is_artifact": True, "has_alt": False}],
        links=[{"doc_id": 1, "ord": 0, "text": "t"}, {"doc_id": 1, "ord": 1, "uri": "u"}, {"doc_id": 1, "ord": 2, "text": ""}],
    )
    got = outcome(c, "PDFUA-ALT-001")
    assert got[1] == [("FAIL", 1)] * 2 + [("WARNING", 1)] * 3 + [("PASS", 4)] and got[2] == [("PASS", 1)] and 3 not in got
    assert got[4] == [("FAIL", 1)] * 5 and 5 not in got
    marks = c.rule("PDFUA-ALT-001").where("doc_id = 1 AND status = 'FAIL'").orderBy("pos").collect()
    assert [(r.page, r.object_reference.split(" ")[0]) for r in marks] == [(3, "<Figure"), (1, "<Formula")]


def test_guidelines(spark):
    c = corpus(
        spark, {
            1: {"xmp_dc_title": "T", "language": "en", "tree": [("Figure", {"alt_text": "a"}), ("Figure", {"actual_text": " ", "has_area": True, "page": 2}), ("Figure", {"is_artifact": True, "has_explicit_bbox": True}), "H2", ("L", ("LI", "LBody"), ("LI", "Span", "Lbl")), ("Table", ("TR", "TD")), ("P", {"lang": "fr", "text_content": "deux mots"})]},
            2: {"is_tagged": False, "has_structure_tree": False, "xmp_metadata_present": False, "display_doc_title": False},
            3: {"has_structure_tree": False}, 4: {"is_tagged": False, "has_structure_tree": False},
        },
        pages=[{"doc_id": 1, "page_number": n, **PAGE, "unmarked": n - 1, "has_structure": n == 1, "tab_order_mode": m} for n, m in ((1, "S"), (2, "W"), (3, "W"))] + [{"doc_id": 2, "page_number": 1, **PAGE, "text": "one\ntwo\n", "height": 0.0}],
        page_mcids=[{"doc_id": 1, "page_number": 1, "ord": i, "mcid": i} for i in range(4)],
        images=[{"doc_id": d, "ord": i, "image_id": f"i{i}", "page": 1, "is_artifact": i == 0, "has_alt": i == 1} for d in (1, 2, 3, 4) for i in range(3)],
        links=[{"doc_id": 1, "ord": 0, "page": 2}, {"doc_id": 2, "ord": 0, "page": 7}],
        form_fields=[{"doc_id": 1, "ord": 0, "name": "f", "tooltip": "t", "page": 1}, {"doc_id": 1, "ord": 1, "name": "g", "tooltip": "", "page": 1}],
    )
    tally = lambda check, d: sorted(outcome(c, check).get(d, []))
    # Graphics of a tagged tree count, else images where the document is tagged or has no pages.
    assert tally("WCAG-1.1.1", 1) == [("FAIL", 1), ("FAIL", 1), ("PASS", 1), ("PASS", 1)] and tally("WCAG-1.1.1", 2) == []
    assert tally("WCAG-1.1.1", 3) == tally("WCAG-1.1.1", 4) == [("FAIL", 1), ("PASS", 1)]
    # Page 1: marked content, order. Pages 2 and 3: unmarked. A table, three figures, a heading, two list items.
    assert tally("WCAG-1.3", 1) == sorted([("PASS", 4), ("PASS", 1), ("FAIL", 1), ("FAIL", 2), ("FAIL", 1), ("FAIL", 1), ("PASS", 1), ("PASS", 1), ("PASS", 1), ("PASS", 1), ("FAIL", 1)])
    assert tally("WCAG-1.3", 2) == [("FAIL", 1), ("FAIL", 5), ("PASS", 1)] and tally("WCAG-1.3", 3) == []
    assert tally("WCAG-1.4", 1) == tally("WCAG-1.4", 2) == [("MANUAL REVIEW", 1)] and tally("WCAG-1.4", 4) == []
    assert tally("WCAG-2.4", 1) == [("FAIL", 1), ("PASS", 1), ("PASS", 1), ("PASS", 1)] and tally("WCAG-2.4", 2) == [("FAIL", 1)] * 3 + [("PASS", 1)]
    # Two words, one graphic that is described, and the language itself.
    assert tally("WCAG-3.1", 1) == [("PASS", 1), ("PASS", 4)] and tally("WCAG-3.1", 2) == [("FAIL", 2)] and tally("WCAG-3.1", 4) == [("FAIL", 1)]
    assert tally("WCAG-4.1", 1) == [("PASS", 1)] * 8 and tally("WCAG-4.1", 2) == [("FAIL", 1)] and tally("WCAG-4.1", 4) == [("PASS", 1)] * 2


def test_list_and_table_counts(spark):
    good, bad = ("L", ("LI", "Lbl", "LBody")), ("L", ("LI", "Span"))
    c = corpus(spark, {1: {"tree": [good, ("L", ("LI", "LBody"), ("LI", "LBody"))]}, 2: {"tree": [bad] * 8}, 3: {"tree": [good, bad]}, 4: {"tree": [("Table", ("TR", "TH")), ("Table", ("TR", "TD"))]}, 5: {"has_structure_tree": False}})
    got = outcome(c, "PDFUA-LIST-001")
    assert got[1] == [("PASS", 3)] and got[2] == [("FAIL", 0)] * 6 and got[3] == [("FAIL", 0), ("PASS", 0)] and got[5] == [("PASS", 0)]
    got = outcome(c, "PDFUA-TABLE-001")
    assert got[4] == [("PASS", 1), ("FAIL", 1)] and got[1] == got[5] == [("PASS", 0)]


PAGE = {"width": 612.0, "height": 792.0, "text": "", "links_count": 0, "annotations_count": 0, "has_structure": True, "tab_order_mode": "S", "unmarked": 0, "tagged_ops": 0, "artifact_ops": 0, "tagged_in_artifact": 0}


def test_document_settings(spark):
    c = corpus(spark, {
        1: {"xmp_dc_title": "T", "language": "en-GB", "stream_text_strings": 7, "tree": ["P"], "bookmarks_count": 2, "embedded_files_count": 3},
        2: {"xmp_metadata_present": False, "xmp_dc_title": "T", "pdfua_identifier_present": False, "display_doc_title": False, "has_suspects": True, "has_structure_tree": False, "page_count": 21},
        3: {"xmp_dc_title": " \t", "language": "  ", "tree": [("Span", {"lang": "en"}), ("Span", {"lang": " en", "page": 4}), ("Span", {"lang": "english!"})], "page_count": 20},
        4: {"language": " fr ", "has_structure_tree": False}, 5: {"language": "x", "tree": []},
    }, pages=[{"doc_id": 4, "page_number": n, **PAGE, "text": "un deux"} for n in (1, 2)])
    one = lambda check, d: [s for s, _ in outcome(c, check)[d]]
    assert [one("PDFUA-META-001", d) for d in (1, 2)] == [["PASS"], ["FAIL"]]
    assert [one("PDFUA-META-002", d) for d in (1, 2, 3)] == [["PASS"], ["FAIL"], ["FAIL"]]
    assert [one("PDFUA-META-003", d) for d in (1, 2)] == [["PASS"], ["FAIL"]]
    assert one("PDFUA-SETTINGS-001", 1) == ["PASS", "PASS"] and one("PDFUA-SETTINGS-001", 2) == ["FAIL", "FAIL"]
    assert {d: x for d, x in outcome(c, "PDFUA-SETTINGS-003").items() if d < 4} == {1: [("PASS", 1)], 2: [("WARNING", 1)], 3: [("PASS", 0)]}
    assert outcome(c, "PDFUA-EMBEDDED-001")[1] == [("PASS", 3)] and outcome(c, "PDFUA-EMBEDDED-001")[2] == [("NOT APPLICABLE", 0)]
    # A language of white space is named but no tag; the words of pages count where no strings were read.
    assert outcome(c, "PDFUA-LANG-001") == {1: [("PASS", 7)], 2: [("FAIL", 1)], 3: [("WARNING", 1)], 4: [("PASS", 4)], 5: [("WARNING", 1)]}
    assert outcome(c, "PDFUA-LANG-002") == {1: [("PASS", 1)], 3: [("FAIL", 1), ("FAIL", 1)], 5: [("PASS", 1)]}
    assert [r.page for r in c.rule("PDFUA-LANG-002").where("doc_id = 3").orderBy("pos").collect()] == [4, 1]


def test_annotations_forms_artifacts(spark):
    note = {"is_tagged": False, "subtype": "Link", "page": 1}
    c = corpus(
        spark, {1: {"tree": ["P"]}, 2: {"tree": [("Artifact", {"page": 2}), *["artifact"] * 6]}, 3: {"is_tagged": False, "has_structure_tree": False}, 4: {}},
        pages=[{"doc_id": 1, "page_number": 1, **PAGE, "links_count": 1}, {"doc_id": 1, "page_number": 2, **PAGE, "tab_order_mode": "R"}, *({"doc_id": d, "page_number": n, **PAGE, "tab_order_mode": None} for d in (2, 3) for n in (1, 2))],
        annotations=[{"doc_id": d, "ord": i, "annot_id": f"a{i}", **note} for d in (2, 3) for i in range(7)] + [{"doc_id": 1, "ord": 0, "annot_id": "p", "subtype": "Popup", "is_tagged": False, "page": 1}],
        form_fields=[{"doc_id": 1, "ord": 0, "name": "UnnamedField", "tooltip": " "}, {"doc_id": 1, "ord": 1, "name": "n", "tooltip": None}, {"doc_id": 1, "ord": 2, "name": "n", "tooltip": "t"}],
        artifacts=[{"doc_id": 1, "page_number": 1, "ord": i, "is_inside_tagged": i == 0, "text_snippet": ""} for i in range(3)] + [{"doc_id": 2, "page_number": 1, "ord": 0, "is_inside_tagged": True}],
    )
    assert outcome(c, "PDFUA-ANNOT-001") == {1: [("PASS", 1)], 2: [("FAIL", 1)] * 5}
    assert outcome(c, "PDFUA-ANNOT-002") == {1: [("PASS", 1)], 2: [("FAIL", 1)], 3: [("FAIL", 1)]}
    # Missing tooltips come before missing names.
    got = c.rule("PDFUA-FORM-001").where("doc_id = 1").orderBy("branch", "pos").collect()
    assert [(r.status, r.object_reference, r.items_count) for r in got] == [("FAIL", "FormField 'UnnamedField'", 1), ("FAIL", "FormField 'n'", 1), ("FAIL", "FormField", 1), ("PASS", None, 1)]
    assert outcome(c, "PDFUA-FORM-001")[4] == [("PASS", 0)]
    assert outcome(c, "PDFUA-ARTIFACT-001") == {1: [("PASS", 1)], 2: [("FAIL", 1)] * 5, 4: [("PASS", 1)]}
    assert outcome(c, "PDFUA-ART-003") == {1: [("FAIL", 1), ("PASS", 2)], 2: [("FAIL", 1)], 3: [("PASS", 0)], 4: [("PASS", 0)]}


def test_characters(spark):
    icon, other, far = "\ue001", "\ue002", "\U000f0001"
    c = corpus(
        spark, {
            1: {"tree": [("P", {"text_content": f"a{icon}{far}", "page": 3}), ("P", {"actual_text": "x"}, ("Span", {"text_content": icon})), ("Formula", ("Span", {"text_content": icon})), ("Artifact", {"is_artifact": True, "text_content": icon})]},
            2: {"has_structure_tree": False}, 3: {"tree": [("P", {"text_content": icon})] * 7},
        },
        pages=[{"doc_id": 1, "page_number": 1, **PAGE, "text": icon}, {"doc_id": 2, "page_number": 1, **PAGE, "text": f"{icon}{icon}{other}{far}\ufffd"}, {"doc_id": 2, "page_number": 2, **PAGE, "text": f"{icon}"}, {"doc_id": 2, "page_number": 3, **PAGE, "text": f"{icon} \ufffd"}],
        artifacts=[{"doc_id": 2, "page_number": n, "ord": i, "is_inside_tagged": False, "text_snippet": s} for n, i, s in ((1, 0, f"top {icon}"), (1, 1, far), (2, 0, icon), (3, 0, ""))],
    )
    # Characters that an artifact of the page shows are its own, in documents without structure.
    assert outcome(c, "PDFUA-UNICODE-001") == {1: [("WARNING", 2)], 2: [("WARNING", 1), ("WARNING", 1)], 3: [("WARNING", 1)] * 5}
    assert [r.page for r in c.rule("PDFUA-UNICODE-001").where("doc_id < 3").orderBy("doc_id", "pos").collect()] == [3, 1, 3]
    assert outcome(c, "PDFUA-UNICODE-002") == {1: [("PASS", 0)], 2: [("FAIL", 2)], 3: [("PASS", 0)]}


def test_syntax(spark):
    c = corpus(
        spark, {1: {"tree": ["P"]}, 2: {"pdf_version": "x", "is_encrypted": True, "allows_extraction": False, "parent_tree_valid": False, "tree": [("", {}), "P"]}, 3: {"pdf_version": "2.6", "has_structure_tree": False}, 4: {"has_parent_tree": False, "tree": []}},
        pages=[{"doc_id": 1, "page_number": 1, **PAGE}, {"doc_id": 2, "page_number": 1, **PAGE, "width": 0.0}],
        form_xobjects=[{"doc_id": 1, "ord": 0, "is_valid": True}, *({"doc_id": 2, "ord": i, "is_valid": i > 1} for i in range(5))],
    )
    got = outcome(c, "PDFUA-SYNTAX-001")
    assert got[1] == [("PASS", 1)] * 4 + [("PASS", 2), ("PASS", 1), ("PASS", 1)]
    assert got[2] == [("FAIL", 1), ("FAIL", 1), ("FAIL", 1), ("FAIL", 1), ("PASS", 2), ("FAIL", 2), ("PASS", 3), ("FAIL", 1)]
    assert got[3] == [("FAIL", 1), ("PASS", 1)] and got[4] == [("PASS", 1), ("PASS", 1), ("PASS", 1), ("FAIL", 1)]


def test_lists_tables_toc_notes(spark):
    row = ("TR", "TD", "TD")
    c = corpus(spark, {
        1: {"tree": [("L", ("LI", "Lbl", "LBody"))]}, 2: {"tree": [("L", ("LI", "Span"))]}, 3: {"tree": ["P"]},
        4: {"tree": [("Table", row, row), ("Table", row, ("TR", "TD")), "Table"]}, 5: {"tree": [("Table", ("TR", ("TH", {"row_span": 2}), "TD"), ("TR", "TD"))]},
        6: {"tree": ["TOCI", ("TOCI", ("P", ("Link", {"attr_dest": "Chapter1"})))]}, 7: {"tree": [("P", "Note"), ("Note", "Lbl"), ("Reference", {"attr_ref": "node_3"})]},
    })
    assert outcome(c, "PDFUA-LIST-001")[1] == [("PASS", 1)] and outcome(c, "PDFUA-LIST-001")[2] == [("FAIL", 0)] and outcome(c, "PDFUA-LIST-001")[3] == [("PASS", 0)]
    tables = outcome(c, "QUAL-TABLE-001")
    assert tables[4] == [("WARNING", 1), ("WARNING", 1), ("PASS", 1)] and tables[5] == [("PASS", 1)] and 1 not in tables
    assert outcome(c, "PDFUA-TABLE-001")[5] == [("PASS", 1)]
    assert outcome(c, "QUAL-TOC-001")[6] == [("FAIL", 1), ("PASS", 1)] and outcome(c, "QUAL-TOC-002")[6] == [("WARNING", 1), ("PASS", 1)]
    assert outcome(c, "QUAL-NOTE-001")[7] == [("WARNING", 1), ("PASS", 1)] and outcome(c, "QUAL-NOTE-002")[7] == [("WARNING", 1), ("PASS", 1)] and outcome(c, "QUAL-NOTE-003")[7] == [("WARNING", 1), ("PASS", 1)]


def test_whitespace_suppression(spark):
    c = corpus(spark, {1: {"tree": [("P", {"text_content": "   \n\t  "})]}, 2: {"tree": [("P", {"text_content": "   "}, ("Span", {"text_content": " "}))]}, 3: {"tree": [("P", {"text_content": "Hello World"}, ("Span", {"text_content": " "}))]}})
    assert outcome(c, "QUAL-WHITE-001") == {1: [("WARNING", 1)], 2: [("WARNING", 1)], 3: [("PASS", 0)]}


def test_content_and_parent_tree(spark):
    page = {"width": 612.0, "height": 792.0, "text": "x", "links_count": 0, "annotations_count": 0, "has_structure": True, "tab_order_mode": "S", "unmarked": 0, "tagged_ops": 0, "artifact_ops": 0, "tagged_in_artifact": 0}
    c = corpus(
        spark, {1: {"tree": [("P", {"obj_num": 100, "page": 1})]}, 2: {"tree": ["P"]}},
        pages=[{"doc_id": d, "page_number": 1, "struct_parents_id": 0, **page} for d in (1, 2)],
        page_mcids=[{"doc_id": d, "page_number": 1, "ord": m, "mcid": m} for d in (1, 2) for m in (0, 1)],
        node_mcids=[{"doc_id": 1, "node_id": "node_1", "ord": 0, "mcid": 0, "is_entry": False}, *({"doc_id": 2, "node_id": "node_1", "ord": m, "mcid": m, "is_entry": False} for m in (0, 1))],
        parent_tree=[{"doc_id": 1, "sp_id": 0, "is_array": True, "idx": 0, "is_null": False, "target_obj": 200, "target_tag": "H1"}, {"doc_id": 1, "sp_id": 0, "is_array": True, "idx": 1, "is_null": False, "target_obj": 300, "target_tag": "Artifact"}],
    )
    assert outcome(c, "PDFUA-CONTENT-005") == {1: [("FAIL", 1)], 2: [("PASS", 0)]}
    tree = [s for s, _ in outcome(c, "PDFUA-TREE-002")[1]]
    assert tree == ["PASS", "PASS", "FAIL", "FAIL", "FAIL"]


def test_roles(spark):
    c = corpus(spark, {1: {"tree": ["MainTitle", "CircularA", "P", "Odd"]}}, role_map=[{"doc_id": 1, "custom_tag": a, "mapped_tag": b} for a, b in (("MainTitle", "H1"), ("CircularA", "CircularB"), ("CircularB", "CircularA"))])
    assert outcome(c, "PDFUA-ROLE-001")[1] == [("FAIL", 1), ("FAIL", 1), ("PASS", 2)]
    assert {r.tag: r.resolved for r in c.sql("SELECT * FROM $roles").collect()} == {"MainTitle": "H1", "CircularA": "CircularB", "CircularB": "CircularA"}


def test_score_and_comparison(spark):
    c = corpus(spark, {1: {}})
    one = ["PASS", "FAIL", "WARNING", "MANUAL REVIEW", "NOT APPLICABLE"]
    c.frames["findings"] = spark.createDataFrame([(1, s, 1) for s in one], "doc_id long, status string, items_count long")
    t = c.sql(report.totals()).first()
    assert (t.passed, t.failed, t.warned, t.manual, t.not_applicable, t.compliance_score) == (1, 1, 1, 1, 1, 33.3)
    side = "doc_id long, category string, check_name string, page int, status string, ord int"

    def compare(engine, oracle):
        c.frames["e"] = spark.createDataFrame([(1, "Fonts", "Font Embedding", p, s, i) for i, (p, s) in enumerate(engine)], side)
        c.frames["o"] = spark.createDataFrame([(1, "Fonts", "Font Embedding", p, s, i) for i, (p, s) in enumerate(oracle)], side)
        c._views.clear()
        return sorted((r.classification, r.page) for r in c.sql(report.comparison("SELECT * FROM $e", "SELECT * FROM $o")).collect())

    assert compare([(1, "FAIL"), (7, "FAIL")], [(1, "FAIL")]) == [("MATCH", 1), ("REFERENCE_ORACLE_OMISSION", 7)]
    assert compare([(3, "PASS")], [(None, "PASS")]) == [("MATCH", 3)]
    assert [k for k, _ in compare([(1, "PASS"), (2, "PASS"), (3, "PASS")], [(None, "PASS")] * 2)] == ["ENGINE_ONLY", "MATCH", "MATCH"]


def test_audit_isolates_errors(spark, tmp_path):
    c = corpus(spark, {1: {"tree": ["H1"]}, 2: {"tree": []}})

    def broken(corpus):
        return corpus.sql("SELECT no_such_column FROM $documents")

    found = c.audited(f"file://{tmp_path}/findings", rules=["QUAL-HEAD-001", "PDFUA-META-001"], custom={"OWN-1": broken})
    got = {(r.doc_id, r.check_id): r.status for r in found.collect()}
    assert got[1, "OWN-1"] == got[2, "OWN-1"] == "ERROR" and got[1, "QUAL-HEAD-001"] == "PASS" and len(got) == 6


def test_catalogue():
    assert len(RULES) == 67 and [r.ord for r in RULES.values()] == list(range(1, 68))


@pytest.mark.parametrize("name", ["table_regularity", "html_frames", "mark_stack_counts", "readability", "rule_qual_white_001", "category_matrix_pdfua"])
def test_against_second_engine(spark, name):
    import duckdb

    from lectern import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    names = sorted(got.columns)
    r = con.execute(queries.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(n) for n in names]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(x[n] for n in names) for x in got.collect()), key=key) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=key)


def test_queries_make_what_they_read(spark, tmp_path):
    """A query writes the tables that it reads and those they are made of, once, and no others."""
    from lectern.sources import load

    sf = tmp_path / "sf0.001"
    sf.symlink_to("/root/testdata/sf0.001")
    runs = __import__("__spark_entry__").queries()
    for name, want in (("metadata_sheet", {"documents"}), ("image_occurrences", {"documents", "lines", "images"}), ("ancestor_flags", {"documents", "lines", "images", "tree", "nodes", "node_mcids", "nf", "flags"})):
        assert runs[name](spark, str(sf)).count() > 0
        path, made = load._prepared(spark, str(sf))
        assert set(made) == want == {x for x in os.listdir(path.removeprefix("file://"))}


def test_a_matrix_evaluates_the_rules_of_its_standard(spark, tmp_path):
    """Other rules are left to the reports that read them, and the matrix is what it is over the findings of all."""
    from lectern.sources import load

    sf = tmp_path / "sf0.001"
    sf.symlink_to("/root/testdata/sf0.001")
    got = __import__("__spark_entry__").queries()["category_matrix_heuristics"](spark, str(sf)).collect()
    path, _ = load._prepared(spark, str(sf))
    assert load._AUDITED[path] == {c for c in RULES if RULES[c].standard == "AI"}
    more = load.prepared_corpus(spark, str(sf))
    more.frames["findings"] = more.audited(f"file://{tmp_path}/f", rules=[*load._AUDITED[path], "WCAG-1.3", "PDFUA-META-001"])
    assert sorted(got) == sorted(more.sql(report.matrix("AI")).collect()) and any(r.passed + r.warned + r.failed + r.manual for r in got)


def test_decoding_anomalies_make_no_features(spark, tmp_path):
    """Neither features nor the tree are written for the anomalies, whose flags are those of the table."""
    from lectern.sources import load

    sf = tmp_path / "sf0.001"
    sf.symlink_to("/root/testdata/sf0.001")
    runs = __import__("__spark_entry__").queries()
    got = {tuple(r) for r in runs["decoding_anomalies"](spark, str(sf)).collect()}
    path, made = load._prepared(spark, str(sf))
    assert set(made) == {"documents", "lines", "nodes"} == set(os.listdir(path.removeprefix("file://")))
    corpus = load.prepared_corpus(spark, str(sf))
    text = __import__("lectern.queries").queries._star()["decoding_anomalies"](corpus.dialect)
    assert got == {tuple(r) for r in corpus.sql(text).collect()}
    assert {x for _, _, x in got} == {True, False}
