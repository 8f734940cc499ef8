"""The rules on content, the structure tree and authoring quality on hand-built documents: what passes, what
fails, what is left of many after the cap, and what a rule's guard leaves out."""

from test_rules import PAGE, corpus, outcome


def capped(status, n, k=5):
    """n rows of which k are listed and the rest stands in one."""
    return [(status, 1)] * min(n, k) + ([(status, n - k)] if n > k else [])


def page(doc_id, number=1, **more):
    return {"doc_id": doc_id, "page_number": number, **PAGE, **more}


BARE = {"is_tagged": False, "has_structure_tree": False}


def test_tagged_pdf(spark):
    docs = {1: {"tree": ["P"]}, 2: BARE, 3: {**BARE}, 4: {"is_tagged": True, "has_structure_tree": False}, 5: BARE}
    c = corpus(spark, docs, pages=[page(2, text="words"), page(3, text="  "), page(5)], images=[{"doc_id": 5, "ord": 0, "image_id": "i"}])
    # An untagged document fails; its content is counted elsewhere, so the finding weighs only where there is none.
    assert outcome(c, "PDFUA-CONTENT-001") == {1: [("PASS", 1)], 2: [("FAIL", 0)], 3: [("FAIL", 1)], 4: [("FAIL", 1)], 5: [("FAIL", 0)]}


def test_content_tagged(spark):
    docs = {1: {"tree": ["P"]}, 2: {"tree": ["P"]}, 3: BARE, 4: {"tree": ["P"]}, 5: {"tree": ["P"]}}
    pages = [page(1, text="four"), page(2, text="0123456789", unmarked=3), page(2, 2, unmarked=0), page(3, text="one\ntwo\n")] + [page(4, n, unmarked=2, text="x" * 10) for n in range(1, 14)] + [page(5, tagged_ops=7)]
    c = corpus(spark, docs, pages=pages, images=[{"doc_id": 3, "ord": 0, "image_id": "i"}])
    got = outcome(c, "PDFUA-CONTENT-002")
    assert got[1] == [("PASS", 4)] and got[2] == [("FAIL", 3), ("PASS", 7)]
    # Untagged: an image and two lines. Thirteen pages: ten listed with what is unmarked, the rest in one; 130 characters less 26.
    assert got[3] == [("FAIL", 3)] and got[4] == [("FAIL", 2)] * 10 + [("FAIL", 6), ("PASS", 104)] and got[5] == [("PASS", 7)]


def test_content_inside_artifacts_and_nesting(spark):
    docs = {1: {"tree": ["P"]}, 2: {"tree": ["P"]}, 3: BARE, 4: {"tree": ["P"]}}
    pages = [page(1), page(2, 1, tagged_in_artifact=2), page(2, 2, tagged_in_artifact=1), page(3, 1, tagged_in_artifact=1)]
    nested = [{"doc_id": d, "page_number": p, "ord": o, "mcid": m, "is_inside_tagged": i, "is_unmarked": False} for d, p, o, m, i in [(1, 1, 0, 5, False), (1, 1, 1, None, True), (2, 1, 0, 5, True), (2, 1, 1, 6, True), (3, 1, 0, 5, True)] + [(4, p, 0, 1, True) for p in range(1, 10)]]
    c = corpus(spark, docs, pages=pages, occurrences=nested)
    got = outcome(c, "PDFUA-CONTENT-004")
    assert got[1] == got[4] == [("PASS", 1)] and got[2] == [("FAIL", 1)] * 2 and 3 not in got
    got = outcome(c, "PDFUA-CONTENT-007")
    # A page counts once; nine pages: five and one more finding for all the rest.
    assert got[1] == [("PASS", 1)] and got[2] == [("FAIL", 1)] and 3 not in got and got[4] == [("FAIL", 1)] * 6


def test_marked_content_exists(spark):
    docs = {1: {"tree": [("P", {"page": 1}), ("P", {"page": 1})]}, 2: {"tree": [("P", {"page": 1})]}, 3: {"has_structure_tree": False}, 4: {"tree": [("P", {"page": 2})]}}
    refs = [(1, "node_1", 0, 4, None), (1, "node_2", 0, 4, 2), (2, "node_1", 0, 9, None)] + [(4, "node_1", o, 50 + o, None) for o in range(13)]
    c = corpus(spark, docs, node_mcids=[{"doc_id": d, "node_id": n, "ord": o, "mcid": m, "explicit_page": p, "is_entry": True} for d, n, o, m, p in refs], page_mcids=[{"doc_id": 1, "page_number": 1, "ord": 0, "mcid": 4}, {"doc_id": 1, "page_number": 2, "ord": 0, "mcid": 4}, {"doc_id": 2, "page_number": 2, "ord": 0, "mcid": 9}])
    assert outcome(c, "PDFUA-CONTENT-006") == {1: [("PASS", 0)], 2: [("FAIL", 1)], 4: capped("FAIL", 13, 10)}


def test_tree(spark):
    odd = ("P", ("P", {"text_content": "x"}))
    docs = {
        1: {"tree": [("Sect", "H1", "H2", "P"), ("Sect", "H3")]}, 2: {"tree": []}, 3: {"is_tagged": False, "tree": [odd]}, 4: {"tree": [odd, ("P", {"tag": "", "standard_tag": ""}), ("Artifact", {})]}, 5: {"tree": ["H1"] + [("P", "Table")] * 8},
        6: {"tree": ["H2", "H4", "Sect", "Div"]},
    }
    c = corpus(spark, docs)
    got = outcome(c, "PDFUA-TREE-001")
    assert got[1] == [("PASS", 6)] and got[2] == [("FAIL", 1)] and 3 not in got
    # A paragraph in a paragraph; an element without a type and an artifact.
    assert got[4] == [("FAIL", 1)] * 2 + [("WARNING", 1), ("PASS", 1)]
    assert got[5] == capped("WARNING", 8) + [("PASS", 9)]
    # Two empty containers, the first heading is no H1, the second skips a level: all four elements are odd.
    assert got[6] == [("WARNING", 1)] * 4


def test_structure_elements(spark):
    table = ("Table", ("TR", "TH", "TD"))
    docs = {
        1: {"tree": [table, ("L", ("LI", "Lbl", "LBody")), "H1"]}, 2: {"tree": [("Table", "TH"), ("L", ("LI", "P")), ("Table", ("TR", "P"))]}, 3: {"has_structure_tree": False}, 4: {"tree": [("L", *[("LI", "Div")] * 9)]}, 5: {"tree": [("P", {"page": 0})]},
    }
    c = corpus(spark, docs, node_mcids=[{"doc_id": 5, "node_id": "node_1", "ord": 0, "mcid": 1, "is_entry": True}])
    got = outcome(c, "PDFUA-STRUCT-001")
    # Elements of weight pass (a table, a header cell, a heading); where there is none, all elements count.
    assert got[1] == [("PASS", 3)] and got[2] == [("FAIL", 1)] * 3 and 3 not in got
    # Nine divisions are all the elements of weight there, and as many faults.
    assert got[4] == capped("FAIL", 9) and got[5] == [("FAIL", 1)]


def test_empty_elements(spark):
    docs = {
        1: {"tree": [("P", {"text_content": "x"}), ("P", {"alt_text": "a"}), ("Span", {"actual_text": "b"}), ("H1", {"title": "t"}), ("P", "Span"), "Div"]}, 2: {"tree": [("P", {"text_content": " \n"}), "Link", "P"]}, 3: {"has_structure_tree": False}, 4: {"tree": ["H2"] * 12},
    }
    c = corpus(spark, docs, node_mcids=[{"doc_id": 2, "node_id": "node_3", "ord": 0, "mcid": 1, "is_entry": True}])
    got = outcome(c, "PDFUA-STRUCT-002")
    # The span inside the paragraph of document 1 is empty itself; marked content fills the third element of document 2.
    assert got == {1: [("FAIL", 1)], 2: [("FAIL", 1)] * 2, 4: capped("FAIL", 12)}
    assert outcome(corpus(spark, {1: {"tree": [("P", {"text_content": "x"})]}}), "PDFUA-STRUCT-002") == {1: [("PASS", 0)]}


def test_figure_boxes(spark):
    fig = lambda *kids, **k: ("Figure", {"page": 1, **k}, *kids)
    docs = {
        1: {"tree": [fig(), fig(bbox_state="valid")]}, 2: {"tree": [fig(bbox_state="invalid"), fig()]}, 3: {"tree": ["P"]}, 4: {"has_structure_tree": False}, 5: {"tree": [fig(bbox_state="invalid")] * 9},
        6: {"tree": [fig(bbox_state="valid")]}, 7: {"tree": [fig(("Span", {"page": 2, "bbox_state": "valid"}), bbox_state="valid")]},
    }
    c = corpus(spark, docs, node_pages=[{"doc_id": d, "node_id": "node_1", "page": p} for d in (6, 7) for p in (1, 2)])
    got = outcome(c, "PDFUA-FIG-001")
    # Two pages want a box on each.
    assert got == {1: [("PASS", 2)], 2: [("FAIL", 1), ("PASS", 1)], 5: capped("FAIL", 9), 6: [("FAIL", 1)], 7: [("PASS", 1)]}


def test_containers(spark):
    docs = {1: {"tree": [("Sect", "P"), "P"]}, 2: {"tree": ["Div", "BlockQuote"]}, 3: {"has_structure_tree": False}, 4: {"tree": ["Part"] * 6}, 5: {"tree": ["Art"]}}
    c = corpus(spark, docs, node_mcids=[{"doc_id": 5, "node_id": "node_1", "ord": 0, "mcid": 1, "is_entry": True}])
    # Three are listed, and nothing stands for the rest.
    assert outcome(c, "QUAL-STRUCT-001") == {1: [("PASS", 1)], 2: [("WARNING", 1)] * 2, 4: [("WARNING", 1)] * 3, 5: [("PASS", 1)]}


def test_link_labels(spark):
    said = {1: ["Annual report"], 2: ["Click here", " more... ", "https://example.org", "www.example.org", "Read on"], 4: ["here"] * 7}
    c = corpus(spark, {1: {}, 2: {}, 3: {}, 4: {}}, links=[{"doc_id": d, "ord": o, "page": 2, "text": t} for d, texts in said.items() for o, t in enumerate(texts)])
    # Addresses are one finding; of seven vague labels five are listed.
    assert outcome(c, "QUAL-LINK-001") == {1: [("PASS", 1)], 2: [("WARNING", 1)] * 3, 3: [("PASS", 1)], 4: [("WARNING", 1)] * 5}
    assert [r.evidence for r in c.rule("QUAL-LINK-001").where("doc_id = 2").orderBy("branch", "pos").collect()] == ['Text: "Click here"', 'Text: "more..."', 'Text: "https://example.org"']


def test_link_elements(spark):
    docs = {
        1: {"tree": [("Link", {"text_content": "x"}), ("Link", "Span")]}, 2: {"tree": ["Link", ("Link", {"text_content": " "}), ("Link", {"text_content": "x"})]}, 3: {"tree": [("Reference", "Link"), ("TOCI", "Link")]}, 4: {"has_structure_tree": False}, 5: {"tree": ["Link"] * 8},
    }
    assert outcome(corpus(spark, docs), "QUAL-LINK-002") == {1: [("PASS", 2)], 2: [("FAIL", 1)] * 2 + [("PASS", 1)], 5: capped("FAIL", 8)}


def test_page_bounds(spark):
    box = lambda d, p, o, x0, y0, x1, y1: {"doc_id": d, "page_number": p, "ord": o, "mcid": o, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}
    marks = [box(1, 1, 0, 50, 50, 200, 100), box(1, 1, 1, 600, 700, 900, 900), box(2, 1, 0, 50, 50, 200, 100), box(2, 1, 1, 700, 850, 800, 900), box(4, 1, 0, 700, 0, 700, 9), box(6, 1, 0, 700, 0, 800, 9)]
    marks += [box(5, 1, o, -9, 0, -1, 9) for o in range(8)]
    c = corpus(spark, {d: {} for d in range(1, 7)}, pages=[page(1), page(2), page(4), page(5), page(6, width=0.0)], page_mcids=marks)
    # Partly off the page, without an area, or on a page without a size is no fault; no pages, no finding.
    got = outcome(c, "QUAL-BOUND-001")
    assert got == {1: [("PASS", 0)], 2: [("WARNING", 1)], 4: [("PASS", 0)], 5: capped("WARNING", 8), 6: [("PASS", 0)]}
    assert [r.object_reference for r in c.rule("QUAL-BOUND-001").where("doc_id = 2").collect()] == ["MCID 1"]


def test_alternative_texts_of_text(spark):
    docs = {1: {"tree": [("P", {"text_content": "words"}), ("Figure", {"alt_text": "a"})]}, 2: {"tree": [("P", {"text_content": "words", "alt_text": "other"}), ("P", {"text_content": "x", "alt_text": "one sign"})]}, 3: {"tree": ["Figure"]}, 4: {"has_structure_tree": False}, 5: {"tree": [("H1", {"text_content": "words", "alt_text": "a"})] * 7}}
    assert outcome(corpus(spark, docs), "QUAL-TEXT-001") == {1: [("PASS", 0)], 2: [("WARNING", 1)], 5: capped("WARNING", 7)}


def test_validity_of_alternative_texts(spark):
    fig = lambda alt, **k: ("Figure", {"alt_text": alt, **k})
    docs = {
        1: {"tree": [fig("A red barn"), ("Figure", {"actual_text": "words"})]}, 2: {"tree": [fig(" "), fig("scan.PNG"), fig("Logo"), fig("!?"), fig("ok"), ("Figure", {})]}, 3: {"tree": ["P"]}, 4: {"tree": [fig("image")] * 8 + [fig("A view of the sea")]},
        5: {"tree": [fig("photo", is_artifact=True)]}, 6: {"has_structure_tree": False},
    }
    c = corpus(spark, docs, images=[{"doc_id": 6, "ord": 0, "image_id": "i", "is_artifact": False, "has_alt": True, "alt_text": "picture"}, {"doc_id": 6, "ord": 1, "image_id": "j", "is_artifact": True, "has_alt": True, "alt_text": "picture"}])
    got = outcome(c, "QUAL-ALT-001")
    assert got[1] == [("PASS", 2)] and got[2] == [("WARNING", 1)] * 4 + [("PASS", 1)] and got[4] == capped("WARNING", 8) + [("PASS", 1)] and 3 not in got and 5 not in got
    assert got[6] == [("WARNING", 1)]
    assert [r.severity for r in c.rule("QUAL-ALT-001").where("doc_id = 2 AND status = 'WARNING'").orderBy("pos").collect()] == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM"]


def test_body_text_as_artifact(spark):
    texts = {1: ["Page 1 of 5", "12", "x ∈ A for every one of them", "short words here", "1234 5678 9012 3456 7890"], 2: ["This body sentence was marked by mistake"], 4: ["This body sentence was marked by mistake"] * 7}
    c = corpus(spark, {d: {} for d in range(1, 5)}, artifacts=[{"doc_id": d, "page_number": 1, "ord": o, "is_inside_tagged": False, "text_snippet": t} for d, x in texts.items() for o, t in enumerate(x)])
    # Page numbers, formulas and what has few words are what artifacts are for; without any nothing is said.
    assert outcome(c, "QUAL-ART-001") == {2: [("WARNING", 1)], 4: capped("WARNING", 7)}


def test_titles(spark):
    docs = {1: {"title": "A study of bridges"}, 2: {"title": ""}, 3: {"title": "Untitled"}, 4: {"title": "A.PDF"}, 5: {"title": "a"}, 6: {"title": "A study", "display_doc_title": False}, 7: {"title": "", "xmp_dc_title": "A study"}, 8: {"title": " \t"}}
    got = outcome(corpus(spark, docs), "QUAL-TITLE-001")
    assert {d: s for d, [(s, _)] in got.items()} == {1: "PASS", 2: "FAIL", 3: "FAIL", 4: "FAIL", 5: "FAIL", 6: "FAIL", 7: "PASS", 8: "FAIL"}


def test_bookmarks_and_outline(spark):
    docs = {1: {"tree": ["H1"], "bookmarks_count": 2}, 2: {"tree": ["H1"]}, 3: {"tree": ["P"], "page_count": 11}, 4: {"has_structure_tree": False, "page_count": 10}, 5: {"tree": ["P"], "page_count": 99, "bookmarks_count": 1}}
    c = corpus(spark, docs)
    assert outcome(c, "QUAL-BOOKMARK-001") == {1: [("PASS", 1)], 2: [("WARNING", 1)]}
    assert outcome(c, "AI-OUTLINE-001") == {1: [("PASS", 1)], 2: [("PASS", 1)], 3: [("WARNING", 1)], 4: [("PASS", 1)], 5: [("PASS", 1)]}


def test_list_items(spark):
    docs = {1: {"tree": [("L", ("LI", "Lbl", "LBody"), ("LI", "Link"))]}, 2: {"tree": [("L", "LI", ("LI", "P"), ("LI", "LBody"))]}, 3: {"tree": ["P"]}, 4: {"has_structure_tree": False}, 5: {"tree": [("L", *["LI"] * 9)]}}
    assert outcome(corpus(spark, docs), "QUAL-LIST-001") == {1: [("PASS", 2)], 2: [("FAIL", 1)] * 2 + [("PASS", 1)], 5: capped("FAIL", 9)}


def test_what_alternative_texts_say(spark):
    fig = lambda alt: ("Figure", {"alt_text": alt})
    docs = {1: {"tree": [fig("A red barn at dusk"), fig(None), fig(" "), fig("Photosynthesis explained")]}, 2: {"tree": [fig("Image of a barn at dusk"), fig("red barn")]}, 3: {"tree": ["P"]}, 4: {"has_structure_tree": False}, 5: {"tree": [fig("Photo of it all today")] * 7}}
    # Five are listed, and nothing stands for the rest; no bad text at all is a pass, also without figures.
    assert outcome(corpus(spark, docs), "AI-ALT-001") == {1: [("PASS", 1)], 2: [("WARNING", 1)] * 2, 3: [("PASS", 1)], 4: [("PASS", 1)], 5: [("WARNING", 1)] * 5}


def test_readability(spark):
    hard = "Incomprehensibilities characterise institutionalisation notwithstanding organisational heterogeneity."
    c = corpus(spark, {1: {}, 2: {}, 3: {}, 4: {}}, pages=[page(1, text="The cat sat on the mat. It was warm."), page(2, text=hard), page(4, text="  "), page(1, 2, text="The dog ran.")])
    assert {d: [s for s, _ in x] for d, x in outcome(c, "AI-READ-001").items()} == {1: ["PASS"], 2: ["WARNING"], 3: ["PASS"], 4: ["PASS"]}
