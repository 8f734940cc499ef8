"""Elements of deeply nested pages against a stack."""

from lectern.functions.sql import Duck
from lectern.plans import marks
from lectern.queries import queries


def test_parents_at_any_depth(spark, tmp_path):
    depth = 40
    pages = {1: "<div>" * depth + "<ul><li>a</li><li>b</li></ul>" + "<ul></ul>" + "</div>" * depth, 2: "<div><ul><li>x</li></ul></div><div><p>y</p></div>"}
    spark.createDataFrame(list(pages.items()), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.opens): r for r in queries()["html_structure"](spark, str(tmp_path)).collect()}
    want = {}
    for page, html in pages.items():
        stack = []
        for k, tag in enumerate(t.split(">")[0] for t in html.split("<")[1:]):
            if tag.startswith("/"):
                stack.pop()
            else:
                want[page, 2 * (k + 1)] = (stack[-1] if stack else None, len(stack) + 1, tag)
                stack.append(2 * (k + 1))
    assert {k: (r.parent, r.depth, r.name) for k, r in got.items()} == want
    lists = {(r.page_id, r.opens): r.children for r in queries()["html_list_items"](spark, str(tmp_path)).collect()}
    assert lists == {k: sum(w[0] == k[1] and x == k[0] for (x, _), w in want.items()) for k, v in want.items() if v[2] == "ul"}


def test_oracle_text_is_kept():
    assert "WHEN 16 THEN max(CASE WHEN depth = 15" in marks.html_nodes(Duck())


def test_marked_content_against_a_stack(spark):
    """Where operators stand, and the innermost tagged frame around them; closes of nothing are ignored."""
    import random

    rng, rows, want = random.Random(1), [], {}
    for doc in range(6):
        stack = []
        for seq in range(200):
            op = rng.choice(["tagged", "tagged", "artifact", "close", "close", "close" if doc else "text", "text", "paint"])
            rows.append((doc, seq, op))
            if op == "close" and stack:
                closed = stack.pop()
            inside = [s for k, s in stack if k == "tagged"]
            want[doc, seq] = (bool(inside), any(k == "artifact" for k, _ in stack), inside[-1] if inside else None)
            if op in ("tagged", "artifact"):
                stack.append((op, seq))
    spark.createDataFrame(rows, "doc_id long, seq long, op string").createOrReplaceTempView("marked_ops")
    got = {(r.doc_id, r.seq): (r.in_tagged, r.in_artifact, r.innermost) for r in spark.sql(marks.marked_content("SELECT * FROM marked_ops")).collect()}
    assert got == want and closed
