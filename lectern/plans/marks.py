"""Stacks as windows: marked content of pages, and the elements of HTML.

Depth is a running sum that ignores closes of nothing: s less its running minimum where that is
negative.  A close belongs to the last open of its level, so pairs are found without a stack."""

from __future__ import annotations

from lectern.functions.sql import Duck

_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def framed(ops: str, key: str, order: str) -> str:
    """ops (key, order, step: 1 open, -1 close, 0 other) with depth, level and, for closes, the position of the open they end."""
    run = f"OVER (PARTITION BY {key} ORDER BY {order} {_ROWS})"
    a = f"SELECT o.*, sum(step) {run} AS s FROM ({ops}) o"
    b = f"SELECT a.*, s - least(0, min(s) {run}) AS depth FROM ({a}) a"
    c = f"SELECT b.*, lag(depth, 1, 0) OVER (PARTITION BY {key} ORDER BY {order}) AS before FROM ({b}) b"
    d = f"SELECT c.*, CASE WHEN step = 1 THEN depth WHEN step = -1 AND before > 0 THEN before END AS level FROM ({c}) c"
    return f"SELECT d.*, CASE WHEN step = -1 AND level IS NOT NULL THEN max(CASE WHEN step = 1 THEN {order} END) OVER (PARTITION BY {key}, level ORDER BY {order} {_ROWS}) END AS opened FROM ({d}) d"


def marked_content(ops: str) -> str:
    """Content operators (doc_id, seq, op: tagged, artifact, close, text, paint) with where they stand.

    in_tagged and in_artifact: an open frame of that kind; innermost: the last open tagged frame around
    the operator, by the place where it was opened.  Tagged frames stand in levels of their own: one that
    is opened registers at its level, and every operator asks for the last one registered at the level
    that is open around it."""
    stepped = f"SELECT x.*, CASE WHEN op IN ('tagged', 'artifact') THEN 1 WHEN op = 'close' THEN -1 ELSE 0 END AS step FROM ({ops}) x"
    f = framed(stepped, "doc_id", "seq")
    kinds = f"SELECT f.*, o.op AS opened_op FROM ({f}) f LEFT JOIN ({ops}) o ON o.doc_id = f.doc_id AND o.seq = f.opened"
    run = f"OVER (PARTITION BY doc_id ORDER BY seq {_ROWS})"
    live = lambda k: f"sum(CASE WHEN op = '{k}' THEN 1 WHEN opened_op = '{k}' THEN -1 ELSE 0 END) {run} - CASE WHEN op = '{k}' THEN 1 ELSE 0 END > 0"
    tagged = f"sum(CASE WHEN op = 'tagged' THEN 1 WHEN opened_op = 'tagged' THEN -1 ELSE 0 END) {run} - CASE WHEN op = 'tagged' THEN 1 ELSE 0 END"
    placed = f"SELECT doc_id, seq, op, depth, opened, {live('tagged')} AS in_tagged, {live('artifact')} AS in_artifact, CAST({tagged} AS BIGINT) AS around FROM ({kinds}) k"
    asks = f"SELECT p.*, p.around AS level, 1 AS asks FROM ({placed}) p UNION ALL SELECT p.*, p.around + 1, 0 FROM ({placed}) p WHERE op = 'tagged'"
    last = f"max(CASE WHEN asks = 0 THEN seq END) OVER (PARTITION BY doc_id, level ORDER BY seq {_ROWS})"
    found = f"SELECT a.*, CASE WHEN around > 0 THEN {last} END AS innermost FROM ({asks}) a"
    return f"SELECT doc_id, seq, op, depth, opened, in_tagged, in_artifact, innermost FROM ({found}) f WHERE asks = 1"


def operation_counts(ops: str) -> str:
    """Tagged, artifact and unmarked drawing operators of each document, and artifacts inside tagged content."""
    m = marked_content(ops)
    draw = "op IN ('text', 'paint')"
    n = lambda c: f"CAST(count(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"SELECT doc_id, {n(f'{draw} AND in_tagged AND NOT in_artifact')} AS tagged_ops, {n(f'{draw} AND in_artifact')} AS artifact_ops, {n(f'{draw} AND NOT in_tagged AND NOT in_artifact')} AS unmarked, {n(chr(39).join(['op = ', 'artifact', ' AND in_tagged']))} AS artifacts_in_tagged FROM ({m}) m GROUP BY doc_id"


#: Tags that open no element, or only style the text they stand in.
NOISE = ("b", "br", "meta", "i", "hr", "link", "input", "span", "a", "img", "em", "strong")


def html_tokens(d) -> str:
    """Tags of pages in order: page_id, pos, name, is_close; scripts, styles, comments and inline tags left out."""
    clean = d.replaced("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    found = d.found(clean, r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>")
    toks = f"SELECT page_id, {found} AS toks FROM $pages WHERE html IS NOT NULL"
    each = f"SELECT t.page_id, CAST(k.n AS BIGINT) AS pos, {d.at('t.toks', 'k.n')} AS tok FROM (SELECT * FROM ({toks}) z WHERE {d.size('toks')} > 0) t, {d.numbers('1', d.size('t.toks'))} k"
    name = d.replaced("lower(tok)", r"^</?([a-z0-9]+)[^>]*>$", d.group(1))
    return f"SELECT page_id, pos, {name} AS name, tok LIKE '</%' AS is_close FROM ({each}) e"


def html_frames(d) -> str:
    """Elements of pages: page_id, open, stop, depth, name.  A paragraph that no end tag follows ends before the next block tag."""
    noise = "(" + ", ".join(f"'{x}'" for x in NOISE) + ")"
    base = f"SELECT page_id, pos * 2 AS pos, name, is_close FROM ({html_tokens(d)}) t WHERE name NOT IN {noise}"
    nxt = "OVER (PARTITION BY page_id ORDER BY pos)"
    ahead = f"SELECT b.*, lead(name) {nxt} AS next_name, lead(is_close) {nxt} AS next_close, lead(pos) {nxt} AS next_pos, lag(name) {nxt} AS last_name, lag(is_close) {nxt} AS last_close FROM ({base}) b"
    implied = f"SELECT page_id, next_pos - 1 AS pos, 'p' AS name, -1 AS step FROM ({ahead}) a WHERE name = 'p' AND NOT is_close AND next_pos IS NOT NULL AND NOT (next_name = 'p' AND next_close)"
    ops = f"SELECT page_id, pos, name, CASE WHEN is_close THEN -1 ELSE 1 END AS step FROM ({ahead}) a UNION ALL SELECT page_id, pos, name, step FROM ({implied}) i"
    f = framed(ops, "page_id", "pos")
    last = f"SELECT page_id, max(pos) AS stop FROM ({ops}) o GROUP BY page_id"
    ends = f"SELECT page_id, opened, min(pos) AS stop FROM ({f}) c WHERE opened IS NOT NULL GROUP BY page_id, opened"
    return f"SELECT o.page_id, o.pos AS opens, coalesce(e.stop, l.stop) AS stops, o.depth, o.name FROM ({f}) o LEFT JOIN ({ends}) e ON e.page_id = o.page_id AND e.opened = o.pos JOIN ({last}) l ON l.page_id = o.page_id WHERE o.step = 1"


def html_nodes(d) -> str:
    """Structure elements of pages: roles by tag, with the enclosing element (the open frame last begun).

    The oracle keeps its text, which looks for it by a list of depths and finds none below depth 16."""
    role = "CASE name WHEN 'ul' THEN 'L' WHEN 'ol' THEN 'L' WHEN 'li' THEN 'LI' WHEN 'p' THEN 'P' WHEN 'nav' THEN 'Sect' WHEN 'article' THEN 'Sect' WHEN 'section' THEN 'Sect' WHEN 'footer' THEN 'Sect' WHEN 'div' THEN 'Div' WHEN 'table' THEN 'Table' WHEN 'tr' THEN 'TR' WHEN 'th' THEN 'TH' WHEN 'td' THEN 'TD' WHEN 'h1' THEN 'H1' WHEN 'h2' THEN 'H2' WHEN 'h3' THEN 'H3' WHEN 'h4' THEN 'H4' WHEN 'h5' THEN 'H5' WHEN 'h6' THEN 'H6' ELSE 'NonStruct' END"
    f = html_frames(d)
    if not isinstance(d, Duck):
        # Each element stands in its own level, and asks in the level above for the last open before it.
        asks = f"SELECT x.*, x.depth - k.n AS level, CASE WHEN k.n = 0 THEN x.opens END AS here, k.n AS ask FROM ({f}) x, {d.numbers('0', '1')} k"
        run = f"SELECT a.*, max(here) OVER (PARTITION BY page_id, level ORDER BY opens {_ROWS}) AS parent FROM ({asks}) a"
        return f"SELECT page_id, opens, stops, depth, name, {role} AS role, parent FROM ({run}) r WHERE ask = 1"
    above = f"max(CASE WHEN depth = {{}} THEN opens END) OVER (PARTITION BY page_id ORDER BY opens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parents = " ".join(f"WHEN {k + 1} THEN {above.format(k)}" for k in range(1, 16))
    return f"SELECT page_id, opens, stops, depth, name, {role} AS role, CASE depth {parents} END AS parent FROM ({f}) x"
