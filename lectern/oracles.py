"""Queries of another engine's own, written by hand: what the operators of plans.locate must give.

They share no text with those: pairs in place of indexes, recursion in place of windows, one statement
in place of steps.  Tables are entities over the base tables ($name)."""

from __future__ import annotations

BOX = "x0, y0, x1, y1"
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}+', ''), '{SPACES}+$', '')"


BLOCKS = f"""blocks AS MATERIALIZED (SELECT a.doc_id, a.page_number, a.block, a.text, a.x0, a.y0, a.x1, a.y1, (SELECT count(DISTINCT b.block) FROM $spans b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.block <> a.block AND b.ord < a.o) AS idx
  FROM (SELECT doc_id, page_number, block, min(ord) AS o, string_agg(text, ' ' ORDER BY ord) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM $spans GROUP BY ALL) a)"""

MARKS = f"""{BLOCKS},
marks AS MATERIALIZED (SELECT m.doc_id, m.page_number, m.mcid, m.text, coalesce(b.x0, 0.0) AS x0, coalesce(b.y0, 0.0) AS y0, coalesce(b.x1, 0.0) AS x1, coalesce(b.y1, 0.0) AS y1
  FROM (SELECT f.*, (SELECT count(DISTINCT g.mcid) FROM $page_mcids g WHERE g.doc_id = f.doc_id AND g.page_number = f.page_number AND g.ord < f.ord) AS idx FROM $page_mcids f) m
  LEFT JOIN blocks b ON b.doc_id = m.doc_id AND b.page_number = m.page_number AND b.idx = m.idx)"""

NODE_TEXTS = f"""{MARKS},
uses AS (SELECT n.doc_id, n.node_id, m.ord, m.mcid, CASE WHEN m.is_entry THEN CASE WHEN coalesce(m.explicit_page, 0) <> 0 THEN m.explicit_page ELSE n.page END ELSE n.page END AS page
  FROM $nodes n JOIN $node_mcids m ON m.doc_id = n.doc_id AND m.node_id = n.node_id WHERE m.is_entry OR NOT EXISTS (SELECT 1 FROM $node_mcids e WHERE e.doc_id = m.doc_id AND e.node_id = m.node_id AND e.is_entry)),
said AS (SELECT u.doc_id, u.node_id, string_agg(k.text, ' ' ORDER BY u.ord, u.mcid) FILTER (WHERE k.text <> '') AS text, min(k.x0) FILTER (WHERE k.x0 > 0 OR k.y0 > 0 OR k.x1 > 0 OR k.y1 > 0) AS x0, min(k.y0) FILTER (WHERE k.x0 > 0 OR k.y0 > 0 OR k.x1 > 0 OR k.y1 > 0) AS y0,
    max(k.x1) FILTER (WHERE k.x0 > 0 OR k.y0 > 0 OR k.x1 > 0 OR k.y1 > 0) AS x1, max(k.y1) FILTER (WHERE k.x0 > 0 OR k.y0 > 0 OR k.x1 > 0 OR k.y1 > 0) AS y1
  FROM uses u JOIN marks k ON k.doc_id = u.doc_id AND k.page_number = u.page AND k.mcid = u.mcid WHERE u.page <> 0 GROUP BY ALL),
node_texts AS MATERIALIZED (SELECT n.doc_id, n.node_id, CASE WHEN n.text_content IS NULL OR n.text_content = '' THEN coalesce(s.text, '') ELSE n.text_content END AS text, s.x0, s.y0, s.x1, s.y1 FROM $nodes n LEFT JOIN said s ON s.doc_id = n.doc_id AND s.node_id = n.node_id)"""

#: A span begins an island if its predecessor by rank ends 35 or more above it; it is of the last island begun.
ISLANDS = r"""math AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, ord) AS r FROM $spans
  WHERE regexp_matches(text, '[-=+±×÷√∫∑∏∂∆∇≈≠≤≥∞αβγδεθλμπσωΩ]') OR (regexp_matches(font, '(?i)math|symbol|italic|cambria') AND length(trim(text, ' ')) <= 4)),
begun AS (SELECT a.doc_id, a.page_number, a.r, row_number() OVER (PARTITION BY a.doc_id, a.page_number ORDER BY a.r) AS island FROM math a LEFT JOIN math b ON b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.r = a.r - 1 WHERE b.r IS NULL OR NOT a.y0 - b.y1 < 35),
islands AS MATERIALIZED (SELECT doc_id, page_number, island, min(x0) - 8 AS x0, min(y0) - 6 AS y0, max(x1) + 8 AS x1, max(y1) + 6 AS y1, count(*) AS n FROM (SELECT m.*, g.island FROM math m ASOF JOIN begun g ON g.doc_id = m.doc_id AND g.page_number = m.page_number AND g.r <= m.r) z GROUP BY doc_id, page_number, island)"""


def _closure(name: str, boxes: str, sums: tuple[str, ...] = ()) -> str:
    """All boxes of a page against all, round by round: a box goes to the least of those whose cluster its cluster touches, until a page rests."""
    kept = "".join(f", s.{c}" for c in sums)
    touch = "t.cx0 <= s.cx1 + 3 AND s.cx0 <= t.cx1 + 3 AND t.cy0 <= s.cy1 + 3 AND s.cy0 <= t.cy1 + 3"
    own = "OVER (PARTITION BY doc_id, page_number, lab)"
    return f"""{name}_state AS (
  SELECT 0 AS it, true AS moved, doc_id, page_number, id, id AS lab, x0, y0, x1, y1, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1{"".join(f", {c}" for c in sums)} FROM ({boxes}) b
  UNION ALL
  SELECT it, bool_or(lab <> old) OVER (PARTITION BY doc_id, page_number) AS moved, doc_id, page_number, id, lab, x0, y0, x1, y1, min(x0) {own}, min(y0) {own}, max(x1) {own}, max(y1) {own}{"".join(f", {c}" for c in sums)}
  FROM (SELECT s.it + 1 AS it, s.doc_id, s.page_number, s.id, s.lab AS old, min(t.lab) AS lab, s.x0, s.y0, s.x1, s.y1{kept} FROM {name}_state s JOIN {name}_state t ON t.doc_id = s.doc_id AND t.page_number = s.page_number AND {touch} WHERE s.moved GROUP BY ALL) n),
{name} AS MATERIALIZED (SELECT doc_id, page_number, lab, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n{"".join(f", sum({c}) AS {c}" for c in sums)} FROM (SELECT *, max(it) OVER (PARTITION BY doc_id, page_number) AS last FROM {name}_state) z WHERE it = last GROUP BY doc_id, page_number, lab)"""


CLUSTERS = _closure("touching", "SELECT row_number() OVER () AS id, doc_id, page_number, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM $drawings") + """,
clusters AS MATERIALIZED (SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY (x1 - x0) * (y1 - y0) DESC, y0, x0, x1, y1) AS INT) AS nth, x0, y0, x1, y1, n FROM touching WHERE x1 - x0 > 3 AND y1 - y0 > 3)"""

GRIDS = _closure("ruled", "SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT doc_id, page_number, x0, y0, x1, y1, CAST(y1 - y0 <= 2 AS INT) AS across, CAST(x1 - x0 <= 2 AS INT) AS down FROM $drawings WHERE (y1 - y0 <= 2 AND x1 - x0 >= 10) OR (x1 - x0 <= 2 AND y1 - y0 >= 10)) d", ("across", "down")) + """,
grids AS MATERIALIZED (SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, x1, y1) AS INT) AS nth, x0, y0, x1, y1, across, down FROM ruled WHERE across >= 2 AND down >= 2 AND across + down >= 5)"""

_B = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"
SIZES = "sizes AS MATERIALIZED (SELECT doc_id, page_number, CASE WHEN max(width) > 0 THEN max(width) ELSE 612.0 END AS width, CASE WHEN max(height) > 0 THEN max(height) ELSE 792.0 END AS height FROM $pages GROUP BY ALL)"


def _first(name: str, source: str, order: str) -> str:
    return f"f_{name} AS (SELECT doc_id, page_number, {_B} AS box FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY {order}) AS rn FROM {source}) z WHERE rn = 1)"


LOCATORS = ", ".join([
    SIZES, _first("island", "islands", "island"), _first("cluster", "clusters", "nth"), _first("image", "(SELECT * FROM $boxes WHERE kind = 'image')", "ord"), _first("grid", "grids", "nth"),
    _first("heading", "(SELECT * FROM $spans WHERE length(trim(text, ' ')) >= 2 AND size > 0)", "size DESC, ord"), _first("link", "(SELECT * FROM $boxes WHERE kind IN ('link', 'annotation'))", "kind DESC, ord"),
    _first("anything", "(SELECT * FROM blocks WHERE trim(text, ' ') <> '')", "idx"), _first("anchor", "(SELECT * FROM blocks WHERE trim(text, ' ') <> '' AND x1 - x0 > 20 AND y1 - y0 > 8)", "idx"),
    "locators AS MATERIALIZED (SELECT s.*, coalesce(i.box, c.box) AS formula, coalesce(m.box, c.box) AS figure, coalesce(g.box, c.box) AS grid, h.box AS heading, l.box AS link, a.box AS anything, n.box AS anchor FROM sizes s "
    + " ".join(f"LEFT JOIN f_{t} {a} ON {a}.doc_id = s.doc_id AND {a}.page_number = s.page_number" for t, a in (("island", "i"), ("cluster", "c"), ("image", "m"), ("grid", "g"), ("heading", "h"), ("link", "l"), ("anything", "a"), ("anchor", "n"))) + ")",
])


def _readable(depth: int = 5) -> str:
    """Readable texts from the lowest level of the tree up; trees of the projection are no deeper."""
    own = _strip("replace(coalesce(n.text_content, ''), chr(0), '')")
    actual = _strip("replace(coalesce(n.actual_text, ''), chr(0), '')")
    steps = [f"tree AS MATERIALIZED (SELECT n.doc_id, n.node_id, n.parent_id, n.pos, n.depth, upper(coalesce(n.standard_tag, '')) AS std, {own} AS own, {actual} AS actual FROM $nodes n)"]
    for k in range(depth, -1, -1):
        # A child's level may be any below its parent's.
        deeper = " UNION ALL ".join(f"SELECT * FROM said{j}" for j in range(k + 1, depth + 1))
        below = f"LEFT JOIN (SELECT doc_id, parent_id, list(said ORDER BY pos) AS parts FROM ({deeper}) b WHERE std NOT IN ('FIGURE', 'FORMULA', 'TABLE', 'NOTE') GROUP BY ALL) c ON c.doc_id = t.doc_id AND c.parent_id = t.node_id" if k < depth else ""
        parts = "list_filter(list_concat([t.own], coalesce(c.parts, [])), lambda x: x <> '')" if below else "list_filter([t.own], lambda x: x <> '')"
        steps.append(f"said{k} AS (SELECT doc_id, node_id, parent_id, pos, std, CASE WHEN actual <> '' THEN actual ELSE {_strip("coalesce(array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' '), '')")} END AS said FROM (SELECT t.*, {parts} AS parts FROM tree t {below} WHERE t.depth = {k}) p)")
    return ", ".join(steps) + ", readable AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, node_id, said FROM said{k}" for k in range(depth + 1)) + ")"


_FLIP = "CASE WHEN l.y0 < {h} AND l.y1 <= {h} THEN {{'x0': l.x0, 'y0': {top}, 'x1': l.x1, 'y1': {bottom}}} ELSE {{'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1}} END"
_VALID = "coalesce(abs({p}x1 - {p}x0) >= 3 AND abs({p}y1 - {p}y0) >= 3 AND {p}x0 < {w} AND {p}y0 < {h} AND {p}x1 > 0 AND {p}y1 > 0, false)"

#: Boxes climb from node to node as long as the next one above has none.
GEOMETRY = f"""{_readable()},
sized AS (SELECT n.doc_id, n.node_id, n.parent_id, CASE WHEN coalesce(n.page, 0) = 0 THEN 1 ELSE n.page END AS page_number, coalesce(s.width, 612.0) AS width, coalesce(s.height, 792.0) AS height, t.x0, t.y0, t.x1, t.y1 FROM $nodes n JOIN node_texts t ON t.doc_id = n.doc_id AND t.node_id = n.node_id LEFT JOIN sizes s ON s.doc_id = n.doc_id AND s.page_number = CASE WHEN coalesce(n.page, 0) = 0 THEN 1 ELSE n.page END),
layouts AS (SELECT * FROM $boxes WHERE kind = 'layout'),
drawn AS (SELECT z.doc_id, z.node_id, z.parent_id, z.page_number, CASE WHEN {_VALID.format(p='z.', w='z.width', h='z.height')} THEN 'own' WHEN l.x0 IS NOT NULL THEN 'layout' END AS source,
  CASE WHEN {_VALID.format(p='z.', w='z.width', h='z.height')} THEN {{'x0': z.x0, 'y0': z.y0, 'x1': z.x1, 'y1': z.y1}} WHEN l.x0 IS NOT NULL THEN {_FLIP.format(h='z.height', top='greatest(0.0, z.height - greatest(l.y0, l.y1))', bottom='least(z.height, z.height - least(l.y0, l.y1))')} END AS box
  FROM sized z LEFT JOIN layouts l ON l.doc_id = z.doc_id AND l.node_id = z.node_id),
looked AS (SELECT d.doc_id, d.node_id, min_by({{'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1}}, s.ord) AS box FROM drawn d JOIN readable r ON r.doc_id = d.doc_id AND r.node_id = d.node_id JOIN $spans s ON s.doc_id = d.doc_id AND s.page_number = d.page_number AND contains(lower(s.text), lower(r.said[:45])) WHERE d.source IS NULL AND length(r.said) >= 3 GROUP BY ALL),
based AS MATERIALIZED (SELECT d.doc_id, d.node_id, d.parent_id, coalesce(d.source, CASE WHEN k.box IS NOT NULL THEN 'text' END) AS source, coalesce(d.box, k.box) AS box FROM drawn d LEFT JOIN looked k ON k.doc_id = d.doc_id AND k.node_id = d.node_id),
climbs AS (SELECT doc_id, parent_id AS node_id, box FROM based WHERE box IS NOT NULL UNION ALL SELECT c.doc_id, b.parent_id, c.box FROM climbs c JOIN based b ON b.doc_id = c.doc_id AND b.node_id = c.node_id WHERE b.box IS NULL),
geometry AS MATERIALIZED (SELECT doc_id, node_id, source, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1 FROM based WHERE box IS NOT NULL
  UNION ALL SELECT b.doc_id, b.node_id, 'children', min(c.box.x0), min(c.box.y0), max(c.box.x1), max(c.box.y1) FROM based b JOIN climbs c ON c.doc_id = b.doc_id AND c.node_id = b.node_id WHERE b.box IS NULL GROUP BY b.doc_id, b.node_id)"""

#: A figure's candidates in order: descendants with a box, and leaves without one where the page has an image.
FIGURES = f"""images AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord) AS rn FROM $boxes WHERE kind = 'image') z WHERE rn = 1),
held AS MATERIALIZED (SELECT n.doc_id, n.node_id, n.pos, n.subtree_end, n.standard_tag, CASE WHEN coalesce(n.page, 0) = 0 THEN 1 ELSE n.page END AS page_number, NOT EXISTS (SELECT 1 FROM $nodes k WHERE k.doc_id = n.doc_id AND k.parent_id = n.node_id) AS leaf,
  t.x0 > 0 OR t.y0 > 0 OR t.x1 > 0 OR t.y1 > 0 AS owns, t.x0 AS ox0, t.y0 AS oy0, t.x1 AS ox1, t.y1 AS oy1, l.x0, l.y0, l.x1, l.y1 FROM $nodes n JOIN node_texts t ON t.doc_id = n.doc_id AND t.node_id = n.node_id LEFT JOIN $boxes l ON l.kind = 'layout' AND l.doc_id = n.doc_id AND l.node_id = n.node_id),
tries AS (SELECT f.doc_id, f.node_id, f.page_number, d.pos - f.pos AS nth, i.rn IS NOT NULL AS pictured, coalesce(p.height, 792.0) AS height, coalesce(d.owns, false) AS owns, d.x0 IS NOT NULL AS laid, d.leaf, d.ox0, d.oy0, d.ox1, d.oy1, d.x0 AS lx0, d.y0 AS ly0, d.x1 AS lx1, d.y1 AS ly1, i.x0 AS ix0, i.y0 AS iy0, i.x1 AS ix1, i.y1 AS iy1
  FROM held f JOIN held d ON d.doc_id = f.doc_id AND d.pos BETWEEN f.pos AND f.subtree_end LEFT JOIN images i ON i.doc_id = f.doc_id AND i.page_number = f.page_number LEFT JOIN (SELECT doc_id, page_number, max(height) AS height FROM $pages GROUP BY ALL) p ON p.doc_id = f.doc_id AND p.page_number = f.page_number WHERE upper(f.standard_tag) = 'FIGURE'),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY nth) AS rn FROM tries WHERE owns OR laid OR (pictured AND leaf)) z WHERE rn = 1),
figures AS (SELECT doc_id, node_id, page_number, CASE WHEN NOT owns AND NOT laid THEN 'image' WHEN nth > 0 THEN 'descendant' WHEN owns THEN 'own' ELSE 'layout' END AS source,
  CASE WHEN owns THEN ox0 WHEN laid THEN lx0 ELSE ix0 END AS x0, CASE WHEN owns THEN oy0 WHEN laid THEN CASE WHEN ly0 < height AND ly1 <= height THEN least(height - ly0, height - ly1) ELSE ly0 END ELSE iy0 END AS y0,
  CASE WHEN owns THEN ox1 WHEN laid THEN lx1 ELSE ix1 END AS x1, CASE WHEN owns THEN oy1 WHEN laid THEN CASE WHEN ly0 < height AND ly1 <= height THEN greatest(height - ly0, height - ly1) ELSE ly1 END ELSE iy1 END AS y1 FROM won)"""

_QUOTES = "list_concat(" + ", ".join(f"""list_concat(regexp_extract_all(coalesce({s}, ''), '["'']([^"'']{{3,60}})["'']', 1), [{_strip(f"regexp_extract(coalesce({s}, ''), 'Content:[ \\t\\n\\r\\f\\x0B]*[\"'']?([^\"''\\n\\r]{{3,60}})', 1)")}, {_strip(f"regexp_extract(coalesce({s}, ''), 'Text:[ \\t\\n\\r\\f\\x0B]*[\"'']?([^\"''\\n\\r]{{3,60}})', 1)")}])""" for s in ("evidence", "message", "object_reference")) + ")"
_CLEAN = _strip("replace(replace(t, concat(chr(92), 'n'), ' '), chr(92), '')")

#: Findings with a page, each once, and what they quote.
PLACES = """asked AS MATERIALIZED (SELECT DISTINCT doc_id, check_id, name, category, message, object_reference, evidence, page, x0, y0, x1, y1 FROM $findings WHERE page IS NOT NULL),
last_pages AS (SELECT doc_id, max(page_number) AS last FROM $pages GROUP BY doc_id),
places AS MATERIALIZED (SELECT row_number() OVER () AS fid, a.*, greatest(1, least(l.last, a.page)) AS page_number, l.last IS NOT NULL AS has_pages, coalesce(s.width, 612.0) AS width, coalesce(s.height, 792.0) AS height FROM asked a LEFT JOIN last_pages l ON l.doc_id = a.doc_id LEFT JOIN sizes s ON s.doc_id = a.doc_id AND s.page_number = greatest(1, least(l.last, a.page)))"""

QUOTED = f"""quotes AS (SELECT fid, doc_id, page_number, unnest(range(len(ts))) AS nth, unnest(ts) AS t FROM (SELECT p.*, {_QUOTES} AS ts FROM places p) q),
needles AS MATERIALIZED (SELECT fid, doc_id, page_number, nth, {_CLEAN}[:35] AS needle FROM quotes WHERE length({_CLEAN}) >= 3),
texts_of_pages AS (SELECT DISTINCT doc_id, page_number, needle FROM needles),
seen AS (SELECT t.doc_id, t.page_number, t.needle, min(s.x0) AS x0, min(s.y0) AS y0, max(s.x1) AS x1, max(s.y1) AS y1, count(*) AS n FROM texts_of_pages t JOIN $spans s ON s.doc_id = t.doc_id AND s.page_number = t.page_number AND contains(lower(s.text), lower(t.needle)) GROUP BY ALL),
told AS MATERIALIZED (SELECT * FROM (SELECT n.fid, n.nth, n.needle, s.x0, s.y0, s.x1, s.y1, s.n, row_number() OVER (PARTITION BY n.fid ORDER BY n.nth) AS rn FROM needles n JOIN seen s ON s.doc_id = n.doc_id AND s.page_number = n.page_number AND s.needle = n.needle) z WHERE rn = 1)"""

_HAS = lambda word, *cols: " OR ".join(f"contains(lower(coalesce({c}, '')), '{word}')" for c in cols)


def _located() -> str:
    """One statement: all stages of every finding side by side, the first that gives a box taken."""
    by_kind = [
        ("formula", _HAS("formula", "name", "category", "message", "object_reference"), "v.formula"),
        ("figure", f"{_HAS('figure', 'name', 'category')} OR {_HAS('image', 'name', 'category')}", "coalesce(i.box, v.figure)"),
        ("table", f"{_HAS('table', 'name', 'category', 'message')} OR {_HAS('th', 'object_reference')} OR {_HAS('td', 'object_reference')}", "v.grid"),
        ("heading", f"{_HAS('heading', 'name', 'category')} OR regexp_matches(lower(coalesce(object_reference, '')), '\\bh[1-6]\\b')", "v.heading"),
        ("unmarked", f"{_HAS('untagged', 'message')} OR {_HAS('unmarked', 'message')} OR {_HAS('content', 'category')}", "v.anything"),
        ("link", f"{_HAS('link', 'name', 'category')} OR {_HAS('annot', 'name')}", "v.link"),
    ]
    box = lambda a: "{" + ", ".join(f"'{x}': {a}.{x}" for x in ("x0", "y0", "x1", "y1")) + "}"
    steps = [("nowhere", "NOT has_pages", "{'x0': 72.0, 'y0': 72.0, 'x1': 500.0, 'y1': 180.0}"), ("explicit", _VALID.format(p="p.", w="p.width", h="p.height"), box("p")), ("node", "g.x0 IS NOT NULL", box("g")), ("text", "t.fid IS NOT NULL", box("t"))]
    steps += [(k, f"({cond}) AND {b} IS NOT NULL", b) for k, cond, b in by_kind] + [("anchor", "v.anchor IS NOT NULL", "v.anchor")]
    stage = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c, _ in steps) + " ELSE 'page' END"
    place = "CASE " + " ".join(f"WHEN {c} THEN {b}" for _, c, b in steps) + " ELSE {'x0': p.width * 1e-1, 'y0': p.height * 2e-1, 'x1': p.width * 9e-1, 'y1': p.height * 4e-1} END"
    n0 = lambda a, b, m: f"greatest(0.0, least({m} - 5.0, least({a}, {b})))"
    return f"""tags_of AS (SELECT DISTINCT n.doc_id, n.node_id, n.pos, u.tag, g.page FROM $nodes n, (SELECT unnest([0, 1]) AS w) x, LATERAL (SELECT CASE x.w WHEN 0 THEN upper(n.standard_tag) ELSE upper(n.tag) END AS tag) u, LATERAL (SELECT n.page AS page UNION ALL SELECT s.page FROM $node_pages s WHERE s.doc_id = n.doc_id AND s.node_id = n.node_id) g WHERE u.tag <> '' AND g.page IS NOT NULL),
tagged AS (SELECT doc_id, page, tag, arg_min(node_id, pos) AS node_id FROM tags_of GROUP BY ALL),
referred AS (SELECT p.fid, coalesce(n.node_id, t.node_id) AS node_id FROM (SELECT *, nullif(regexp_extract(object_reference, 'id=["'']?([a-zA-Z0-9_-]+)', 1), '') AS id, upper(regexp_extract(object_reference, '<([a-zA-Z0-9_-]+)', 1)) AS tag FROM places) p LEFT JOIN $nodes n ON n.doc_id = p.doc_id AND n.node_id = p.id LEFT JOIN tagged t ON t.doc_id = p.doc_id AND t.page = p.page_number AND t.tag = p.tag),
numbered AS (SELECT doc_id, page_number, {_B} AS box, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord) - 1 AS nth FROM $boxes WHERE kind = 'image'),
resolved AS (SELECT p.*, {stage} AS stage, {place} AS b FROM places p LEFT JOIN referred r ON r.fid = p.fid LEFT JOIN geometry g ON g.doc_id = p.doc_id AND g.node_id = r.node_id LEFT JOIN told t ON t.fid = p.fid LEFT JOIN locators v ON v.doc_id = p.doc_id AND v.page_number = p.page_number
  LEFT JOIN numbered i ON i.doc_id = p.doc_id AND i.page_number = p.page_number AND i.nth = try_cast(regexp_extract(lower(coalesce(p.object_reference, '')), 'image\\s*([0-9]+)', 1) AS BIGINT)),
fitted AS (SELECT *, {n0('b.x0', 'b.x1', 'width')} AS nx, {n0('b.y0', 'b.y1', 'height')} AS ny FROM resolved)
SELECT doc_id, check_id, name, category, message, object_reference, evidence, page, page_number, stage, CASE WHEN stage IN ('nowhere', 'page') THEN b.x0 ELSE nx END AS x0, CASE WHEN stage IN ('nowhere', 'page') THEN b.y0 ELSE ny END AS y0,
  CASE WHEN stage IN ('nowhere', 'page') THEN b.x1 ELSE greatest(nx + 5.0, least(width, greatest(b.x0, b.x1))) END AS x1, CASE WHEN stage IN ('nowhere', 'page') THEN b.y1 ELSE greatest(ny + 5.0, least(height, greatest(b.y0, b.y1))) END AS y1 FROM fitted"""


def texts() -> dict[str, str]:
    """name -> SQL over entities."""
    boxes = lambda k: f"{k}.x0 AS {k}_x0, {k}.y0 AS {k}_y0, {k}.x1 AS {k}_x1, {k}.y1 AS {k}_y1"
    kinds = ("formula", "figure", "grid", "heading", "link", "anything", "anchor")
    pages = ", ".join([BLOCKS, ISLANDS, CLUSTERS, GRIDS, LOCATORS])
    nodes = f"{NODE_TEXTS}, {SIZES}, {GEOMETRY}"
    whole = ", ".join([NODE_TEXTS, ISLANDS, CLUSTERS, GRIDS, LOCATORS, GEOMETRY, PLACES, QUOTED])
    return {
        "mark_boxes": f"WITH {MARKS} SELECT doc_id, page_number, mcid, text, {BOX} FROM marks",
        "node_texts": f"WITH {NODE_TEXTS} SELECT doc_id, node_id, text, {BOX} FROM node_texts",
        "formula_islands": f"WITH {ISLANDS} SELECT doc_id, page_number, CAST(island AS INT) AS island, {BOX}, n FROM islands",
        "drawing_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, page_number, nth, {BOX}, n FROM clusters",
        "ruled_tables": f"WITH RECURSIVE {GRIDS} SELECT doc_id, page_number, nth, {BOX}, CAST(across AS BIGINT) AS across, CAST(down AS BIGINT) AS down FROM grids",
        "page_locators": f"WITH RECURSIVE {pages} SELECT doc_id, page_number, width, height, {', '.join(boxes(k) for k in kinds)} FROM locators",
        "node_geometry": f"WITH RECURSIVE {nodes} SELECT doc_id, node_id, source, {BOX} FROM geometry",
        "figure_boxes": f"WITH {NODE_TEXTS}, {FIGURES} SELECT doc_id, node_id, page_number, source, {BOX} FROM figures",
        "text_evidence": f"WITH {SIZES}, {PLACES}, {QUOTED} SELECT p.doc_id, p.check_id, p.page, p.object_reference, p.evidence, p.message, t.needle, {', '.join(f't.{x}' for x in BOX.split(', '))}, t.n FROM places p JOIN told t ON t.fid = p.fid",
        "located_findings": f"WITH RECURSIVE {whole}, {_located()}",
    }


def _finding(ord_: int, check_id: str, name: str, standard: str, severity: str, branch: int, pos: str, status: str, items: str, page: str, ref: str, message: str, evidence: str, remediation: str, source: str) -> str:
    """A finding for each row of source, all of its columns spelled out."""
    null = "CAST(NULL AS DOUBLE)"
    return f"SELECT doc_id, {ord_} AS rule_ord, '{check_id}' AS check_id, '{name}' AS name, '{name}' AS category, '{standard}' AS standard, {branch} AS branch, CAST({pos} AS BIGINT) AS pos, '{status}' AS status, '{severity}' AS severity, CAST({items} AS BIGINT) AS items_count, CAST({page} AS INT) AS page, CAST({ref} AS VARCHAR) AS object_reference, CAST(1.0 AS DOUBLE) AS confidence, true AS machine_testable, false AS manual_review_required, '{message}' AS message, {evidence} AS evidence, CAST({remediation} AS VARCHAR) AS remediation, {null} AS x0, {null} AS y0, {null} AS x1, {null} AS y1 FROM {source}"


def _readable_documents() -> str:
    """The guideline on languages: one finding a document, one for each element that names a language."""
    words = lambda x: f"len(regexp_extract_all(coalesce({x}, ''), '[^\\s]+'))"
    units = f"""page_words AS (SELECT doc_id, sum({words('text')}) AS n FROM $pages GROUP BY doc_id), node_words AS (SELECT doc_id, sum({words('text_content')}) AS n FROM $nodes GROUP BY doc_id),
described AS (SELECT doc_id, count(*) AS n FROM $nodes WHERE doc_id IN (SELECT doc_id FROM $documents WHERE has_structure_tree) AND tag IS DISTINCT FROM 'StructTreeRoot' AND upper(standard_tag) IN ('FIGURE', 'FORMULA', 'FORM') AND (trim(coalesce(alt_text, '')) <> '' OR trim(coalesce(actual_text, '')) <> '') GROUP BY doc_id),
counted AS (SELECT d.doc_id, d.language IS NOT NULL AND d.language <> '' AS named, CASE WHEN d.stream_text_strings > 0 THEN d.stream_text_strings WHEN p.n > 0 THEN p.n WHEN w.n > 0 THEN w.n ELSE 0 END + coalesce(a.n, 0) + CASE WHEN d.language <> '' THEN 1 ELSE 0 END AS n
  FROM $documents d LEFT JOIN page_words p ON p.doc_id = d.doc_id LEFT JOIN node_words w ON w.doc_id = d.doc_id LEFT JOIN described a ON a.doc_id = d.doc_id),
speaking AS (SELECT n.doc_id, n.pos, n.page, concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref FROM $nodes n JOIN $documents d ON d.doc_id = n.doc_id AND d.has_structure_tree WHERE n.tag IS DISTINCT FROM 'StructTreeRoot' AND trim(coalesce(n.lang, '')) <> '')"""
    whole = ("WCAG-3.1", "3.1 Readable", "WCAG", "HIGH")
    items = "CASE WHEN n < 1 THEN 1 ELSE n END"
    out = [
        _finding(43, *whole, 1, "0", "FAIL", items, "NULL", "NULL", "The document names no language.", f"concat('Items: ', {items})", "'Set the language of the document and of its parts.'", "counted WHERE NOT named"),
        _finding(43, *whole, 1, "0", "PASS", items, "NULL", "NULL", "The document names its language.", f"concat('Items: ', {items})", "NULL", "counted WHERE named"),
        _finding(43, *whole, 2, "pos", "PASS", "1", "page", "ref", "An element names its language.", "CASE WHEN page IS NULL THEN ref ELSE concat(ref, ', page ', page) END", "NULL", "speaking"),
    ]
    return f"WITH {units} " + " UNION ALL ".join(out)


_BLANKS = "trim(replace(coalesce({}, ''), chr(0), ''))"


def _walk() -> str:
    """The tree walked from its root: a child is visited if its parent is and does not stop the reading; lists, items and tables indent what is below."""
    clean = _BLANKS.format
    return f"""{_readable()},
shown AS (SELECT d.doc_id FROM $documents d WHERE d.is_tagged AND d.has_structure_tree),
kids AS (SELECT doc_id, parent_id, count(*) AS n, bool_or(s IN ('FIGURE', 'FORMULA', 'TABLE', 'L', 'H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6')) AS nested, count(*) FILTER (WHERE s = 'LI') AS items, arg_min(node_id, pos) FILTER (WHERE s = 'LBL') AS label_id, arg_min(node_id, pos) FILTER (WHERE s = 'CAPTION') AS caption_id
  FROM (SELECT *, upper(coalesce(standard_tag, '')) AS s FROM $nodes) z WHERE parent_id IS NOT NULL GROUP BY ALL),
facts AS MATERIALIZED (SELECT n.doc_id, n.node_id, n.parent_id, n.pos, n.subtree_end, n.page, n.alt_text, n.title, n.text_content, upper(coalesce(n.standard_tag, '')) AS s, upper(coalesce(p.standard_tag, '')) AS above, r.said, coalesce(k.n, 0) AS kids, coalesce(k.nested, false) AS nested, coalesce(k.items, 0) AS items, k.label_id, k.caption_id,
    n.is_artifact OR upper(coalesce(n.standard_tag, '')) = 'ARTIFACT' OR lower(coalesce(n.tag, '')) = 'artifact' OR coalesce(n.attr_o = '/Artifact', false) OR coalesce(n.attr_type = '/Pagination', false) OR coalesce(n.attr_placement = '/Background', false) AS decorative
  FROM $nodes n JOIN shown USING (doc_id) JOIN readable r ON r.doc_id = n.doc_id AND r.node_id = n.node_id LEFT JOIN $nodes p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id LEFT JOIN kids k ON k.doc_id = n.doc_id AND k.parent_id = n.node_id),
kinds AS MATERIALIZED (SELECT *, CASE WHEN s IN ('H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6') THEN 'heading' WHEN s IN ('FIGURE', 'FORMULA', 'MATH') THEN 'graphic'
    WHEN s IN ('STRUCTTREEROOT', 'DOCUMENT', 'PART', 'ART', 'SECT', 'DIV', 'TOC', 'TOCI', 'INDEX', 'NONSTRUCT', 'PRIVATE') THEN 'pass' WHEN decorative THEN 'artifact' WHEN s IN ('TR', 'THEAD', 'TBODY', 'TFOOT') THEN 'pass'
    WHEN s = 'L' THEN 'list' WHEN s = 'LI' THEN 'list_item' WHEN s = 'LBODY' THEN 'body' WHEN s = 'TABLE' THEN 'table' WHEN s IN ('TH', 'TD') THEN 'cell' WHEN s IN ('P', 'BLOCKQUOTE', 'CAPTION', 'NOTE', 'SPAN') THEN 'block' WHEN s = 'LINK' THEN 'link' ELSE 'other' END AS does,
    (s = 'LBL' AND above = 'LI') OR (s = 'CAPTION' AND above = 'TABLE') AS taken FROM facts),
acts AS MATERIALIZED (SELECT *, NOT taken AND CASE WHEN does IN ('pass') THEN false WHEN does = 'body' THEN kids = 0 AND said <> '' WHEN does = 'block' THEN NOT nested AND said <> '' WHEN does = 'other' THEN kids = 0 AND {clean('text_content')} <> '' ELSE true END AS spoken,
    taken OR does IN ('heading', 'graphic', 'artifact', 'cell', 'link') OR (does = 'block' AND NOT nested AND said <> '') AS stops FROM kinds),
walked AS (SELECT a.*, 0 AS indent FROM acts a WHERE a.parent_id IS NULL
  UNION ALL SELECT a.*, w.indent + CASE WHEN w.does IN ('list', 'list_item', 'table') THEN 1 ELSE 0 END FROM walked w JOIN acts a ON a.doc_id = w.doc_id AND a.parent_id = w.node_id WHERE NOT w.stops),
told AS MATERIALIZED (SELECT w.*, l.said AS label, c.said AS caption FROM walked w LEFT JOIN readable l ON l.doc_id = w.doc_id AND l.node_id = w.label_id LEFT JOIN readable c ON c.doc_id = w.doc_id AND c.node_id = w.caption_id),
lines AS (SELECT doc_id, pos * 2 AS place, indent AS depth, page,
    CASE does WHEN 'heading' THEN concat('heading', CASE WHEN s <> 'H' THEN s[2:2] ELSE CAST(least(6, greatest(1, indent + 1)) AS VARCHAR) END) WHEN 'graphic' THEN concat(CASE s WHEN 'FIGURE' THEN 'figure' ELSE 'formula' END, CASE WHEN decorative THEN '_artifact' WHEN alt_text IS NULL THEN '_missing' WHEN {clean('alt_text')} = '' THEN '_empty' ELSE '' END)
      WHEN 'cell' THEN CASE s WHEN 'TH' THEN 'header_cell' ELSE 'cell' END WHEN 'block' THEN CASE s WHEN 'P' THEN 'paragraph' WHEN 'SPAN' THEN 'text' ELSE lower(s) END WHEN 'other' THEN 'text' ELSE does END AS kind,
    CASE WHEN NOT spoken THEN '' WHEN does = 'graphic' THEN {clean('alt_text')} WHEN does = 'artifact' THEN '' WHEN does = 'list' THEN CAST(items AS VARCHAR) WHEN does = 'list_item' THEN coalesce(label, '') WHEN does = 'table' THEN CASE WHEN coalesce(caption, '') <> '' THEN caption ELSE coalesce(title, '') END
      WHEN does = 'link' THEN CASE WHEN said <> '' THEN said WHEN coalesce(alt_text, '') <> '' THEN alt_text ELSE 'Link' END WHEN does = 'other' THEN {clean('text_content')} ELSE said END AS text
  FROM told WHERE spoken OR (s = 'P' AND does = 'block')),
rests AS (SELECT doc_id, pos * 2 + 1 AS place, indent + 1 AS depth, page, 'body' AS kind, CASE WHEN coalesce(label, '') <> '' AND starts_with(said, label) THEN trim(said[length(label) + 1:]) ELSE said END AS text FROM told t WHERE does = 'list_item' AND NOT EXISTS (SELECT 1 FROM told b WHERE b.doc_id = t.doc_id AND b.spoken AND b.pos > t.pos AND b.pos <= t.subtree_end)),
items AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS seq, CAST(depth AS INT) AS depth, kind, text, page FROM (SELECT * FROM lines UNION ALL SELECT * FROM rests WHERE text <> '') z
  UNION ALL SELECT doc_id, 1, 0, 'warning', 'The document is untagged or has no structure tree.', NULL FROM $documents WHERE NOT (is_tagged AND has_structure_tree))"""


def _transcript() -> str:
    said = "CASE WHEN starts_with(kind, 'heading') THEN concat('HEADING LEVEL ', kind[8:8], ': ', text) WHEN kind = 'list' THEN concat('LIST of ', text, ' items') WHEN kind = 'list_item' THEN rtrim(concat('LIST ITEM ', text)) WHEN kind LIKE 'f%!_missing' ESCAPE '!' THEN concat(upper(split_part(kind, '_', 1)), ' without a description') WHEN kind LIKE 'f%!_empty' ESCAPE '!' THEN concat(upper(split_part(kind, '_', 1)), ' with an empty description') WHEN kind LIKE '%artifact' THEN 'DECORATIVE' WHEN kind IN ('figure', 'formula', 'table', 'link') THEN concat(upper(kind), ': ', text) ELSE text END"
    tag = "CASE WHEN starts_with(kind, 'heading') THEN concat('h', kind[8:8]) ELSE 'p' END"
    escaped = "replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"SELECT doc_id, string_agg(concat(repeat('  ', depth), said), chr(10) ORDER BY seq) AS transcript, string_agg(concat('<', {tag}, ' class=''', kind, ''' style=''margin-left:', depth * 2, 'em''>', {escaped}, '</', {tag}, '>'), chr(10) ORDER BY seq) AS html FROM (SELECT *, {said} AS said FROM items) s WHERE said <> '' GROUP BY doc_id"


def by_hand() -> dict[str, str]:
    """Texts for queries of other modules."""
    count = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"
    figure = "SELECT doc_id, page, arg_min(alt, pos) AS alt FROM (SELECT doc_id, coalesce(page, 0) AS page, pos, CASE WHEN alt_text IS NOT NULL AND alt_text <> '' THEN alt_text ELSE coalesce(actual_text, '') END AS alt FROM $nodes WHERE upper(standard_tag) = 'FIGURE') f GROUP BY doc_id, page"
    return {
        "figure_alt_of_page": f"WITH figures AS MATERIALIZED ({figure}) SELECT i.doc_id, i.image_id, i.page, trim(CASE WHEN f.doc_id IS NOT NULL THEN f.alt ELSE z.alt END) AS alt_text, CASE WHEN f.doc_id IS NOT NULL THEN f.alt <> '' ELSE coalesce(z.alt <> '', false) END AS has_alt FROM $images i LEFT JOIN figures f ON f.doc_id = i.doc_id AND f.page = i.page LEFT JOIN figures z ON z.doc_id = i.doc_id AND z.page = 0",
        "rule_wcag_3_1": _readable_documents(),
        "reading_order": f"WITH RECURSIVE {_walk()} SELECT * FROM items",
        "reading_totals": f"WITH RECURSIVE {_walk()} SELECT doc_id, {count("starts_with(kind, 'heading')", 'headings')}, {count("starts_with(kind, 'f')", 'figures')}, {count("kind = 'list'", 'lists')}, {count("kind = 'table'", 'tables')}, {count("kind = 'paragraph'", 'paragraphs')} FROM items GROUP BY doc_id",
        "reading_transcript": f"WITH RECURSIVE {_walk()} {_transcript()}",
    }
