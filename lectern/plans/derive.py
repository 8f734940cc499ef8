"""Tables derived from the entities, which many rules read: node features, tables, lists, roles."""

from __future__ import annotations

from lectern.functions.sql import Spark, one_of
from lectern.schema import STANDARD_TYPES

DECORATIVE = "(n.is_artifact OR upper(coalesce(n.standard_tag, '')) = 'ARTIFACT' OR lower(coalesce(n.tag, '')) = 'artifact' OR coalesce(n.attr_o, '') = '/Artifact' OR coalesce(n.attr_type, '') = '/Pagination' OR coalesce(n.attr_placement, '') = '/Background')"

ROLE_UP = "upper(coalesce(nullif(n.standard_tag, ''), n.tag, ''))"


def features() -> str:
    """Nodes of trees with their parent's tags and text, number of children and of marked content, and whether they are decorative."""
    return f"""SELECT n.*, p.tag AS parent_tag, p.standard_tag AS parent_std, p.text_content AS parent_text, p.actual_text AS parent_actual, p.alt_text AS parent_alt,
  upper(coalesce(n.standard_tag, '')) AS std_up, upper(coalesce(n.tag, '')) AS tag_up, {ROLE_UP} AS role_up,
  coalesce(nullif(n.standard_tag, ''), 'Span') AS role, n.tag = 'StructTreeRoot' AS is_root,
  coalesce(c.n_children, 0) AS n_children, coalesce(m.n_mcids, 0) AS n_mcids, {DECORATIVE} AS decorative
FROM $nodes n
LEFT JOIN $nodes p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id
LEFT JOIN (SELECT doc_id, parent_id, count(*) AS n_children FROM $nodes WHERE parent_id IS NOT NULL GROUP BY doc_id, parent_id) c ON c.doc_id = n.doc_id AND c.parent_id = n.node_id
LEFT JOIN (SELECT doc_id, node_id, count(*) AS n_mcids FROM $node_mcids GROUP BY doc_id, node_id) m ON m.doc_id = n.doc_id AND m.node_id = n.node_id"""


def headings() -> str:
    """Numbered headings with the level of the one before, in reading order."""
    return """SELECT doc_id, node_id, tag, pos, page, level, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS before
FROM (SELECT doc_id, node_id, tag, pos, page, try_cast(substr(standard_tag, 2, 1) AS INT) AS level FROM $nodes WHERE upper(standard_tag) IN ('H1', 'H2', 'H3', 'H4', 'H5', 'H6')) h"""


def table_view(d) -> str:
    """Tables: rows, columns, header and data cells over all descendants, and whether every row is as wide.

    A cell takes col_span columns in its own and the following row_span - 1 rows that exist.  Rows and
    cells of nested tables count for the outer ones too: a row asks at each level of tables open above
    it for the last table begun there, and numbers are differences of running counts."""
    numbers = d.numbers("c.r", "least(c.r + c.row_span - 1, t.n_rows)")
    run = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    count = lambda tag: f"count(CASE WHEN std = '{tag}' THEN 1 END) {run}"
    return f"""WITH n0 AS (SELECT doc_id, node_id, parent_id, tag, page, pos, subtree_end, row_span, col_span, upper(standard_tag) AS std FROM $nodes),
c0 AS (SELECT n0.*, {count("TR")} AS c_tr, {count("TH")} AS c_th, {count("TD")} AS c_td FROM n0),
t0 AS (SELECT a.doc_id, a.node_id, a.page, a.pos, a.subtree_end, a.c_tr AS tr_before, b.c_tr - a.c_tr AS n_rows, b.c_th - a.c_th AS n_th, b.c_td - a.c_td AS n_td FROM c0 a JOIN c0 b ON b.doc_id = a.doc_id AND b.pos = a.subtree_end WHERE a.std = 'TABLE'),
ends AS (SELECT doc_id, pos, 1 AS step FROM t0 UNION ALL SELECT doc_id, subtree_end + 1, -1 FROM t0),
steps AS (SELECT doc_id, pos, sum(step) AS step FROM ends GROUP BY doc_id, pos),
x0 AS (SELECT c.doc_id, c.node_id, c.pos, c.std, c.c_tr, coalesce(s.step, 0) AS step FROM c0 c LEFT JOIN steps s ON s.doc_id = c.doc_id AND s.pos = c.pos),
x1 AS (SELECT x0.*, CAST(sum(step) {run} AS BIGINT) AS level FROM x0),
asks AS (SELECT x.doc_id, x.node_id, x.pos, x.c_tr, x.std, k.n AS level FROM (SELECT * FROM x1 WHERE std IN ('TABLE', 'TR') AND level > 0) x, {d.numbers("CASE WHEN x.std = 'TABLE' THEN x.level ELSE CAST(1 AS BIGINT) END", "x.level")} k),
under AS (SELECT doc_id, node_id AS row_id, c_tr, std, max(CASE WHEN std = 'TABLE' THEN pos END) OVER (PARTITION BY doc_id, level ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS table_pos FROM asks),
tr AS (SELECT u.doc_id, t.node_id AS table_id, u.row_id, CAST(u.c_tr - t.tr_before AS BIGINT) AS r FROM under u JOIN t0 t ON t.doc_id = u.doc_id AND t.pos = u.table_pos WHERE u.std = 'TR'),
cell AS (SELECT tr.doc_id, tr.table_id, tr.r, greatest(coalesce(x.row_span, 1), 1) AS row_span, greatest(coalesce(x.col_span, 1), 1) AS col_span
  FROM tr JOIN n0 x ON x.doc_id = tr.doc_id AND x.parent_id = tr.row_id AND x.std IN ('TH', 'TD')),
covered AS (SELECT c.doc_id, c.table_id, k.n AS r, c.col_span FROM cell c JOIN t0 t ON t.doc_id = c.doc_id AND t.node_id = c.table_id, {numbers} k),
width AS (SELECT tr.doc_id, tr.table_id, tr.r, coalesce(sum(v.col_span), 0) AS w FROM tr LEFT JOIN covered v ON v.doc_id = tr.doc_id AND v.table_id = tr.table_id AND v.r = tr.r GROUP BY tr.doc_id, tr.table_id, tr.r),
shape AS (SELECT doc_id, table_id, max(w) AS n_cols, count(DISTINCT w) AS widths FROM width GROUP BY doc_id, table_id)
SELECT t.doc_id, t.node_id AS table_id, t.page, t.pos, t.n_rows, t.n_th, t.n_td, CAST(coalesce(s.n_cols, 0) AS BIGINT) AS n_cols, coalesce(s.widths, 0) <= 1 AS is_regular, t.n_th > 0 AS has_headers
FROM t0 t LEFT JOIN shape s ON s.doc_id = t.doc_id AND s.table_id = t.node_id"""


def list_view() -> str:
    """Lists: number of items, and whether children of lists and of items are of the kinds allowed."""
    return """SELECT l.doc_id, l.node_id AS list_id, l.page, l.pos, coalesce(c.n_items, 0) AS n_items, coalesce(c.n_children, 0) > 0 AND coalesce(c.bad, 0) = 0 AND coalesce(c.bad_items, 0) = 0 AS is_valid
FROM $nodes l LEFT JOIN (
  SELECT x.doc_id, x.parent_id, count(*) AS n_children, count(CASE WHEN upper(x.standard_tag) = 'LI' THEN 1 END) AS n_items, count(CASE WHEN upper(coalesce(x.standard_tag, '')) NOT IN ('LI', 'CAPTION') THEN 1 END) AS bad,
    count(CASE WHEN upper(x.standard_tag) = 'LI' AND (k.n IS NULL OR k.bad > 0) THEN 1 END) AS bad_items
  FROM $nodes x LEFT JOIN (SELECT doc_id, parent_id, count(*) AS n, count(CASE WHEN upper(coalesce(standard_tag, '')) NOT IN ('LBL', 'LBODY', 'CAPTION') THEN 1 END) AS bad FROM $nodes WHERE parent_id IS NOT NULL GROUP BY doc_id, parent_id) k
    ON k.doc_id = x.doc_id AND k.parent_id = x.node_id
  WHERE x.parent_id IS NOT NULL GROUP BY x.doc_id, x.parent_id) c ON c.doc_id = l.doc_id AND c.parent_id = l.node_id
WHERE upper(l.standard_tag) = 'L'"""


def roles(d) -> str:
    """What custom tags resolve to: doc_id, tag, resolved, is_circular, is_standard.

    A document's map is followed until a standard type, a tag it does not map, or as many links as it
    has entries, after which the chain must be a circle.  Spark folds over the map of the document;
    an ANSI engine walks it by recursion."""
    standard = one_of(STANDARD_TYPES)
    if isinstance(d, Spark):
        maps = "SELECT doc_id, map_from_entries(collect_list(struct(custom_tag, mapped_tag))) AS m FROM (SELECT doc_id, custom_tag, max(mapped_tag) AS mapped_tag FROM $role_map WHERE custom_tag IS NOT NULL GROUP BY doc_id, custom_tag) r GROUP BY doc_id"
        walked = f"SELECT doc_id, tag, first_tag, m, aggregate(sequence(1, size(m)), first_tag, (c, i) -> CASE WHEN c IN {standard} THEN c ELSE coalesce(m[c], c) END) AS cur FROM (SELECT doc_id, m, explode(m) AS (tag, first_tag) FROM ({maps}) a) b"
        ends = f"SELECT doc_id, tag, first_tag, cur, m[cur] IS NOT NULL AS goes_on FROM ({walked}) w"
        return f"SELECT {_OUTCOME.format(standard=standard)} FROM ({ends}) e"
    return f"""WITH RECURSIVE entries AS (SELECT doc_id, custom_tag, max(mapped_tag) AS mapped_tag FROM $role_map WHERE custom_tag IS NOT NULL GROUP BY doc_id, custom_tag),
sizes AS (SELECT doc_id, count(*) AS n FROM entries GROUP BY doc_id),
walk AS (SELECT doc_id, custom_tag AS tag, mapped_tag AS first_tag, mapped_tag AS cur, 0 AS k FROM entries
  UNION ALL SELECT w.doc_id, w.tag, w.first_tag, r.mapped_tag, w.k + 1 FROM walk w JOIN entries r ON r.doc_id = w.doc_id AND r.custom_tag = w.cur JOIN sizes s ON s.doc_id = w.doc_id WHERE w.cur NOT IN {standard} AND w.k < s.n),
ends AS (SELECT w.doc_id, w.tag, w.first_tag, w.cur, r.custom_tag IS NOT NULL AS goes_on FROM (SELECT w.*, row_number() OVER (PARTITION BY doc_id, tag ORDER BY k DESC) AS rn FROM walk w) w LEFT JOIN entries r ON r.doc_id = w.doc_id AND r.custom_tag = w.cur WHERE rn = 1)
SELECT {_OUTCOME.format(standard=standard)} FROM ends"""


_OUTCOME = "doc_id, tag, CASE WHEN tag IN {standard} THEN tag WHEN cur IN {standard} THEN cur WHEN goes_on THEN first_tag ELSE tag END AS resolved, tag NOT IN {standard} AND cur NOT IN {standard} AND goes_on AS is_circular, tag IN {standard} OR cur IN {standard} AS is_standard, tag NOT IN {standard} AS is_mapped"


def node_roles() -> str:
    """Nodes but the root with the outcome of their raw tag's role mapping."""
    standard = one_of(STANDARD_TYPES)
    return f"""SELECT n.doc_id, n.node_id, n.tag, n.pos, n.page, coalesce(r.is_circular, false) AS is_circular,
  CASE WHEN n.tag IN {standard} THEN true ELSE coalesce(r.is_standard, false) END AS is_standard
FROM $nodes n LEFT JOIN $roles r ON r.doc_id = n.doc_id AND r.tag = n.tag WHERE n.tag <> 'StructTreeRoot' OR n.tag IS NULL"""


#: Pre-order intervals nest, so a node has an ancestor of some kind exactly if the furthest end of those
#: begun so far reaches it: one running maximum a document instead of a join of intervals.
UP_TO = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: The same backwards: the first of what follows a node.
AFTER = "OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def inside(cond: str, window: str = BEFORE) -> str:
    """Whether a node has an ancestor (with UP_TO: or is a node) that meets cond."""
    return f"coalesce(max(CASE WHEN {cond} THEN subtree_end END) {window} >= pos, false)"


def flags(d) -> str:
    """For every node: whether it or an ancestor is a formula, has a replacement text, is decorative."""
    from lectern.functions.sql import filled

    return f"""SELECT doc_id, node_id, {inside("role_up IN ('FORMULA', 'MATH')", UP_TO)} AS in_formula,
  {inside(f"{filled(d, 'actual_text')} OR {filled(d, 'alt_text')}", UP_TO)} AS has_text, {inside("decorative", UP_TO)} AS in_artifact FROM $nf"""


def own_flags(d) -> str:
    """flags from nodes alone: no features are made, and three marks a node are dealt out in place of its texts."""
    from lectern.functions.sql import filled

    own = f"SELECT n.*, {ROLE_UP} AS role_up, {DECORATIVE} AS decorative FROM $nodes n"
    marks = f"SELECT doc_id, node_id, pos, subtree_end, role_up IN ('FORMULA', 'MATH') AS formula, {filled(d, 'actual_text')} OR {filled(d, 'alt_text')} AS texted, decorative FROM ({own}) o"
    return f"SELECT doc_id, node_id, {inside('formula', UP_TO)} AS in_formula, {inside('texted', UP_TO)} AS has_text, {inside('decorative', UP_TO)} AS in_artifact FROM ({marks}) m"


def mcid_refs() -> str:
    """Marked content that nodes name, with the page it is looked for on (0 counts as missing)."""
    return """SELECT m.doc_id, m.node_id, n.tag, n.pos, n.obj_num, m.ord, m.mcid, m.is_entry, coalesce(nullif(m.explicit_page, 0), n.page) AS page
FROM $node_mcids m JOIN $nodes n ON n.doc_id = m.doc_id AND n.node_id = m.node_id"""


def node_boxes() -> str:
    """Nodes with the union of their marks' boxes, as plans.locate gives it: the i-th mark of a page has the box of its i-th block of text."""
    blocks = "SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY first_ord) AS i, x0, y0, x1, y1 FROM (SELECT doc_id, page_number, block, min(ord) AS first_ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM $spans GROUP BY doc_id, page_number, block) b"
    marks = "SELECT doc_id, page_number, mcid, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord, mcid) AS i FROM (SELECT doc_id, page_number, mcid, min(ord) AS ord FROM $page_mcids GROUP BY doc_id, page_number, mcid) m"
    refs = "SELECT m.doc_id, m.node_id, m.mcid, m.is_entry, max(CASE WHEN m.is_entry THEN 1 ELSE 0 END) OVER (PARTITION BY m.doc_id, m.node_id) AS entries, nullif(m.explicit_page, 0) AS own_page, nullif(n.page, 0) AS node_page FROM $node_mcids m JOIN $nodes n ON n.doc_id = m.doc_id AND n.node_id = m.node_id"
    used = f"SELECT doc_id, node_id, mcid, CASE WHEN entries = 1 THEN coalesce(own_page, node_page) ELSE node_page END AS page FROM ({refs}) r WHERE is_entry OR entries = 0"
    return f"""SELECT u.doc_id, u.node_id, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1 FROM ({used}) u JOIN ({marks}) m ON m.doc_id = u.doc_id AND m.page_number = u.page AND m.mcid = u.mcid
JOIN ({blocks}) b ON b.doc_id = m.doc_id AND b.page_number = m.page_number AND b.i = m.i WHERE b.x0 > 0 OR b.y0 > 0 OR b.x1 > 0 OR b.y1 > 0 GROUP BY u.doc_id, u.node_id"""


def derived(d) -> dict[str, str]:
    return {"nf": features(), "headings": headings(), "table_view": table_view(d), "list_view": list_view(), "roles": roles(d), "node_roles": node_roles(), "flags": flags(d), "mcid_refs": mcid_refs(), "node_boxes": node_boxes()}
