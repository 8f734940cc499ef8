"""WCAG rules.  Guidelines without machine checks emit nothing but stay in the catalogue."""

from __future__ import annotations

from lectern.functions.sql import filled, truthy
from lectern.schema import CRITICAL, FAIL, HIGH, LOW, MANUAL, MEDIUM, PASS, WARNING

from .base import DOCS, NAMED, counted, rows
from .pdfua import text_units, untagged_total

TREE_NODES = "(SELECT n.*, t.is_tagged FROM $nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE NOT n.is_root)"


def text_alternatives(d) -> list[str]:
    graphics = f"(SELECT * FROM {TREE_NODES} n WHERE n.is_tagged AND n.std_up IN ('FIGURE', 'FORMULA') AND NOT n.is_artifact)"
    has = f"({filled(d, 's.alt_text')} OR {filled(d, 's.actual_text')})"
    images = "(SELECT i.* FROM $images i JOIN (SELECT t.doc_id FROM " + counted(DOCS, "SELECT * FROM $pages") + " t WHERE NOT (t.has_structure_tree AND t.is_tagged) AND (t.is_tagged OR t.n0 = 0)) o ON o.doc_id = i.doc_id WHERE NOT i.is_artifact)"
    tip = filled(d, "s.tooltip")
    field = "concat('FormField ''', s.name, '''')"
    out = []
    for status, yes in ((PASS, ""), (FAIL, "NOT ")):
        sev = HIGH if status == FAIL else None
        out.append(rows(graphics, status, "Text alternative of a graphic.", f"{yes}{has}", page="s.page", ref=NAMED, severity=sev, branch=1, pos="s.pos"))
        out.append(rows(images, status, "Text alternative of an image.", f"{yes}s.has_alt", page="s.page", ref="concat('Image ', s.image_id)", severity=sev, branch=2, pos="s.ord"))
        out.append(rows("$form_fields", status, "Alternate name of a form field.", f"{yes}{tip}", page="s.page", ref=field, branch=3, pos="s.ord"))
    return out


def nothing(d) -> list[str]:
    return []


def adaptable(d) -> list[str]:
    bare = untagged_total(d)
    live = "(SELECT doc_id FROM $documents WHERE is_tagged OR has_structure_tree)"
    pages = f"(SELECT p.*, coalesce(m.n, 0) AS mcids FROM $pages p JOIN {live} l ON l.doc_id = p.doc_id LEFT JOIN (SELECT doc_id, page_number, count(*) AS n FROM $page_mcids GROUP BY doc_id, page_number) m ON m.doc_id = p.doc_id AND m.page_number = p.page_number)"
    tables = f"(SELECT v.* FROM $table_view v JOIN {live} l ON l.doc_id = v.doc_id)"
    nodes = lambda cond: f"(SELECT * FROM {TREE_NODES} n WHERE {cond})"
    figure, items = nodes("n.std_up = 'FIGURE'"), f"(SELECT n.*, coalesce(b.n, 0) AS bad FROM {TREE_NODES} n LEFT JOIN (SELECT doc_id, parent_id, count(*) AS n FROM $nodes WHERE upper(coalesce(standard_tag, '')) NOT IN ('LBL', 'LBODY', 'CAPTION') GROUP BY doc_id, parent_id) b ON b.doc_id = n.doc_id AND b.parent_id = n.node_id WHERE n.std_up = 'LI')"
    page1, li = "coalesce(nullif(s.page, 0), 1)", "concat('<LI id=''', s.node_id, '''>')"
    return [
        rows(bare, PASS, "Reading order of an untagged document.", branch=1),
        rows(bare, FAIL, "The document is not tagged.", severity=CRITICAL, branch=2),
        rows(bare, FAIL, "Untagged content.", "s.total > 0", "s.total", severity=HIGH, branch=3),
        rows(pages, FAIL, "Unmarked content on the page.", "s.unmarked > 0", "s.unmarked", "s.page_number", severity=HIGH, branch=4, pos="s.page_number * 3"),
        rows(pages, PASS, "Marked content on the page.", "s.mcids > 0 OR s.tagged_ops > 0", "CASE WHEN s.mcids > 0 THEN s.mcids ELSE s.tagged_ops END", "s.page_number", branch=4, pos="s.page_number * 3 + 1"),
        rows(pages, PASS, "Reading order of the page.", "s.mcids > 0 OR s.has_structure", page="s.page_number", branch=4, pos="s.page_number * 3 + 2"),
        rows(tables, PASS, "The table has headers.", "s.has_headers", page="s.page", ref="concat('Table ', s.table_id)", branch=5, pos="s.pos"),
        rows(tables, FAIL, "The table has no headers.", "NOT s.has_headers", page="s.page", ref="concat('Table ', s.table_id)", branch=5, pos="s.pos"),
        rows(figure, PASS, "The figure has a bounding box.", "s.has_area OR s.has_explicit_bbox", page=page1, ref=NAMED, branch=6, pos="s.pos"),
        rows(figure, FAIL, "The figure has no bounding box.", "NOT (s.has_area OR s.has_explicit_bbox)", page=page1, ref=NAMED, severity=HIGH, branch=6, pos="s.pos"),
        rows(nodes("n.std_up IN ('H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6')"), PASS, "A heading.", page="s.page", ref=NAMED, branch=7, pos="s.pos"),
        rows(items, FAIL, "The list item holds what it must not.", "s.bad > 0", page=page1, ref=li, branch=8, pos="s.pos"),
        rows(items, PASS, "The list item is sound.", "s.bad = 0", page=page1, ref=li, branch=8, pos="s.pos"),
    ]


def distinguishable(d) -> list[str]:
    docs = counted(DOCS, "SELECT * FROM $fonts", f"SELECT * FROM $pages WHERE {filled(d, 'text')}")
    return [rows(docs, MANUAL, "A person must judge contrast.", "s.is_tagged OR s.n0 > 0 OR s.n1 > 0", manual=True)]


def navigable(d) -> list[str]:
    title = filled(d, "s.xmp_dc_title")
    live = "SELECT doc_id, page FROM $annotations WHERE coalesce(page, 0) <> 0 UNION SELECT doc_id, page FROM $links WHERE coalesce(page, 0) <> 0"
    bad = f"SELECT p.doc_id, p.page_number FROM $pages p JOIN ({live}) i ON i.doc_id = p.doc_id AND i.page = p.page_number WHERE coalesce(p.tab_order_mode, '') <> 'S'"
    out = []
    for branch, ok in ((1, "s.xmp_metadata_present"), (2, title), (3, "s.display_doc_title")):
        out += [rows("$documents", PASS, "Title and metadata help navigation.", ok, branch=branch), rows("$documents", FAIL, "Title or metadata are missing.", f"NOT {ok}", branch=branch)]
    out.append(rows(f"({bad})", FAIL, "The page's tab order does not follow the structure.", page="s.page_number", branch=4, pos="s.page_number"))
    out.append(rows(counted(DOCS, live, bad), PASS, "Tab order follows the structure.", "s.n0 > 0 AND s.n1 = 0", "s.n0", branch=4))
    return out


def readable(d) -> list[str]:
    alts = f"SELECT * FROM {TREE_NODES} n WHERE n.std_up IN ('FIGURE', 'FORMULA', 'FORM') AND ({filled(d, 'n.alt_text')} OR {filled(d, 'n.actual_text')})"
    docs = counted(f"SELECT * FROM {text_units(d)} u", alts)
    items = f"greatest(1, s.text_units + s.n0 + CASE WHEN {truthy('s.language')} THEN 1 ELSE 0 END)"
    return [
        rows(docs, FAIL, "The document names no language.", f"NOT {truthy('s.language')}", items, branch=1),
        rows(docs, PASS, "The document names its language.", truthy("s.language"), items, branch=1),
        rows(TREE_NODES, PASS, "An element names its language.", filled(d, "s.lang"), page="s.page", ref=NAMED, branch=2, pos="s.pos"),
    ]


def compatible(d) -> list[str]:
    docs = counted(DOCS, "SELECT * FROM $links", "SELECT * FROM $form_fields", "SELECT * FROM $annotations")
    barred = "(NOT t.is_tagged AND NOT t.has_structure_tree AND t.n0 + t.n1 + t.n2 > 0)"
    live = f"(SELECT t.* FROM {docs} t WHERE NOT {barred})"
    pages = f"(SELECT p.doc_id, p.page_number, p.width > 0 AND p.height > 0 AS sized FROM $pages p JOIN {live} l ON l.doc_id = p.doc_id)"
    tags = lambda cond: f"(SELECT r.doc_id, count(DISTINCT r.tag) AS n FROM $node_roles r JOIN {live} l ON l.doc_id = r.doc_id AND l.has_structure_tree WHERE {cond} GROUP BY r.doc_id)"
    odd = f"(SELECT r.doc_id, count(*) AS n FROM $role_map r JOIN {live} l ON l.doc_id = r.doc_id WHERE (instr(lower(r.custom_tag), 'artifact') > 0 OR instr(lower(r.custom_tag), 'inline') > 0) AND trim(replace(r.mapped_tag, '/', '')) IN ('Sect', 'Part', 'Document', 'Art') GROUP BY r.doc_id)"
    return [
        rows(pages, PASS, "The page's markup is sound.", "s.sized", page="s.page_number", branch=1, pos="s.page_number * 2"),
        rows(pages, PASS, "The page's resources are sound.", "s.sized", page="s.page_number", branch=1, pos="s.page_number * 2 + 1"),
        rows(pages, FAIL, "The page has no valid size.", "NOT s.sized", page="s.page_number", branch=1, pos="s.page_number * 2"),
        rows(live, PASS, "The document's markup is sound.", branch=2),
        rows(live, PASS, "The document's catalogue is sound.", branch=2, pos="1"),
        rows(f"(SELECT t.doc_id FROM {docs} t WHERE {barred})", FAIL, "Interactive elements of an untagged document have no role.", severity=HIGH, branch=3),
        rows(tags("r.is_circular"), FAIL, "Role mappings are circular.", items="s.n", severity=HIGH, branch=4),
        rows(tags("NOT r.is_circular AND NOT r.is_standard"), WARNING, "Tags map to no standard type.", items="s.n", severity=MEDIUM, branch=5),
        rows(odd, WARNING, "Role mappings are questionable.", items="s.n", severity=LOW, branch=6),
    ]


RULES = {"WCAG-1.1.1": text_alternatives, "WCAG-1.2": nothing, "WCAG-1.3": adaptable, "WCAG-1.4": distinguishable, **{f"WCAG-{g}": nothing for g in ("2.1", "2.2", "2.3")}, "WCAG-2.4": navigable, "WCAG-2.5": nothing, "WCAG-3.1": readable, "WCAG-3.2": nothing, "WCAG-3.3": nothing, "WCAG-4.1": compatible}
