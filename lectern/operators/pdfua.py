"""PDF/UA rules, one function each, in registry order."""

from __future__ import annotations

from lectern.functions.sql import SPACE, filled, one_of, strip, truthy
from lectern.schema import BCP47, BLOCK_PARENTS, CONTAINERS, CRITICAL, FAIL, FILE_NAME, HIGH, ILLUSTRATION_ROLES, INADMISSIBLE, INLINE_ROLES, LOW, MEDIUM, NOT_APPLICABLE, PASS, PLACEHOLDER, PRIVATE_USE, STANDARD_ENCODINGS, WARNING

from .base import DOCS, TAGGED_TREE, WITH_TREE, capped, counted, rows


def syntax(d) -> list[str]:
    number = d.number("s.pdf_version")
    ok = f"coalesce({number} BETWEEN 1.0 AND 2.5, false)"
    pages = "(SELECT *, width > 0 AND height > 0 AS sized FROM $pages)"
    blank = f"SELECT doc_id, node_id FROM $nodes WHERE NOT {filled(d, 'tag')}"
    nodes = counted(WITH_TREE, "SELECT * FROM $nodes", blank)
    forms = counted(DOCS, "SELECT * FROM $form_xobjects", "SELECT * FROM $form_xobjects WHERE NOT is_valid")
    return [
        rows("$documents", PASS, "The version is within the supported range.", ok, branch=1),
        rows("$documents", FAIL, "The version is malformed or out of range.", f"NOT {ok}", severity=HIGH, branch=1, evidence="concat('Version: ', coalesce(s.pdf_version, 'none'))"),
        rows("$documents", FAIL, "Encryption bars assistive technology from the text.", "s.is_encrypted AND NOT s.allows_extraction", severity=CRITICAL, branch=2),
        rows("$documents", PASS, "Security settings let assistive technology read.", "NOT (s.is_encrypted AND NOT s.allows_extraction)", branch=2),
        rows(pages, PASS, "The page's media box is valid.", "s.sized", page="s.page_number", branch=3, pos="s.page_number * 2"),
        rows(pages, PASS, "The page's contents are valid.", "s.sized", page="s.page_number", branch=3, pos="s.page_number * 2 + 1"),
        rows(pages, FAIL, "The page has no valid size.", "NOT s.sized", page="s.page_number", severity=HIGH, branch=3, pos="s.page_number * 2"),
        rows(nodes, FAIL, "Structure elements without a type.", "s.n1 > 0", "s.n1", severity=HIGH, branch=4),
        rows(nodes, PASS, "Structure elements have types.", "s.n0 > s.n1", "s.n0 - s.n1", branch=4, pos="1"),
        rows(forms, FAIL, "Form XObjects are malformed.", "s.n1 > 0", "s.n1", severity=HIGH, branch=5),
        rows(forms, PASS, "Form XObjects are well formed.", "s.n0 > s.n1", "s.n0 - s.n1", branch=5, pos="1"),
        rows("$documents", PASS, "The parent tree is present and valid.", "s.has_structure_tree AND s.has_parent_tree AND s.parent_tree_valid", branch=6),
        rows("$documents", FAIL, "The parent tree is empty or invalid.", "s.has_structure_tree AND s.has_parent_tree AND NOT s.parent_tree_valid", severity=HIGH, branch=6),
        rows("$documents", FAIL, "The structure tree has no parent tree.", "s.has_structure_tree AND NOT s.has_parent_tree", severity=HIGH, branch=6),
    ]


def font_embedding(d) -> list[str]:
    bad = "SELECT * FROM $fonts WHERE NOT is_embedded AND is_used"
    each = f"(SELECT f.*, coalesce(p.idx, 0) AS idx, coalesce(p.page, 1) AS page FROM ({bad}) f LEFT JOIN $font_pages p ON p.doc_id = f.doc_id AND p.font_ord = f.ord)"
    docs = counted("SELECT DISTINCT doc_id FROM $fonts", "SELECT * FROM $fonts", bad)
    return [
        rows(each, FAIL, "The font is not embedded.", items="CASE WHEN s.idx = 0 THEN 1 ELSE 0 END", page="s.page", ref="concat('Font ', s.name)", branch=1, pos="s.ord * 100000 + s.idx"),
        rows(docs, PASS, "Fonts are embedded.", "s.n0 > s.n1", "s.n0 - s.n1", branch=2),
    ]


def font_unicode(d) -> list[str]:
    used = f"(SELECT f.*, f.has_tounicode OR f.has_standard_encoding OR coalesce({d.replaced('f.encoding', '^/+|/+$', '')} IN {one_of(STANDARD_ENCODINGS)}, false) AS mapped, coalesce(p.page, 1) AS page FROM $fonts f LEFT JOIN $font_pages p ON p.doc_id = f.doc_id AND p.font_ord = f.ord AND p.idx = 0 WHERE f.is_used)"
    good = f"(SELECT doc_id, count(*) AS n FROM {used} u WHERE is_embedded AND mapped GROUP BY doc_id)"
    return [
        rows(used, WARNING, "The font has no mapping to Unicode.", "NOT s.mapped", page="s.page", ref="concat('Font ', s.name)", branch=1, pos="s.ord", evidence="concat('Encoding: ', coalesce(s.encoding, 'none'))"),
        rows(good, PASS, "Embedded fonts map to Unicode.", items="s.n", branch=2),
    ]


def private_use(d) -> list[str]:
    count = lambda x: d.size(d.found(f"coalesce({x}, '')", PRIVATE_USE))
    nodes = f"SELECT n.doc_id, n.pos, coalesce(nullif(n.page, 0), 1) AS page, concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref, {count('n.text_content')} AS cnt0 FROM $nodes n JOIN $flags f ON f.doc_id = n.doc_id AND f.node_id = n.node_id JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE {count('n.text_content')} > 0 AND NOT f.in_formula AND NOT f.has_text AND NOT f.in_artifact"
    # On pages without structure, characters that an artifact of the page shows are its own.
    shown = "(SELECT doc_id, page_number, string_agg(text_snippet, '') AS chars FROM $artifacts WHERE text_snippet <> '' GROUP BY doc_id, page_number)"
    bare = f"(SELECT p.doc_id, p.page_number, CASE WHEN a.chars IS NULL THEN p.text ELSE translate(p.text, a.chars, '') END AS text FROM $pages p JOIN $documents t ON t.doc_id = p.doc_id AND NOT t.has_structure_tree LEFT JOIN {shown} a ON a.doc_id = p.doc_id AND a.page_number = p.page_number WHERE {count('p.text')} > 0)"
    pages = f"SELECT p.doc_id, p.page_number AS pos, p.page_number AS page, concat('Page ', CAST(p.page_number AS STRING)) AS ref, {count('p.text')} AS cnt0 FROM {bare} p WHERE {count('p.text')} > 0"
    found = f"{nodes} UNION ALL {pages}"
    return [*capped(found, WARNING, "Private-use characters without a replacement text.", 5, None, 1, HIGH, items="s.cnt0"), rows(counted(DOCS, found), PASS, "No private-use characters lack a replacement text.", "s.n0 = 0", "0", branch=2)]


def replacement_characters(d) -> list[str]:
    found = "(SELECT doc_id, count(*) AS n, min(page_number) AS page FROM $pages WHERE instr(text, '�') > 0 GROUP BY doc_id)"
    docs = f"(SELECT t.doc_id FROM $documents t LEFT JOIN {found} f ON f.doc_id = t.doc_id WHERE f.doc_id IS NULL)"
    return [rows(found, FAIL, "Pages hold replacement characters.", items="s.n", page="s.page", severity=HIGH, branch=1), rows(docs, PASS, "No page holds replacement characters.", items="0", branch=2)]


def tagged_pdf(d) -> list[str]:
    content = "(SELECT t.doc_id, t.is_tagged AND t.has_structure_tree AS ok, t.n0 + t.n1 + t.n2 > 0 AS any_content FROM " + counted(DOCS, f"SELECT * FROM $pages WHERE {filled(d, 'text')}", "SELECT * FROM $images", "SELECT * FROM $page_mcids") + " t)"
    return [rows(content, PASS, "The document is tagged.", "s.ok"), rows(content, FAIL, "The document is not tagged.", "NOT s.ok", "CASE WHEN s.any_content THEN 0 ELSE 1 END", severity=CRITICAL)]


LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def untagged_total(d) -> str:
    """Untagged documents with their images and lines of text."""
    lines = f"{d.size(d.found('p.text', LINES))} + CASE WHEN {d.matches('p.text', f'({LINES})$')} THEN 0 ELSE 1 END"
    return f"(SELECT t.doc_id, coalesce(i.n, 0) + coalesce(p.n, 0) AS total FROM $documents t LEFT JOIN (SELECT doc_id, count(*) AS n FROM $images GROUP BY doc_id) i ON i.doc_id = t.doc_id LEFT JOIN (SELECT p.doc_id, sum({lines}) AS n FROM $pages p WHERE {filled(d, 'p.text')} GROUP BY p.doc_id) p ON p.doc_id = t.doc_id WHERE NOT t.is_tagged AND NOT t.has_structure_tree)"


def content_tagged(d) -> list[str]:
    sums = "SELECT doc_id, sum(length(coalesce(text, ''))) AS chars, sum(unmarked) AS unmarked, sum(tagged_ops) AS tagged FROM $pages GROUP BY doc_id"
    docs = counted("SELECT * FROM $documents WHERE is_tagged OR has_structure_tree", "SELECT * FROM $page_mcids", "SELECT * FROM $images", "SELECT * FROM $links")
    unmarked = "SELECT p.doc_id, p.page_number AS pos, p.page_number AS page, concat('Untagged Content on Page ', CAST(p.page_number AS STRING)) AS ref, CASE WHEN p.unmarked > 0 THEN p.unmarked ELSE 1 END AS cnt0, p.unmarked FROM $pages p JOIN $documents t ON t.doc_id = p.doc_id AND (t.is_tagged OR t.has_structure_tree) LEFT JOIN (SELECT DISTINCT doc_id, page_number FROM $occurrences WHERE is_unmarked) o ON o.doc_id = p.doc_id AND o.page_number = p.page_number WHERE p.unmarked > 0 OR o.doc_id IS NOT NULL"
    base = f"(SELECT t.doc_id, CASE WHEN coalesce(q.chars, 0) + t.n0 + t.n1 + t.n2 = 0 THEN coalesce(q.tagged, 0) + t.n1 ELSE coalesce(q.chars, 0) + t.n0 + t.n1 + t.n2 END - coalesce(q.unmarked, 0) AS passed, u.doc_id IS NOT NULL AS dirty FROM {docs} t LEFT JOIN ({sums}) q ON q.doc_id = t.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM ({unmarked}) x) u ON u.doc_id = t.doc_id)"
    ranked = f"(SELECT u.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ({unmarked}) u)"
    rest = f"(SELECT doc_id, min(page) AS page, sum(unmarked) AS n FROM {ranked} r WHERE rn > 10 GROUP BY doc_id)"
    return [
        rows(untagged_total(d), FAIL, "The document's content is not tagged.", "s.total > 0", "s.total", severity=HIGH, branch=1),
        rows(ranked, FAIL, "The page has content that is neither tagged nor an artifact.", "s.rn <= 10", "s.cnt0", "s.page", "s.ref", HIGH, branch=2, pos="s.rn"),
        rows(rest, FAIL, "Further pages have unmarked content.", items="s.n", page="s.page", severity=HIGH, branch=3),
        rows(base, PASS, "Content is tagged or an artifact.", "s.dirty AND s.passed > 0", "s.passed", branch=4),
        rows(base, PASS, "All content is tagged or an artifact.", "NOT s.dirty", "greatest(s.passed, 1)", branch=4),
    ]


TAGGED_OR_TREE = "SELECT * FROM $documents WHERE is_tagged OR has_structure_tree"


def tagged_in_artifact(d) -> list[str]:
    found = "SELECT p.doc_id, p.page_number FROM $pages p JOIN $documents t ON t.doc_id = p.doc_id AND (t.is_tagged OR t.has_structure_tree) WHERE p.tagged_in_artifact > 0"
    return [rows(f"({found})", FAIL, "The page has tagged content inside an artifact.", page="s.page_number", severity=HIGH, branch=1, pos="s.page_number"), rows(counted(TAGGED_OR_TREE, found), PASS, "No tagged content lies inside an artifact.", "s.n0 = 0", branch=2)]


def mcid_references(d) -> list[str]:
    placed = """SELECT r.doc_id, CASE WHEN r.page IS NOT NULL THEN r.page WHEN t.n0 = 1 THEN t.only_page ELSE s.page END AS page, r.mcid, r.page IS NULL AND t.n0 <> 1 AND s.page IS NULL AS anywhere
FROM $mcid_refs r JOIN (SELECT t.doc_id, count(p.page_number) AS n0, min(p.page_number) AS only_page FROM $documents t LEFT JOIN $pages p ON p.doc_id = t.doc_id WHERE t.has_structure_tree GROUP BY t.doc_id) t ON t.doc_id = r.doc_id
LEFT JOIN $node_pages s ON s.doc_id = r.doc_id AND s.node_id = r.node_id AND r.page IS NULL AND NOT r.is_entry AND t.n0 <> 1"""
    orphans = f"SELECT m.doc_id, m.page_number, count(*) AS n FROM $page_mcids m LEFT JOIN (SELECT DISTINCT doc_id, page, mcid FROM ({placed}) a WHERE NOT anywhere) r ON r.doc_id = m.doc_id AND r.page = m.page_number AND r.mcid = m.mcid LEFT JOIN (SELECT DISTINCT doc_id, mcid FROM ({placed}) b WHERE anywhere) g ON g.doc_id = m.doc_id AND g.mcid = m.mcid WHERE r.doc_id IS NULL AND g.doc_id IS NULL GROUP BY m.doc_id, m.page_number"
    docs = "(SELECT t.doc_id FROM " + counted(DOCS, "SELECT * FROM $page_mcids", orphans) + " t WHERE (t.has_structure_tree OR t.n0 > 0) AND t.n1 = 0)"
    return [rows(f"({orphans})", FAIL, "Marked content that no structure element names.", items="s.n", page="s.page_number", severity=HIGH, branch=1, pos="s.page_number"), rows(docs, PASS, "All marked content is named by structure elements.", items="0", branch=2)]


def mcid_existence(d) -> list[str]:
    bad = "SELECT r.doc_id, CAST(r.pos AS BIGINT) * 10000 + r.ord AS pos, nullif(r.page, 0) AS page, concat('<', r.tag, '>') AS ref FROM $mcid_refs r JOIN $documents t ON t.doc_id = r.doc_id AND t.has_structure_tree LEFT JOIN (SELECT DISTINCT doc_id, page_number, mcid FROM $page_mcids) m ON m.doc_id = r.doc_id AND m.page_number = r.page AND m.mcid = r.mcid WHERE m.doc_id IS NULL"
    return [*capped(bad, FAIL, "A structure element names marked content that its page lacks.", 10, "sum", 1, HIGH), rows(counted(WITH_TREE, bad), PASS, "All marked content that elements name exists.", "s.n0 = 0", "0", branch=2)]


def nested_content(d) -> list[str]:
    bad = "SELECT o.doc_id, o.page_number AS pos, o.page_number AS page, CAST(NULL AS STRING) AS ref FROM (SELECT DISTINCT doc_id, page_number FROM $occurrences WHERE is_inside_tagged AND mcid IS NOT NULL) o JOIN $documents t ON t.doc_id = o.doc_id AND (t.is_tagged OR t.has_structure_tree)"
    return [*capped(bad, FAIL, "Marked content is nested on the page.", 5, "one", 1, HIGH), rows(counted(TAGGED_OR_TREE, bad), PASS, "No marked content is nested.", "s.n0 = 0", branch=2)]


def artifact_in_tree(d) -> list[str]:
    bad = "SELECT n.doc_id, n.pos, n.page, concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref FROM $nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE n.std_up = 'ARTIFACT' OR n.tag_up = 'ARTIFACT'"
    return [*capped(bad, FAIL, "An artifact stands in the structure tree.", 5, None, 1, HIGH), rows(counted(WITH_TREE, bad), PASS, "No artifacts stand in the structure tree.", "s.n0 = 0", branch=2)]


def artifact_in_tagged(d) -> list[str]:
    docs = counted(DOCS, "SELECT * FROM $artifacts", "SELECT * FROM $artifacts WHERE is_inside_tagged")
    return [
        rows("(SELECT * FROM $artifacts WHERE is_inside_tagged)", FAIL, "An artifact lies inside tagged content.", page="s.page_number", ref="concat('Artifact on Page ', CAST(s.page_number AS STRING))", severity=HIGH, branch=1, pos="s.page_number * 100000 + s.ord"),
        rows(docs, PASS, "Artifacts lie outside tagged content.", "s.n0 = 0 OR s.n0 > s.n1", "s.n0 - s.n1", branch=2),
    ]


def annotations_tagged(d) -> list[str]:
    bad = "SELECT a.doc_id, a.ord AS pos, a.page, concat('Annotation ', a.annot_id) AS ref FROM $annotations a JOIN $documents t ON t.doc_id = a.doc_id AND t.is_tagged WHERE NOT a.is_tagged AND a.subtype IN ('Link', 'Widget', 'Text')"
    docs = counted("SELECT DISTINCT a.doc_id FROM $annotations a JOIN $documents t ON t.doc_id = a.doc_id AND t.is_tagged", bad)
    return [*capped(bad, FAIL, "An annotation is not tagged.", 5, None, 1, HIGH), rows(docs, PASS, "Annotations are tagged.", "s.n0 = 0", branch=2)]


INTERACTIVE = "(p.annotations_count > 0 OR p.links_count > 0 OR a.doc_id IS NOT NULL)"


def tab_order(d) -> list[str]:
    pages = f"SELECT p.doc_id, p.page_number, {INTERACTIVE} AS interactive, coalesce(p.tab_order_mode, '') <> 'S' AND ({INTERACTIVE} OR NOT t.is_tagged) AS bad FROM $pages p JOIN $documents t ON t.doc_id = p.doc_id LEFT JOIN (SELECT DISTINCT doc_id, page FROM $annotations) a ON a.doc_id = p.doc_id AND a.page = p.page_number"
    docs = f"(SELECT doc_id, min(CASE WHEN bad THEN page_number END) AS first_bad, count(CASE WHEN interactive THEN 1 END) AS n FROM ({pages}) p GROUP BY doc_id)"
    return [rows(docs, FAIL, "Pages do not use the structure as tab order.", "s.first_bad IS NOT NULL", page="s.first_bad", severity=HIGH), rows(docs, PASS, "Tab order follows the structure.", "s.first_bad IS NULL", "greatest(s.n, 1)")]


def form_fields(d) -> list[str]:
    tip, name = f"NOT {filled(d, 'tooltip')}", f"(NOT {filled(d, 'name')} OR {strip(d, 'name')} = 'UnnamedField')"
    docs = counted(DOCS, "SELECT * FROM $form_fields", f"SELECT * FROM $form_fields WHERE {tip} OR {name}")
    return [
        rows(f"(SELECT * FROM $form_fields WHERE {tip})", FAIL, "The form field has no tooltip.", page="s.page", ref="concat('FormField ''', s.name, '''')", severity=HIGH, branch=1, pos="s.ord"),
        rows(f"(SELECT * FROM $form_fields WHERE {name})", FAIL, "The form field has no name.", page="s.page", ref="'FormField'", severity=HIGH, branch=2, pos="s.ord"),
        rows(docs, PASS, "Form fields have tooltips and names.", "s.n0 = 0 OR s.n0 > s.n1", "s.n0 - s.n1", branch=3),
    ]


def embedded_files(d) -> list[str]:
    return [rows("$documents", NOT_APPLICABLE, "No embedded files.", "coalesce(s.embedded_files_count, 0) = 0", "0"), rows("$documents", PASS, "Embedded files are listed.", "s.embedded_files_count > 0", "s.embedded_files_count")]


def text_units(d) -> str:
    """Documents with text_units: strings in content streams, else words on pages, else words in nodes."""
    words = lambda x: d.size(d.found(f"coalesce({x}, '')", f"[^{SPACE[1:]}+"))
    return f"(SELECT t.*, coalesce(nullif(t.stream_text_strings, 0), nullif(p.n, 0), nullif(n.n, 0), 0) AS text_units FROM $documents t LEFT JOIN (SELECT doc_id, sum({words('text')}) AS n FROM $pages GROUP BY doc_id) p ON p.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, sum({words('text_content')}) AS n FROM $nodes GROUP BY doc_id) n ON n.doc_id = t.doc_id)"


def document_language(d) -> list[str]:
    lang = strip(d, "s.language")
    ok = d.matches(lang, BCP47)
    return [
        rows("$documents", FAIL, "The document names no language.", f"NOT {truthy('s.language')}", severity=HIGH),
        rows("$documents", WARNING, "The document's language is not a BCP 47 tag.", f"{truthy('s.language')} AND NOT {ok}"),
        rows(text_units(d), PASS, "The document's language is valid.", f"{truthy('s.language')} AND {ok}", "greatest(s.text_units, 1)"),
    ]


def structure_language(d) -> list[str]:
    bad = f"SELECT n.doc_id, n.pos, n.page, n.tag FROM $nodes n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE {truthy('n.lang')} AND NOT {d.matches('n.lang', BCP47)}"
    return [rows(f"({bad})", FAIL, "The element's language is not a BCP 47 tag.", page="coalesce(nullif(s.page, 0), 1)", ref="concat('<', s.tag, '>')", branch=1, pos="s.pos"), rows(counted(WITH_TREE, bad), PASS, "Languages of elements are valid.", "s.n0 = 0", branch=2)]


def _first_page(n: str) -> str:
    return f"coalesce(nullif({n}.page, 0), sp.page, 1)"


SPANNED = "LEFT JOIN (SELECT doc_id, node_id, min(page) AS page FROM $node_pages GROUP BY doc_id, node_id) sp ON sp.doc_id = n.doc_id AND sp.node_id = n.node_id"
ARTIFACT_NODE = "(n.is_artifact OR n.std_up = 'ARTIFACT' OR n.tag_up = 'ARTIFACT' OR coalesce(n.attr_o, '') = '/Artifact')"
UNTYPED = "(coalesce(n.tag, '') = '' OR coalesce(n.standard_tag, '') = '')"
LOOSE_INLINE = f"n.role IN {one_of(ILLUSTRATION_ROLES + INLINE_ROLES)} AND (n.parent_id IS NULL OR n.parent_tag = 'StructTreeRoot' OR upper(coalesce(n.parent_std, '')) IN {one_of(BLOCK_PARENTS)}) AND lower(trim(replace(coalesce(nullif(n.placement, ''), n.attr_placement, ''), '/', ''))) <> 'block'"


def tree_integrity(d) -> list[str]:
    """Every node once, with the numbers of the branches it meets; headings out of order come last."""
    n = f"$nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree AND t.is_tagged {SPANNED}"
    sound = f"NOT n.is_root AND NOT {UNTYPED} AND NOT {ARTIFACT_NODE}"
    inside = " OR ".join(f"(coalesce(nullif(n.parent_std, ''), 'Span') = '{p}' AND n.role IN {one_of(kids)})" for p, kids in INADMISSIBLE.items())
    level = "CASE WHEN n.std_up IN ('H1', 'H2', 'H3', 'H4', 'H5', 'H6') THEN CAST(substr(n.std_up, 2, 1) AS INT) END"
    marked = f"SELECT n.doc_id, n.pos AS spot, {_first_page('n')} AS page, concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref, n.is_root, {level} AS level, NOT n.is_root AND ({UNTYPED} OR {ARTIFACT_NODE}) AS b0, {sound} AND n.parent_id IS NOT NULL AND coalesce(n.parent_tag, '') <> 'StructTreeRoot' AND ({inside}) AS b1, {sound} AND {LOOSE_INLINE} AS b2, {sound} AND n.role IN {one_of(CONTAINERS)} AND n.n_children = 0 AND n.n_mcids = 0 AS b3 FROM {n}"
    # The level of the numbered heading before, by a running count of headings, in the same order as the nodes.
    headed = f"SELECT m.*, last_level AS before FROM (SELECT m.*, max(CASE WHEN level IS NOT NULL THEN spot * 8 + level END) OVER (PARTITION BY doc_id ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 8 AS last_level FROM ({marked}) m) m"
    last = 100_000_000_000
    # One row for each branch that a node meets (0 is an error, the rest are warnings), found in one pass.
    met = f"SELECT m.doc_id, m.page, m.ref, k.n AS branch_no, CASE WHEN k.n = 4 THEN {last} + m.spot ELSE CAST(m.spot AS BIGINT) * 10 + k.n END AS pos FROM (SELECT h.*, coalesce((before IS NULL AND level <> 1) OR level > before + 1, false) AS b4 FROM ({headed}) h WHERE NOT is_root) m, {d.numbers('0', '4')} k WHERE CASE k.n WHEN 0 THEN m.b0 WHEN 1 THEN m.b1 WHEN 2 THEN m.b2 WHEN 3 THEN m.b3 ELSE m.b4 END"
    bad, odd = f"SELECT * FROM ({met}) b WHERE branch_no = 0", f"SELECT * FROM ({met}) o WHERE branch_no > 0"
    sums = f"SELECT doc_id, count(CASE WHEN branch_no = 0 THEN 1 END) AS n1, count(CASE WHEN branch_no > 0 THEN 1 END) AS n2 FROM ({met}) a GROUP BY doc_id"
    docs = f"(SELECT c.*, coalesce(a.n1, 0) AS n1, coalesce(a.n2, 0) AS n2 FROM {counted(TAGGED_TREE, 'SELECT * FROM $nodes WHERE parent_id IS NOT NULL')} c LEFT JOIN ({sums}) a ON a.doc_id = c.doc_id)"
    return [
        rows(docs, FAIL, "The structure tree is empty.", "s.n0 = 0", branch=1),
        *capped(bad, FAIL, "An element of the tree has no type or is an artifact.", 5, "sum", 2, HIGH),
        *capped(odd, WARNING, "An element of the tree is placed questionably.", 5, "sum", 3, LOW),
        rows(docs, PASS, "Elements meet the tree's requirements.", "s.n0 > s.n1 + s.n2", "s.n0 - s.n1 - s.n2", branch=4),
    ]


def parent_tree(d) -> list[str]:
    docs = counted(DOCS, "SELECT * FROM $page_mcids")
    live = f"(SELECT * FROM {docs} t WHERE t.has_structure_tree OR t.has_parent_tree OR t.n0 > 0)"
    on = f"(SELECT doc_id FROM {live} l WHERE l.has_parent_tree)"
    pages = f"SELECT p.* FROM $pages p JOIN {on} o ON o.doc_id = p.doc_id"
    marked = "SELECT DISTINCT doc_id, page_number FROM $page_mcids"
    unlinked = f"SELECT p.doc_id, count(*) AS n, min(p.page_number) AS page FROM ({pages}) p JOIN ({marked}) m ON m.doc_id = p.doc_id AND m.page_number = p.page_number WHERE p.struct_parents_id IS NULL GROUP BY p.doc_id"
    keys = "SELECT doc_id, sp_id, max(CASE WHEN is_array THEN 1 ELSE 0 END) = 1 AS is_array, count(CASE WHEN is_array THEN idx END) AS size FROM $parent_tree GROUP BY doc_id, sp_id"
    absent = f"SELECT p.doc_id, p.page_number AS pos, p.page_number AS page, CAST(NULL AS STRING) AS ref FROM ({pages}) p LEFT JOIN ({keys}) k ON k.doc_id = p.doc_id AND k.sp_id = p.struct_parents_id WHERE p.struct_parents_id IS NOT NULL AND k.doc_id IS NULL"
    slots = f"SELECT p.doc_id, p.page_number, CAST(p.page_number AS BIGINT) * 100000 + m.ord AS pos, m.mcid, k.size, e.is_null, e.target_obj, e.target_tag, e.doc_id IS NOT NULL AS found FROM ({pages}) p JOIN ({keys}) k ON k.doc_id = p.doc_id AND k.sp_id = p.struct_parents_id AND k.is_array JOIN $page_mcids m ON m.doc_id = p.doc_id AND m.page_number = p.page_number LEFT JOIN $parent_tree e ON e.doc_id = p.doc_id AND e.sp_id = p.struct_parents_id AND e.is_array AND e.idx = m.mcid"
    missing = f"SELECT doc_id, pos, page_number AS page, CAST(NULL AS STRING) AS ref FROM ({slots}) x WHERE NOT found OR is_null"
    other = f"SELECT r.doc_id, CAST(r.pos AS BIGINT) * 10000 + r.ord AS pos, r.page, concat('<', r.tag, '>') AS ref FROM $mcid_refs r JOIN ({pages}) p ON p.doc_id = r.doc_id AND p.page_number = r.page JOIN $parent_tree e ON e.doc_id = r.doc_id AND e.sp_id = p.struct_parents_id AND e.is_array AND e.idx = r.mcid AND NOT e.is_null WHERE coalesce(e.target_obj, 0) <> 0 AND coalesce(r.obj_num, 0) <> 0 AND e.target_obj <> r.obj_num"
    objs = "SELECT DISTINCT doc_id, obj_num FROM $nodes WHERE coalesce(obj_num, 0) <> 0"
    wrong = f"SELECT x.doc_id, x.pos, x.page_number AS page, CAST(NULL AS STRING) AS ref FROM ({slots}) x LEFT JOIN ({objs}) o ON o.doc_id = x.doc_id AND o.obj_num = x.target_obj LEFT JOIN (SELECT DISTINCT doc_id FROM ({objs}) y) h ON h.doc_id = x.doc_id WHERE x.found AND NOT x.is_null AND (lower(coalesce(x.target_tag, '')) = 'artifact' OR (coalesce(x.target_obj, 0) <> 0 AND h.doc_id IS NOT NULL AND o.doc_id IS NULL))"
    return [
        rows(live, FAIL, "There is no parent tree.", "NOT s.has_parent_tree", severity=HIGH, branch=1),
        rows(live, WARNING, "The parent tree has no valid entries.", "s.has_parent_tree AND NOT s.parent_tree_valid", severity=MEDIUM, branch=1),
        rows(live, PASS, "The parent tree is valid.", "s.has_parent_tree AND s.parent_tree_valid", "0", branch=1),
        rows(f"({unlinked})", FAIL, "Pages with marked content lack a key into the parent tree.", items="s.n", page="s.page", severity=HIGH, branch=2),
        rows(counted(f"SELECT * FROM {on} o", unlinked), PASS, "Pages with marked content have keys into the parent tree.", "s.n0 = 0", "0", branch=2),
        *capped(absent, FAIL, "A page's key is not in the parent tree.", 5, None, 3, HIGH),
        *capped(missing, FAIL, "Marked content has no entry in the parent tree.", 10, None, 4, HIGH),
        *capped(other, FAIL, "Structure tree and parent tree name different elements.", 10, None, 5, HIGH),
        *capped(wrong, FAIL, "An entry of the parent tree is no structure element.", 10, None, 6, HIGH),
    ]


def structure_nesting(d) -> list[str]:
    n = f"$nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree {SPANNED}"
    first = f"CASE WHEN {UNTYPED} THEN 1 WHEN {ARTIFACT_NODE} THEN 2 WHEN n.n_mcids > 0 AND coalesce(n.page, 0) = 0 AND NOT n.has_pg_attr THEN 3 WHEN {LOOSE_INLINE} THEN 4 ELSE 0 END"
    cols = f"n.doc_id, {_first_page('n')} AS page, concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref"
    own = f"SELECT {cols}, CAST(n.pos AS BIGINT) * 1000000 AS pos FROM {n} WHERE NOT n.is_root AND {first} > 0"
    kid = "coalesce(nullif(c.standard_tag, ''), 'Span')"
    kids = f"SELECT {cols}, CAST(n.pos AS BIGINT) * 1000000 + c.pos AS pos FROM {n} JOIN $nodes c ON c.doc_id = n.doc_id AND c.parent_id = n.node_id WHERE NOT n.is_root AND {first} = 0 AND CASE n.role WHEN 'LI' THEN {kid} NOT IN ('Lbl', 'LBody') WHEN 'Table' THEN {kid} NOT IN ('TR', 'THEAD', 'TBODY', 'TFOOT', 'Caption') WHEN 'THEAD' THEN {kid} <> 'TR' WHEN 'TBODY' THEN {kid} <> 'TR' WHEN 'TFOOT' THEN {kid} <> 'TR' WHEN 'TR' THEN {kid} NOT IN ('TH', 'TD') ELSE false END"
    bad = f"SELECT * FROM ({own}) a UNION ALL SELECT * FROM ({kids}) b"
    weighed = one_of("H H1 H2 H3 H4 H5 H6 Table TH Document Art Part Sect Div Index TOC TOCI Formula Form".split())
    docs = counted(WITH_TREE, "SELECT * FROM $nf WHERE NOT is_root", f"SELECT * FROM $nf WHERE NOT is_root AND standard_tag IN {weighed}", bad)
    total = "(CASE WHEN s.n1 > 0 THEN s.n1 ELSE s.n0 END)"
    return [*capped(bad, FAIL, "A structure element is invalid or holds what it must not.", 5, "sum", 1, HIGH), rows(docs, PASS, "Structure elements meet the requirements.", f"{total} > s.n2", f"{total} - s.n2", branch=2)]


def figure_boxes(d) -> list[str]:
    pages = "SELECT f.doc_id, f.node_id, p.page FROM figs f JOIN $node_pages p ON p.doc_id = f.doc_id AND p.node_id = f.node_id"
    own = "SELECT f.doc_id, f.node_id, f.page FROM figs f WHERE coalesce(f.page, 0) <> 0 UNION SELECT f.doc_id, f.node_id, c.page FROM figs f JOIN $nodes c ON c.doc_id = f.doc_id AND c.parent_id = f.node_id WHERE coalesce(c.page, 0) <> 0"
    boxed = "SELECT f.doc_id, f.node_id, f.page FROM figs f WHERE (f.bbox_state = 'valid' OR f.struct_bbox_valid) AND coalesce(f.page, 0) <> 0 UNION SELECT f.doc_id, f.node_id, coalesce(nullif(c.page, 0), p.page) FROM figs f JOIN $nodes c ON c.doc_id = f.doc_id AND c.parent_id = f.node_id AND (c.bbox_state = 'valid' OR c.struct_bbox_valid) LEFT JOIN $node_pages p ON p.doc_id = c.doc_id AND p.node_id = c.node_id AND coalesce(c.page, 0) = 0"
    figs = "SELECT n.* FROM $nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE NOT n.is_root AND n.std_up = 'FIGURE'"
    bad = f"""WITH figs AS ({figs}), spanned AS ({pages}), spans AS (SELECT * FROM spanned UNION SELECT o.* FROM ({own}) o LEFT JOIN (SELECT DISTINCT doc_id, node_id FROM spanned) h ON h.doc_id = o.doc_id AND h.node_id = o.node_id WHERE h.doc_id IS NULL),
many AS (SELECT doc_id, node_id FROM spans GROUP BY doc_id, node_id HAVING count(DISTINCT page) > 1), boxed AS ({boxed}),
short AS (SELECT DISTINCT s.doc_id, s.node_id FROM spans s JOIN many m ON m.doc_id = s.doc_id AND m.node_id = s.node_id LEFT JOIN boxed b ON b.doc_id = s.doc_id AND b.node_id = s.node_id AND b.page = s.page WHERE b.doc_id IS NULL)
SELECT f.doc_id, f.pos, coalesce(nullif(f.page, 0), 1) AS page, '<Figure>' AS ref FROM figs f LEFT JOIN short x ON x.doc_id = f.doc_id AND x.node_id = f.node_id WHERE f.bbox_state = 'invalid' OR x.doc_id IS NOT NULL"""
    docs = counted(WITH_TREE, figs, bad)
    return [*capped(bad, FAIL, "The figure's bounding boxes are invalid or incomplete.", 5, "sum", 1, HIGH), rows(docs, PASS, "Figures' bounding boxes are sound.", "s.n0 > s.n1", "s.n0 - s.n1", branch=2)]


def lists(d) -> list[str]:
    docs = f"(SELECT t.doc_id, count(l.list_id) AS n, count(CASE WHEN NOT l.is_valid THEN 1 END) AS bad, coalesce(sum(l.n_items), 0) AS items FROM $documents t LEFT JOIN $list_view l ON l.doc_id = t.doc_id GROUP BY t.doc_id)"
    bad = "SELECT l.doc_id, l.pos, l.page, concat('List ', l.list_id) AS ref, CASE WHEN t.has_structure_tree THEN 0 ELSE 1 END AS w FROM $list_view l JOIN $documents t ON t.doc_id = l.doc_id WHERE NOT l.is_valid"
    return [*capped(bad, FAIL, "The list's structure is invalid.", 5, "sum", 1, HIGH, items="s.w"), rows(docs, PASS, "Lists are well structured.", "s.n = 0 OR s.n > s.bad", "CASE WHEN s.bad = 0 THEN s.items ELSE 0 END", branch=2)]


def tables(d) -> list[str]:
    return [
        rows(counted(DOCS, "SELECT * FROM $table_view"), PASS, "There are no tables.", "s.n0 = 0", "0", branch=1),
        rows("$table_view", PASS, "The table has header cells.", "s.has_headers", page="s.page", ref="concat('Table ', s.table_id)", branch=2, pos="s.pos"),
        rows("$table_view", FAIL, "The table has no header cells.", "NOT s.has_headers", page="s.page", ref="concat('Table ', s.table_id)", severity=HIGH, branch=2, pos="s.pos"),
    ]


def empty_elements(d) -> list[str]:
    bad = f"SELECT n.doc_id, n.pos, coalesce(nullif(n.page, 0), 1) AS page, concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref FROM $nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE n.role IN ('P', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'Span', 'Link') AND n.n_children = 0 AND n.n_mcids = 0 AND NOT {truthy('n.alt_text')} AND NOT {truthy('n.actual_text')} AND NOT {truthy('n.title')} AND NOT {filled(d, 'n.text_content')}"
    return [*capped(bad, FAIL, "The element is empty.", 5, "sum", 1, HIGH), rows(counted(WITH_TREE, bad), PASS, "No leaf elements are empty.", "s.n0 = 0", "0", branch=2)]


def role_mapping(d) -> list[str]:
    found = lambda cond: f"SELECT r.doc_id, r.pos, coalesce(nullif(r.page, 0), 1) AS page, concat('<', r.tag, '>') AS ref FROM $node_roles r JOIN $documents t ON t.doc_id = r.doc_id AND t.has_structure_tree WHERE {cond}"
    loop, lost = found("r.is_circular"), found("NOT r.is_circular AND NOT r.is_standard")
    docs = counted(WITH_TREE, "SELECT * FROM $node_roles", loop, lost)
    return [*capped(loop, FAIL, "The tag's role mapping is circular.", 5, "sum", 1, HIGH), *capped(lost, FAIL, "The tag maps to no standard type.", 5, "sum", 2, HIGH), rows(docs, PASS, "Roles are standard or mapped.", "s.n0 > s.n1 + s.n2", "s.n0 - s.n1 - s.n2", branch=3)]


def alternative_text(d) -> list[str]:
    alt = strip(d, "coalesce(nullif(n.alt_text, ''), n.actual_text, '')")
    g = f"SELECT n.doc_id, n.node_id, CASE WHEN n.std_up = 'FORMULA' THEN 'Formula' ELSE 'Figure' END AS label, CASE WHEN n.std_up = 'FORMULA' THEN 1 ELSE 0 END * 1000000000 + n.pos AS ord, coalesce(nullif(n.page, 0), sp.page, 1) AS page, n.decorative, {alt} AS alt FROM $nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.is_tagged AND t.has_structure_tree {SPANNED} WHERE n.std_up IN ('FIGURE', 'FORMULA')"
    none = f"SELECT * FROM ({g}) g WHERE NOT decorative AND alt = ''"
    poor = f"SELECT * FROM ({g}) g WHERE NOT decorative AND alt <> '' AND ({d.matches('alt', FILE_NAME)} OR {d.matches('alt', PLACEHOLDER)} OR length(alt) <= 2)"
    images = "SELECT i.doc_id, i.ord AS pos, i.page, concat('Image ', i.image_id) AS ref FROM $images i JOIN $documents t ON t.doc_id = i.doc_id AND t.is_tagged AND t.has_structure_tree WHERE NOT i.is_artifact AND NOT i.has_alt AND coalesce(i.structure_element_id, '') = ''"
    docs = counted(TAGGED_TREE, g, none, poor, "SELECT * FROM $images", f"SELECT * FROM $links WHERE {truthy('text')} OR {truthy('uri')}")
    ref = "concat('<', s.label, ' id=''', s.node_id, '''>')"
    return [
        rows(docs, PASS, "There are no figures, formulas or images.", "s.n0 = 0 AND s.n3 = 0", branch=0),
        rows(f"({none})", FAIL, "An alternative text is missing.", page="s.page", ref=ref, severity=HIGH, branch=1, pos="s.ord"),
        rows(f"({poor})", WARNING, "An alternative text looks like a placeholder.", page="s.page", ref=ref, severity=MEDIUM, branch=2, pos="s.ord"),
        *capped(images, FAIL, "An image is neither tagged nor an artifact.", 5, None, 3, HIGH),
        rows(docs, PASS, "Elements have alternative descriptions.", "(s.n0 > 0 OR s.n3 > 0) AND s.n0 - s.n1 - s.n2 + s.n4 > 0", "greatest(s.n0 - s.n1 - s.n2, 0) + s.n4", branch=4),
    ]


def xmp_stream(d) -> list[str]:
    return [rows("$documents", PASS, "An XMP stream is present.", "s.xmp_metadata_present"), rows("$documents", FAIL, "There is no XMP stream.", "NOT s.xmp_metadata_present", severity=HIGH)]


def xmp_title(d) -> list[str]:
    ok = f"s.xmp_metadata_present AND {filled(d, 's.xmp_dc_title')}"
    return [rows("$documents", PASS, "The XMP stream has a title.", ok), rows("$documents", FAIL, "The XMP stream has no title.", f"NOT ({ok})", severity=HIGH)]


def pdfua_identifier(d) -> list[str]:
    return [rows("$documents", PASS, "The PDF/UA identifier is present.", "s.pdfua_identifier_present"), rows("$documents", FAIL, "There is no PDF/UA identifier.", "NOT s.pdfua_identifier_present", severity=HIGH)]


def display_title(d) -> list[str]:
    return [
        rows("$documents", PASS, "The window shows the document's title.", "s.display_doc_title", branch=1),
        rows("$documents", FAIL, "The window does not show the document's title.", "NOT s.display_doc_title", severity=HIGH, branch=1),
        rows("$documents", FAIL, "Marked as having suspect tags.", "s.has_suspects", severity=HIGH, branch=2),
        rows("$documents", PASS, "Not marked as having suspect tags.", "NOT s.has_suspects", branch=2),
    ]


def bookmarks(d) -> list[str]:
    return [
        rows("$documents", PASS, "There are bookmarks.", "s.bookmarks_count > 0"),
        rows("$documents", WARNING, "A long document has no bookmarks.", "s.bookmarks_count = 0 AND s.page_count > 20", severity=MEDIUM),
        rows("$documents", PASS, "A short document needs no bookmarks.", "s.bookmarks_count = 0 AND s.page_count <= 20", "0"),
    ]


RULES = {
    "PDFUA-SYNTAX-001": syntax, "PDFUA-FONT-001": font_embedding, "PDFUA-FONT-002": font_unicode, "PDFUA-UNICODE-001": private_use, "PDFUA-UNICODE-002": replacement_characters,
    "PDFUA-CONTENT-001": tagged_pdf, "PDFUA-CONTENT-002": content_tagged, "PDFUA-CONTENT-004": tagged_in_artifact, "PDFUA-CONTENT-005": mcid_references, "PDFUA-CONTENT-006": mcid_existence, "PDFUA-CONTENT-007": nested_content,
    "PDFUA-ARTIFACT-001": artifact_in_tree, "PDFUA-ART-003": artifact_in_tagged, "PDFUA-ANNOT-001": annotations_tagged, "PDFUA-ANNOT-002": tab_order, "PDFUA-FORM-001": form_fields, "PDFUA-EMBEDDED-001": embedded_files,
    "PDFUA-LANG-001": document_language, "PDFUA-LANG-002": structure_language, "PDFUA-TREE-001": tree_integrity, "PDFUA-TREE-002": parent_tree, "PDFUA-STRUCT-001": structure_nesting, "PDFUA-FIG-001": figure_boxes,
    "PDFUA-LIST-001": lists, "PDFUA-TABLE-001": tables, "PDFUA-STRUCT-002": empty_elements, "PDFUA-ROLE-001": role_mapping, "PDFUA-ALT-001": alternative_text,
    "PDFUA-META-001": xmp_stream, "PDFUA-META-002": xmp_title, "PDFUA-META-003": pdfua_identifier, "PDFUA-SETTINGS-001": display_title, "PDFUA-SETTINGS-003": bookmarks,
}
