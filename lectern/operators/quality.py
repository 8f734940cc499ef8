"""Authoring-quality rules and deterministic heuristics."""

from __future__ import annotations

from lectern.functions.sql import SPACE, filled, one_of, strip, truthy
from lectern.plans.derive import AFTER, BEFORE, inside
from lectern.schema import FAIL, FILE_NAME, GENERIC_TITLES, HEADINGS, HIGH, INFO, LIST_ITEM_DISALLOWED, LOW, MATH_OR_CODE, MEDIUM, PAGINATION, PASS, PLACEHOLDER_QUALITY, REDUNDANT_ALT, TEXT_ROLES, TEXT_ROLES_WIDE, VAGUE_LINK, WARNING

from .base import DOCS, NAMED, WITH_TREE, capped, counted, rows

TREE = "$nf n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree"
PAGE1 = "coalesce(nullif(n.page, 0), 1) AS page"
REF = "concat('<', n.tag, ' id=''', n.node_id, '''>') AS ref"


def _is(tag: str) -> str:
    return f"(n.std_up = '{tag}' OR n.tag_up = '{tag}')"


def heading_hierarchy(d) -> list[str]:
    first = f"SELECT n.doc_id, n.tag, n.node_id, n.level, n.page FROM $headings n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE n.before IS NULL AND n.level <> 1"
    skips = f"SELECT n.doc_id, n.pos, {PAGE1}, {REF}, concat('Level ', CAST(n.level AS STRING), ' after level ', CAST(n.before AS STRING)) AS quote FROM $headings n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE n.level > n.before + 1"
    docs = counted(WITH_TREE, "SELECT * FROM $headings", first, skips)
    return [
        rows(docs, WARNING, "There are no numbered headings.", "s.n0 = 0", confidence="0.8", branch=1),
        rows(f"({first})", WARNING, "The first heading is not H1.", page="coalesce(nullif(s.page, 0), 1)", ref=NAMED, confidence="0.85", branch=2),
        *capped(skips, WARNING, "A heading level is skipped.", 5, "sum", 3, MEDIUM, "0.85", "0.85", evidence="s.quote"),
        rows(docs, PASS, "Heading levels are consistent.", "s.n0 > 0 AND s.n1 = 0 AND s.n2 = 0", branch=4),
    ]


def empty_containers(d) -> list[str]:
    bad = f"SELECT n.doc_id, n.pos, {PAGE1}, concat('<', n.tag, '>') AS ref FROM {TREE} WHERE NOT n.is_root AND n.role IN ('Sect', 'Div', 'Part', 'Art', 'BlockQuote') AND n.n_children = 0 AND n.n_mcids = 0"
    return [*capped(bad, WARNING, "A container is empty.", 3, None, 1, confidence="0.8"), rows(counted(WITH_TREE, bad), PASS, "Containers hold content.", "s.n0 = 0", branch=2)]


def table_regularity(d) -> list[str]:
    bad = "SELECT doc_id, pos, page, concat('Table ', table_id) AS ref FROM $table_view WHERE NOT (n_rows > 0 AND n_cols > 0 AND is_regular)"
    docs = counted("SELECT DISTINCT doc_id FROM $table_view", "SELECT * FROM $table_view", bad)
    return [*capped(bad, WARNING, "The table is incomplete or irregular.", 5, "sum", 1, HIGH, "0.9"), rows(docs, PASS, "Tables are complete and regular.", "s.n0 > s.n1", "s.n0 - s.n1", branch=2)]


def link_labels(d) -> list[str]:
    text = strip(d, "coalesce(text, '')")
    vague = f"SELECT doc_id, ord AS pos, page, CAST(NULL AS STRING) AS ref, concat('Text: \"', {text}, '\"') AS quote FROM $links WHERE {d.matches(text, VAGUE_LINK)}"
    bare = f"SELECT doc_id, ord, page, concat('Text: \"', {text}, '\"') AS quote FROM $links WHERE {text} LIKE 'http://%' OR {text} LIKE 'https://%' OR {text} LIKE 'www.%'"
    one = f"(SELECT doc_id, page, quote FROM (SELECT b.*, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM ({bare}) b) r WHERE rn = 1)"
    docs = counted(DOCS, "SELECT * FROM $links", vague, bare)
    return [
        rows(docs, PASS, "There are no links.", "s.n0 = 0", branch=0),
        *capped(vague, WARNING, "The link's label says too little.", 5, None, 1, confidence="0.9", evidence="s.quote"),
        rows(one, WARNING, "Links are labelled with their address.", page="s.page", confidence="0.9", branch=2, evidence="s.quote"),
        rows(docs, PASS, "Link labels are meaningful.", "s.n0 > 0 AND s.n1 = 0 AND s.n2 = 0", branch=3),
    ]


def page_bounds(d) -> list[str]:
    bad = "SELECT m.doc_id, CAST(m.page_number AS BIGINT) * 100000 + m.ord AS pos, m.page_number AS page, concat('MCID ', CAST(m.mcid AS STRING)) AS ref FROM $page_mcids m JOIN $pages p ON p.doc_id = m.doc_id AND p.page_number = m.page_number WHERE p.width > 0 AND p.height > 0 AND (m.x1 <= -0.5 OR m.y1 <= -0.5 OR m.x0 >= p.width + 0.5 OR m.y0 >= p.height + 0.5) AND m.x1 > m.x0 AND m.y1 > m.y0"
    docs = counted("SELECT DISTINCT doc_id FROM $pages", bad)
    return [*capped(bad, WARNING, "Tagged content lies outside the page.", 5, "sum", 1, HIGH), rows(docs, PASS, "Tagged content lies within pages.", "s.n0 = 0", "0", branch=2)]


def toc_links(d) -> list[str]:
    ahead = f"SELECT n.*, min(CASE WHEN {_is('LINK')} THEN pos END) {AFTER} AS next_link FROM $nf n"
    toci = f"SELECT n.*, {REF}, coalesce(n.next_link <= n.subtree_end, false) AS linked FROM ({ahead}) n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE {_is('TOCI')}"
    bad = f"SELECT i.doc_id, i.pos, coalesce(nullif(i.page, 0), 1) AS page, i.ref FROM ({toci}) i WHERE NOT i.linked"
    return [*capped(bad, FAIL, "The contents entry has no link.", 5, "sum", 1, HIGH), rows(counted(DOCS, f"SELECT * FROM ({toci}) i WHERE i.linked"), PASS, "Contents entries have links.", "s.n0 > 0", "s.n0", branch=2)]


def toc_destinations(d) -> list[str]:
    link = "role_up = 'LINK'"
    ahead = f"SELECT n.*, min(CASE WHEN {link} THEN pos END) {AFTER} AS next_link FROM $nf n"
    first = f"SELECT doc_id, parent_id, min(pos) AS pos FROM $nf WHERE {link} GROUP BY doc_id, parent_id"
    toci = f"SELECT i.doc_id, i.pos, i.page, {REF.replace('n.', 'i.')}, {truthy('l.attr_dest')} AS ok FROM ({ahead}) i JOIN $documents t ON t.doc_id = i.doc_id AND t.has_structure_tree LEFT JOIN ({first}) c ON c.doc_id = i.doc_id AND c.parent_id = i.node_id LEFT JOIN $nodes l ON l.doc_id = i.doc_id AND l.pos = coalesce(c.pos, CASE WHEN i.next_link <= i.subtree_end THEN i.next_link END) WHERE {_is('TOCI').replace('n.', 'i.')}"
    bad = f"SELECT i.doc_id, i.pos, coalesce(nullif(i.page, 0), 1) AS page, i.ref FROM ({toci}) i WHERE NOT i.ok"
    return [*capped(bad, WARNING, "The contents entry leads to no heading.", 5, "sum", 1, MEDIUM), rows(counted(DOCS, f"SELECT * FROM ({toci}) i WHERE i.ok"), PASS, "Contents entries lead to headings.", "s.n0 > 0", "s.n0", branch=2)]


def alt_on_text(d) -> list[str]:
    text = f"SELECT n.* FROM {TREE} WHERE n.std_up IN {one_of(TEXT_ROLES)}"
    bad = f"SELECT n.doc_id, n.pos, {PAGE1}, {REF}, concat('Alternative text: \"', n.alt_text, '\"') AS quote FROM ({text}) n WHERE {filled(d, 'n.alt_text')} AND length({strip(d, 'coalesce(n.text_content, chr(32))')}) > 1"
    docs = counted(f"SELECT DISTINCT doc_id FROM ({text}) x", bad)
    return [*capped(bad, WARNING, "A text element has an alternative text.", 5, "sum", 1, MEDIUM, evidence="s.quote"), rows(docs, PASS, "No text element has an alternative text.", "s.n0 = 0", "0", branch=2)]


def alt_validity(d) -> list[str]:
    nodes = f"SELECT n.doc_id, CAST(n.pos AS BIGINT) AS pos, {PAGE1}, {REF}, {strip(d, 'coalesce(n.alt_text, n.actual_text)')} AS alt FROM {TREE} WHERE n.std_up IN ('FIGURE', 'FORMULA') AND NOT n.decorative AND coalesce(n.alt_text, n.actual_text) IS NOT NULL"
    graphics = f"SELECT DISTINCT n.doc_id, n.node_id FROM {TREE} WHERE n.std_up IN ('FIGURE', 'FORMULA')"
    images = f"SELECT i.doc_id, 1000000000000 + i.ord AS pos, coalesce(nullif(i.page, 0), 1) AS page, concat('<Image id=''', i.image_id, '''>') AS ref, {strip(d, 'i.alt_text')} AS alt FROM $images i LEFT JOIN ({graphics}) g ON g.doc_id = i.doc_id AND g.node_id = i.structure_element_id WHERE NOT i.is_artifact AND g.doc_id IS NULL AND {truthy('i.alt_text')}"
    both = f"{nodes} UNION ALL {images}"
    short = f"length(alt) <= 2 AND NOT {d.matches('alt', r'^[\p{L}\p{N}]+$')}"
    bad = f"SELECT doc_id, pos, page, ref, concat('Alternative text: \"', alt, '\"') AS quote, CASE WHEN alt = '' THEN 'HIGH' ELSE 'MEDIUM' END AS sev FROM ({both}) b WHERE alt = '' OR {d.matches('alt', FILE_NAME)} OR {d.matches('alt', PLACEHOLDER_QUALITY)} OR ({short})"
    ranked = f"(SELECT f.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.pos) AS rn, count(*) OVER (PARTITION BY f.doc_id) AS cnt FROM ({bad}) f)"
    docs = counted(f"SELECT DISTINCT doc_id FROM ({both}) x", both, bad)
    return [
        rows(ranked, WARNING, "An alternative text is empty, a file name or a placeholder.", "s.rn <= 5", page="s.page", ref="s.ref", severity="(s.sev)", branch=1, pos="s.rn", evidence="s.quote"),
        rows(ranked, WARNING, "Further alternative texts are poor.", "s.rn = 6", "s.cnt - 5", severity=MEDIUM, branch=1, pos="6"),
        rows(docs, PASS, "Alternative texts are valid.", "s.n0 > s.n1", "s.n0 - s.n1", branch=2),
    ]


def _notes() -> str:
    return f"SELECT n.*, {REF} FROM {TREE} WHERE {_is('NOTE')}"


def _noted(bad_or_good: str, good: str, message: str, severity: str, status: str = WARNING) -> list[str]:
    bad = f"SELECT i.doc_id, i.pos, coalesce(nullif(i.page, 0), 1) AS page, i.ref FROM ({_notes()}) i LEFT JOIN ({good}) g ON g.doc_id = i.doc_id AND g.node_id = i.node_id WHERE g.doc_id IS NULL"
    return [*capped(bad, status, message, 5, "sum", 1, severity), rows(counted(DOCS, good), PASS, bad_or_good, "s.n0 > 0", "s.n0", branch=2)]


def note_references(d) -> list[str]:
    refs = f"SELECT n.doc_id, n.node_id, n.attr_ref, n.text_content, concat_ws(' ', n.attr_o, n.attr_type, n.attr_placement, n.attr_ref, n.attr_dest) AS attrs FROM {TREE} WHERE {_is('REFERENCE')}"
    ids = f"SELECT doc_id, attr_ref AS id FROM ({refs}) a WHERE {truthy('attr_ref')} UNION SELECT doc_id, node_id FROM ({refs}) b"
    # Equality is a hash join; for containment all that a document's references say is one text.
    said = f"SELECT doc_id, {d.joined("concat(coalesce(text_content, ''), ' | ', attrs)", ' | ', 'node_id')} AS said FROM ({refs}) r GROUP BY doc_id"
    good = f"SELECT i.doc_id, i.node_id FROM ({_notes()}) i JOIN ({ids}) x ON x.doc_id = i.doc_id AND x.id = i.node_id UNION SELECT i.doc_id, i.node_id FROM ({_notes()}) i JOIN ({ids}) x ON x.doc_id = i.doc_id AND x.id = CAST(i.obj_num AS STRING) UNION SELECT i.doc_id, i.node_id FROM ({_notes()}) i JOIN ({said}) r ON r.doc_id = i.doc_id WHERE instr(r.said, i.node_id) > 0"
    return _noted("Notes are referenced.", good, "A note is not referenced.", HIGH)


def note_labels(d) -> list[str]:
    good = f"SELECT DISTINCT i.doc_id, i.node_id FROM ({_notes()}) i JOIN $nf n ON n.doc_id = i.doc_id AND n.parent_id = i.node_id AND {_is('LBL')}"
    return _noted("Notes have labels.", good, "A note has no label.", MEDIUM)


def notes_in_paragraphs(d) -> list[str]:
    placed = f"SELECT n.*, {inside("role_up = 'P'")} AS in_p FROM $nf n"
    good = f"SELECT n.doc_id, n.node_id FROM ({placed}) n JOIN $documents t ON t.doc_id = n.doc_id AND t.has_structure_tree WHERE {_is('NOTE')} AND NOT n.in_p"
    return _noted("Notes stand outside paragraphs.", good, "A note stands inside a paragraph.", LOW)


def artifacted_body(d) -> list[str]:
    text = strip(d, "coalesce(text_snippet, '')")
    words = d.size(d.kept(d.found("txt", f"[^{SPACE[1:]}+"), "w", f"length(w) > 1 AND {d.matches('w', r'^\p{L}+$')}"))
    bad = f"SELECT doc_id, CAST(page_number AS BIGINT) * 100000 + ord AS pos, page_number AS page, CAST(NULL AS STRING) AS ref, concat('Content: \"', txt, '\"') AS quote FROM (SELECT a.*, {text} AS txt FROM $artifacts a) x WHERE txt <> '' AND txt NOT LIKE 'Artifact in Form XObject%' AND NOT {d.matches('txt', PAGINATION)} AND NOT {d.matches('txt', MATH_OR_CODE)} AND length(txt) > 20 AND {words} >= 4"
    return capped(bad, WARNING, "Body text is marked as an artifact.", 5, "sum", 1, HIGH, evidence="s.quote")


def link_completeness(d) -> list[str]:
    links = f"SELECT n.*, {REF}, (n.n_children > 0 OR n.n_mcids > 0 OR {filled(d, 'n.text_content')}) AS ok FROM {TREE} WHERE n.std_up = 'LINK' AND upper(coalesce(nullif(n.parent_std, ''), n.parent_tag, '')) NOT IN ('REFERENCE', 'TOCI')"
    bad = f"SELECT doc_id, pos, coalesce(nullif(page, 0), 1) AS page, ref FROM ({links}) l WHERE NOT ok"
    return [*capped(bad, FAIL, "The link element is incomplete.", 5, "sum", 1, HIGH), rows(counted(DOCS, f"SELECT * FROM ({links}) l WHERE ok"), PASS, "Link elements are complete.", "s.n0 > 0", "s.n0", branch=2)]


def whitespace_only(d) -> list[str]:
    own = lambda x: f"coalesce(length({x}) > 0 AND {strip(d, x)} = '', false)"
    parent = filled(d, "coalesce(nullif(n.parent_text, ''), nullif(n.parent_actual, ''), n.parent_alt)")
    kept = f"NOT (upper(coalesce(nullif(n.parent_std, ''), n.parent_tag, '')) IN {one_of(TEXT_ROLES_WIDE)} AND {parent})"
    marked = f"SELECT r.doc_id, r.node_id, {d.joined('m.text', '', 'r.ord')} AS txt FROM (SELECT m.doc_id, m.node_id, m.ord, m.mcid, coalesce(nullif(n.page, 0), 1) AS page FROM $node_mcids m JOIN $nodes n ON n.doc_id = m.doc_id AND n.node_id = m.node_id WHERE NOT m.is_entry OR m.explicit_page = coalesce(nullif(n.page, 0), 1)) r JOIN $page_mcids m ON m.doc_id = r.doc_id AND m.page_number = r.page AND m.mcid = r.mcid GROUP BY r.doc_id, r.node_id"
    flagged = f"SELECT n.doc_id, n.node_id, n.tag, n.pos, n.subtree_end, n.page FROM {TREE} LEFT JOIN ({marked}) k ON k.doc_id = n.doc_id AND k.node_id = n.node_id WHERE NOT n.is_root AND n.role_up IN {one_of(TEXT_ROLES_WIDE)} AND CASE WHEN n.actual_text IS NOT NULL THEN {own('n.actual_text')} WHEN n.alt_text IS NOT NULL THEN {own('n.alt_text')} WHEN coalesce(length(n.text_content), 0) > 0 THEN {own('n.text_content')} AND {kept} WHEN n.n_children = 0 AND n.n_mcids > 0 THEN {own('k.txt')} AND {kept} ELSE false END"
    # Below a flagged element nothing is flagged: what has a flagged candidate above it falls away.
    bad = f"SELECT * FROM (SELECT f.*, max(subtree_end) {BEFORE} AS reach FROM ({flagged}) f) u WHERE coalesce(reach < pos, true)"
    return [rows(f"({bad})", WARNING, "The element's text is only white space.", page="coalesce(nullif(s.page, 0), 1)", ref=NAMED, severity=HIGH, branch=1, pos="s.pos"), rows(counted(WITH_TREE, bad), PASS, "No element's text is only white space.", "s.n0 = 0", "0", branch=2)]


def title_quality(d) -> list[str]:
    title = strip(d, "coalesce(nullif(s.title, ''), nullif(s.xmp_dc_title, ''), s.doc_info_title, '')")
    base = f"lower({strip(d, d.replaced('coalesce(s.filename, chr(32))', r'(.)[.][^./]*$', d.group(1)))})"
    bad = f"({title} = '' OR ({base} <> '' AND (lower({title}) = {base} OR lower({title}) = lower(s.filename))) OR lower({title}) IN {one_of(GENERIC_TITLES)})"
    return [rows("$documents", FAIL, "The title is missing, generic or not shown.", f"{bad} OR NOT s.display_doc_title", severity=HIGH), rows("$documents", PASS, "The title is meaningful and shown.", f"NOT {bad} AND s.display_doc_title")]


def bookmarks_for_headings(d) -> list[str]:
    docs = counted(WITH_TREE, f"SELECT * FROM $nf WHERE std_up IN {one_of(HEADINGS)}")
    return [rows(docs, PASS, "Headings come with bookmarks.", "s.n0 > 0 AND s.bookmarks_count > 0"), rows(docs, WARNING, "There are headings but no bookmarks.", "s.n0 > 0 AND s.bookmarks_count = 0", severity=MEDIUM)]


def list_items(d) -> list[str]:
    items = f"SELECT n.*, {REF}, (n.n_children = 0 AND n.n_mcids = 0) OR k.doc_id IS NOT NULL AS bad FROM {TREE} LEFT JOIN (SELECT DISTINCT doc_id, parent_id FROM $nodes WHERE upper(coalesce(nullif(standard_tag, ''), tag, '')) IN {one_of(LIST_ITEM_DISALLOWED)}) k ON k.doc_id = n.doc_id AND k.parent_id = n.node_id WHERE {_is('LI')}"
    bad = f"SELECT doc_id, pos, coalesce(nullif(page, 0), 1) AS page, ref FROM ({items}) i WHERE bad"
    return [*capped(bad, FAIL, "The list item is empty or holds what it must not.", 5, "sum", 1, HIGH), rows(counted(DOCS, f"SELECT * FROM ({items}) i WHERE NOT bad"), PASS, "List items are well formed.", "s.n0 > 0", "s.n0", branch=2)]


def alt_semantics(d) -> list[str]:
    figures = f"SELECT n.*, {REF}, {strip(d, 'n.alt_text')} AS alt FROM {TREE} WHERE n.std_up = 'FIGURE'"
    words = d.size(d.found("alt", f"[^{SPACE[1:]}+"))
    bad = f"SELECT doc_id, pos, coalesce(nullif(page, 0), 1) AS page, ref, concat('Alternative text: \"', alt, '\"') AS quote FROM ({figures}) f WHERE {truthy('alt')} AND ({d.matches('alt', REDUNDANT_ALT)} OR ({words} < 3 AND length(alt) < 15))"
    return [*capped(bad, WARNING, "An alternative text says little.", 5, None, 1, evidence="s.quote"), rows(counted(DOCS, bad), PASS, "Alternative texts are meaningful.", "s.n0 = 0", branch=2)]


def readability_of(d, source: str) -> str:
    """doc_id, words, sentences, syllables and the reading ease of each (doc_id, txt) of source."""
    tokens = d.found("txt", r"[\p{L}\p{N}_]+")
    words = d.kept(tokens, "w", d.matches("w", "^[a-zA-Z]+$"))
    vowels = d.each("words", "w", f"CAST(greatest(1, {d.size(d.found('lower(w)', '[aeiouy]+'))}) AS BIGINT)")
    parts = d.kept(d.found("txt", "[^.!?]+"), "p", f"length({strip(d, 'p')}) > 2")
    counts = f"SELECT doc_id, CAST({d.size('words')} AS BIGINT) AS words, greatest(1, CAST({d.size(parts)} AS BIGINT)) AS sentences, CAST({d.total(vowels)} AS BIGINT) AS syllables FROM (SELECT doc_id, txt, {words} AS words FROM ({source}) x) y"
    ease = "206.835 - 1.015 * (CAST(words AS DOUBLE) / CAST(sentences AS DOUBLE)) - 84.6 * (CAST(syllables AS DOUBLE) / CAST(greatest(1, words) AS DOUBLE))"
    return f"SELECT doc_id, words, sentences, syllables, greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), round(CAST({ease} AS DOUBLE), 1))) AS ease FROM ({counts}) c"


def readability(d) -> list[str]:
    whole = f"SELECT doc_id, txt FROM (SELECT doc_id, {strip(d, d.joined('text', ' ', 'page_number'))} AS txt FROM $pages WHERE {truthy('text')} GROUP BY doc_id) w WHERE txt <> ''"
    score = f"({readability_of(d, whole)})"
    return [
        rows(counted(DOCS, whole), PASS, "There is no text to read.", "s.n0 = 0", severity=INFO, branch=0),
        rows(score, "(CASE WHEN s.ease >= 40 THEN 'PASS' ELSE 'WARNING' END)", "Reading ease of the text.", severity=INFO, branch=1),
    ]


def outline(d) -> list[str]:
    return [rows("$documents", WARNING, "A document of many pages has no bookmarks.", "s.bookmarks_count = 0 AND s.page_count > 10"), rows("$documents", PASS, "The outline suits the document.", "NOT (s.bookmarks_count = 0 AND s.page_count > 10)")]


RULES = {
    "QUAL-HEAD-001": heading_hierarchy, "QUAL-STRUCT-001": empty_containers, "QUAL-TABLE-001": table_regularity, "QUAL-LINK-001": link_labels, "QUAL-BOUND-001": page_bounds, "QUAL-TOC-001": toc_links, "QUAL-TOC-002": toc_destinations,
    "QUAL-TEXT-001": alt_on_text, "QUAL-ALT-001": alt_validity, "QUAL-NOTE-001": note_references, "QUAL-NOTE-002": note_labels, "QUAL-NOTE-003": notes_in_paragraphs, "QUAL-ART-001": artifacted_body, "QUAL-LINK-002": link_completeness,
    "QUAL-WHITE-001": whitespace_only, "QUAL-TITLE-001": title_quality, "QUAL-BOOKMARK-001": bookmarks_for_headings, "QUAL-LIST-001": list_items, "AI-ALT-001": alt_semantics, "AI-READ-001": readability, "AI-OUTLINE-001": outline,
}
