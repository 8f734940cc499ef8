"""What is made of findings: totals, scores, matrices, searches, and the comparison with an oracle.

Everything is SQL over $findings and the entities; see lectern.functions.sql for its two dialects."""

from __future__ import annotations

from lectern.functions.sql import filled, one_of, quoted, strip
from lectern.schema import AI_MOVES, CATEGORIES, HEADINGS, ORACLE_NAMES, PDFUA_MOVES, PROBLEMS, QUALITY_OF

_SUM = "CAST(coalesce(sum(CASE WHEN {cond} THEN items_count ELSE 0 END), 0) AS BIGINT)"
PASSED, WARNED = _SUM.format(cond="status = 'PASS'"), _SUM.format(cond="status = 'WARNING'")
FAILED, MANUAL = _SUM.format(cond="status IN ('FAIL', 'ERROR')"), _SUM.format(cond="status = 'MANUAL REVIEW'")
COUNTS = f"{PASSED} AS passed, {WARNED} AS warned, {FAILED} AS failed, {MANUAL} AS manual"
SCORE = "CASE WHEN passed + warned + failed = 0 THEN CAST(100.0 AS DOUBLE) ELSE round(CAST(100.0 AS DOUBLE) * passed / (passed + warned + failed), 1) END"
#: Compliance bands: from 90 green, from 70 amber.
BAND = "CASE WHEN compliance_score >= 90 THEN 'green' WHEN compliance_score >= 70 THEN 'amber' ELSE 'red' END"


def totals() -> str:
    """Totals in items, the number of findings, and the compliance score of each document."""
    sums = f"SELECT d.doc_id, {COUNTS}, CAST(count(CASE WHEN status = 'NOT APPLICABLE' THEN 1 END) AS BIGINT) AS not_applicable, CAST(count(f.status) AS BIGINT) AS findings_count FROM $documents d LEFT JOIN $findings f ON f.doc_id = d.doc_id GROUP BY d.doc_id"
    return f"SELECT s.*, passed + warned + failed + manual AS total_checks, {SCORE} AS compliance_score FROM ({sums}) s"


def batch_summary() -> str:
    """One row a file as a batch scan lists it; files that could not be read stand there with zeros and their error."""
    read = f"SELECT t.doc_id, d.filename, d.is_tagged, t.passed, t.warned, t.failed, t.compliance_score, {BAND} AS band, 'Success' AS status FROM ({totals()}) t JOIN $documents d ON d.doc_id = t.doc_id"
    none = "CAST(0 AS BIGINT)"
    return f"{read} UNION ALL SELECT doc_id, filename, false, {none}, {none}, {none}, CAST(0.0 AS DOUBLE), 'red', concat('Error: ', message) FROM $errors"


def document_info() -> str:
    """The document's facts beside counts of its elements; the root is no tag."""
    n = lambda t, w="true": f"LEFT JOIN (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM ${t} WHERE {w} GROUP BY doc_id) {t} ON {t}.doc_id = d.doc_id"
    parts = [("nodes", "tag <> 'StructTreeRoot' OR tag IS NULL"), ("fonts", "true"), ("images", "true"), ("links", "true"), ("form_fields", "true"), ("annotations", "true"), ("table_view", "true")]
    cols = ", ".join(f"coalesce({t}.n, 0) AS {'tables' if t == 'table_view' else t}_count" for t, _ in parts)
    return f"SELECT d.doc_id, d.filename, d.filepath, d.filesize, d.pdf_version, d.page_count, coalesce(nullif(d.title, ''), 'Untitled') AS title, coalesce(d.author, '') AS author, d.display_doc_title, d.pdfua_identifier_present AS pdfua_declared, coalesce(nullif(d.language, ''), 'Not specified') AS language, d.is_tagged, d.is_encrypted, d.bookmarks_count, {cols} FROM $documents d " + " ".join(n(t, w) for t, w in parts)


def _seed(standard: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {i} AS ord, {quoted(c)} AS category" for i, c in enumerate(CATEGORIES[standard])) + ")"


def _case(x: str, moves: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in moves.items()) + f" ELSE {other} END"


def matrix(standard: str) -> str:
    """Every category of a standard for every document, with items passed, warned, failed and left to a person."""
    if standard == "PDF/UA":
        target = _pdfua_category()
        # Failures of font embedding count once a font, however many pages they are listed for.
        once = "row_number() OVER (PARTITION BY doc_id, check_id, CASE WHEN status IN ('FAIL', 'ERROR') THEN coalesce(nullif(object_reference, ''), message) END, status IN ('FAIL', 'ERROR') ORDER BY branch, pos)"
        found = f"SELECT doc_id, {target} AS category, status, items_count FROM (SELECT f.*, CASE WHEN check_id = 'PDFUA-FONT-001' AND status IN ('FAIL', 'ERROR') THEN {once} ELSE 1 END AS nth FROM $findings f WHERE lower(standard) = 'pdf/ua') x WHERE nth = 1"
    elif standard == "Quality":
        found = f"SELECT doc_id, {_case('check_id', QUALITY_OF, quoted(''))} AS category, status, items_count FROM $findings"
    elif standard == "AI":
        found = f"SELECT doc_id, {_case('category', AI_MOVES, quoted(CATEGORIES['AI'][0]))} AS category, status, items_count FROM $findings WHERE lower(standard) = 'ai'"
    else:
        # A category that is not in the list goes to the one whose first three characters it shares.
        found = f"SELECT f.doc_id, coalesce(c.category, f.category) AS category, f.status, f.items_count FROM $findings f LEFT JOIN {_seed(standard)} c ON substr(c.category, 1, 3) = substr(f.category, 1, 3) WHERE lower(f.standard) = 'wcag'"
    names = ["passed", "warned", "failed", "manual"]
    extra = ""
    if standard == "WCAG":
        names.append("not_applicable")
        extra = ", CAST(coalesce(sum(CASE WHEN status = 'NOT APPLICABLE' THEN greatest(items_count, 1) ELSE 0 END), 0) AS BIGINT) AS not_applicable"
    # Findings are added up before they meet the seed of categories.
    sums = f"SELECT doc_id, category, {COUNTS}{extra} FROM ({found}) f GROUP BY doc_id, category"
    cols = ", ".join(f"coalesce(f.{n}, 0) AS {n}" for n in names)
    return f"SELECT d.doc_id, c.ord, c.category, {cols} FROM $documents d CROSS JOIN {_seed(standard)} c LEFT JOIN ({sums}) f ON f.doc_id = d.doc_id AND f.category = c.category"


def icons(standard: str) -> str:
    """A category's icon, and whether the document complies with the standard as a whole."""
    icon = "CASE WHEN failed > 0 THEN 'fail' WHEN warned > 0 THEN 'warn' WHEN passed > 0 THEN 'pass' ELSE 'none' END"
    return f"SELECT doc_id, ord, category, {icon} AS icon, sum(failed) OVER (PARTITION BY doc_id) = 0 AS compliant FROM ({matrix(standard)}) m"


def first_open_category(standard: str) -> str:
    """The first category with failures or warnings, else the first."""
    return f"SELECT doc_id, category FROM (SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN failed > 0 OR warned > 0 THEN 0 ELSE 1 END, ord) AS rn FROM ({matrix(standard)}) m) r WHERE rn = 1"


def score_bars() -> str:
    """Share of passed findings (rows, not items) of each standard, cut to a whole number."""
    return "SELECT doc_id, standard, CASE WHEN t = 0 THEN 100 ELSE CAST(floor(100.0 * p / t) AS INT) END AS bar FROM (SELECT doc_id, standard, count(CASE WHEN status = 'PASS' THEN 1 END) AS p, count(CASE WHEN status IN ('PASS', 'FAIL', 'WARNING', 'ERROR') THEN 1 END) AS t FROM $findings GROUP BY doc_id, standard) s"


def raw_categories() -> str:
    return f"SELECT doc_id, standard, category, {COUNTS} FROM $findings GROUP BY doc_id, standard, category"


def rollup() -> str:
    """Findings by status for each standard and category, each standard, and all, in one pass."""
    return "SELECT standard, category, status, CAST(count(*) AS BIGINT) AS findings, CAST(sum(items_count) AS BIGINT) AS items FROM $findings GROUP BY GROUPING SETS ((standard, category, status), (standard, status), (status))"


#: The matrix category of a PDF/UA finding.
def _pdfua_category() -> str:
    moved = _case("category", PDFUA_MOVES, "category")
    return f"CASE WHEN category = 'Annotations' THEN CASE WHEN check_id = 'PDFUA-ANNOT-002' THEN 'Document settings' ELSE 'Content' END WHEN check_id LIKE 'PDFUA-UNICODE-%' THEN 'Natural language' WHEN {moved} IN {one_of(CATEGORIES['PDF/UA'])} THEN {moved} ELSE 'Content' END"


def search(text: str = "", statuses: tuple[str, ...] = (), standard: str = "", category: str = "", rules: tuple[str, ...] = ()) -> str:
    """Findings that meet all conditions given; a category means the raw one or that of the standard's matrix; text is looked for, in lower case, in id, category, name, message and evidence."""
    cond = ["true"]
    if statuses:
        cond.append(f"status IN {one_of(statuses)}")
    if standard:
        cond.append(f"lower(standard) = {quoted(standard.lower())}")
    if category:
        cond.append(f"(lower(category) = {quoted(category.lower())} OR (lower(standard) = 'wcag' AND substr(category, 1, 3) = {quoted(category[:3])}) OR (lower(standard) = 'pdf/ua' AND lower({_pdfua_category()}) = {quoted(category.lower())}))")
    if rules:
        cond.append(f"check_id IN {one_of(rules)}")
    if text:
        cond.append(f"instr(lower(concat_ws(' ', check_id, category, name, message, evidence)), {quoted(text.lower())}) > 0")
    return f"SELECT doc_id, check_id, branch, pos, status, severity, items_count, page, object_reference, message, evidence, remediation FROM $findings WHERE {' AND '.join(cond)}"


def drilldown_counts() -> str:
    """How many findings, problems and items a drill-down into each category of the PDF/UA matrix shows."""
    found = f"SELECT doc_id, {_pdfua_category()} AS category, status, items_count FROM $findings WHERE lower(standard) = 'pdf/ua'"
    sums = f"SELECT doc_id, category, count(*) AS findings, count(CASE WHEN status IN {one_of(PROBLEMS)} THEN 1 END) AS problems, sum(items_count) AS items FROM ({found}) f GROUP BY doc_id, category"
    return f"SELECT d.doc_id, c.ord, c.category, CAST(coalesce(s.findings, 0) AS BIGINT) AS findings, CAST(coalesce(s.problems, 0) AS BIGINT) AS problems, CAST(coalesce(s.items, 0) AS BIGINT) AS items FROM $documents d CROSS JOIN {_seed('PDF/UA')} c LEFT JOIN ({sums}) s ON s.doc_id = d.doc_id AND s.category = c.category"


def problems() -> str:
    """Problems, and findings with a page, with the next and the one before, round in a circle."""
    order = "ORDER BY rule_ord, branch, pos, object_reference, page"
    listed = f"SELECT doc_id, check_id, page, status, row_number() OVER (PARTITION BY doc_id {order}) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM $findings WHERE status IN {one_of(PROBLEMS)} OR page IS NOT NULL"
    return f"SELECT doc_id, check_id, page, status, n, n % total + 1 AS next_n, (n + total - 2) % total + 1 AS previous_n FROM ({listed}) x"


def tag_tree(d) -> str:
    """The tree as lines: tag, what it stands for, the first 60 characters of a text for it, its language and attributes.

    Attributes: marked content, placement, the layout box (or that there is a box), then what else the element has."""
    marks = f"SELECT doc_id, node_id, {d.joined('CAST(mcid AS STRING)', ', ', 'ord, mcid')} AS mcids FROM $node_mcids GROUP BY doc_id, node_id"
    number = lambda x: f"CAST(CAST(round({x}, 2) AS DECIMAL(18,2)) AS STRING)"
    box = "concat('Struct /BBox: [', " + ", ', ', ".join(number(f"b.{x}") for x in ("x0", "y0", "x1", "y1")) + ", ']')"
    rest = ", ".join(f"CASE WHEN {c} <> '' THEN concat('{k}: ', {c}) END" for k, c in (("O", "n.attr_o"), ("Type", "n.attr_type"), ("Ref", "n.attr_ref"), ("Dest", "n.attr_dest")))
    dump = f"concat_ws('; ', CASE WHEN m.mcids IS NOT NULL THEN concat('MCIDs: [', m.mcids, ']') END, CASE WHEN n.placement <> '' THEN concat('Placement: /', n.placement) END, CASE WHEN b.node_id IS NOT NULL THEN {box} WHEN n.has_explicit_bbox THEN 'Explicit /BBox: Present in attributes' END, {rest})"
    label = "CASE WHEN n.tag = n.standard_tag THEN n.tag ELSE concat(n.tag, ' (', coalesce(n.standard_tag, ''), ')') END"
    return f"""SELECT n.doc_id, n.pos, n.depth, {label} AS label, substr(coalesce(nullif(n.alt_text, ''), nullif(n.actual_text, ''), n.title, ''), 1, 60) AS snippet, coalesce(nullif(n.lang, ''), 'Default') AS language, coalesce(nullif({dump}, ''), 'No special attributes.') AS attributes
FROM $nodes n LEFT JOIN ({marks}) m ON m.doc_id = n.doc_id AND m.node_id = n.node_id LEFT JOIN (SELECT * FROM $boxes WHERE kind = 'layout') b ON b.doc_id = n.doc_id AND b.node_id = n.node_id"""


def inventory() -> str:
    """How many elements of each kind a document has; headings are those of its structure tree."""
    kinds = [("Fonts", "$fonts", "true"), ("Images", "$images", "true"), ("Tables", "$table_view", "true"), ("Links", "$links", "true"), ("Form Fields", "$form_fields", "true"), ("Headings", "$nodes", f"upper(standard_tag) IN {one_of(HEADINGS)}")]
    counts = " UNION ALL ".join(f"SELECT doc_id, {i + 1} AS ord, count(*) AS n FROM {t} WHERE {w} GROUP BY doc_id" for i, (_, t, w) in enumerate(kinds))
    names = ["Pages", *(k for k, _, _ in kinds), "Bookmarks"]
    seed = " UNION ALL ".join(f"SELECT {i} AS ord, {quoted(k)} AS kind" for i, k in enumerate(names))
    return f"SELECT d.doc_id, k.ord, k.kind, CAST(CASE k.ord WHEN 0 THEN d.page_count WHEN {len(names) - 1} THEN d.bookmarks_count ELSE coalesce(c.n, 0) END AS BIGINT) AS n FROM $documents d CROSS JOIN ({seed}) k LEFT JOIN ({counts}) c ON c.doc_id = d.doc_id AND c.ord = k.ord"


#: Pages of a font that its row shows.
FONT_PAGES = 8


def elements(d) -> str:
    """The rows of the element views: kind, place in its list, page, name, and what else the row shows in one text."""
    yes = lambda x: f"CASE WHEN {x} THEN 'Yes' ELSE 'No' END"
    pages = f"SELECT doc_id, font_ord, {d.joined('CAST(page AS STRING)', ', ', 'idx')} AS pages FROM (SELECT * FROM $font_pages WHERE idx < {FONT_PAGES}) p GROUP BY doc_id, font_ord"
    text = lambda x: f"CAST({x} AS STRING)"
    views = [
        f"SELECT f.doc_id, 'Fonts' AS kind, f.ord, CAST(NULL AS INT) AS page, f.name, concat_ws(' | ', {yes('f.is_embedded')}, {yes('f.has_tounicode')}, coalesce(f.encoding, ''), coalesce(p.pages, '')) AS shown FROM $fonts f LEFT JOIN ({pages}) p ON p.doc_id = f.doc_id AND p.font_ord = f.ord",
        f"SELECT doc_id, 'Images', ord, page, image_id, concat_ws(' | ', {yes('has_alt')}, coalesce(nullif(alt_text, ''), '(None)'), {yes('is_artifact')}) FROM $images",
        f"SELECT doc_id, 'Tables', pos, page, table_id, concat_ws(' | ', {text('n_rows')}, {text('n_cols')}, {yes('has_headers')}, {text('n_th')}, {text('n_td')}, CASE WHEN is_regular THEN 'Yes' ELSE 'Irregular' END) FROM $table_view",
        "SELECT doc_id, 'Links', ord, page, coalesce(text, ''), coalesce(uri, '') FROM $links",
        "SELECT doc_id, 'Forms', ord, page, name, coalesce(nullif(tooltip, ''), '(Missing Tooltip)') FROM $form_fields",
    ]
    return " UNION ALL ".join(views)


def metadata_sheet(d) -> str:
    """The document's 21 properties as key and value, with defaults, in one scan."""
    said = lambda x, none: f"coalesce(nullif({x}, ''), '{none}')"
    stripped = lambda x, none: f"CASE WHEN {filled(d, x)} THEN {strip(d, x)} ELSE '{none}' END"
    missing = "(Not specified)"
    tool = "CASE WHEN coalesce(creator, '') = '' AND coalesce(producer, '') = '' THEN '(Not specified)' WHEN coalesce(producer, '') = '' THEN creator WHEN coalesce(creator, '') = '' THEN producer ELSE concat(creator, ' / ', producer) END"
    yes = lambda cond, a, b: f"CASE WHEN {cond} THEN '{a}' ELSE '{b}' END"
    sheet = [
        ("File Name", "filename"),
        ("File Location", "filepath"),
        ("File Size", "concat(CAST(round(filesize / CAST(1024 AS DOUBLE), 1) AS STRING), ' KB (', CAST(filesize AS STRING), ' bytes)')"),
        ("Page Count", "CAST(page_count AS STRING)"),
        ("PDF Version", "concat('PDF ', coalesce(pdf_version, ''))"),
        ("Document Title (Effective)", stripped("title", "No title")),
        ("XMP Dublin Core Title", said("xmp_dc_title", "(Missing from XMP)")),
        ("Legacy Info Title", said("doc_info_title", missing)),
        ("Author / Creator", stripped("author", "No author")),
        ("Subject / Description", f"coalesce(nullif(xmp_dc_description, ''), nullif(subject, ''), '{missing}')"),
        ("Keywords", said("keywords", missing)),
        ("Application / Producer", tool),
        ("Creation Date", said("creation_date", missing)),
        ("Modification Date", said("modification_date", missing)),
        ("Primary Language", said("language", missing)),
        ("Tagged", yes("is_tagged", "Yes", "No")),
        ("Title shown", yes("display_doc_title", "Yes", "No")),
        ("PDF/UA Identifier", "CASE WHEN pdfua_identifier_present THEN concat('Yes (Part ', CAST(coalesce(nullif(pdfua_part, 0), 1) AS STRING), ')') ELSE 'No' END"),
        ("XMP Metadata Stream", yes("xmp_metadata_present", "Yes", "No")),
        ("Encrypted", yes("is_encrypted", "Yes", "No")),
        ("Extraction Allowed", yes("allows_extraction", "Yes", "No")),
    ]
    key, value = ("CASE k.n " + " ".join(f"WHEN {i} THEN {x[j] if j else quoted(x[j])}" for i, x in enumerate(sheet)) + " END" for j in (0, 1))
    return f"SELECT t.doc_id, CAST(k.n AS INT) AS ord, {key} AS property, {value} AS value FROM $documents t, {d.numbers('0', str(len(sheet) - 1))} k"


def engine_records() -> str:
    """Findings under the oracle's names: errors count as failures, manual review as warnings."""
    pick = lambda k: "CASE check_id " + " ".join(f"WHEN {quoted(r)} THEN {quoted(v[k])}" for r, v in ORACLE_NAMES.items()) + f" ELSE {('category', 'name')[k]} END"
    return f"SELECT doc_id, {pick(0)} AS category, {pick(1)} AS check_name, page, CASE status WHEN 'ERROR' THEN 'FAIL' WHEN 'MANUAL REVIEW' THEN 'WARNING' ELSE status END AS status, row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord, branch, pos, object_reference, page) AS ord FROM $findings"


def comparison(engine: str, oracle: str) -> str:
    """Records of engine and oracle (doc_id, category, check_name, page, status, ord) paired one to one.

    First on the same page, equal statuses before unequal ones; then across pages in the same two
    steps; what is left is missing from the engine, found by it alone, or an omission of the oracle.
    Pairing in order is pairing by rank, so each step is a join.  Text for an ANSI engine; Spark takes
    the steps of plans.compare."""
    key = "doc_id, category, check_name"
    side = lambda x: f"SELECT {key}, page, coalesce(page, -1) AS pg, status, ord FROM ({x}) x"
    ctes = [f"e0 AS MATERIALIZED ({side(engine)})", f"o0 AS MATERIALIZED ({side(oracle)})"]
    steps = [("pg, status", "ord", "MATCH"), ("pg", "ord", "STATUS_MISMATCH"), ("status", "pg, ord", "MATCH"), ("", "pg, ord", "STATUS_MISMATCH")]
    out = []
    for k, (more, order, result) in enumerate(steps):
        part = f"{key}, {more}" if more else key
        ctes += [f"{s}r{k} AS MATERIALIZED (SELECT x.*, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {s}{k} x)" for s in "eo"]
        on = " AND ".join(f"e.{c} = o.{c}" for c in [*part.split(", "), "rn"])
        page = "e.page" if k < 2 else "coalesce(e.page, o.page)"
        out.append(f"SELECT e.doc_id, {page} AS page, e.category, e.check_name, '{result}' AS classification, o.status AS oracle_status, e.status AS engine_status FROM er{k} e JOIN or{k} o ON {on}")
        left = "e.doc_id, e.category, e.check_name, e.page, e.pg, e.status, e.ord"
        ctes.append(f"e{k + 1} AS (SELECT {left} FROM er{k} e LEFT JOIN or{k} o ON {on} WHERE o.doc_id IS NULL)")
        ctes.append(f"o{k + 1} AS (SELECT {left.replace('e.', 'o.')} FROM or{k} o LEFT JOIN er{k} e ON {on} WHERE e.doc_id IS NULL)")
    ctes.append("covered AS (SELECT DISTINCT doc_id, check_name FROM o0)")
    none = "CAST(NULL AS STRING)"
    out.append(f"SELECT doc_id, page, category, check_name, 'MISSING_FROM_ENGINE', status, {none} FROM o4")
    out.append(f"SELECT e.doc_id, e.page, e.category, e.check_name, CASE WHEN c.doc_id IS NOT NULL AND e.category = 'Fonts' AND e.check_name = 'Font Embedding' AND e.status = 'FAIL' THEN 'REFERENCE_ORACLE_OMISSION' ELSE 'ENGINE_ONLY' END, {none}, e.status FROM e4 e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.check_name = e.check_name")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(out)


def comparison_rollup(engine: str, oracle: str) -> str:
    return f"SELECT doc_id, category, classification, CAST(count(*) AS BIGINT) AS n FROM ({comparison(engine, oracle)}) c GROUP BY GROUPING SETS ((doc_id, classification), (category, classification), (classification))"


#: How a document's font findings relate to the oracle's, tested in this order.
FONT_MATCH = (
    ("oracle_font_failed = engine_font_failed AND oracle_font_warned = engine_font_warned", "MATCH"),
    ("engine_font_failed > oracle_font_failed AND oracle_font_failed > 0", "ENGINE_FOUND_ADDITIONAL_OCCURRENCES"),
    ("engine_font_failed < oracle_font_failed", "ENGINE_MISSED_FAILURES"),
    ("oracle_font_passed > 0 AND engine_font_failed > 0", "STATUS_DISAGREEMENT"),
)


def font_match(oracle: str) -> str:
    """One row a document: the oracle's records by status, those of its fonts, the engine's findings of font
    embedding, all its findings and items, and how the two say of fonts relate.

    Records of the oracle and findings are added up apart, each to the document, before they meet."""
    by = lambda name, status, cond="true": f"count(CASE WHEN status IN ({status}) AND {cond} THEN 1 END) AS {name}"
    statuses = (("passed", "'PASS'"), ("failed", "'FAIL'"), ("warned", "'WARNING'"), ("info", "'INFO', 'MANUAL REVIEW'"))
    fonts = "category = 'Fonts' AND check_name = 'Font Embedding'"
    said = ", ".join([*(by(f"oracle_{n}", s) for n, s in statuses), *(by(f"oracle_font_{n}", s, fonts) for n, s in statuses)])
    embedding = "check_id = 'PDFUA-FONT-001'"
    engine = (("passed", "'PASS'"), ("failed", "'FAIL', 'ERROR'"), ("warned", "'WARNING'"))
    found = ", ".join([f"count(CASE WHEN {embedding} THEN 1 END) AS engine_font_records", *(by(f"engine_font_{n}", s, embedding) for n, s in (*engine, ("info", "'MANUAL REVIEW'"))), *(by(f"engine_{n}", s) for n, s in engine)])
    names = [f"oracle_{k}" for k in ("total", *(n for n, _ in statuses))] + ["oracle_font_total"] + [f"oracle_font_{n}" for n, _ in statuses] + ["engine_font_records"] + [f"engine_font_{n}" for n in ("passed", "failed", "warned", "info")] + [f"engine_{n}" for n, _ in engine]
    counts = ", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in names)
    one = f"""SELECT d.doc_id, d.page_count, d.is_tagged, {counts} FROM $documents d
LEFT JOIN (SELECT doc_id, count(*) AS oracle_total, count(CASE WHEN {fonts} THEN 1 END) AS oracle_font_total, {said} FROM ({oracle}) o GROUP BY doc_id) o ON o.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, {found} FROM $findings GROUP BY doc_id) e ON e.doc_id = d.doc_id"""
    status = "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for cond, name in FONT_MATCH) + " ELSE 'EVALUATION_DIFFERENCE' END"
    return f"SELECT x.*, {status} AS font_match, t.findings_count, t.total_checks AS items_total, t.passed AS items_passed, t.failed AS items_failed, t.warned AS items_warned, t.compliance_score FROM ({one}) x JOIN ({totals()}) t ON t.doc_id = x.doc_id"


def merged_categories() -> str:
    """Category counts of the four standards of a document by name: what stands under one name in several is added up."""
    each = " UNION ALL ".join(f"SELECT doc_id, category, passed, warned, failed, manual FROM ({matrix(s)}) m{i}" for i, s in enumerate(CATEGORIES))
    return f"SELECT doc_id, category, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(warned) AS BIGINT) AS warned, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(manual) AS BIGINT) AS manual FROM ({each}) c GROUP BY doc_id, category"
