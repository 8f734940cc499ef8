"""The engine's queries over the driver's tables, each with its form for an ANSI engine.

Rules and reports run over the star-schema projection (lectern.sources.star), HTML queries over
pages, readability over documents, mark stacks over events.  The projections are stand-ins that make
every rule meet violations and passes; they are no reading of real PDF files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern import oracles
from lectern.functions.sql import Duck, Spark, bound, strip, tables_in
from lectern.operators import quality, reading
from lectern.plans import compare, derive, locate, marks, report
from lectern.plans.audit import EVALUATORS, FINDINGS, Corpus, ansi, rule_sql
from lectern.plans.stage import released, written
from lectern.sources import pdf, pdf_writer, star
from lectern.sources.load import audited_corpus, prepared_corpus, table

#: Oracle records (synthetic): what another checker might say of the same documents.
ORACLE = "SELECT doc_id, category, check_name, page, status, row_number() OVER (PARTITION BY doc_id ORDER BY category, check_name, page, status) AS ord FROM (" + " UNION ALL ".join([
    "SELECT doc_id, 'Document' AS category, 'Document Title' AS check_name, CAST(NULL AS INT) AS page, CASE WHEN doc_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM $documents WHERE doc_id % 7 <> 0",
    "SELECT doc_id, 'Document', 'Display Document Title', CAST(NULL AS INT), CASE WHEN doc_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END FROM $documents",
    "SELECT f.doc_id, 'Fonts', 'Font Embedding', p.page, CASE WHEN f.is_embedded THEN 'PASS' ELSE 'FAIL' END FROM $fonts f JOIN $font_pages p ON p.doc_id = f.doc_id AND p.font_ord = f.ord WHERE p.page % 3 <> 0",
    "SELECT doc_id, 'Structure', 'Heading Structure', page, 'WARNING' FROM $nodes WHERE standard_tag = 'H3'",
]) + ") o"


def findings_sql(d) -> str:
    """The findings of all rules as one text."""
    texts = [rule_sql(d, r) for r in EVALUATORS]
    return " UNION ALL ".join(f"SELECT {FINDINGS} FROM ({t}) f" for t in texts if t)


def _star() -> dict[str, Callable[[object], str]]:
    """Queries over the star projection: name -> SQL in a dialect."""
    out: dict[str, Callable] = {}
    for check_id in EVALUATORS:
        if rule_sql(Duck(), check_id):
            out["rule_" + check_id.lower().replace("-", "_").replace(".", "_")] = lambda d, c=check_id: rule_sql(d, c)
    for name, text in (("role_resolution", "SELECT * FROM $roles"), ("table_regularity", "SELECT * FROM $table_view"), ("list_structure", "SELECT * FROM $list_view"), ("ancestor_flags", "SELECT * FROM $flags"), ("heading_order", "SELECT * FROM $headings"), ("mcid_page_resolution", "SELECT * FROM $mcid_refs"),
        ("node_features", "SELECT doc_id, node_id, parent_tag, parent_std, role, role_up, n_children, n_mcids, decorative FROM $nf"),
        ("text_bbox_union", "SELECT r.doc_id, r.node_id, min(m.x0) AS x0, min(m.y0) AS y0, max(m.x1) AS x1, max(m.y1) AS y1, count(*) AS parts FROM $mcid_refs r JOIN $page_mcids m ON m.doc_id = r.doc_id AND m.page_number = r.page AND m.mcid = r.mcid WHERE m.x0 > 0 OR m.y0 > 0 OR m.x1 > 0 OR m.y1 > 0 GROUP BY r.doc_id, r.node_id"),
        ("image_occurrences", "SELECT doc_id, image_id, page, concat('img_p', CAST(page AS STRING), '_', CAST(xref AS STRING), CASE WHEN k > 1 THEN concat('_', CAST(k AS STRING)) ELSE '' END) AS occurrence FROM (SELECT i.*, row_number() OVER (PARTITION BY doc_id, page, xref ORDER BY ord) AS k FROM $images i) i"),
        ("element_inventory", "SELECT doc_id, standard_tag, CAST(count(*) AS BIGINT) AS n FROM $nodes GROUP BY doc_id, standard_tag"),
    ):
        out[name] = lambda d, t=text: t
    # The first figure of the page, else the first of those without a page, lends every image its text.
    first = "SELECT doc_id, page, alt, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS rn FROM (SELECT doc_id, coalesce(page, 0) AS page, pos, coalesce(nullif(alt_text, ''), actual_text, '') AS alt FROM $nodes WHERE upper(standard_tag) = 'FIGURE') a"
    figure = lambda d: f"SELECT i.doc_id, i.image_id, i.page, {strip(d, 'coalesce(f.alt, z.alt)')} AS alt_text, coalesce(coalesce(f.alt, z.alt) <> '', false) AS has_alt FROM $images i LEFT JOIN ({first}) f ON f.doc_id = i.doc_id AND f.page = i.page AND f.rn = 1 LEFT JOIN ({first}) z ON z.doc_id = i.doc_id AND z.page = 0 AND z.rn = 1"
    out["figure_alt_of_page"] = figure
    # Replacement characters always count; private-use ones unless a replacement text, a formula or an artifact exempts them.
    lost, private = "[\\x{FFFD}]", "[\\x{E000}-\\x{F8FF}]"
    own = "coalesce(n.text_content, '')"
    out["decoding_anomalies"] = lambda d: f"SELECT n.doc_id, n.node_id, {d.matches(f"concat(coalesce(n.actual_text, ''), {own})", lost)} OR ({d.matches(own, private)} AND NOT (f.in_formula OR f.in_artifact OR f.has_text OR coalesce(n.actual_text <> '', false))) AS has_decoding_error FROM $nodes n JOIN $flags f ON f.doc_id = n.doc_id AND f.node_id = n.node_id"
    out["bbox_states"] = lambda d: "SELECT doc_id, bbox_state, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN struct_bbox_valid THEN 1 END) AS BIGINT) AS boxed FROM $nodes GROUP BY doc_id, bbox_state"
    out["html_report_filter"] = lambda d: report.search(statuses=("FAIL",))
    out["problem_list"] = lambda d: report.search(statuses=("FAIL", "WARNING", "ERROR"))
    out["document_info"] = lambda d: report.document_info()
    out["tag_tree"] = report.tag_tree
    out["inventory"] = lambda d: report.inventory()
    out["element_rows"] = report.elements
    out["metadata_sheet"] = lambda d: report.metadata_sheet(d)
    out["batch_summary"] = lambda d: report.batch_summary()
    out["totals"] = lambda d: report.totals()
    for standard, short in (("PDF/UA", "pdfua"), ("WCAG", "wcag"), ("Quality", "quality"), ("AI", "heuristics")):
        out[f"category_matrix_{short}"] = lambda d, s=standard: report.matrix(s)
    out["category_icons"] = lambda d: report.icons("PDF/UA")
    out["first_open_category"] = lambda d: report.first_open_category("PDF/UA")
    out["raw_categories"] = lambda d: report.raw_categories()
    out["score_bars"] = lambda d: report.score_bars()
    out["findings_rollup"] = lambda d: report.rollup()
    out["finding_search"] = lambda d: report.search("title", ("FAIL", "ERROR", "WARNING"))
    out["finding_drilldown"] = lambda d: report.search(standard="wcag", category="2.4 Navigable")
    out["problem_navigation"] = lambda d: report.problems()
    out["oracle_comparison"] = lambda d: report.comparison(report.engine_records(), ORACLE)
    out["drilldown_mapped"] = lambda d: report.search(standard="pdf/ua", category="Structure elements")
    out["drilldown_counts"] = lambda d: report.drilldown_counts()
    out["font_match"] = lambda d: report.font_match(ORACLE)
    out["merged_categories"] = lambda d: report.merged_categories()
    out["comparison_rollup"] = lambda d: report.comparison_rollup(report.engine_records(), ORACLE)
    return out


EVENT_OPS = "SELECT user_id AS doc_id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'tagged' WHEN 1 THEN 'artifact' WHEN 2 THEN 'close' WHEN 3 THEN 'close' WHEN 4 THEN 'text' WHEN 5 THEN 'paint' ELSE 'text' END AS op FROM $events"


def _plain() -> dict[str, Callable[[object], str]]:
    """Queries straight over the driver's tables."""
    inventory = lambda d: f"SELECT name, is_close, CAST(count(*) AS BIGINT) AS n FROM ({marks.html_tokens(d)}) t GROUP BY name, is_close"
    title = lambda d: d.replaced("html", r"(?is)^.*?<title>(.*?)</title>.*$", d.group(1))
    lang = lambda d: d.replaced("html", r"(?is)^.*?<html[^>]*lang=\"([^\"]*)\".*$", d.group(1))
    return {
        "html_tag_inventory": inventory,
        "html_frames": marks.html_frames,
        "html_structure": marks.html_nodes,
        "html_list_items": lambda d: f"SELECT n.page_id, n.opens, CAST(count(c.opens) AS BIGINT) AS children FROM ({marks.html_nodes(d)}) n LEFT JOIN ({marks.html_nodes(d)}) c ON c.page_id = n.page_id AND c.parent = n.opens WHERE n.role = 'L' GROUP BY n.page_id, n.opens",
        "html_title_language": lambda d: f"SELECT page_id, {title(d)} AS title, {lang(d)} AS lang FROM $pages WHERE html IS NOT NULL",
        "readability": lambda d: quality.readability_of(d, "SELECT doc_id, text AS txt FROM $documents WHERE text IS NOT NULL"),
        "mark_stack": lambda d: marks.marked_content(EVENT_OPS),
        "mark_stack_counts": lambda d: marks.operation_counts(EVENT_OPS),
    }


def _run_star(spark: SparkSession, sf_dir: str, text, standard: str | None = None) -> DataFrame:
    """standard: the one whose findings the text reads, where it reads no others."""
    sql = text(Spark())
    corpus = audited_corpus(spark, sf_dir, standard) if "findings" in tables_in(sql) else prepared_corpus(spark, sf_dir)
    return corpus.sql(sql)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = audited_corpus(spark, sf_dir)
    return compare.compared(corpus.sql(report.engine_records()), written(corpus.sql(ORACLE), "oracle"))


def _anomalies(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    """Flags come from nodes alone; what is read once is not written, and no step keeps the shuffle files of another."""
    corpus = prepared_corpus(spark, sf_dir, ("tree",))
    corpus.frames["flags"] = written(corpus.sql(derive.own_flags(corpus.dialect)), "flags")
    released(spark)
    return corpus.sql(text(corpus.dialect))


def _files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """PDF files made of the star projection's trees (a file a document) and read again from their bytes."""
    corpus = prepared_corpus(spark, sf_dir)
    return pdf.extracted(pdf_writer.tagged_files(corpus.sql("SELECT doc_id, pos, depth, tag, alt_text, title, row_span, col_span, text_content FROM $nodes WHERE tag <> 'StructTreeRoot'")))


def pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure elements that the PDF reader finds in those files."""
    return _files(spark, sf_dir)["nodes"].where("pos > 0").select("doc_id", "pos", "depth", "subtree_end", "tag", "alt_text", "title", "row_span", "col_span")


def pdf_marked_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked content that the PDF reader finds in those files."""
    return _files(spark, sf_dir)["page_mcids"].select("doc_id", "page_number", "mcid", "text")


def _said(c: Corpus) -> DataFrame:
    """Readable texts of all nodes."""
    return reading.texts(c.sql("SELECT * FROM $nf"))


def _shown(c: Corpus) -> DataFrame:
    """Findings that name a page, with what tells where on it they are."""
    return c.sql("SELECT doc_id, check_id, name, category, message, object_reference, evidence, page, x0, y0, x1, y1 FROM $findings WHERE page IS NOT NULL")


def _flat(df: DataFrame) -> DataFrame:
    """Boxes as four columns each."""
    cols = [[f"{n}.{x} AS {n}_{x}" for x in ("x0", "y0", "x1", "y1")] if k.startswith("struct") else [n] for n, k in df.dtypes]
    return df.selectExpr(*[x for c in cols for x in c])


#: Queries that are functions of a corpus; their oracles are written by hand (lectern.oracles).
PLACES = {
    "mark_boxes": locate.mark_boxes,
    "node_texts": locate.node_texts,
    "formula_islands": locate.formula_islands,
    "drawing_clusters": locate.drawing_clusters,
    "ruled_tables": locate.ruled_tables,
    "page_locators": lambda c: _flat(locate.page_locators(c)),
    "node_geometry": lambda c: locate.node_geometry(c, _said(c)),
    "figure_boxes": locate.figure_boxes,
    "text_evidence": lambda c: locate.text_evidence(c, _shown(c)),
    "located_findings": lambda c: locate.located(c, _shown(c), _said(c)),
}
#: Reports whose SQL takes the findings of one standard only.
OF_STANDARD = {"category_matrix_heuristics": "AI", "category_matrix_wcag": "WCAG"}
#: Those that read findings.
OF_FINDINGS = ("text_evidence", "located_findings")


#: What the files were made of, so what reading them must give: ranks of elements, and their texts
#: (content under an artifact's tag is none).
PDF_ORACLES = {
    "pdf_structure": "SELECT n.doc_id, n.pos, n.depth_in_file AS depth, n.subtree_end, n.tag, n.alt_text, n.title, n.row_span, n.col_span FROM (SELECT a.*, 1 + (SELECT count(*) FROM $nodes b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND a.pos <= b.subtree_end AND b.tag <> 'StructTreeRoot') AS depth_in_file FROM $nodes a) n WHERE n.tag <> 'StructTreeRoot'",
    "pdf_marked_content": "SELECT doc_id, 1 AS page_number, pos AS mcid, text_content AS text FROM $nodes WHERE tag NOT IN ('StructTreeRoot', 'Artifact')",
}


def _run_plain(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    sql = text(Spark())
    views = {}
    for t in tables_in(sql):
        views[t] = "lectern_plain_" + "".join(c if c.isalnum() else "_" for c in sf_dir) + t
        table(spark, sf_dir, t).createOrReplaceTempView(views[t])
    return spark.sql(bound(sql, views))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, text in _star().items():
        out[name] = lambda spark, sf_dir, t=text, s=OF_STANDARD.get(name): _run_star(spark, sf_dir, t, s)
    for name, text in _plain().items():
        out[name] = lambda spark, sf_dir, t=text: _run_plain(spark, sf_dir, t)
    for name, made in PLACES.items():
        corpus = audited_corpus if name in OF_FINDINGS else prepared_corpus
        out[name] = lambda spark, sf_dir, f=made, c=corpus: f(c(spark, sf_dir))
    out["reading_order"] = lambda spark, sf_dir: reading.reading(prepared_corpus(spark, sf_dir))
    out["reading_totals"] = lambda spark, sf_dir: reading.totals(reading.reading(prepared_corpus(spark, sf_dir)))
    out["reading_transcript"] = lambda spark, sf_dir: reading.transcript(reading.reading(prepared_corpus(spark, sf_dir)))
    out["pdf_structure"] = pdf_structure
    out["pdf_marked_content"] = pdf_marked_content
    out["decoding_anomalies"] = lambda spark, sf_dir, t=_star()["decoding_anomalies"]: _anomalies(spark, sf_dir, t)
    out["oracle_comparison"] = _compared
    out["comparison_rollup"] = lambda spark, sf_dir: compare.rolled_up(_compared(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    d = Duck()
    known = {**star.ENTITIES, "findings": findings_sql(d)}
    out = {name: ansi(text(d), known) for name, text in _star().items()}
    out |= {name: ansi(text, known) for name, text in (PDF_ORACLES | oracles.texts() | oracles.by_hand()).items()}
    return out | {name: bound(text(d), {t: t for t in tables_in(text(d))}) for name, text in _plain().items()}
