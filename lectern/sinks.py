"""Where reports go: JSON a document, CSV and HTML of findings, transcripts."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans import report
from lectern.plans.audit import Corpus
from lectern.schema import CATEGORIES, PROBLEMS
from lectern.sources import pdf_writer

VERSION = "0.1.0"
CSV_COLUMNS = ["check_id", "name", "category", "standard", "status", "severity", "message", "page", "object_reference", "items_count", "confidence", "evidence", "remediation"]

#: Buttons that show the rows of one status; FAIL does not show ERROR.
HTML_HEAD = (
    "<!DOCTYPE html><meta charset='utf-8'><title>Audit</title><p>"
    + "".join(f"<button onclick=\"show('{s}')\">{s}</button>" for s in ("ALL", "FAIL", "WARNING", "MANUAL REVIEW", "PASS"))
    + "</p><script>function show(s){document.querySelectorAll('tr[data-status]').forEach(r=>{r.hidden=s!='ALL'&&r.dataset.status!=s})}</script>"
)


def json_reports(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """doc_id and one JSON text a document: document, summary, category_breakdown of the four standards, findings.

    summary.total_checks is the number of findings here; the item total is items_total."""
    corpus.frames["findings"] = findings
    corpus._views.pop("findings", None)
    totals = corpus.sql(report.totals())
    summary = totals.select("doc_id", F.struct(F.col("findings_count").alias("total_checks"), F.col("total_checks").alias("items_total"), "passed", "warned", "failed", F.col("manual").alias("manual_review"), "not_applicable", "compliance_score").alias("summary"))
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    listed = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "branch", "pos", *CSV_COLUMNS, box.alias("bounding_box")))).alias("findings"))
    whole = corpus.frames["documents"].select("doc_id", F.struct("filename", "title", "page_count", "language", "is_tagged").alias("document")).join(summary, "doc_id").join(listed, "doc_id", "left")
    for standard in CATEGORIES:
        rows = corpus.sql(report.matrix(standard)).groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("ord", "category", "passed", "warned", "failed", "manual"))).alias(standard))
        whole = whole.join(rows, F.col("doc_id") == F.col("of"), "left").drop("of")
    breakdown = F.struct(*[F.col(f"`{c}`") for c in CATEGORIES])
    return whole.select("doc_id", F.to_json(F.struct(F.lit("lectern").alias("application"), F.lit(VERSION).alias("version"), "document", "summary", breakdown.alias("category_breakdown"), "findings")).alias("report"))


def diagnostics(corpus: Corpus) -> DataFrame:
    """doc_id and a JSON text of what was read: the document's facts, elements (the root counted), and pages with their first 20 marks."""
    marks = corpus.frames["page_mcids"].groupBy("doc_id", "page_number").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "mcid"))), lambda x: x["mcid"]), 1, 20).alias("mcids"))
    pages = corpus.frames["pages"].join(marks, ["doc_id", "page_number"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "width", "height", "tab_order_mode", "struct_parents_id", "mcids"))).alias("pages"))
    nodes = corpus.frames["nodes"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_elements"))
    facts = corpus.frames["documents"]
    whole = facts.select("doc_id", F.struct(*[c for c in facts.columns if c != "doc_id"]).alias("document")).join(nodes, "doc_id", "left").join(pages, "doc_id", "left")
    return whole.select("doc_id", F.to_json(F.struct("document", F.struct(F.coalesce("total_elements", F.lit(0)).alias("total_elements")).alias("structure"), "pages")).alias("dump"))


def regression_report(compared: DataFrame, mismatches: int = 30) -> tuple[str, str]:
    """The comparison of engine and oracle as JSON and Markdown: counts by class, by category and class, and
    the first mismatches.  What comes to the driver is as large as the categories, not as the records."""
    kinds = compared.groupBy("category", "classification").count().collect()
    total: dict[str, int] = {}
    by: dict[str, dict[str, int]] = {}
    for r in kinds:
        total[r.classification] = total.get(r.classification, 0) + r["count"]
        by.setdefault(r.category, {})[r.classification] = r["count"]
    first = compared.where("classification != 'MATCH' and classification != 'ENGINE_ONLY'").orderBy("doc_id", "category", "check_name", "page", "classification").limit(mismatches).collect()
    data = {"totals": dict(sorted(total.items())), "categories": {k: dict(sorted(v.items())) for k, v in sorted(by.items())}, "mismatches": [r.asDict() for r in first]}
    lines = ["# Regression report", "", "| Class | Records |", "|---|---|", *(f"| {k} | {v} |" for k, v in data["totals"].items()), "", "| Category | Class | Records |", "|---|---|---|"]
    lines += [f"| {c} | {k} | {n} |" for c, v in data["categories"].items() for k, n in v.items()]
    lines += ["", "| Document | Page | Check | Class | Oracle | Engine |", "|---|---|---|---|---|---|"]
    lines += [f"| {r.doc_id} | {r.page or 'Doc'} | {r.check_name} | {r.classification} | {r.oracle_status or ''} | {r.engine_status or ''} |" for r in first]
    return json.dumps(data, ensure_ascii=False, indent=1), "\n".join(lines) + "\n"


def pdf_reports(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """doc_id and a PDF file a document: its totals, and its problems in order."""
    corpus.frames["findings"] = findings
    corpus._views.pop("findings", None)
    listed = findings.where(F.col("status").isin(*PROBLEMS)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", "branch", "pos", F.concat_ws("  ", "status", "severity", "check_id", F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("-"))), "message").alias("line")))), lambda x: x["line"]).alias("lines"))
    whole = corpus.sql(report.totals()).select("doc_id", "passed", "warned", "failed", "compliance_score").join(corpus.frames["documents"].select("doc_id", "filename"), "doc_id").join(listed, "doc_id", "left")

    def run(frames):
        for f in frames:
            files = [pdf_writer.report(f"Audit of {r.filename}", [f"Passed {r.passed}, warnings {r.warned}, failed {r.failed}, score {r.compliance_score}", "", *(r.lines if r.lines is not None else [])]) for r in f.itertuples()]
            yield pd.DataFrame({"doc_id": f.doc_id, "content": files})

    return whole.mapInPandas(run, "doc_id long, content binary")


def write_csv(findings: DataFrame, path: str) -> None:
    """CSV for spreadsheet programs, in one file a partition, each with a header that begins with the mark they look for;
    no page is "Doc".  For one file, give findings in one partition."""
    page = F.when(F.coalesce(F.col("page"), F.lit(0)) == 0, "Doc").otherwise(F.col("page").cast("string"))
    rows = findings.select(*[(page.alias("page") if c == "page" else F.col(c)) for c in CSV_COLUMNS])
    rows.withColumnRenamed(CSV_COLUMNS[0], "﻿" + CSV_COLUMNS[0]).write.mode("overwrite").option("header", True).csv(path)


def html_rows(findings: DataFrame) -> DataFrame:
    """doc_id and a document's findings as an HTML table, escaped, made where the rows are."""
    cell = lambda c: F.concat(F.lit("<td>"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), F.lit("</td>"))
    row = F.concat(F.lit("<tr data-status='"), "status", F.lit("'>"), *[cell(c) for c in CSV_COLUMNS], F.lit("</tr>"))
    head = HTML_HEAD + "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in CSV_COLUMNS) + "</tr>"
    body = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "branch", "pos", row.alias("row")))).alias("rows"))
    return body.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table>")).alias("html"))
