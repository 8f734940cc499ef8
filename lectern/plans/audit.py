"""The audit: entities in, findings out, for all documents at once."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, PySparkException, PythonException, SparkRuntimeException, UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.sql import Duck, Spark, bound, quoted, tables_in
from lectern.operators import pdfua, quality, wcag
from lectern.operators.base import COLUMNS
from lectern.schema import BOXED, ENTITIES, ERROR, HIGH, REMEDIES, RULES, Rule

from .derive import derived
from .stage import held, released

EVALUATORS = {**pdfua.RULES, **wcag.RULES, **quality.RULES}
#: Columns of findings.
FINDINGS = "doc_id, rule_ord, check_id, name, category, standard, branch, pos, status, severity, items_count, page, object_reference, confidence, machine_testable, manual_review_required, message, evidence, remediation, x0, y0, x1, y1"

FINDINGS_SCHEMA = "doc_id long, rule_ord int, check_id string, name string, category string, standard string, branch int, pos long, status string, severity string, items_count long, page int, object_reference string, confidence double, machine_testable boolean, manual_review_required boolean, message string, evidence string, remediation string, x0 double, y0 double, x1 double, y1 double"


#: Characters of SQL up to which branches of a rule share a job: what the driver holds for a plan grows with it.
JOB_TEXT = 4000


#: Whether a join deals out again what is dealt by some of its keys only.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def rule_sql(d, check_id: str, selects: list[str] | None = None) -> str | None:
    """The findings of a rule (of some of its branches, where selects names them) as one SELECT over entities, or None for a rule that emits nothing."""
    selects = selects or EVALUATORS[check_id](d)
    if not selects:
        return None
    r: Rule = RULES[check_id]
    union = " UNION ALL ".join(f"SELECT {COLUMNS} FROM ({s}) r{i}" for i, s in enumerate(selects))
    # What a rule does not quote is told by where the finding stands.
    place = "CASE WHEN object_reference IS NOT NULL AND page IS NOT NULL THEN concat(object_reference, ', page ', CAST(page AS STRING)) WHEN object_reference IS NOT NULL THEN object_reference WHEN page IS NOT NULL THEN concat('Page ', CAST(page AS STRING)) ELSE concat('Items: ', CAST(items_count AS STRING)) END"
    box = ", ".join(f"{'b.' + x if check_id in BOXED else 'CAST(NULL AS DOUBLE)'} AS {x}" for x in ("x0", "y0", "x1", "y1"))
    named = d.replaced("u.object_reference", "^.*id='([^']*)'.*$", d.group(1))
    boxes = f" LEFT JOIN $node_boxes b ON b.doc_id = u.doc_id AND b.node_id = {named} AND u.status <> 'PASS'" if check_id in BOXED else ""
    return (
        f"SELECT u.doc_id, {r.ord} AS rule_ord, {quoted(r.check_id)} AS check_id, {quoted(r.name)} AS name, {quoted(r.category)} AS category, {quoted(r.standard)} AS standard, branch, pos, status, coalesce(severity, {quoted(r.severity)}) AS severity, "
        f"items_count, page, object_reference, confidence, {str(r.machine_testable).lower()} AND NOT manual AS machine_testable, manual AS manual_review_required, message, coalesce(evidence, {place}) AS evidence, "
        f"CASE WHEN status IN ('PASS', 'NOT APPLICABLE') THEN CAST(NULL AS STRING) ELSE {quoted(REMEDIES[check_id])} END AS remediation, {box} FROM ({union}) u{boxes}"
    )


def rule_parts(d, check_id: str) -> list[str]:
    """The findings of a rule as SELECTs that together hold all its branches, each once; long branches stand alone."""
    parts: list[list[str]] = []
    for select in EVALUATORS[check_id](d) or []:
        if parts and sum(map(len, parts[-1])) + len(select) <= JOB_TEXT:
            parts[-1].append(select)
        else:
            parts.append([select])
    return [rule_sql(d, check_id, part) for part in parts]


class Corpus:
    """Entity tables of any number of documents, as DataFrames; derived tables are views over them."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        self.spark, self.dialect = spark, Spark()
        self.frames = dict(frames)
        for name, schema in ENTITIES.items():
            if name not in self.frames:
                self.frames[name] = spark.createDataFrame([], schema)
        self._derived = derived(self.dialect)
        self._views: dict[str, str] = {}
        self._mark = uuid.uuid4().hex[:12]

    def view(self, name: str) -> str:
        """The temporary view of an entity or derived table."""
        if name not in self._views:
            frame = self.frames[name] if name in self.frames else self.sql(self._derived[name])
            self._views[name] = f"lectern_{self._mark}_{name}"
            frame.createOrReplaceTempView(self._views[name])
        return self._views[name]

    def sql(self, text: str) -> DataFrame:
        """A SELECT over entities and derived tables ($name); Spark has no word for the second engine's MATERIALIZED."""
        text = text.replace(" AS MATERIALIZED (", " AS (")
        return self.spark.sql(bound(text, {t: self.view(t) for t in tables_in(text)}))

    def names(self, rules: list[str]) -> list[str]:
        """Tables to have views of before rules are evaluated side by side."""
        return [*self.frames, *self._derived]

    def rule(self, check_id: str) -> DataFrame | None:
        text = rule_sql(self.dialect, check_id)
        return None if text is None else self.sql(text)

    def audited(self, path: str, rules: list[str] | None = None, custom: dict | None = None, threads: int = 4, adaptive: bool = True, bucketed: bool = False) -> DataFrame:
        """All findings of the rules (all by default) and of custom ones (check_id -> function of the corpus).

        Each rule writes its part of a findings table under path, a few rules at a time, in a job or, where
        its text is long, several: one plan of all rules would take longer to plan than to run, and this
        way a rule that fails, in planning or evaluation, gives an ERROR finding a document and harms no
        other.  Garbage is collected after each job, so that the driver's heap stays near what one plan
        takes.  What is no fault of a rule (lost executors, full disks, memory) fails the whole audit.

        adaptive: false plans each job once (the driver then holds no new plans, threads and metrics for
        every stage of it).  bucketed: tables stand in buckets by document, which is then enough for joins that
        ask for more than the document (most rules become one stage), and no table goes through the driver.
        The session's settings come back at the end."""
        names = self.names(rules if rules is not None else list(RULES))
        with held(self.spark, {CO_PARTITION: "false"} if bucketed else {}), ThreadPoolExecutor(threads) as pool:
            list(pool.map(self.view, names))

        def work(check_id: str, evaluate, r: Rule) -> None:
            part = f"{path}/{r.ord:03d}"
            try:
                for k, found in enumerate(evaluate()):
                    if found is not None:
                        found.select(*FINDINGS.split(", ")).write.mode("append" if k else "overwrite").parquet(part)
                    del found
                    released(self.spark)
            except Exception as e:
                if not _of_the_rule(e):
                    raise
                self._error(r, e).select(*FINDINGS.split(", ")).write.mode("overwrite").parquet(part)

        jobs = [(c, lambda c=c: map(self.sql, rule_parts(self.dialect, c)), RULES[c]) for c in (rules if rules is not None else RULES)]
        jobs += [(c, lambda f=f: [f(self)], Rule(len(RULES) + 1 + k, c, c, "Custom", "Custom", HIGH)) for k, (c, f) in enumerate((custom or {}).items())]
        settings = {} if adaptive else {"spark.sql.adaptive.enabled": "false"}
        settings |= {CO_PARTITION: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"} if bucketed else {}
        with held(self.spark, settings), ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda j: work(*j), jobs))
        return self.spark.read.schema(FINDINGS_SCHEMA).parquet(f"{path}/*")

    def _error(self, r: Rule, e: Exception) -> DataFrame:
        values = {"rule_ord": F.lit(r.ord), "check_id": F.lit(r.check_id), "name": F.lit(r.name), "category": F.lit(r.category), "standard": F.lit(r.standard), "branch": F.lit(0), "pos": F.lit(0).cast("long"), "status": F.lit(ERROR), "severity": F.lit(HIGH), "items_count": F.lit(1).cast("long"), "page": F.lit(None).cast("int"), "object_reference": F.lit(None).cast("string"), "confidence": F.lit(0.5), "machine_testable": F.lit(True), "manual_review_required": F.lit(False), "message": F.lit(f"The rule could not be evaluated: {str(e)[:200]}"), "evidence": F.lit(type(e).__name__), "remediation": F.lit("Report the error and evaluate the document again."), **{x: F.lit(None).cast("double") for x in ("x0", "y0", "x1", "y1")}}
        return self.frames["documents"].select("doc_id", *[v.alias(k) for k, v in values.items()])


#: What Spark raises where an expression cannot be planned or evaluated, and its JVM names inside failed jobs.
RULE_ERRORS = (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException, UnsupportedOperationException)
RULE_CAUSES = re.compile(r"\b(AnalysisException|Spark(Arithmetic|ArrayIndexOutOfBounds|DateTime|IllegalArgument|NumberFormat|Runtime|UnsupportedOperation)Exception|PythonException|ArithmeticException|NumberFormatException)\b")
OTHER_CAUSES = re.compile(r"ExecutorLostFailure|OutOfMemoryError|No space left|FetchFailed|IOException|FileNotFoundException|TaskKilled|SparkContext was shut down")


def _of_the_rule(e: Exception) -> bool:
    """Whether evaluating the rule failed, and not what it ran on."""
    said = str(e)
    if OTHER_CAUSES.search(said):
        return False
    if isinstance(e, RULE_ERRORS):
        return True
    if isinstance(e, (PySparkException, Py4JError)):
        return bool(RULE_CAUSES.search(said))
    return not isinstance(e, (OSError, MemoryError))


def ansi(text: str, entities: dict[str, str], base: tuple[str, ...] = ()) -> str:
    """text as a self-contained query for an ANSI engine: its tables, and theirs, as common table expressions.

    entities: SQL of entity tables over base tables ($name of base tables stay plain names)."""
    known = {**derived(Duck()), **entities}
    order: list[str] = []

    def need(sql: str) -> None:
        for t in tables_in(sql):
            if t in known and t not in order:
                need(known[t])
                if t not in order:
                    order.append(t)
            elif t not in known and t in ENTITIES:
                raise KeyError(t)

    need(text)
    named = {t: (f"e_{t}" if t in known else t) for t in [*known, *tables_in(text), *(x for k in order for x in tables_in(known[k]))]}
    if text.lstrip().upper().startswith("WITH"):
        text = f"SELECT * FROM ({text}) whole"
    ctes = ", ".join(f"e_{t} AS ({bound(known[t], named)})" for t in order)
    return (f"WITH {ctes} " if ctes else "") + bound(text, named)
