"""How rules emit findings: plain rows, rows up to a cap with a remainder, and per-document rows.

A rule is a function of the dialect that returns SELECTs in the columns of COLUMNS; their union is
the rule.  `branch` and `pos` give the order inside the rule.  `evidence` is what was
read, where a rule has something to quote; findings without it say where they stand (plans.audit)."""

from __future__ import annotations

from lectern.functions.sql import quoted

COLUMNS = "doc_id, branch, pos, status, severity, items_count, page, object_reference, confidence, manual, message, evidence"
NO_PAGE, NO_REF = "CAST(NULL AS INT)", "CAST(NULL AS STRING)"


def rows(source: str, status: str, message: str, where: str = "true", items: str = "1", page: str = NO_PAGE, ref: str = NO_REF, severity: str | None = None, confidence: str = "1.0", branch: int = 0, pos: str = "0", manual: bool = False, evidence: str = NO_REF) -> str:
    """A finding for each row of source (a table or a bracketed SELECT with doc_id)."""
    sev = quoted(severity) if severity and not severity.startswith("(") else severity or "CAST(NULL AS STRING)"
    state = status if status.startswith("(") else quoted(status)
    return (
        f"SELECT s.doc_id, {branch} AS branch, CAST({pos} AS BIGINT) AS pos, {state} AS status, {sev} AS severity, CAST({items} AS BIGINT) AS items_count, CAST({page} AS INT) AS page, "
        f"{ref} AS object_reference, CAST({confidence} AS DOUBLE) AS confidence, {str(manual).lower()} AS manual, {quoted(message)} AS message, {evidence} AS evidence FROM {source} s WHERE {where}"
    )


def capped(found: str, status: str, message: str, k: int, rest: str | None = "sum", branch: int = 0, severity: str | None = None, confidence: str = "1.0", rest_confidence: str = "1.0", items: str = "1", rest_page: bool = False, evidence: str = NO_REF) -> list[str]:
    """The first k rows of found (doc_id, pos, page, ref) of each document, and what becomes of the rest.

    evidence: of the first k.  rest: "sum", one more row with the rest's number; "one", one more row; None, nothing."""
    ranked = f"(SELECT f.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.pos) AS rn, count(*) OVER (PARTITION BY f.doc_id) AS cnt FROM ({found}) f)"
    if not rest:
        return [rows(ranked, status, message, f"s.rn <= {k}", items, "s.page", "s.ref", severity, confidence, branch, "s.rn", evidence=evidence)]
    # The rest's row is made of the first row beyond the cap, so found is worked out once.
    one = lambda x, y: f"CASE WHEN s.rn <= {k} THEN {x} ELSE {y} END"
    left = f"(s.cnt - {k})" if rest == "sum" else "1"
    text = rows(ranked, status, message, f"s.rn <= {k + 1}", one(items, left if items == "1" else f"{left} * ({items})"), one("s.page", "s.page" if rest_page else NO_PAGE), one("s.ref", NO_REF), severity, one(confidence, rest_confidence), branch, "s.rn", evidence=one(evidence, NO_REF))
    return [text.replace(f"{quoted(message)} AS message", f"{one(quoted(message), quoted('Further elements: ' + message))} AS message")]


def counted(docs: str, *found: str) -> str:
    """docs (a SELECT with doc_id) with n0, n1, ...: how many rows each of found has for the document."""
    joins = "".join(f" LEFT JOIN (SELECT doc_id, count(*) AS c FROM ({f}) f{i} GROUP BY doc_id) c{i} ON c{i}.doc_id = g.doc_id" for i, f in enumerate(found))
    counts = ", ".join(f"coalesce(c{i}.c, 0) AS n{i}" for i in range(len(found)))
    return f"(SELECT g.*, {counts} FROM ({docs}) g{joins})"


DOCS = "SELECT * FROM $documents"
WITH_TREE = "SELECT * FROM $documents WHERE has_structure_tree"
TAGGED_TREE = "SELECT * FROM $documents WHERE has_structure_tree AND is_tagged"
NAMED = "concat('<', s.tag, ' id=''', s.node_id, '''>')"
