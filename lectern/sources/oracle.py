"""Oracle records from spreadsheets (.xlsx): a zip of XML, first sheet, shared strings resolved."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "pdf_id string, page int, category string, check_name string, status string, ord int"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> list[list[str]]:
    """Cells of the first sheet as text, by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        rows = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                col = k
                if letters:
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    col -= 1
                v, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_NS}t")) if inline is not None else (v.text or "") if v is not None else ""
                cells[col] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def oracle_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all spreadsheets under path: id, page (null if not a number), category, check, status.

    The header row and rows of fewer than five cells or no id are left out; INFO and MANUAL REVIEW are warnings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f.content:
                rows = [r for r in sheet_rows(data)[1:] if len(r) >= 5 and r[0].strip()]
                status = [{"INFO": "WARNING", "MANUAL REVIEW": "WARNING"}.get(s := r[4].strip().upper(), s) for r in rows]
                pages = pd.array([int(float(r[1])) if re.fullmatch(r"\s*\d+(\.0*)?\s*", r[1]) else None for r in rows], dtype="Int32")
                yield pd.DataFrame({"pdf_id": [r[0].strip() for r in rows], "page": pages, "category": [r[2].strip() for r in rows], "check_name": [r[3].strip() for r in rows], "status": status, "ord": range(len(rows))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInPandas(run, SCHEMA)


REFERENCE = "pdf_id string, page int, category string, check_name string, status string, severity string, ord int"


def reference_records(spark: SparkSession, path: str) -> DataFrame:
    """The same records as they stand in the sheets, statuses only upper-cased, with the severity of a sixth cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f.content:
                rows = [r for r in sheet_rows(data)[1:] if len(r) >= 5 and r[0].strip()]
                pages = pd.array([int(float(r[1])) if re.fullmatch(r"\s*\d+(\.0*)?\s*", r[1]) else None for r in rows], dtype="Int32")
                cell = lambda k: [r[k].strip() if len(r) > k else "" for r in rows]
                yield pd.DataFrame({"pdf_id": cell(0), "page": pages, "category": cell(2), "check_name": cell(3), "status": [x.upper() for x in cell(4)], "severity": cell(5), "ord": range(len(rows))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInPandas(run, REFERENCE)
