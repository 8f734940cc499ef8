"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each derivative has an id of its own, names the response it came from in WARC-Refers-To, keeps the
response's URI and date, and carries digests of its own block.  The metadata record's JSON holds the
source's WARC and HTTP headers and digests, and the page's title, language and links; the conversion
record, which only textual responses have, holds the page's visible text.  Ids are drawn from content, so a task that runs again writes
the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import Page

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: The date of responses whose capture time the source table does not hold.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, payload_digest string, header string, block string"


def sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(of))}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def lines(fields: list[tuple[str, str]]) -> str:
    return VERSION + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields)


def parse_header(header: str) -> list[tuple[str, str]]:
    """Named fields of a WARC or HTTP header, in order; folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in header.replace(CRLF, "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def grouped(fields: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Fields by name, all of them: the values of a name that repeats stand in a list, in order."""
    out: dict[str, str | list[str]] = {}
    for k, v in fields:
        have = out.get(k)
        out[k] = v if have is None else [*have, v] if isinstance(have, list) else [have, v]
    return out


def _unchunked(body: bytes) -> bytes:
    """The body of chunks; what does not look like chunks stays as it is."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(out) if out else body
        if size == 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decoded(payload: bytes, fields: list[tuple[str, str]]) -> bytes | None:
    """A payload without its transfer and content encodings, the last one first; None where one is not known or broken."""
    said = lambda name: [x.strip().lower() for k, v in fields if k.lower() == name for x in v.split(",") if x.strip()]
    for encoding in reversed([*said("content-encoding"), *said("transfer-encoding")]):
        try:
            if encoding == "chunked":
                payload = _unchunked(payload)
            elif encoding in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(31).decompress(payload)
            elif encoding == "deflate":
                payload = zlib.decompressobj(15 if payload[:1] == b"\x78" else -15).decompress(payload)
            elif encoding != "identity":
                return None
        except zlib.error:
            return None
    return payload


def textual(kind: str, payload: bytes) -> str | None:
    """html, plain or None: what a payload of this type is; without a type, what it looks like."""
    mime = kind.partition(";")[0].strip().lower()
    if mime in ("text/html", "application/xhtml+xml") or not mime and b"\0" not in payload:
        return "html"
    return "plain" if mime.startswith("text/") or mime in ("application/json", "application/xml") or mime.endswith(("+xml", "+json")) else None


def response(page_id: int | None, url: str | None, body: str | None, date: str | None = None) -> tuple[str, bytes]:
    """The response record of a captured page: WARC header and HTTP message."""
    payload = (body or "").encode()
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload
    uri = _clean(url or "")
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), uri, sha1(payload))), ("WARC-Target-URI", uri), ("WARC-Date", date or NO_DATE), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(http)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
    return lines(fields), http


def derivatives(header: str, block: bytes) -> list[tuple]:
    """The metadata record of one response, and of a textual one the conversion record, in the columns of RECORD after page_id.

    The text is that of the body without its transfer and content encodings; digests and lengths are
    those of the payload as it was captured."""
    source = parse_header(header)
    get = {k.lower(): v for k, v in source}
    head, _, payload = block.partition(b"\r\n\r\n")
    http = head.decode("utf-8", "replace")
    fields = parse_header(http)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    charset = kind.lower().partition("charset=")[2].partition(";")[0].strip("\"' ;") or "utf-8"
    body = decoded(payload, fields)
    form = None if body is None else textual(kind, body)
    try:
        text = body.decode(charset, "replace") if form else ""
    except LookupError:
        text = body.decode("utf-8", "replace")
    page = Page(text if form == "html" else "", links=True)
    ref, uri, date = get.get("warc-record-id", ""), get.get("warc-target-uri", ""), get.get("warc-date", NO_DATE)
    digest = get.get("warc-payload-digest") or sha1(payload)
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Length": str(len(header.encode())),
            "Block-Digest": get.get("warc-block-digest") or sha1(block),
            "Actual-Content-Length": str(len(block)),
            "WARC-Header-Metadata": grouped(source),
            "Payload-Metadata": {
                "Actual-Content-Type": kind,
                "HTTP-Response-Metadata": {
                    "Response-Message": dict(zip(("Version", "Status", "Reason"), http.split(CRLF, 1)[0].split(" ", 2))),
                    "Headers": grouped(fields),
                    "Entity-Digest": digest,
                    "Entity-Length": str(len(payload)),
                    "HTML-Metadata": {"Head": {"Title": page.title, "Language": page.lang}, "Links": [{"path": "A@/href", "url": u} for u, _ in page.links]},
                },
            },
        }
    }
    made = []
    derived = [("metadata", "application/json", json.dumps(envelope, ensure_ascii=False))]
    if form:
        derived.append(("conversion", "text/plain", text if form == "plain" else "\n".join(b for b, _ in page.blocks)))
    for what, mime, content in derived:
        raw = content.encode()
        own, mark = record_id(what, ref, digest), sha1(raw)
        out = [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", ref), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", mark)]
        if what == "conversion" and page.lang:
            out.append(("WARC-Identified-Content-Language", _clean(page.lang)))
        out += [("Content-Type", mime), ("Content-Length", str(len(raw)))]
        made.append((what, own, ref, uri, mime, len(raw), mark, digest, lines(out), content))
    return made


_KINDS = [pa.int64(), *[pa.string()] * 5, pa.int64(), *[pa.string()] * 4]
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=_NAMES)


def built(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Two rows, a metadata and a conversion record, for every row of pages (columns as in RECORD).

    header and block are the records' own; refers_to is the response's id, payload_digest the
    response's.  A null page is a response without a body: its conversion is empty.  A null url gives
    an empty target URI; a null id stays null; equal rows give equal records; an empty table gives
    none; other columns are not read.  Nothing is shuffled."""
    date = F.lit(None).cast("string") if date_col is None else F.col(date_col).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, url, body, day in zip(*(c for c in b.columns)):
                rows += [(i.as_py(), *r) for r in derivatives(*response(i.as_py(), url.as_py(), body.as_py(), day.as_py()))]
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), date.alias("date"))
    return src.mapInArrow(run, RECORD)


def records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, block) of the records of a WARC file, gzipped by record or whole, or plain."""
    f: io.BufferedIOBase = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    f = io.BufferedReader(f)
    while line := f.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := f.readline()).strip():
            head.append(line)
        header = b"".join(head).decode("utf-8", "replace")
        size = next((int(v) for k, v in parse_header(header) if k.lower() == "content-length" and v.isdigit()), 0)
        yield header, f.read(size)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Derivatives of the response records in the WARC files under path (page_id is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                for header, block in records(data.as_py()):
                    if dict(parse_header(header)).get("WARC-Type") == "response":
                        rows += [(None, *r) for r in derivatives(header, block)]
                    if len(rows) >= 1000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def written(derived: DataFrame, path: str) -> None:
    """Write records as WARC files through Spark's own writer, a gzipped file a partition; a record ends with two CRLF and nothing else."""
    whole = F.concat("header", F.lit(CRLF), "block", F.lit(CRLF))
    derived.select(whole.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF).text(path)
