"""PDF files written by the format alone: tagged files of structure trees, and reports as pages of text."""

from __future__ import annotations

import textwrap
import zlib

import pandas as pd
from pyspark.sql import DataFrame


def text_string(x: str) -> bytes:
    """A text string of the format: UTF-16 behind its mark, in hexadecimal."""
    return b"<FEFF" + x.encode("utf-16-be").hex().encode() + b">"


def name(x: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#/()<>[]{}%" else b"#%02X" % c for c in x.encode("latin-1", "replace"))


def stream(data: bytes, more: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n" % (more, len(packed)) + packed + b"\nendstream"


def written(objects: dict[int, bytes], root: int = 1) -> bytes:
    """A file of numbered objects with its cross-reference table."""
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n" % size + b"0000000000 65535 f \n"
    out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, size))
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, start))


FONT = b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /ToUnicode 5 0 R >>"


def _codes(texts: list[str]) -> dict[str, int]:
    return {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}


def _cmap(codes: dict[str, int]) -> bytes:
    rows = [b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()]
    blocks = [rows[k : k + 100] for k in range(0, len(rows), 100)]
    return stream(b"\n".join(b"%d beginbfchar\n" % len(b) + b"\n".join(b) + b"\nendbfchar" for b in blocks))


def _shown(text: str, codes: dict[str, int]) -> bytes:
    return b"<" + b"".join(b"%04X" % codes[c] for c in text) + b"> Tj"


def tagged(nodes: pd.DataFrame) -> bytes:
    """A file of one page whose structure tree is nodes (pos, depth, tag, alt_text, title, row_span, col_span,
    text_content): each stands under the last one before it of a smaller depth, and marks its own text."""
    rows = list(nodes.sort_values("pos").itertuples())
    codes = _codes([r.text_content or "" for r in rows])
    number = {r.pos: 10 + i for i, r in enumerate(rows)}
    kids: dict[int, list[int]] = {0: []}
    parent: dict[int, int] = {}
    above: list = []
    for r in rows:
        while above and above[-1].depth >= r.depth:
            above.pop()
        parent[r.pos] = above[-1].pos if above else 0
        kids.setdefault(parent[r.pos], []).append(r.pos)
        above.append(r)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /StructTreeRoot 6 0 R /MarkInfo << /Marked true >> >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 7 0 R >> >> >>",
        4: stream(b"BT /F1 10 Tf\n" + b"\n".join(b"%s <</MCID %d>> BDC %s EMC" % (name(r.tag or "Span"), r.pos, _shown(r.text_content or "", codes)) for r in rows) + b"\nET"),
        5: _cmap(codes),
        6: b"<< /Type /StructTreeRoot /K [" + b" ".join(b"%d 0 R" % number[k] for k in kids[0]) + b"] >>",
        7: FONT,
    }
    for r in rows:
        more = b"".join(b" /%s %s" % (k, text_string(v)) for k, v in ((b"Alt", r.alt_text), (b"T", r.title)) if isinstance(v, str))
        inner = b" ".join([b"%d" % r.pos, *(b"%d 0 R" % number[k] for k in kids.get(r.pos, []))])
        up = number[parent[r.pos]] if parent[r.pos] else 6
        objects[number[r.pos]] = b"<< /Type /StructElem /S %s /P %d 0 R /Pg 3 0 R /K [%s]%s /A << /O /Table /RowSpan %d /ColSpan %d >> >>" % (name(r.tag or ""), up, inner, more, r.row_span, r.col_span)
    return written(objects)


def tagged_files(nodes: DataFrame) -> DataFrame:
    """doc_id, filename, content: a tagged file of each document's nodes."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        doc = f.doc_id.iloc[0]
        return pd.DataFrame({"doc_id": [doc], "filename": [f"{doc}.pdf"], "content": [tagged(f)]})

    return nodes.groupBy("doc_id").applyInPandas(one, "doc_id long, filename string, content binary")


def report(title: str, lines: list[str]) -> bytes:
    """Lines of text on pages of 60, wrapped at 95 characters."""
    flat = [w for x in [title, "", *lines] for w in (textwrap.wrap(x, 95) or [""])]
    sheets = [flat[k : k + 60] for k in range(0, len(flat), 60)]
    codes = _codes(flat)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Lang (en) /ViewerPreferences << /DisplayDocTitle true >> >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(sheets))) + b"] /Count %d /MediaBox [0 0 612 792] >>" % len(sheets), 5: _cmap(codes), 7: FONT}
    for i, sheet in enumerate(sheets):
        body = b"BT /F1 9 Tf 36 756 Td 12 TL\n" + b"\n".join(_shown(x, codes) + b" T*" for x in sheet) + b"\nET"
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 7 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(body)
    return written(dict(sorted(objects.items())))
