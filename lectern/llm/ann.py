"""Largest inner products by score-aware quantisation: four-bit tables, then exact reranking.

A vector is coded in four bits for each of its subspaces of DIMS dimensions.  Codewords and codes
minimise the anisotropic loss: the residual's part along the vector itself weighs ETA times the part
across it, since for a query with a large inner product only the former changes the score much.  What
the code leaves is coded FINER times more, in 16 even levels of its own largest component, so that
rows which share a code (dense groups, near copies) still differ.  A scan decodes a block of codes
once and multiplies it with a block of queries; the best scanned candidates are scored exactly on the
original vectors.

Only codes travel to the scans (half a byte a component and step): a task holds one block of queries, the codes
of at most PART vectors stream past it, and the KEEP best of each query go on as row numbers.  Those
alone are joined with their vectors for reranking.  Every code is scanned for every query, as recall
asks where vectors do not cluster; so work grows with queries times vectors, but no task, row or
message grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Production parameters.
TOP = 20
DIMS = 1
FINER = 2
ETA = 2.5
SAMPLE = 5_000
ROUNDS = 6
BLOCK = 1024
QUERIES = 4096
PART = 4_000_000
KEEP = 128
QUERY_EVERY = 20
#: Codebooks (128 bytes a dimension, for each length of vectors) go out by broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20
#: Keys of query blocks go out by broadcast up to so many.
BROADCAST_BLOCKS = 1_000_000


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of vectors that are not null, empty or zero and whose components are all finite numbers."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def _padded(x: np.ndarray, dims: int) -> np.ndarray:
    lack = -x.shape[1] % dims
    return np.pad(x, ((0, 0), (0, lack))) if lack else x


def train(sample: np.ndarray, dims: int = DIMS, eta: float = ETA, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Codebooks (subspaces, 16, dims) by alternating assignment and weighted least squares."""
    x = _padded(sample, dims)
    parts = x.reshape(len(x), -1, dims)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    units = unit.reshape(parts.shape)
    rng = np.random.default_rng(seed)
    books = np.stack([parts[rng.permutation(len(x))[np.arange(16) % len(x)], m] for m in range(parts.shape[1])])
    books = books + rng.normal(scale=1e-6, size=books.shape)
    codes = encode(x, books, 1.0)
    for _ in range(rounds):
        # For one codeword, all else fixed: minimise sum |r|^2 + (eta - 1) (r . u)^2 over its members.
        along = (x * unit).sum(1) - np.einsum("nmd,nmd->n", units, books[np.arange(books.shape[0]), codes])
        for m in range(books.shape[0]):
            u, own = units[:, m], (units[:, m] * books[m][codes[:, m]]).sum(1)
            for k in range(16):
                at = codes[:, m] == k
                if not at.any():
                    continue
                uk = u[at]
                lhs = at.sum() * np.eye(dims) + (eta - 1) * uk.T @ uk
                rhs = parts[at, m].sum(0) + (eta - 1) * (uk * (along[at] + own[at])[:, None]).sum(0)
                books[m, k] = np.linalg.solve(lhs, rhs)
            along += own - (u * books[m][codes[:, m]]).sum(1)
        codes = encode(x, books, eta)
    return books


def encode(x: np.ndarray, books: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
    x = _padded(x, books.shape[2])
    parts = x.reshape(len(x), *books.shape[::2])
    units = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
    plain = np.stack([((parts[:, m, None] - books[m]) ** 2).sum(2) for m in range(books.shape[0])], 1)
    codes = plain.argmin(2)
    if eta == 1.0:
        return codes.astype(np.uint8)
    shift = np.stack([((parts[:, m, None] - books[m]) * units[:, m, None]).sum(2) for m in range(books.shape[0])], 1)
    along = np.take_along_axis(shift, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(books.shape[0]):
            rest = along - np.take_along_axis(shift[:, m], codes[:, m, None], 1)[:, 0]
            codes[:, m] = (plain[:, m] + (eta - 1) * (rest[:, None] + shift[:, m]) ** 2).argmin(1)
            along = rest + np.take_along_axis(shift[:, m], codes[:, m, None], 1)[:, 0]
    return codes.astype(np.uint8)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: np.ndarray, m: int) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :m]


def coded(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Bytes (rows, width): the codes, then for each of FINER steps a scale and what the steps before leave, in 16 even levels of it."""
    x = _padded(x, books.shape[2])
    codes = encode(x, books)
    parts = [pack(codes)]
    rest = x - books[np.arange(len(books)), codes].reshape(x.shape)
    for _ in range(FINER):
        scale = np.clip(np.abs(rest).max(axis=1, keepdims=True), 1e-30, 1e30).astype(np.float32)
        level = np.clip(np.rint((rest / scale + 1) * 7.5), 0, 15).astype(np.uint8)
        rest = rest - (level / 7.5 - 1) * scale
        parts += [scale.view(np.uint8), pack(level)]
    return np.hstack(parts)


def decoded(rows: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors (rows, dimensions) that coded bytes stand for."""
    m, dims = len(books), books.shape[0] * books.shape[2]
    at = -(-m // 2)
    out = books.astype(np.float32)[np.arange(m), unpack(rows[:, :at], m)].reshape(len(rows), -1)
    for _ in range(FINER):
        scale = np.ascontiguousarray(rows[:, at : at + 4]).view(np.float32)
        half = -(-dims // 2)
        out += (unpack(rows[:, at + 4 : at + 4 + half], dims) * np.float32(1 / 7.5) - 1) * scale
        at += 4 + half
    return out


def scan(queries: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) with decoded vectors."""
    return _padded(queries, found.shape[1]).astype(np.float32) @ found.T


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += query[d] * rows[:, d]
    return total


class Scan:
    """The best candidates of one block of queries, while codes stream past."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, books: np.ndarray, keep: int):
        # A query's own scale changes nothing in its order, and keeps its tables within four bytes.
        self.qid, self.q, self.books, self.keep = qid, q / np.abs(q).max(axis=1, keepdims=True), books, keep
        self.rid, self.score = np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, rid: np.ndarray, packed: np.ndarray) -> None:
        self.held.append((rid, packed))
        self.rows += len(rid)
        if self.rows >= 16 * BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rid, packed = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.rows = [], 0
        vectors, best = decoded(packed, self.books), []
        for a in range(0, len(self.q), 128):
            rough = scan(self.q[a : a + 128], vectors)
            rough[rid == self.qid[a : a + 128, None]] = -np.inf  # a query's own row, left out by found()
            held, score = self.rid[a : a + 128], self.score[a : a + 128]
            if score.shape[1] < self.keep:
                ids = np.broadcast_to(rid, rough.shape)
            else:
                # Only what beats the last of those held can change them.
                r, c = np.nonzero(rough > score.min(axis=1, keepdims=True))
                n = np.bincount(r, minlength=len(rough))
                place = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                more, ids = np.full((len(rough), n.max()), -np.inf, np.float32), np.full((len(rough), n.max()), -1, np.int64)
                more[r, place], ids[r, place] = rough[r, c], rid[c]
                rough = more
            rough, ids = np.hstack([score, rough]), np.hstack([held, ids])
            if rough.shape[1] > self.keep:
                at = np.argpartition(-rough, self.keep - 1, axis=1)[:, : self.keep]
                rough, ids = np.take_along_axis(rough, at, 1), np.take_along_axis(ids, at, 1)
            best.append((ids, rough))
        self.rid, self.score = (np.vstack(x) for x in zip(*best))

    def found(self) -> pa.RecordBatch:
        """query, candidate, rough score; row numbers."""
        self.flush()
        ok = self.rid != self.qid[:, None]
        qid = np.repeat(self.qid, ok.sum(1))
        return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(self.rid[ok]), pa.array(self.score[ok])], names=["query", "rid", "rough"])


def _books(clean: DataFrame, sample: int) -> DataFrame:
    """d and the codebooks of vectors of that length, each fitted in one task on at most `sample` of them."""
    first = W.partitionBy("d").orderBy(F.xxhash64("vec_id"), "vec_id", "rid")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        x = np.array(f.sort_values("rid").v.tolist(), np.float64)
        # Codes are of vectors in units of the sample's largest component, so no magnitude is lost.
        unit = np.abs(x).max()
        return pd.DataFrame({"d": [f.d.iloc[0]], "books": [np.float64(unit).tobytes() + train(x / unit).tobytes()]})

    return clean.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("d", "rid", "v").groupBy("d").applyInPandas(one, "d int, books binary")


def _book(data: bytes) -> tuple[float, np.ndarray]:
    """The unit that vectors are measured in, and the codebooks."""
    whole = np.frombuffer(data, np.float64)
    return whole[0], whole[1:].reshape(-1, 16, DIMS)


def _measured(v: list, unit: float) -> np.ndarray:
    """Vectors in the unit; what is far beyond the sample is cut where squares still are numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.array(v, np.float64) / unit, -1e100, 1e100)


def _codes(clean: DataFrame, books: DataFrame) -> DataFrame:
    """d, ids, codes: all vectors in blocks of up to BLOCK of one length."""
    schema = "d int, ids binary, codes binary"

    def blocks(frames: Iterator[tuple], book_of) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(d: int, part: list) -> pd.DataFrame:
            ids, (unit, book) = np.array([i for i, _ in part], np.int64), book_of[d]
            return pd.DataFrame({"d": [d], "ids": [ids.tobytes()], "codes": [coded(_measured([v for _, v in part], unit), book).tobytes()]})

        for i, d, v in frames:
            part = held.setdefault(d, [])
            part.append((i, v))
            if len(part) == BLOCK:
                yield row(d, held.pop(d))
        for d, part in held.items():
            yield row(d, part)

    if (books.select(F.sum(F.length("books"))).first()[0] or 0) <= BROADCAST_BYTES:
        shared = clean.sparkSession.sparkContext.broadcast({r.d: r.books for r in books.collect()})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = {d: _book(b) for d, b in shared.value.items()}
            yield from blocks((x for f in frames for x in zip(f.rid, f.d, f.v)), known)

        return clean.select("rid", "d", "v").mapInPandas(run, schema)

    def run_joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[float, np.ndarray]] = {}

        def rows():
            for f in frames:
                for i, d, v, b in zip(f.rid, f.d, f.v, f.books):
                    if d not in known:
                        known[d] = _book(b)
                    yield i, d, v

        yield from blocks(rows(), known)

    return clean.select("rid", "d", "v").join(books, "d").select("rid", "d", "v", "books").mapInPandas(run_joined, schema)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = QUERY_EVERY, top: int = TOP, sample: int = SAMPLE, part: int = PART, queries: int | None = None, keep: int = KEEP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows of largest inner product for each row whose id
    `every` divides, out of all rows but that row itself; score is exact.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    null ids.  Vectors of unlike lengths are searched apart.  Ties go to the smaller id; equal
    vectors are candidates each, and so are rows that repeat an id; a query row that repeats an id
    has a list of its own.  Fewer candidates than `top` give fewer rows; no vectors give none; other
    columns are not read.  The codebooks are fitted on at most `sample` vectors of a length, the
    first by a hash of their ids; every vector is indexed.  queries: of a block, by default so many
    that all cores have a block, QUERIES at most."""
    spark = vectors.sparkSession
    clean = staged(usable(vectors, id_col, vec_col).withColumn("d", F.size("v")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asked = clean.where(F.pmod("vec_id", F.lit(every)) == 0)
    total, n_asked = clean.agg(F.count(F.lit(1)), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1))).first()
    size = queries or min(QUERIES, max(128, -(-n_asked // spark.sparkContext.defaultParallelism)))
    blocks, parts = max(1, -(-n_asked // size)), max(1, -(-total // part))
    books = staged(_books(clean, sample), "books")
    codes = staged(_codes(clean, books), "codes")

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [f.d.iloc[0]], "q": [f.q.iloc[0]], "ids": [f.rid.to_numpy(np.int64).tobytes()], "rows": [np.array(f.v.tolist(), np.float64).tobytes()]})

    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("q")
    left = asked.select("d", block, "rid", "v").groupBy("d", "q").applyInPandas(packed, "d int, q long, ids binary, rows binary")
    left = staged(left.join(books, "d"), "queries")
    keys = left.select("d", "q")
    if blocks <= BROADCAST_BLOCKS and books.count() <= 1:
        keys = F.broadcast(keys)
    none = F.lit(None).cast("binary")
    asks = left.select("d", "q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "ids", "rows", "books")
    answers = codes.join(keys, "d").select("d", "q", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "ids", F.col("codes").alias("rows"), none.alias("books"))
    cells = asks.unionByName(answers).repartition(min(blocks * parts, 100_000), "d", "q", "part").sortWithinPartitions("d", "q", "part", "kind").select("kind", "ids", "rows", "books")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Scan | None = None
        for b in batches:
            for kind, ids, rows, book in zip(*(c for c in b.columns)):
                at = np.frombuffer(ids.as_py(), np.int64)
                if kind.as_py() == 0:
                    if now is not None:
                        yield now.found()
                    now = Scan(at, np.frombuffer(rows.as_py(), np.float64).reshape(len(at), -1), _book(book.as_py())[1], keep)
                else:
                    now.add(at, np.frombuffer(rows.as_py(), np.uint8).reshape(len(at), -1))
        if now is not None:
            yield now.found()

    near = cells.mapInArrow(run, "query long, rid long, rough float")
    if parts > 1:
        near = near.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("rough"), "rid"))).where(F.col("n") <= keep)
    pairs = near.select("query", "rid").join(clean.select("rid", "vec_id", "v"), "rid").join(asked.select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query")
    score = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    ranked = pairs.select("query", "query_id", "vec_id", "rid", score.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
