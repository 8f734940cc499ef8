"""Vector codes of one entry a part, their codebooks fitted by Hamerly's Lloyd over whole numbers.

Components become floor(SCALE * x); a vector is cut into PARTS equal parts, each with a codebook of its
own.  Beside its codes a vector keeps two bounds a part between rounds: one above the distance to its
entry, one below the distance to the second nearest.  When entries move, the bounds move by as much;
only where the upper one is not strictly below the lower one are distances worked out, first that to
the own entry, then, if that does not part them either, those to all entries, in whole numbers, the
lower index first.  Bounds are doubles rounded outwards, so what they decide is what whole numbers
would; ties are never strict and always end in a scan.

Vectors stay together in blocks; a round is one pass that reads a table of blocks and writes the next
(vectors, codes, bounds), which is also where the lineage ends: a lost executor costs the tasks it had.
A block also writes what its moved parts change in the entries' sums; those are added up in tasks, then
by groupBy.  Only sums of entries (16 vectors' worth for each length) reach the driver, and codebooks
go out again; lengths are taken together up to BOOK_NUMBERS numbers of codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged
from .integers import LONGEST, alike, digits, floors, number, settled

#: Production parameters.
ENTRIES = 16
PARTS = 8
SCALE = 4096
ROUNDS = 6
#: Vectors in a block at most, and their components.
BLOCK = 1024
BLOCK_NUMBERS = 1 << 18
#: Numbers in codebooks that are fitted at once at most (8 bytes each, to every executor).
BOOK_NUMBERS = 1 << 20
#: The sums of labels go out by broadcast up to so many labels.
BROADCAST_LABELS = 100_000

#: A little more than one: bounds are widened by it, well beyond the error of a conversion and a root.
WIDER = 1 + 2.0**-48


def usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, parts: int) -> DataFrame:
    """(vec_id, label, v, d): vectors without null or non-finite components whose length d the parts divide."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return named.where(F.col("v").isNotNull() & (F.size("v") % parts == 0) & finite).withColumn("d", F.size("v"))


class Book:
    """The codebooks of one length: entries (parts, k, size), and how far each moved in the last round."""

    def __init__(self, entries: list[np.ndarray], before: list[np.ndarray] | None = None):
        self.entries = entries
        self.moves = []
        for m, now in enumerate(entries):
            then = now if before is None else before[m]
            now, then = alike(now, then, now.shape[1])
            self.moves.append(np.array([_root(int(s), up=True) for s in ((now - then) ** 2).sum(1).tolist()]))


def _root(square: int, up: bool) -> float:
    """The square root as a double that is not below (not above) it."""
    try:
        return float(square) ** 0.5 * WIDER if up else float(square) ** 0.5 / WIDER
    except OverflowError:
        return float("inf") if up else 0.0


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    if squares.dtype == object:
        return np.array([_root(s, up) for s in squares.tolist()], np.float64)
    return np.sqrt(squares.astype(np.float64)) * (WIDER if up else 1 / WIDER)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its nearest entry (lower index of equals), an upper bound on that distance, a lower
    bound on the second nearest's; infinite where there is one entry."""
    x, entries = alike(x, entries, x.shape[1])
    far = np.stack([((x - e) ** 2).sum(1) for e in entries], 1)
    if far.dtype == object:
        order = [sorted(range(len(r)), key=r.__getitem__) for r in far.tolist()]
        best = np.array([o[0] for o in order], int)
        second = np.array([o[1] if len(o) > 1 else -1 for o in order], int)
    else:
        best = np.argmin(far, axis=1)
        rest = far.copy()
        rest[np.arange(len(far)), best] = LONGEST
        second = np.argmin(rest, axis=1) if len(entries) > 1 else np.full(len(far), -1)
    rows = np.arange(len(far))
    lower = _roots(far[rows, second], up=False) if len(entries) > 1 else np.full(len(far), np.inf)
    return best, _roots(far[rows, best], up=True), lower


class Part:
    """One part position of a block: codes and bounds, and the scans that its last round took."""

    def __init__(self, x: np.ndarray, codes: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.x, self.codes, self.upper, self.lower = x, codes, upper, lower
        self.scanned = 0

    def round(self, entries: np.ndarray, moves: np.ndarray) -> None:
        """Assign again after the entries have moved by `moves`."""
        if self.codes is None:
            self.codes, self.upper, self.lower = scan(self.x, entries)
            self.scanned = len(self.x)
            return
        # The furthest move among entries other than one's own: the largest, or the next for its owner.
        far = int(np.argmax(moves))
        rest = np.delete(moves, far)
        next_far = rest.max() if rest.size else 0.0
        self.upper = (self.upper + moves[self.codes]) * WIDER
        self.lower = np.maximum((self.lower - np.where(self.codes == far, next_far, moves[far])), 0) / WIDER
        open_ = np.flatnonzero(~(self.upper < self.lower))
        if open_.size:
            x, own = alike(self.x[open_], entries[self.codes[open_]], self.x.shape[1])
            self.upper[open_] = _roots(((x - own) ** 2).sum(1), up=True)
            open_ = open_[~(self.upper[open_] < self.lower[open_])]
        if open_.size:
            self.codes[open_], self.upper[open_], self.lower[open_] = scan(self.x[open_], entries)
        self.scanned = int(open_.size)

    def change(self, before: np.ndarray | None, k: int) -> np.ndarray:
        """What this round changes in (count, sums of components) of each entry."""
        out = np.zeros((k, self.x.shape[1] + 1), object)
        at = np.arange(len(self.x)) if before is None else np.flatnonzero(before != self.codes)
        for sign, codes in ((1, self.codes), (-1, before)):
            for c in np.unique(codes[at]).tolist() if codes is not None else ():
                rows = at[codes[at] == c]
                out[c] += sign * np.array([len(rows), *self.x[rows].sum(0).tolist()], object)
        return out


def _matrix(column: pa.Array, kind: str, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(column.as_py(), kind).reshape(rows, width).copy()


def _cut(data: pa.Scalar, rows: int, d: int, parts: int, scale: int) -> list[np.ndarray]:
    whole = np.frombuffer(data.as_py(), np.float64).reshape(rows, parts, d // parts)
    return [floors(whole[:, m], scale, d) for m in range(parts)]


#: Columns of a table of blocks; ids and labels, as they were, stand in lists.
BLOCKS = "d int, n int, ids array<long>, labels array<{label}>, v binary, codes binary, upper binary, lower binary, scanned long, change array<array<long>>"


def _blocks(clean: DataFrame, label: str) -> DataFrame:
    """Vectors in blocks of one length, without codes yet."""
    schema = BLOCKS.format(label=label)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        count: dict[int, int] = {}

        def block(d: int) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held.pop(d)).combine_chunks()
            count.pop(d)
            size = max(1, min(BLOCK, BLOCK_NUMBERS // max(d, 1)))
            for a in range(0, len(whole), size):
                part = whole.slice(a, size)
                n = len(part)
                one = lambda x: pa.array([x])
                values = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                listed = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part[c].combine_chunks()) for c in ("vec_id", "label")]
                empty = pa.array([b""], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int32()), *listed, one(values.tobytes()), empty, empty, empty, pa.array([0], pa.int64()), pa.array([[]], pa.list_(pa.list_(pa.int64())))], names=names)

        for b in batches:
            for d in np.unique(b["d"].to_numpy()).tolist():
                own = b.filter(pc.equal(b["d"], d))
                held.setdefault(d, []).append(own)
                count[d] = count.get(d, 0) + len(own)
                if count[d] >= BLOCK or count[d] * d >= BLOCK_NUMBERS:
                    yield from block(d)
            # Many lengths at once must not pile up either.
            if sum(n * d for d, n in count.items()) >= 16 * BLOCK_NUMBERS:
                for d in list(held):
                    yield from block(d)
        for d in list(held):
            yield from block(d)

    return clean.select("d", "vec_id", "label", "v").mapInArrow(run, schema)


def _round(blocks: DataFrame, books: Broadcast, parts: int, scale: int) -> DataFrame:
    """Blocks after one more assignment."""
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                d, n = b["d"][i].as_py(), b["n"][i].as_py()
                book: Book = books.value[d]
                xs = _cut(b["v"][i], n, d, parts, scale)
                first = not b["codes"][i].as_py()
                codes = None if first else _matrix(b["codes"][i], "u1", parts, n)
                upper, lower = (None, None) if first else (_matrix(b[c][i], "f8", parts, n) for c in ("upper", "lower"))
                now, change = [], []
                for m, x in enumerate(xs):
                    before = None if first else codes[:, m].astype(int)
                    part = Part(x) if first else Part(x, before.copy(), upper[:, m].copy(), lower[:, m].copy())
                    part.round(book.entries[m], book.moves[m])
                    change += part.change(before, len(book.entries[m])).ravel().tolist()
                    now.append(part)
                packed = lambda name, kind: np.stack([getattr(p, name) for p in now], 1).astype(kind).tobytes()  # noqa: B023, E731
                made = {"codes": pa.array([packed("codes", "u1")]), "upper": pa.array([packed("upper", "f8")]), "lower": pa.array([packed("lower", "f8")]), "scanned": pa.array([sum(p.scanned for p in now)], pa.int64()), "change": pa.array([digits(change)], pa.list_(pa.list_(pa.int64())))}
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([made.get(c, row[c]) for c in names], names=names)

    return blocks.mapInArrow(run, blocks.schema)


def _changes(blocks: DataFrame) -> dict[int, dict[int, int]]:
    """By length, place of a number in (part, entry, count and components): how much it changed.

    A task adds up its blocks' lists, groupBy the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (d, place), x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([place], pa.int32()), pa.array([x.tolist()], pa.list_(pa.int64()))], names=["d", "place", "digits"])
            total.clear()

        for b in batches:
            for d, change in zip(b["d"].to_pylist(), b["change"]):
                for place, x in enumerate(change.values):
                    x = x.values.to_numpy().astype(np.int64)
                    total[d, place] = total[d, place] + x if (d, place) in total else x
            if sum(map(len, total.values())) > 2 * BOOK_NUMBERS:
                yield from rows()
        yield from rows()

    merged = blocks.select("d", "change").mapInArrow(run, "d int, place int, digits array<long>").select("d", "place", F.posexplode("digits").alias("at", "digit")).where("digit <> 0").groupBy("d", "place", "at").agg(F.sum("digit").alias("digit"))
    found: dict[int, dict[int, dict[int, int]]] = {}
    for r in merged.collect():
        found.setdefault(r["d"], {}).setdefault(r["at"], {})[r["place"]] = r["digit"]
    return {d: {at: number(p) for at, p in of.items()} for d, of in found.items()}


def _rows(blocks: DataFrame, books: Broadcast, parts: int, scale: int, label: str) -> DataFrame:
    """vec_id, label, d, code, error of every vector in blocks that have their last codes."""
    schema = f"vec_id long, label {label}, d int, code string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                d, n = b["d"][i].as_py(), b["n"][i].as_py()
                codes = _matrix(b["codes"][i], "u1", parts, n)
                error = np.zeros(n, object)
                for m, x in enumerate(_cut(b["v"][i], n, d, parts, scale)):
                    x, own = alike(x, books.value[d].entries[m][codes[:, m]], d)
                    error += ((x - own) ** 2).sum(1).astype(object)
                # Errors travel as text: they may be longer than a long.
                yield pa.RecordBatch.from_arrays([b["ids"][i].values, b["labels"][i].values, pa.array([d] * n, pa.int32()), pa.array([c.tobytes().hex() for c in codes]), pa.array([str(e) for e in error.tolist()])], names=["vec_id", "label", "d", "code", "error"])

    return blocks.select("d", "n", "ids", "labels", "v", "codes").mapInArrow(run, schema)


def _start(clean: DataFrame, lengths: list[int], entries: int, parts: int, scale: int) -> dict[int, Book]:
    """Codebooks of the vectors of the smallest ids of each length: equal ids by components, null ids last."""
    out = {}
    for d in lengths:
        first = [r.v for r in clean.where(F.col("d") == d).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
        whole = np.array(first, np.float64).reshape(len(first), parts, d // parts)
        out[d] = Book([settled(floors(whole[:, m], scale, d).tolist(), d // parts) if d else np.zeros((len(first), 0), np.int64) for m in range(parts)])
    return out


def _moved(books: dict[int, Book], sums: dict[int, np.ndarray], parts: int) -> dict[int, Book]:
    """Codebooks with every used entry at the floors of its parts' means, the others where they were."""
    out = {}
    for d, book in books.items():
        size = d // parts
        table = sums[d].reshape(parts, -1, size + 1).tolist()
        entries = [settled([[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(table[m], book.entries[m].tolist())], size) for m in range(parts)]
        out[d] = Book(entries, book.entries)
    return out


def _batches(lengths: Iterable[int], entries: int) -> Iterator[list[int]]:
    held: list[int] = []
    for d in sorted(lengths):
        if held and (sum(held) + d) * entries > BOOK_NUMBERS:
            yield held
            held = []
        held.append(d)
    if held:
        yield held


def fitted(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE, rounds: int = ROUNDS, scans: list | None = None) -> DataFrame | None:
    """vec_id, label, d, code, error (as text), codebooks_sha256, as a written table; None without vectors.

    scans: gets, for each round, how many parts had all their distances worked out."""
    spark = vectors.sparkSession
    label = vectors.select(label_col).schema[0].dataType.simpleString()
    clean = usable(vectors, id_col, label_col, vec_col, parts)
    lengths = [r.d for r in clean.select("d").distinct().collect()]
    out = None
    for group in _batches(lengths, entries):
        own = clean.where(F.col("d").isin(group))
        books = _start(own, group, entries, parts, scale)
        blocks = staged(_blocks(own, label), "blocks")
        sums = {d: np.zeros(sum(e.shape[0] * (e.shape[1] + 1) for e in b.entries), object) for d, b in books.items()}
        for r in range(rounds + 1):
            shared = spark.sparkContext.broadcast(books)
            after = staged(_round(blocks, shared, parts, scale), "blocks")
            dropped(spark, blocks)
            blocks = after
            if scans is not None:
                scans.append(blocks.agg(F.sum("scanned")).first()[0])
            if r < rounds:
                for d, change in _changes(blocks).items():
                    for at, v in change.items():
                        sums[d][at] += v
                books = _moved(books, sums, parts)
        sha = {d: hashlib.sha256(",".join(str(x) for e in b.entries for x in e.ravel().tolist()).encode()).hexdigest() for d, b in books.items()}
        told = F.create_map(*[F.lit(x) for d in group for x in (d, sha[d])])
        rows = staged(_rows(blocks, shared, parts, scale, label).withColumn("codebooks_sha256", told[F.col("d")]), "codes")
        dropped(spark, blocks)
        out = rows if out is None else out.unionByName(rows)
    return out


def coded(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    code: two hex digits a part; label_error: errors summed over rows of equal labels, null labels
    together.  Null vectors and others go, and so do those whose length the parts do not divide;
    vectors of unlike lengths have codebooks of their own (and empty vectors the empty ones).  Rows that
    repeat, and null ids, are vectors of their own; codebooks start from the smallest ids, null ids
    last, fewer vectors giving fewer entries.  Equal distances go to the lower index.  Numbers are exact
    at any magnitude; an error, or a sum of such, beyond a long is null.  Other columns are not read; no
    vectors give no rows."""
    rows = fitted(vectors, **parameters)
    if rows is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # Beyond 28 places nothing fits in a long any more, and up to there sums fit in 38.
    rows = rows.withColumn("whole", F.when(F.length("error") <= 28, F.col("error").try_cast("decimal(38,0)")))
    of = rows.groupBy("label").agg(F.sum("whole").alias("total"), F.count(F.when(F.col("whole").isNull(), 1)).alias("over"))
    long = lambda x: F.when(x <= F.lit(str(LONGEST)).cast("decimal(38,0)"), x.cast("long"))
    of = of.select(F.col("label").alias("of"), F.when(F.col("over") == 0, long(F.col("total"))).alias("label_error"))
    if of.count() <= BROADCAST_LABELS:
        of = F.broadcast(of)
    joined = rows.join(of, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", long(F.col("whole")).alias("error"), "label_error", "codebooks_sha256")
