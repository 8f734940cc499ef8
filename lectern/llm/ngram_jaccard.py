"""N-gram Jaccard join: R-trees over count vectors find the pairs, exact sets verify them.

The shingles of a document are hashed to 64 bits and dealt by hash into GROUPS groups; how many fall
into each group is the document's point.  No pair shares more shingles than the sum of the smaller
coordinates of its points, and no pair across two tree nodes more than the same sum over the upper
corners of their boxes.  A pair links if its overlap is at least 85/185 of the two sizes together.

1. Documents with the same set become one class; from here on only classes are compared.
2. Points are dealt to trees so that any linked pair meets in one: under any one order of all
   shingles, two sets that link share a shingle among the first floor(0.15 n) + 1 of each.  The
   order is by a count sketch of fixed size over all documents, rare shingles first, so a passage
   that a third of the corpus shares builds no tree of that size unless whole documents agree.
3. Each tree reports only edges that connect its surviving pairs (never all pairs); their components
   are clusters.  Links never leave a cluster, and a class lies in one cluster only, so each set of
   shingles moves once.
4. Inside a cluster a tree over its points proposes pairs, and the sets verify them; pairs that are
   already connected are not looked at again.

Groups of more than LARGE members, in steps 3 and 4, are dealt into tiles, a task each, and PIVOTS
members of the group stand in every tile.  Where members are alike, the pivots connect them, and each
member has moved once.  Only members outside the group's largest connected piece then meet the other
tiles, so no pair of pieces goes unlooked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, staged
from .components import components

#: Production parameters: words in a shingle, and the least overlap in percent of the union.
WORDS = 4
PERCENT = 85
GROUPS = 64
#: Longer documents have finer points: groups from so many shingles on.  Groups nest, so any two compare.
FINER = ((800, 256), (4000, 1024))
SKETCH_BITS, SLICES = 22, 64
LARGE = 512
TILE = 512
PIVOTS = 4
NODE = 32
#: Ids up to this many go out by broadcast (16 MB), and tables of up to so many bytes; beyond it joins shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_BYTES = 16 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    Words are runs of anything but the six ASCII white-space characters, A-Z lower-cased; a text of
    fewer words than a shingle has one shingle, of all of them; no words, none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s *= _P
        s += h[i : len(h) - k + 1 + i]
    s += np.uint64(k)
    s ^= s >> np.uint64(30)
    s *= _M1
    s ^= s >> np.uint64(27)
    s *= _M2
    s ^= s >> np.uint64(31)
    return np.unique(s)


def groups_of(n: int) -> int:
    return next((g for least, g in reversed(FINER) if n > least), GROUPS)


def point(s: np.ndarray) -> bytes:
    """Group counts, a byte each (two where a group has over 255; empty, bounding nothing, over 65,535)."""
    g = groups_of(len(s))
    c = np.bincount((s >> np.uint64(65 - g.bit_length())).astype(np.int64), minlength=g)
    top = c.max()
    return c.astype(np.uint8 if top < 256 else np.uint16).tobytes() if top < 65536 else b""


class Points(np.ndarray):
    """Points of GROUPS groups, a row a member, with the members' own finer points beside them."""

    fine: list


def points(blobs: list[bytes], sizes: np.ndarray) -> Points:
    fine = []
    out = np.empty((len(blobs), GROUPS), np.int32)
    for i, (b, n) in enumerate(zip(blobs, sizes.tolist())):
        if b:
            own = np.frombuffer(b, np.uint8 if len(b) == groups_of(n) else np.uint16).astype(np.int32)
            out[i] = own if len(own) == GROUPS else own.reshape(GROUPS, -1).sum(1)
            fine.append(own)
        else:
            out[i] = n
            fine.append(out[i])
    whole = out.view(Points)
    whole.fine = fine
    return whole


def finer_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The bound of two members by the finest groups they share."""
    g = min(len(a), len(b))
    fold = lambda x: x if len(x) == g else x.reshape(g, -1).sum(1)
    return int(np.minimum(fold(a), fold(b)).sum())


def needed(a, b, percent: int = PERCENT):
    """Least overlap at which sets of a and b shingles link: 100 o >= p (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.trees = n

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.trees -= 1
        return True

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, at.tolist()), np.int64, len(at))


class RTree:
    """Count vectors in sizes' order, packed into leaves of NODE points with their upper corners.

    Two levels of boxes stand over the leaves' points; a search goes down only where the box can
    still hold enough overlap, for all entries of a level at once."""

    def __init__(self, p: np.ndarray, sizes: np.ndarray, percent: int):
        self.order = np.lexsort((*p.T[:4], sizes))
        self.fine = getattr(p, "fine", None)
        self.p, self.n, self.percent = np.asarray(p)[self.order], sizes[self.order], percent
        self._sizes = sizes
        cut = np.arange(0, len(p), NODE)
        self.hi, self.lo_n, self.hi_n = np.maximum.reduceat(self.p, cut), self.n[cut], np.maximum.reduceat(self.n, cut)
        cut = np.arange(0, len(self.hi), NODE)
        self.hi2, self.lo_n2, self.hi_n2 = np.maximum.reduceat(self.hi, cut), self.lo_n[cut], np.maximum.reduceat(self.hi_n, cut)

    def _open(self, q, n, hi, lo_n, hi_n, at):
        if at is not None:
            hi, lo_n, hi_n = hi[at], lo_n[at], hi_n[at]
        # A partner has at least percent of the larger size, and needs what the smallest in the box needs.
        least = np.maximum(lo_n, -(-self.percent * n // 100))
        ok = (least <= hi_n) & (self.percent * lo_n <= 100 * n) & (np.minimum(hi, q).sum(1) >= needed(n, least, self.percent))
        return np.flatnonzero(ok) if at is None else at[ok]

    def search(self, q: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Members whose points leave enough room for a link with (q, n), and their bounds; own: q's finer point."""
        spread = lambda nodes, most: (lambda x: x[x < most])((nodes[:, None] * NODE + np.arange(NODE)).ravel())
        top = self._open(q, n, self.hi2, self.lo_n2, self.hi_n2, None)
        leaves = self._open(q, n, self.hi, self.lo_n, self.hi_n, spread(top, len(self.hi)))
        at = spread(leaves, len(self.p))
        sizes = self.n[at]
        bound = np.minimum(self.p[at], q).sum(1)
        ok = (bound >= needed(n, sizes, self.percent)) & (100 * np.minimum(sizes, n) >= self.percent * np.maximum(sizes, n))
        at, bound = self.order[at[ok]], bound[ok]
        if own is not None and len(own) > GROUPS and self.fine is not None:
            ok = np.array([finer_bound(own, self.fine[j]) >= needed(n, m, self.percent) for j, m in zip(at.tolist(), self._sizes[at].tolist())], bool)
            at, bound = at[ok], bound[ok]
        return at, bound


def _rooms(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of points, row by row, leave room for a link."""
    return (np.minimum(p, q).sum(-1) >= needed(a, b, percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def candidate_edges(p: np.ndarray, fine: list, sizes: np.ndarray, percent: int = PERCENT, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what surviving pairs connect, one fewer than members at most (sides: only pairs of unlike sides are looked at)."""
    forest, edges = Forest(len(sizes)), []
    apart = (lambda i, j: True) if sides is None else (lambda i, j: sides[i] != sides[j])
    room = lambda i, j: len(fine[i]) == GROUPS or len(fine[j]) == GROUPS or finer_bound(fine[i], fine[j]) >= needed(int(sizes[i]), int(sizes[j]), percent)
    if len(sizes) <= NODE:  # a single leaf
        for i in range(len(sizes) - 1):
            ok = _rooms(p[i], p[i + 1 :], sizes[i], sizes[i + 1 :], percent)
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                if forest.find(i) != forest.find(j) and apart(i, j) and room(i, j) and forest.join(i, j):
                    edges.append((i, j))
            if forest.trees == 1:
                break
        return edges
    tree = RTree(p, sizes, percent)
    tree.fine = fine
    for i in tree.order.tolist():
        if forest.trees == 1:
            break
        for j in tree.search(p[i], int(sizes[i]), fine[i])[0].tolist():
            if apart(i, j) and forest.join(i, j):
                edges.append((i, j))
    return edges


def verified_edges(p: np.ndarray, fine: list, sizes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links, as many as connect all members that links connect (sides: only pairs of unlike sides are looked at)."""
    m = len(sizes)
    tree, forest, edges = RTree(p, sizes, percent), Forest(m), []
    tree.fine = fine
    postings = None
    for i in tree.order.tolist():
        if forest.trees == 1:
            break
        n, mine = int(sizes[i]), sets[i]
        at, bound = tree.search(p[i], n, fine[i])
        if sides is not None:
            ok = sides[at] != sides[i]
            at, bound = at[ok], bound[ok]
        ok = forest.roots(at) != forest.find(i)
        at, bound = at[ok], bound[ok]
        if len(at) > 24:
            if postings is None:
                whole, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
                order = np.argsort(whole, kind="stable")
                whole, postings = whole[order], owner[order]
            lo, hi = np.searchsorted(whole, mine, "left"), np.searchsorted(whole, mine, "right")
            size = hi - lo
            overlap = np.bincount(postings[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())], minlength=m)[at]
            for j in at[overlap >= needed(n, sizes[at], percent)].tolist():
                if forest.join(i, j):
                    edges.append((i, j))
            continue
        for j in at[np.argsort(-bound, kind="stable")].tolist():
            if forest.find(i) != forest.find(j) and len(np.intersect1d(mine, sets[j], assume_unique=True)) >= needed(n, int(sizes[j]), percent) and forest.join(i, j):
                edges.append((i, j))
    return edges


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How often each of 2^SKETCH_BITS hash buckets is met in all documents, as levels (16 a doubling).

    Tasks send their counts as SLICES arrays, which add up slice by slice; the sketch's size is fixed
    whatever the input, and so is what reaches the driver (4 MB)."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                # Within a document shingles are distinct, and buckets nearly so: one is enough.
                seen[(shingles(text.as_py(), words) & np.uint64(size - 1)).astype(np.int64)] += 1
        parts = [zlib.compress(x.tobytes(), 1) for x in seen.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
                sums[k] = sums[k] + got if k in sums else got.astype(np.uint64)
        made = [np.minimum(255, np.round(16 * np.log2(1.0 + x.astype(np.float64)))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(made, pa.binary())], names=["slice", "levels"])

    got = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, levels binary").toPandas()
    levels = np.zeros((SLICES, size // SLICES), np.uint8)
    for k, x in zip(got.slice, got.levels):
        levels[k] = np.frombuffer(x, np.uint8)
    return levels.ravel()


def _classes(docs: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, key (128 bits of the set), point and the shards of each document."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(levels)  # 4 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                first = s
                if len(s):
                    most = len(s) - -(-percent * len(s) // 100) + 1
                    bucket = (s & np.uint64(len(level) - 1)).astype(np.int64)
                    first = s[np.lexsort((s, level[bucket]))[:most]]
                for col, x in zip(cols, (len(s), xxhash.xxh3_128_digest(s.tobytes()), point(s), first.view(np.int64))):
                    col.append(x)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n", "key", "point", "shards"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, point binary, shards array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches sorted by their first column, cut so that no run of it is split: batch, starts and ends of runs.

    At most one batch and one run are held; runs have at most LARGE members here."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if cut == 0 and held and held[-1].column(0)[-1].as_py() == key[0]:
            held.append(batch)
            continue
        yield from _run(held + [batch.slice(0, cut)] if held and held[-1].column(0)[-1].as_py() == key[0] or cut else held)
        held = [batch.slice(cut)]
    yield from _run(held)


def _run(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        yield whole, starts, np.r_[starts[1:], len(key)]


def _grouped(members: DataFrame, sizes: DataFrame, key: str, work, whole, large: int, tile: int) -> DataFrame:
    """Edges (a, b) among the members of each key; sizes has a row with the key for each member.

    Keys of up to `large` members stream, sorted, through whole(batches).  The members of a larger key
    are dealt by hash into tiles of about `tile` with the key's pivots, for work(frame, sides); then
    what the largest piece leaves out meets all tiles, pairs of unlike pieces only."""
    schema = "a long, b long"
    counts = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large).select(F.col(key).alias("big"), F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    counts = staged(counts, "large")
    some = counts.limit(1).count() > 0
    small = members.join(counts, F.col(key) == F.col("big"), "left_anti") if some else members
    names = [key, *[c for c in members.columns if c != key]]
    edges = small.select(*names).repartition(key).sortWithinPartitions(key, "cid").mapInArrow(whole, schema)
    if not some:
        return edges
    dealt = staged(members.join(counts, F.col(key) == F.col("big")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")).select(*names, "tiles", "own"), "tiles")
    first = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(F.lit(1), "cid"), "cid"))
    pivots = staged(dealt.withColumn("nth", first).where(F.col("nth") <= PIVOTS).drop("nth", "own"), "pivots").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = dealt.unionByName(pivots.select(*dealt.columns)).drop("tiles")
    inner = staged(tiles.groupBy(key, "own").applyInPandas(lambda f: work(f[~f.cid.duplicated()], None), schema).where("a != b"), "inner")
    pieces = components(inner)
    told = dealt.select(key, "cid", "tiles").distinct().join(pieces, F.col("cid") == F.col("node"), "left").select(key, "cid", "tiles", F.coalesce("component", "cid").alias("piece"))
    told = staged(told, "pieces")
    most = told.groupBy(key, "piece").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max_by("piece", F.struct("n", "piece")).alias("largest"))
    rest = staged(told.join(most.withColumnRenamed(key, "of"), (F.col(key) == F.col("of")) & (F.col("piece") != F.col("largest"))).select(key, "cid", "piece", "tiles"), "rest")
    if rest.limit(1).count():
        blocks = rest.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
        full = dealt.join(told.select(F.col(key).alias("of"), F.col("cid").alias("who"), "piece"), (F.col(key) == F.col("of")) & (F.col("cid") == F.col("who"))).drop("of", "who")
        aside = full.join(rest.select(F.col(key).alias("of"), F.col("cid").alias("who")).distinct(), (F.col(key) == F.col("of")) & (F.col("cid") == F.col("who")), "left_semi")
        aside = aside.join(blocks.withColumnRenamed(key, "of"), F.col(key) == F.col("of")).drop("of").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "cid"), F.col("blocks")).cast("int"))
        one = aside.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*names, "piece", "own", "block")
        two = full.join(blocks.withColumnRenamed(key, "of"), F.col(key) == F.col("of")).drop("of").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*names, "piece", "own", "block")

        def across(f: pd.DataFrame) -> pd.DataFrame:
            f = f[~f.cid.duplicated()]
            return work(f, f.piece.to_numpy())

        edges = edges.union(one.unionByName(two).groupBy(key, "own", "block").applyInPandas(across, schema))
    return edges.union(inner)


def _edge_frame(cid: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": cid[at[:, 0]], "b": cid[at[:, 1]]})


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, large: int = LARGE, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows doc_id, n, key; classes cid, key, n, label (smallest doc_id);
    links a, b between cids - enough of them to connect whatever all links connect, each verified."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole = staged(_classes(src, words, percent, _sketch(src, words)), "shingled")
    named = whole.where("doc_id is not null and n > 0")
    dealt = staged(named.groupBy("key").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("shards").alias("shards")).withColumn("cid", F.monotonically_increasing_id()), "dealt")
    rows = staged(whole.select("doc_id", "n", "key"), "rows")
    dropped(spark, whole)
    # Shards are told by counts that combine before they travel; shards of one member fall away, and of
    # the many shards that have the same members one stays (told by their number and two 64-bit sums
    # of hashes).  What stays is few, and picks its members out of the classes where they lie.
    classes = staged(dealt.drop("shards"), "classes")
    met = dealt.select("cid", F.explode("shards").alias("shard"))
    told = met.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("s2")).where("size > 1")
    lead = staged(told.groupBy("size", "s1", "s2").agg(F.min("shard").alias("shard")).select("shard"), "lead")
    if lead.count() <= BROADCAST_IDS:
        lead = F.broadcast(lead)
    members = met.join(lead, "shard", "left_semi").join(classes.select("cid", "n", "point"), "cid")
    members = staged(members.select("shard", "cid", "n", "point"), "members")
    dropped(spark, dealt)

    def survivors(f: pd.DataFrame, sides: np.ndarray | None) -> pd.DataFrame:
        sizes = f.n.to_numpy(np.int64)
        p = points(f.point.tolist(), sizes)
        return _edge_frame(f.cid.to_numpy(), candidate_edges(p, p.fine, sizes, percent, sides))

    def survivors_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # many shards have the same members; one of them is enough
        for b, starts, ends in _runs(batches):
            cid, sizes = b.column(1).to_numpy(), b.column(2).to_numpy()
            p = points(b.column(3).to_pylist(), sizes)
            two = starts[ends - starts == 2]
            ok = two[_rooms(p[two], p[two + 1], sizes[two], sizes[two + 1], percent)]
            ok = np.array([i for i in ok.tolist() if min(len(p.fine[i]), len(p.fine[i + 1])) == GROUPS or finer_bound(p.fine[i], p.fine[i + 1]) >= needed(int(sizes[i]), int(sizes[i + 1]), percent)], np.int64)
            found = [np.unique(np.stack([cid[ok], cid[ok + 1]], 1), axis=0)]
            for lo, hi in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                if (who := xxhash.xxh3_128_digest(cid[lo:hi].tobytes())) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(who)
                at = np.array(candidate_edges(p[lo:hi], p.fine[lo:hi], sizes[lo:hi], percent), np.int64).reshape(-1, 2)
                found.append(cid[lo:hi][at])
            out = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    clusters = components(_grouped(members, members, "shard", survivors, survivors_of_all, large, tile).where("a != b").distinct())
    inside = classes.join(clusters, F.col("cid") == F.col("node")).select("cid", "key", "n", "point", "label", F.col("component").alias("cluster"))
    inside = staged(inside, "clusters")
    dropped(spark, members)
    wanted = inside.select(F.col("label").alias("doc_id")).distinct()
    small = lambda x, bytes_of: (x.select(F.sum(bytes_of)).first()[0] or 0) <= BROADCAST_BYTES
    ids = F.broadcast(wanted) if small(wanted, F.lit(16)) else wanted
    owners = inside if not small(inside, 40 + F.length("key") + F.length("point")) else F.broadcast(inside)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(s) for s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["doc_id", "of", "hashes"])

    # Repeated ids may bring other texts: the key tells.  The same set may come twice; the work skips it.
    found = src.join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, of binary, hashes binary")
    held = found.join(owners, (F.col("label") == F.col("doc_id")) & (F.col("key") == F.col("of"))).select("cluster", "cid", "n", "point", "hashes")

    def link(f: pd.DataFrame, sides: np.ndarray | None) -> pd.DataFrame:
        fresh = ~f.cid.duplicated().to_numpy()
        f, sides = f[fresh], None if sides is None else sides[fresh]
        sizes = f.n.to_numpy(np.int64)
        sets_ = [np.frombuffer(h, np.uint64) for h in f.hashes]
        p = points(f.point.tolist(), sizes)
        return _edge_frame(f.cid.to_numpy(), verified_edges(p, p.fine, sizes, sets_, percent, sides))

    def link_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts, ends in _runs(batches):
            cid, sizes = b.column(1).to_numpy(), b.column(2).to_numpy()
            p, sets_ = points(b.column(3).to_pylist(), sizes), [np.frombuffer(h, np.uint64) for h in b.column(4).to_pylist()]
            found = [np.empty((0, 2), np.int64)]
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                one = lo + np.unique(cid[lo:hi], return_index=True)[1]
                at = np.array(verified_edges(p[one], [p.fine[i] for i in one], sizes[one], [sets_[i] for i in one], percent), np.int64).reshape(-1, 2)
                found.append(cid[one][at])
            out = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    links = staged(_grouped(held, inside, "cluster", link, link_all, large, tile), "links")
    return rows, classes, links


def joined(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    component_id is the smallest doc_id reachable by links, the document's own included.  A null or
    wordless text has no shingles and its own id; a row with a null id cannot be named by a link and
    takes no part (component_id null).  Rows that repeat an id are documents of their own.  Columns
    other than id and text are not read; an empty table gives no rows."""
    rows, classes, links = classes_and_links(docs, **options)
    comps = components(links)
    lowest = classes.select("cid", "key", "label").join(comps, F.col("cid") == F.col("node"), "left").withColumn("group", F.coalesce("component", "cid"))
    least = lowest.where("component is not null").groupBy("group").agg(F.min("label").alias("least"))
    named = lowest.join(least, "group", "left").select(F.col("key").alias("of"), F.coalesce("least", "label").alias("least"))
    out = rows.select("doc_id", "n", "key").join(named, (F.col("key") == F.col("of")) & F.col("doc_id").isNotNull() & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs with one document of each component left: the one with the smallest id.

    Further rows with that same id stay too only where they are documents of their own component."""
    joined_rows = staged(joined(docs, id_col=id_col, **options), "components")
    gone = joined_rows.where("component_id != doc_id").select(F.col("doc_id").alias("gone")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col).cast("long") == F.col("gone"), "left_anti")
