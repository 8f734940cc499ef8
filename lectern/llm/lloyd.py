"""Centroid clustering by plain Lloyd over whole numbers.

Components become floor(SCALE * x).  Centroids (K vectors, a bound that no input moves) go out by
broadcast; each task takes its vectors' squared differences from every centroid in turn and the lowest
index of the smallest; a task's sums go on as one row a digit, which groupBy adds up.  Vectors stay
where they are read: a round moves K * (components + 2) numbers a task, and a lost task is read anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import alike, as_long, digits, floors, number, settled

#: Production parameters.
K = 16
DIMS = 64
SCALE = 64
ROUNDS = 3


def usable(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(vec_id, v) of vectors with exactly dims components, none null or non-finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where((F.size("v") == dims) & finite)


def seeds(clean: DataFrame, k: int, scale: int, dims: int) -> np.ndarray:
    """The k vectors that come first by the digest of their ids; equal ids by components, null ids last."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = clean.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    return settled([floors(np.array(r.v), scale, dims).tolist() for r in first], dims)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x and its squared distance; the lowest index of equals."""
    own, all_of = alike(x, centroids, x.shape[1])
    far = np.stack([((own - c) ** 2).sum(1) for c in all_of], 1)
    best = np.argmin(far, axis=1) if far.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in far.tolist()], int)
    return best, far[np.arange(len(far)), best]


def sums(clean: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> list[list[int]]:
    """For each centroid: how many vectors it has, their distances' sum, their components' sums."""
    k, dims = centroids.shape
    shared = clean.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dims + 2), object)
        for f in frames:
            if f.empty:
                continue
            x = floors(np.stack(f.v.to_list()), scale, dims)
            best, near = assign(x, shared.value)
            for c in np.unique(best).tolist():
                at = best == c
                total[c] += np.array([int(at.sum()), sum(near[at].tolist()), *x[at].sum(0).tolist()], object)
        parts = digits(total.ravel().tolist())
        yield pd.DataFrame({"place": range(len(parts)), "digits": parts})

    merged = clean.select("v").mapInPandas(run, "place int, digits array<long>").select("place", F.posexplode("digits").alias("at", "digit")).groupBy("place", "at").agg(F.sum("digit").alias("digit"))
    found: dict[int, dict[int, int]] = {}
    for r in merged.collect():
        found.setdefault(r["at"], {})[r["place"]] = r["digit"]
    flat = [number(found.get(i, {})) for i in range(k * (dims + 2))]
    return [flat[c * (dims + 2) : (c + 1) * (dims + 2)] for c in range(k)]


def moved(centroids: np.ndarray, found: list[list[int]]) -> np.ndarray:
    """Every centroid that has vectors at the floors of their means, the others where they were."""
    rows = [[s // n for s in parts] if n else old for (n, _, *parts), old in zip(found, centroids.tolist())]
    return settled(rows, centroids.shape[1])


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with exactly
    `dims` components, none null or non-finite.

    Null vectors and others go.  Rows that repeat are vectors of their own; so are null ids, which are
    never seeds before others.  Equal distances go to the smaller number; a centroid without vectors
    stays where it is.  Fewer vectors than k give as many centroids; no vectors give no rows.  Numbers
    are exact at any magnitude; a distance or a sum of such beyond a long is null.  Other columns are
    not read.  vectors is read rounds + 3 times: write it first if it is dear to make."""
    clean = usable(vectors, id_col, vec_col, dims)
    centroids = seeds(clean, k, scale, dims)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(centroids, sums(clean, centroids, scale))
    inertia = [s[1] for s in sums(clean, centroids, scale)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, [as_long(i) for i in inertia], as_long(sum(inertia)), sha))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, inertia, whole, sha = shared.value
        for f in frames:
            if f.empty:
                continue
            best, near = assign(floors(np.stack(f.v.to_list()), scale, dims), centroids)
            near, own = [as_long(n) for n in near.tolist()], best.tolist()
            yield pd.DataFrame({"vec_id": f.vec_id, "cluster": best, "distance": pd.Series(near, f.index, object), "cluster_inertia": pd.Series([inertia[c] for c in own], f.index, object), "inertia": pd.Series([whole] * len(f), f.index, object), "centroid_sha256": [sha[c] for c in own]})

    # Ids travel as text: pandas would make a column with nulls one of floats.
    found = clean.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(run, schema.replace("vec_id long", "vec_id string"))
    return found.withColumn("vec_id", F.col("vec_id").cast("long"))
