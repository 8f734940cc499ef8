"""Clustering and compression of vectors against brute force over Python's whole numbers, also on odd rows."""

import hashlib
import math
import random

import pytest

from lectern.llm import hamerly, integers, lloyd

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int"


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def odd_vectors(dims, more=()):
    """Nulls, non-finite components, other lengths, ties, repeated rows, null ids, repeated ids."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-3, 4)) / 8 for _ in range(dims)], None if i % 3 == 0 else i % 4) for i in range(60)]
    rows += rows[:7] + [(3, [0.125] * dims, 1), (None, [0.5] * dims, None), (None, [-0.5] * dims, 2)]
    rows += [(100, None, 1), (101, [], 1), (102, [None] + [0.0] * (dims - 1), 1), (103, [float("nan")] * dims, 1), (104, [float("inf")] + [0.0] * (dims - 1), None), (105, [1.0] * (dims + 1), 1)]
    return [(i, v, label, "v", 7) for i, v, label in [*rows, *more]]


def floored(v, scale):
    return [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, centroids):
    return min((squared(v, c), i) for i, c in enumerate(centroids))


def test_whole_numbers():
    for values in ([0], [5, -7], [2**31, -(2**31) - 1], [2**200, -(2**199) + 3, 1], []):
        parts = integers.digits(values)
        assert [integers.number({k: p[i] for k, p in enumerate(parts)}) for i in range(len(values))] == values
    import numpy as np

    x = np.array([[1e30, -1e-30, 0.1, -0.1]])
    assert integers.floors(x, 4096, 4).tolist() == [[math.floor(int(1e30) * 4096), -1, 409, -410]]
    assert integers.floors(x[:, 1:], 4096, 3).dtype == np.int64


def brute_lloyd(rows, k, dims, scale, rounds):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [floored(v, scale) for _, v in order[:k]]
    whole = [(i, floored(v, scale)) for i, v in kept]
    for _ in range(rounds):
        own = [nearest(v, centroids)[1] for _, v in whole]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(whole, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v, centroids)) for i, v in whole]
    of = [sum(d for _, d, c in found if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, c, long(d), long(of[c]), long(sum(of)), sha[c]) for i, d, c in found), key=str)


def lloyd_rows(df, **more):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in lloyd.clustered(df, **more).collect()), key=str)


def test_lloyd(spark, embeddings):
    rows = [(r.vec_id, list(r.embedding)) for r in embeddings.collect()]
    assert lloyd_rows(embeddings) == brute_lloyd(rows, 16, 64, 64, 3)


@pytest.mark.parametrize("more", [(), [(200, [1e30, -1e30, 2e25, 0.0], 1), (201, [1e30, 0.0, 3.0, 0.0], 2)]])
def test_lloyd_on_odd_rows(spark, more):
    rows = odd_vectors(4, more)
    df = spark.createDataFrame([(i, v, *x) for i, v, *x in rows], SCHEMA.replace("float", "double")).repartition(3)
    for k, rounds in ((5, 3), (200, 1)):
        assert lloyd_rows(df, k=k, dims=4, scale=64, rounds=rounds) == brute_lloyd(rows, k, 4, 64, rounds)
    assert lloyd.clustered(df, dims=9).count() == 0 and lloyd.clustered(df.where("false")).count() == 0


def brute_codes(rows, parts, k, scale, rounds):
    """By length of vector: codes, errors and the entries' digest, every distance worked out."""
    kept = [(i, v, label) for i, v, label, *_ in rows if v is not None and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, v, _ in kept}:
        own = sorted(((i, v, label) for i, v, label in kept if len(v) == d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        size = d // parts
        cut = [[floored(v[m * size : (m + 1) * size], scale) for m in range(parts)] for _, v, _ in own]
        books = [[c[m] for c in cut[:k]] for m in range(parts)]
        codes = lambda: [[nearest(c[m], books[m]) for m in range(parts)] for c in cut]  # noqa: B023, E731
        for _ in range(rounds):
            now = codes()
            for m in range(parts):
                for e in range(len(books[m])):
                    mine = [c[m] for c, n in zip(cut, now) if n[m][1] == e]
                    if mine:
                        books[m][e] = [sum(x) // len(mine) for x in zip(*mine)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        out += [(i, "".join(f"{c:02x}" for _, c in n), sum(s for s, _ in n), label, sha) for (i, _, label), n in zip(own, codes())]
    of = {}
    for _, _, error, label, _ in out:
        of[label] = of.get(label, 0) + error
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, code, long(error), long(of[label]), sha) for i, code, error, label, sha in out), key=str)


def codes_of(df, **more):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in hamerly.coded(df, **more).collect()), key=str)


def test_hamerly(embeddings):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in embeddings.collect()]
    scans = []
    assert codes_of(embeddings, scans=scans) == brute_codes(rows, 8, 16, 4096, 6)
    # Bounds must spare scans, more of them as the entries come to rest.
    assert scans[0] == 8 * len(rows) and scans[-1] < scans[1] < scans[0]


@pytest.mark.parametrize("more", [(), [(200, [1e30, -1e30, 2e25, 0.0], 1), (201, [1e30, 0.0, 3.0, 0.0], 2), (202, [5e6, 0.0, 3.0, 0.0], 3)]])
def test_hamerly_on_odd_rows(spark, more):
    """Small grids make ties of most distances; magnitudes up to 1e30 leave the long."""
    rows = odd_vectors(4, [*more, (300, [0.25, 0.5], 3), (301, [0.75, -0.5], 3)])
    df = spark.createDataFrame([(i, v, *x) for i, v, *x in rows], SCHEMA.replace("float", "double")).repartition(3)
    for parts, entries, rounds in ((2, 5, 3), (1, 300, 1)):
        entries = min(entries, 256)
        assert codes_of(df, parts=parts, entries=entries, rounds=rounds, scale=4096) == brute_codes(rows, parts, entries, 4096, rounds)
    assert hamerly.coded(df.where("false")).count() == 0


def test_hamerly_decides_as_whole_numbers_do():
    """Random entries, moved at random: the bounds never keep a code that a scan would change."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 2, 8):
        x = rng.integers(-40, 40, (400, size))
        entries = rng.integers(-40, 40, (7, size))
        part = hamerly.Part(x)
        part.round(entries, np.zeros(7))
        for step in range(30):
            now = entries + rng.integers(-3, 4, entries.shape) * (rng.random(entries.shape) < 0.3) // (1 + step // 8)
            book = hamerly.Book([now], [entries])
            part.round(now, book.moves[0])
            entries = now
            assert part.codes.tolist() == hamerly.scan(x, entries)[0].tolist()
