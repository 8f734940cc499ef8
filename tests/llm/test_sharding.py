"""Shards by bytes against one running sum in Python, on given and odd rows, and as files."""

import collections
import random
import zlib

import pytest

from lectern.llm import sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, size string, shard string, rid int, part int"
LONG = "päragraph of some length " * 4000


def brute(rows, shards):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) by one pass in order."""
    order = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    whole, before, slots, out = sum(r[2] for r in order), 0, collections.Counter(), []
    for known, i, size, crc in order:
        shard = (2 * before + size) * shards // (2 * whole)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def rows_of(df, **more):
    found = sharding.assigned(df, **more).collect()
    assert all(r.law == "bytes" and r.grown_shard is None for r in found)
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found), key=str)


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 8)
    assert rows_of(docs) == want == rows_of(docs.repartition(7))
    sizes, largest = collections.Counter(), max(r[1] for r in want)
    for _, size, _, shard, _ in want:
        sizes[shard] += size
    assert all(abs(sizes[k] - sum(sizes.values()) / 8) <= largest for k in range(8))


ODD = [(1, None), (2, ""), (3, "é"), (3, "é"), (3, "b"), (None, "no id"), (None, "no id"), (None, None), (4, "a" * 50), (5, "same"), (6, "same")]


@pytest.mark.parametrize(
    "rows",
    [ODD, ODD + [(9, LONG)], ODD + [(0, LONG)], [(7, "hot")] * 400 + ODD, [(None, "hot")] * 300 + ODD, [(i, "x" * random.Random(i).randrange(90)) for i in range(500)], [(1, "one")], [(1, None)] * 3],
    ids=["odd", "last document longer than a share", "first one", "hot id", "hot null id", "many", "one", "empty texts"],
)
def test_sharding_of_odd_rows(spark, rows):
    df = spark.createDataFrame([(i, t, "s", "t", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    for shards in (3, 8) if len(rows) > 3 else (1, 8):
        assert rows_of(df, shards=shards) == brute(rows, shards)


def test_sharding_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.assigned(df).count() == 0 and sharding.sharded(df).columns == ["doc_id", "text", "size", "rid", "part", "shard", "slot"]


def test_shards_as_files(spark, tmp_path):
    rows = ODD + [(i, "text %d " % i * (i % 30)) for i in range(20, 300)]
    df = spark.createDataFrame([(i, t, "s", "t", 1, 2) for i, t in rows], SCHEMA)
    back = sharding.written(df, f"file://{tmp_path}/shards", 4).collect()
    found = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in back), key=str)
    assert found == brute(rows, 4) and all((r["size"], r.rid, r.part) == ("s", 1, 2) for r in back)
