"""Contiguous shards of near equal bytes: global prefix sums of sizes, cut at equal targets.

Documents stand in one order: by id, then size and checksum, null ids first; rows equal in all of these
give equal results and are interchangeable.  One pass over the texts leaves a number, the id, the size
and the checksum of each row; all else works on that narrow table.  It is dealt out by ranges of the
order with the number last, so rows of one id, or of none, spread like any others.  Partitions' totals,
as many rows as there are partitions, give the bytes and rows before each; running sums inside a
partition give the rest.  A document goes to the shard in whose span of bytes its middle lies, so a
shard ends half a document off its target at most.  The rank at which a shard begins is counted in the
one partition that its target falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, staged

#: Production parameters.
SHARDS = 8
LAW = "bytes"
#: Rows of a shard that are written together.
PIECE = 100_000
#: monotonically_increasing_id has the partition above so many bits, the row in it below.
BITS = 33


def sized(docs: DataFrame, id_col: str, text_col: str, rid: Column) -> DataFrame:
    """doc_id, size, text_crc32, rid: UTF-8 bytes of the text plus 1 (null: 1), their unsigned checksum, the row's number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), rid.alias("rid"))


def ordered(narrow: DataFrame) -> DataFrame:
    """narrow as a written table in ranges of the order; `at` counts up along it, anew in each partition `part`."""
    keys = ["doc_id", "size", "text_crc32", "rid"]
    at = F.monotonically_increasing_id()
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at)
    return staged(ranged.withColumn("part", F.shiftright("at", BITS)), "ordered")


def offsets(rows: DataFrame) -> DataFrame:
    """part, bytes in it, bytes and rows before it: a written table of as many rows as there are partitions."""
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return staged(totals.select("part", "bytes", summed("bytes").alias("bytes_before"), summed("n").alias("rows_before")), "offsets")


def placed(rows: DataFrame, totals: DataFrame, whole: int, shards: int) -> DataFrame:
    """rows with their rank in the order and their shard."""
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("through", F.sum("size").over(inside)).join(F.broadcast(totals.drop("bytes")), "part")
    # Twice the place of the document's middle, over twice the target's length.
    shard = F.expr(f"CAST(CAST(2 * (bytes_before + through) - size AS DECIMAL(20,0)) * CAST({shards} AS DECIMAL(10,0)) div CAST({2 * whole} AS DECIMAL(20,0)) AS INT)")
    return run.withColumn("shard", shard).withColumn("rank", F.col("rows_before") + F.col("at").bitwiseAND(F.lit((1 << BITS) - 1)))


def cuts(rows: DataFrame, totals: DataFrame, whole: int, shards: int) -> list[int]:
    """The rank at which each shard begins."""
    parts, holds = totals.collect(), {}
    for k in range(1, shards):
        holds[k] = next(p for p in parts if p.bytes_before * shards <= k * whole < (p.bytes_before + p.bytes) * shards)
    own = rows.where(F.col("part").isin(sorted({p.part for p in holds.values()})))
    counts = placed(own, totals, whole, shards).groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n")).collect() if holds else []
    return [0] + [p.rows_before + sum(c.n for c in counts if c.part == p.part and c.shard < k) for k, p in sorted(holds.items())]


def _assigned(narrow: DataFrame, shards: int) -> DataFrame:
    """narrow (a written table, deleted here) with shard and slot."""
    rows = ordered(narrow)
    dropped(narrow.sparkSession, narrow)
    totals = offsets(rows)
    whole = totals.agg(F.sum("bytes")).first()[0]
    if whole is None:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    starts = F.array(*[F.lit(c).cast("long") for c in cuts(rows, totals, whole, shards)])
    return placed(rows, totals, whole, shards).withColumn("slot", F.col("rank") - F.element_at(starts, F.col("shard") + 1))


def assigned(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Shards 0 to shards - 1 are contiguous in the order of ids and as near to equal in bytes as documents
    allow; slots count from 0 in each.  A null text has no bytes and counts 1, like an empty one; null
    ids come first; rows that repeat have slots of their own; a document longer than a shard's share
    leaves the shards that it covers empty; fewer rows than shards leave shards empty; an empty table
    gives none.  Equal texts go where their ids do: this law keeps no groups together.  grown_shard is
    null, as another number of shards moves every cut.  Other columns are not read."""
    narrow = staged(sized(docs, id_col, text_col, F.monotonically_increasing_id()), "sizes")
    found = _assigned(narrow, shards)
    return found.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs, whole, with shard and slot as `assigned` gives them; columns of these names are replaced.

    The rows are written once with their numbers, and meet their places by them."""
    whole = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    narrow = staged(sized(whole, f"row.{id_col}", f"row.{text_col}", F.col("rid")), "sizes")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return whole.join(_assigned(narrow, shards).select("rid", "shard", "slot"), "rid").select(*kept, "shard", "slot")


def written(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards as folders shard=0, shard=1, ... under path, rows in order of their slots; read back.

    A shard is written by as many tasks as it has pieces of PIECE rows."""
    rows = sharded(docs, shards, id_col, text_col)
    rows.repartition("shard", F.floor(F.col("slot") / PIECE)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
