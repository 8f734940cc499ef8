"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources
alike) and 1 (as they come).  The exponent is bisected to meet a target: an entropy of the weights,
or the most times any source may be repeated.  Weights times the token budget are the sources'
budgets.  Each source's documents are dealt by hash into BLOCKS blocks; an epoch is a permutation of
them.  A source gives as many whole epochs as its budget holds and, of one more permutation, the
blocks that come nearest to the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Production parameters.
MAX_REPEATS = 1.5
BLOCKS = 1024
SEED = 20240601
BROADCAST_ROWS = 200_000
#: The exponent is found to within 2 ** -HALVINGS, AHEAD halvings in a job.
HALVINGS, AHEAD = 40, 5

NO_SOURCE = "\u0000"


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space (null: none)."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


class Curve:
    """What weights of one exponent come to, over all sources of (tokens): their normaliser and entropy.

    Sources stay where they are.  An exponent's figures are two sums over them, in logarithms relative
    to the largest source, and one job gives the figures of many exponents, a row each."""

    def __init__(self, totals: DataFrame):
        self.live = totals.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("log"))
        got = self.live.agg(F.min("log").alias("low"), F.max("log").alias("high")).first()
        self.low, self.high = got["low"], got["high"]
        self.known: dict[float, tuple[float, float]] = {}

    def at(self, exponents: list[float]) -> dict[float, tuple[float, float]]:
        """Per exponent: the sum of the weights before they are normalised, and their entropy in bits."""
        new = [x for x in exponents if x not in self.known]
        if new:
            rel = F.col("x") * (F.col("log") - F.lit(self.high))
            each = self.live.select("log", F.explode(F.array(*[F.lit(x) for x in new])).alias("x"))
            for r in each.groupBy("x").agg(F.sum(F.exp(rel)).alias("s"), F.sum(rel * F.exp(rel)).alias("e")).collect():
                self.known[r["x"]] = (r["s"], math.log2(r["s"]) - r["e"] / r["s"] / math.log(2))
        return {x: self.known[x] for x in exponents}

    def total(self, x: float, budget: float | None) -> float:
        """The mixture's tokens.  Without a budget it is the least that reads every source whole: as a
        weight grows no faster than its source, the largest source is the last to be."""
        return budget if budget is not None else math.exp(self.high) * self.known[x][0]

    def most_repeats(self, x: float, budget: float | None) -> float:
        """Times the smallest source is read, which is the most any source is."""
        return self.total(x, budget) / self.known[x][0] * math.exp(x * (self.low - self.high) - self.low)


def bisected(curve: Curve, budget: float | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent: the least whose largest repetition is within max_repeats, or the one whose
    weights have the given entropy in bits (clamped to what exponents from 0 to 1 can reach).

    Each job takes the midpoints that the next AHEAD bisections can come to."""

    def too_flat(x: float) -> bool:
        return curve.known[x][1] > entropy if entropy is not None else curve.most_repeats(x, budget) > max_repeats

    low, high = 0.0, 1.0
    curve.at([low, high])
    if not too_flat(low):
        return low
    for _ in range(0, HALVINGS, AHEAD):
        parts = 2**AHEAD
        curve.at([low + (high - low) * k / parts for k in range(1, parts)])
        for step in range(AHEAD):
            mid = (low + high) / 2
            low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def _plan(docs: DataFrame, p: str, budget, max_repeats, entropy) -> DataFrame:
    """Which block of which source is read in which epoch, and where: source, block, epoch,
    block_rank, order_key.  At most BLOCKS rows a source and epoch."""
    blocks = staged(docs.groupBy(f"{p}source", f"{p}block").agg(F.sum(f"{p}tokens").alias("tokens")), "blocks")
    totals = staged(blocks.groupBy(f"{p}source").agg(F.sum("tokens").alias("tokens")), "sources")
    curve = Curve(totals)
    times = F.lit(0.0)
    if curve.high is not None:
        x = bisected(curve, budget, max_repeats, entropy)
        log = F.log(F.col("tokens").cast("double"))
        times = F.when(F.col("tokens") > 0, F.exp(F.lit(x) * (log - F.lit(curve.high)) - log) * F.lit(curve.total(x, budget) / curve.known[x][0])).otherwise(F.lit(0.0))
    # A source of no tokens costs no budget: once.  Whole epochs keep a hair of rounding.
    whole_epochs = F.floor(F.col("times") + F.lit(1e-9))
    rest = F.greatest(F.lit(0.0), F.col("times") - whole_epochs) * F.col("tokens")
    shares = totals.withColumn("times", times).select(f"{p}source", F.when(F.col("tokens") > 0, whole_epochs).otherwise(F.lit(1)).cast("int").alias("epochs"), F.when(F.col("tokens") > 0, rest).otherwise(F.lit(0.0)).alias("rest"))
    each = blocks.join(shares, f"{p}source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    shuffled = W.partitionBy(f"{p}source", "epoch").orderBy(F.xxhash64(F.lit(SEED), f"{p}source", "epoch", f"{p}block"), f"{p}block")
    ranked = each.withColumn("block_rank", F.row_number().over(shuffled)).withColumn("before", F.sum("tokens").over(shuffled) - F.col("tokens"))
    taken = ranked.where((F.col("epoch") < F.col("epochs")) | (F.col("before") + F.col("tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0))
    stream = W.partitionBy(f"{p}source").orderBy("epoch", "block_rank")
    whole = W.partitionBy(f"{p}source")
    placed = taken.withColumn("order_key", (F.sum("tokens").over(stream) - F.col("tokens") / 2) / F.greatest(F.sum("tokens").over(whole), F.lit(1)))
    return staged(placed.select(f"{p}source", f"{p}block", "epoch", "block_rank", "order_key"), "plan")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, carry: bool = False) -> DataFrame:
    """The mixture as rows, one for each time a document is read.

    Without carry: doc_id, source, n_tokens, epoch, block, block_rank, order_key (sorting by it
    interleaves the sources in proportion).  With carry: the columns of docs, repeated as the
    mixture says.  budget in tokens; None is the least that reads every document at least once, so
    nothing is dropped.  Null sources are a source of their own; null and empty texts have no tokens
    and go with their block; equal rows share a block and are each read; an empty table gives no rows."""
    p = "mix_in_"
    kept = [F.col(f"`{c}`") for c in docs.columns] if carry else [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.lit(SEED), F.coalesce(F.col(f"`{id_col}`").cast("string"), text)), F.lit(BLOCKS)).cast("int")
    rows = docs.select(*kept, F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias(f"{p}source"), block.alias(f"{p}block"), n_tokens(F.col(f"`{text_col}`")).alias(f"{p}tokens"))
    if not carry:
        rows = staged(rows, "mix")
    plan = _plan(rows, p, budget, max_repeats, entropy)
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    out = rows.join(plan, [f"{p}source", f"{p}block"])
    if carry:
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.select("doc_id", "source", F.col(f"{p}tokens").alias("n_tokens"), "epoch", F.col(f"{p}block").alias("block"), "block_rank", "order_key")
