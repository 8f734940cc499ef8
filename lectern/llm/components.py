"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable.  Ids are longs.

    Each round every node takes the smallest label among its neighbours and itself, then the label
    of that label; rounds grow with the logarithm of the longest path.  Labels are written to the
    shared folder each round, so lineage stays short, and per-node minima combine before the shuffle.
    Self-loops count their node; null ends are left out; no edges give no rows."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null")
    both = staged(one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.node == near.src, "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        nxt = staged(spread.join(up, "low", "left").select("node", "was", F.least("low", "up").alias("component")), "labels")
        moved = nxt.where("was != component").limit(1).count()
        dropped(labels.sparkSession, labels)
        labels = nxt.select("node", "component")
        if not moved:
            dropped(labels.sparkSession, both)
            return labels
