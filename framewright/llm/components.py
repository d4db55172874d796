"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (smallest reachable node) for every node of ``links (a, b)``.

    Each round takes the smallest label among the neighbours and then follows
    labels once (pointer jumping), so rounds grow with the logarithm of the
    longest path.  Only the number of changed labels comes to the driver.
    """
    edges = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low"))
        up = lower.select(F.col("node").alias("up"), F.col("low").alias("component"))
        new = scratch.keep(lower.join(up, lower.low == up.up).select("node", "old", "component"))
        changed = new.filter("component < old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            scratch.drop(edges)
            return labels.select("node", "component")
