"""Connected components of verified links by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch_root, staged


def components(links: DataFrame, least: str = "a", other: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) of every node with a link to another.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so a
    star needs one round and a chain a number of rounds logarithmic in its length. Each round is written to the
    shared scratch folder; only a count comes to the driver. Null ends and links of a node to itself are ignored.
    """
    spark, root = links.sparkSession, scratch_root(links.sparkSession)
    pairs = links.select(F.col(least).alias("a"), F.col(other).alias("b")).where("a <> b")
    both = staged(pairs.union(pairs.select("b", "a")).distinct(), "links", root)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels0", root)
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        heads = labels.select(F.col("node").alias("head"), F.col("component").alias("jump"))
        jumped = lower.join(heads, F.col("component") == F.col("head"), "left").select("node", "was", F.least("component", F.coalesce("jump", "component")).alias("component"))
        after = staged(jumped, f"labels{step}", root)
        if not after.where("component <> was").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")
