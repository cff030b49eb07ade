"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .exchange import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges(a, b)`: the smallest node that it reaches.

    Each round hooks every node's label to the smallest label beside it, then replaces labels by their own
    labels, so chains shorten by more than half a round. Hot nodes are met by map-side minimums and by joins
    that Spark splits. Ends when a round changes nothing.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(beside, labels["node"] == beside["a"]).select("node", "label", F.least("label", "seen").alias("next"))
        lower = saved(lower)
        # A label whose node was hooked to a smaller one passes that on to all its holders.
        hooks = lower.where("next < label").groupBy("label").agg(F.min("next").alias("to"))
        if hooks.isEmpty():
            return labels
        up = hooks.select(F.col("label").alias("next"), F.col("to").alias("further"))
        moved = lower.join(hooks, "label", "left").select("node", F.least("next", F.coalesce("to", "next")).alias("next"))
        jumped = moved.join(up, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"))
        labels = jumped
