"""Connected components over written tables."""

from pyspark.sql import DataFrame, functions as F

from corrobora.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round a node takes the smallest label among its neighbours' and its own, then its label's label. The labels
    are written every round; the driver learns only whether any has changed. A node with very many neighbours is
    summed map-side, and adaptive execution splits it in the join.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(
            F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        lower = cut_lineage(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("onwards"))
        fresh = cut_lineage(lower.join(jump, lower["component"] == jump["at"]).select(
            "node", "before", F.least("component", "onwards").alias("component")))
        labels = fresh.select("node", "component")
        if fresh.filter("component < before").isEmpty():
            return labels
