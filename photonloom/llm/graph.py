"""Connected components over an edge table, with every round on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Each round takes the smallest label of the neighbours and then jumps to the label's own label, so
    the rounds grow with the logarithm of a chain's length. Rounds are cut by written tables. Nodes
    without an edge have no row; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = staged(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    labels = staged(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = staged(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new")), "lower")
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = staged(lower.join(jump, "new").select("node", "old", F.least("new", "far").alias("component")), "labels")
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
