"""Connected components of a link table by label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import Workspace


def components(links: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link; links has columns a and b (any order, repeats allowed).

    Each round takes the smallest label among a node's neighbours and then the label's own label, so
    long chains halve.  Hubs are aggregated in each task before they are shuffled, and the joins on
    them are sort-merge joins that adaptive execution can split.  Every round is written once.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = ws.cut(both, f"{name}-links")
    labels = ws.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("next"))
        after = ws.cut(step.join(jump, "c").select("node", "old", F.least("c", "next").alias("component")), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
