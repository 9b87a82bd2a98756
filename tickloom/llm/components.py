"""Connected components of a graph that is far too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), where label is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label's own label, so chains
    shorten by half and stars are done in two rounds. Rounds are cut by tables in the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        lowest = near.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("next"))
        jumped = stage(lowest.join(target, F.col("label") == F.col("t"), "left").select(
            "node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        before = labels.select("node", F.col("label").alias("old"))
        if jumped.join(before, "node").filter(F.col("label") != F.col("old")).isEmpty():
            return jumped
        labels = jumped
