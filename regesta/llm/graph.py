"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regesta.session import materialise, materialise_with


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for every node of the edges (a, b).

    Every round each node takes the least label around it and then the label of that label, which halves long chains;
    it ends when a round changes nothing. A hub's labels are combined before the shuffle. Each round is written
    to the shared folder, so the plan stays short. Self-loops and repeated edges do no harm; no edges, no rows.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    edges = both.select(F.col("a").alias("_a"), F.col("b").alias("_b"))

    while True:
        least = edges.join(labels, F.col("_b") == F.col("node")).groupBy("_a").agg(F.min("component").alias("m"))
        near = labels.join(least, F.col("node") == F.col("_a"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        # the label of that label, as it was before this round: chains get shorter by half
        further = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        after, seen = materialise_with(near.join(further, F.col("component") == F.col("via"), "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"), "labels", moved=F.count_if(F.col("old") != F.col("component")))
        labels = after.select("node", "component")
        if not seen["moved"]:
            return labels
