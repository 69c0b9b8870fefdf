"""Connected components of a large graph, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import cut_lineage


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge: label is the least node of its component.

    Each round gives every node the least label around it and then the label of
    its label, so that the rounds grow with the logarithm of a chain's length.
    Messages are combined before they are shuffled, so a node with very many
    edges costs one row per task. Loops and repeated edges change nothing; no
    edges give no rows; nulls are left out.
    """
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = cut_lineage(clean.unionAll(clean.select(F.col("y"), F.col("x"))).distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    for _ in range(most_rounds):
        seen = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels.node == seen.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("above"), F.col("label").alias("top"))
        new = cut_lineage(near.join(up, near.label == up.above).select("node", "old", F.least("label", "top").alias("label")))
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
