"""Connected components of small, derived edge tables (clusters of topics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge.

    Labels travel along edges and then jump to their label's label until nothing changes, so that rounds grow with the
    logarithm of a chain's length.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("root").alias("other")), "y").groupBy("x").agg(F.min("other").alias("least"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = step.select("node", "root")
        if step.where("old <> root").isEmpty():
            return labels
