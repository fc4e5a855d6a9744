"""Connected components by joins: every node takes its smallest neighbour as parent, parents are jumped, edges contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the smallest node of its component."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(edges.select("a", "b").where("a <> b"), "cc-edges")
    labels = None
    while not left.isEmpty():
        parent = written(both(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "cc-parents")
        while True:  # parents fall along every chain, so that this ends after log2 of the longest
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")), "cc-parents")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        labels = parent.select("node", F.col("up").alias("label")) if labels is None else written(labels.join(parent.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("_a")), parent.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        left = written(left.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "cc-edges")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
