"""Connected components of a graph of links, by contraction: nothing but labels and label pairs moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node that can be reached.

    Each round gives every label the least label beside it, jumps twice along these parents and
    replaces the labels of the links, so links within a part vanish and their count shrinks quickly. Links must not be
    null; those of a node with itself, and repeated ones, are no matter; without links there are no rows."""
    edges = common.stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = common.stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        parents = common.stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parents = parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        parents = common.stored(parents)
        to = parents.select(F.col("node").alias("label"), "parent")
        # late in the rounds one label may be that of most nodes
        sized = common.stored(labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(to, "label"))
        labels = common.stored(common.spread_join(labels, sized, ["label"], "rows", ["node"], "left").select("node", F.coalesce("parent", "label").alias("label")))
        of = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_up"))
        moved = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        edges = common.stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return labels.select("node", F.col("label").alias("component"))
