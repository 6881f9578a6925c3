"""Graphs of edge tables: connected components and reachability, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import looked_up, stored
from .select import dense_ids


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; ``comp`` is the smallest node reachable.

    Labels spread to neighbours and then jump to the label of the label, so the
    rounds grow with the logarithm of a chain's length. Nothing is collected
    but one count a round; a node of many edges and a component of many nodes
    are met in many tasks.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "labels")
    while True:
        near = looked_up(both, "b", "a", labels.withColumnRenamed("node", "b")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        step = stored(step, "labels")
        up = labels.filter("comp < node").select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        after = stored(looked_up(step, "comp", "node", up, "left").select("node", "was", F.least("comp", "above").alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.filter("comp < was").isEmpty():
            return labels


def sized_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, part, size)`` for every one of ``nodes(node)``, lone ones too; parts are numbered by their smallest node."""
    found = nodes.select("node").distinct().join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = stored(found, "components")
    sizes = found.groupBy("comp").agg(F.count("*").alias("size"))
    sizes = stored(sizes, "sizes")
    numbered = sizes.join(dense_ids(sizes, "comp").withColumnRenamed("pos", "part"), "comp")
    return looked_up(found, "comp", "node", numbered).select("node", F.col("part").cast("long").alias("part"), "size")


def reachable(edges: DataFrame) -> DataFrame:
    """``(child, parent)`` over any number of ``edges(child, parent)``; the length of the paths doubles each round, cycles end."""
    pairs = stored(edges.select("child", "parent").distinct(), "reachable")
    n = pairs.count()
    while True:
        on = pairs.select("child", F.col("parent").alias("via")).join(pairs.select(F.col("child").alias("via"), "parent"), "via").select("child", "parent")
        pairs = stored(pairs.union(on).distinct(), "reachable")
        if (now := pairs.count()) == n:
            return pairs
        n = now
