"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is connected with) for each node of edges (a, b) that has a smaller one.

    Every round replaces edges by as many at most, each node linked to the smallest of its neighbours; it ends when all
    edges are stars, after rounds of the order of the logarithm of the nodes. Rounds are written to the shared folder, and
    the one before is removed; nothing is gathered but whether an edge changed. Nodes with very many neighbours can be split
    between tasks, as least values are dealt out before they are joined.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = common.store(edges, "edges")
    while True:
        # large star: the larger neighbours of a node are linked to the smallest of it and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u")
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m")).repartition("b")
        small = large.join(least, "b").select("m", "a", "b")
        small = small.select(F.col("m").alias("a"), F.col("b")).union(small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new = common.store(small, "edges")
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        common.discard(edges)
        edges = new
        if not changed:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
