"""Connected components of a graph in DataFrames, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component (the smallest node reachable), for each node that has an edge.

    Every step is an aggregation and a join on a node, so a node with very many neighbours is split like any skewed key;
    each result is written to the shared folder. The number of steps grows with the logarithm of the largest component.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: each larger neighbour is tied to the smallest node around
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, old = materialise(large, "large"), now
        # small star: each smaller neighbour, and the node itself, is tied to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(tied.union(small.select("a", F.col("m").alias("b"))).distinct(), "small")
        release(large, old)
        state = tuple(now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if state == before:
            break
        before = state
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b"), F.col("b"))).distinct()
