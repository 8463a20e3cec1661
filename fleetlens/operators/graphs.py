"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage, discard


def components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): the smallest node it is connected to.

    Alternating large and small stars: each round links neighbours to the smallest node in sight, and
    the number of rounds grows with the logarithm of the size, whatever the shape.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    spark, own = edges.sparkSession, []
    now, before = cut_lineage(now, "edges", own), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if state == before:
            if paths is not None:
                paths += own
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.union(down.select("a", "m")).distinct(), "edges", own)
        discard(spark, own.pop(0))
