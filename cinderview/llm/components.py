"""Connected components by alternating large and small stars.

Every round is two aggregates (combined before the shuffle) and two joins. What a
join reads is written to the shared folder first: both sides are plain shuffles then,
of which adaptive execution splits a node with many edges, lineage does not grow, and
lost executors cost one round at most.
"""

from pyspark.sql import functions as F

from .common import written


def stamp(edges):
    """Number and checksum of the edges: one row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(spark, edges):
    """``node, component`` for every node that has an edge: the smallest node it is connected to.

    ``edges`` has columns ``a, b`` (numbers, any direction, repeats and loops allowed).
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(spark, edges, "edges")
    seen = stamp(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(spark, both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        large = written(spark, large, "large-star")
        least = written(spark, large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(least, "a")
        small = small.select("a", F.col("least").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = written(spark, small.where("a <> b").distinct(), "edges")
        now = stamp(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
