"""Connected components of an edge table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of edges ``a, b`` (bigint).

    Every round links the larger neighbours of a node to its smallest one (large star), then its
    smaller neighbours (small star), until each node hangs on the smallest of its component. The
    rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder; a node with very many edges is an ordinary skewed join key. Loops and repeated edges
    are harmless.
    """
    edges = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
        state = now
