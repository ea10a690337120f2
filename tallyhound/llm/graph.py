"""Connected components of an edge table, by alternating large and small star steps.

Every step is joins and minima on the edges; no node's neighbours are ever gathered. Minima are
written before they are joined, so both sides are plain shuffles and adaptive execution can split the rows
of a node with many edges. Edges are written after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import stored


def _checksum(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (the least node of its component) for every node of `edges` (a, b), which may
    be of any orderable type. The number of rounds grows with the logarithm of the longest path."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _checksum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
        # Large star: greater neighbours move to the least node around.
        large = stored(both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # Small star: lesser neighbours and the node itself do.
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "least")
        small = (large.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        e = stored(small, "edges")
        after = _checksum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
