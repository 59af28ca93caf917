"""Connected components by alternating large-star / small-star contraction, on DataFrames only.

Every round is a partial aggregate and joins that Spark's adaptive skew handling can split; rounds
are cut with tables in the shared checkpoint folder. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "u")
    return both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from the larger node a to the smaller b."""
    low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = e.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge (a, b); root is the component's smallest node."""
    e = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        e = save(_small_star(_large_star(e)), "cc")
        was, mark = mark, _mark(e)
        if mark == was:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
