"""Connected components by alternating large-star and small-star rounds over a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or smaller) neighbours to its smallest one; edges are (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of each node in an edge, component being the smallest node it is connected to.

    Equal ends and repeated edges are allowed; an empty edge table gives an empty result.
    """
    edges = stored(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now.n, now.h) or not now.n:
            break
        mark = (now.n, now.h)
        edges = stored(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
