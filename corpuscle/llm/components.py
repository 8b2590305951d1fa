"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node; root is the smallest node of its component.

    Each round is two joins over the whole edge table; the edges of a hub are spread by Spark's skew join, the
    minimum per node is pre-aggregated, and the rounds stop when no edge moves (about the logarithm of the longest path).
    Null ends and loops are ignored. Only two numbers per round come to the driver.
    """
    pairs = edges.where(F.col(a) != F.col(b))
    now = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while (mark := _signature(now)) != seen:
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.union(least).distinct(), "small-star")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])
