"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge: component is the smallest node that it is connected with.

    Each round links every neighbour to the smallest node around (large star: the larger neighbours; small star: the
    smaller ones). Rounds are aggregates and joins of edge rows, written to the shared folder, and as many as
    the logarithm of the longest chain; they stop when only stars are left. No group is collected.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: the larger neighbours of each node go to the smallest one around it.
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = stored(small.filter("u <> v").distinct(), "small")
        discard(now, large)
        now = small
        # Done once every node has one parent and no parent has one: each star is then a component.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("child")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("child")))
        if ends.groupBy("x").agg(F.sum("child").alias("up"), F.count(F.lit(1)).alias("all")).filter("up > 1 or up = 1 and `all` > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
