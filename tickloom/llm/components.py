"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, spread


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, after every node hands its neighbours over to the smallest of them."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    own = spread(least)
    if large:  # larger neighbours only
        moved = both.filter("v > u").join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours, and the node itself
        moved = both.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs): root is the smallest node of its component.

    Every round is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of the number
    of nodes. Self-links and repeated links do no harm; an empty table gives an empty result.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "links")
    before, state = None, _state(now)
    while state != before:
        last, now = now, materialise(_stars(_stars(now, True), False), "links")
        discard(last)
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
