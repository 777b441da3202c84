"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.workspace import materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """u -> the smallest of its neighbours and itself; pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_nearest(down), "u")
    return joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (u, component) for every node with a link; component: its smallest node.

    Self-links and nulls are ignored, repeated links count once, an empty table gives no rows.
    """
    edges = materialise(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        edges = materialise(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == mark:
            return edges.select("u", F.col("v").alias("component"))
        mark = now
