"""Two-hop ego network over flow pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOP1, HOP2_SCAN = 6, 60


def ego_network(pairs: DataFrame, center: int) -> DataFrame:
    """Edges (hop, authority_id, bidder_id, won_eur): the centre's HOP1 largest bidders, and for each the
    other authority that paid it most. Only the HOP2_SCAN largest second-hop pairs are looked
    at: a bidder outside them has no second edge.
    """
    first = pairs.where(F.col("authority_id") == center).orderBy(F.desc("won_eur"), "bidder_id").limit(HOP1)
    beyond = pairs.where(F.col("authority_id") != center).join(F.broadcast(first.select("bidder_id")), "bidder_id", "left_semi")
    scanned = beyond.orderBy(F.desc("won_eur"), "authority_id", "bidder_id").limit(HOP2_SCAN)
    best = Window.partitionBy("bidder_id").orderBy(F.desc("won_eur"), "authority_id")
    second = scanned.withColumn("r", F.row_number().over(best)).where("r = 1")
    edge = lambda df, hop: df.select(F.lit(hop).alias("hop"), "authority_id", "bidder_id", "won_eur")
    return edge(first, 1).unionByName(edge(second, 2))


def default_center(pairs: DataFrame) -> DataFrame:
    """The authority with the largest spend (ties: smaller id)."""
    return pairs.groupBy("authority_id").agg(F.sum("won_cents").alias("s")).orderBy(F.desc("s"), "authority_id").limit(1).select("authority_id")


def node_weights(edges: DataFrame) -> DataFrame:
    """Sum of incident edges of each node of either kind."""
    ends = edges.select(F.lit("authority").alias("kind"), F.col("authority_id").alias("node"), "won_cents").unionByName(edges.select(F.lit("bidder").alias("kind"), F.col("bidder_id").alias("node"), "won_cents"))
    return ends.groupBy("kind", "node").agg((F.sum("won_cents").cast("double") / 100).alias("weight_eur"))
