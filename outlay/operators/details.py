"""What the page of one company, authority or contract shows, for all of them at once.

Contracts without an amount count but add nothing; shares of an empty whole are 0; ties go by
the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.operators.pick import latest_by


def procedure_mix(contracts: DataFrame, key: str, group: Column) -> DataFrame:
    """Contracts of each entity by procedure group, with their share; groups without any don't show."""
    n = contracts.groupBy(key, group.alias("procedure_group")).agg(F.count("*").alias("contracts"))
    total = Window.partitionBy(key)  # a handful of groups an entity
    return n.withColumn("share", F.round(F.col("contracts") / F.sum("contracts").over(total), 9))


def sector_profile(contracts: DataFrame, key: str) -> DataFrame:
    """The primary sector's share of an entity's value, and its average number of bids to one decimal."""
    sums = contracts.where("amount_cents is not null and coalesce(division, '') <> ''").groupBy(key, "division").agg(F.sum("amount_cents").alias("v"))
    top = sums.groupBy(key).agg(F.sum("v").alias("total"))
    first = latest_by(sums, [key], [F.desc("v"), F.asc("division")]).select(key, "division", "v")
    bids = contracts.groupBy(key).agg(F.sum("bids_received").alias("b"), F.count("bids_received").alias("n"))
    share = F.when(F.col("total") > 0, F.round(F.col("v") / F.col("total"), 9)).otherwise(F.lit(0.0))
    average = F.when(F.col("n") > 0, F.floor(F.col("b") * 10 / F.col("n") + 0.5) / 10)
    return first.join(top, key).join(bids, key).select(key, "division", share.alias("share"), average.alias("avg_bids"))


def top_partners(contracts: DataFrame, key: str, partner: str, n: int) -> DataFrame:
    """The partners with most value of each entity, with their rank."""
    pairs = contracts.where("amount_cents is not null").groupBy(key, partner).agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("contracts"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cents"), F.asc(partner))))
    return ranked.where(F.col("rank") <= n)


def yearly(contracts: DataFrame, key: str) -> DataFrame:
    return contracts.where("amount_cents is not null and signed_at is not null").groupBy(key, F.substring("signed_at", 1, 4).alias("year")).agg(F.count("*").alias("contracts"), F.sum("amount_cents").alias("cents"))


def value_timeline(contracts: DataFrame) -> DataFrame:
    """estimate (of the lot, else the procedure), signed and current value of each contract, and what changed, as rows."""
    estimate = F.coalesce(F.when(F.col("own_cents") > 0, F.col("own_cents")), F.when(F.col("procedure_cents") > 0, F.col("procedure_cents")))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), c.alias("cents")) for i, (n, c) in enumerate((("estimate", estimate), ("signed", F.col("signing_cents")), ("current", F.col("amount_cents"))))])
    return contracts.select("id", F.inline(F.filter(steps, lambda s: s["cents"].isNotNull())))


def framework_awards(contracts: DataFrame, lots: Column) -> DataFrame:
    """Procedures with more awards than lots (one at least)."""
    per = contracts.groupBy("tender_id").agg(F.count("*").alias("awards"), F.max(lots).alias("lots"))
    return per.select("tender_id", "awards", (F.col("awards") > F.greatest("lots", F.lit(1))).alias("framework"))


def competitors(contracts: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of suppliers that win from one authority, by how many authorities they share.

    Only an authority's first suppliers by value are paired, as its page shows them.
    """
    top = top_partners(contracts, "authority_id", "bidder_id", 5).select("authority_id", "bidder_id")
    pairs = top.join(top.withColumnRenamed("bidder_id", "other"), "authority_id").where("bidder_id < other")
    return pairs.groupBy("bidder_id", "other").agg(F.count("*").alias("authorities")).where(F.col("authorities") >= least)
