"""Competition measures: single offers, concentration, direct awards, recurring pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.operators.rollups import cents

MIN_CONTRACTS = 20


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is nothing to share."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def _positive(when: Column | None = None) -> Column:
    test = F.col("amount_cents") > 0
    return F.coalesce(F.sum(F.when(test if when is None else test & when, F.col("amount_cents"))), F.lit(0))


def offer_totals(contracts: DataFrame) -> DataFrame:
    single = F.col("bids_received") == 1
    totals = contracts.where("bids_received >= 1").agg(F.count("*").alias("contracts"), F.count_if(single).alias("single_offer"), _positive().alias("v"), _positive(single).alias("s"))
    return totals.select(
        "contracts", "single_offer", share(F.col("single_offer"), F.col("contracts")).alias("single_offer_share"),
        cents("v").alias("value_eur"), cents("s").alias("single_value_eur"), share(F.col("s"), F.col("v")).alias("single_value_share"),
    )


def single_offer_by_authority(contracts: DataFrame, least: int = MIN_CONTRACTS, top: int = 20) -> DataFrame:
    grouped = contracts.where("bids_received >= 1").groupBy("authority_id").agg(F.count("*").alias("contracts"), F.count_if(F.col("bids_received") == 1).alias("single_offer"), cents(F.coalesce(F.sum("amount_cents"), F.lit(0))).alias("value_eur"))
    ranked = grouped.where(F.col("contracts") >= least).withColumn("share", F.col("single_offer").cast("double") / F.col("contracts"))
    return ranked.orderBy(F.desc("share"), F.desc("contracts"), "authority_id").limit(top)


def concentration(contracts: DataFrame, least: int = MIN_CONTRACTS, top: int = 20) -> DataFrame:
    """Herfindahl-Hirschman index of positive spend per supplier, for authorities with a choice.

    The sum of squares of the suppliers' cents is exact (decimal), so the index doesn't depend on order.
    """
    pair = contracts.where("amount_cents > 0").groupBy("authority_id", "bidder_id").agg(F.sum("amount_cents").alias("spent"), F.count("*").alias("n"))
    total = pair.groupBy("authority_id").agg(F.sum("spent").alias("total"), F.sum("n").alias("contracts"), F.count("*").alias("suppliers"), F.sum(F.col("spent").cast("decimal(19,0)") * F.col("spent").cast("decimal(19,0)")).alias("squares"))
    kept = total.where((F.col("contracts") >= least) & (F.col("suppliers") >= 2))
    hhi = F.round(F.col("squares").cast("double") / (F.col("total").cast("double") * F.col("total").cast("double")), 9)
    return kept.select("authority_id", "suppliers", "contracts", cents("total").alias("value_eur"), hhi.alias("hhi")).orderBy(F.desc("hhi"), F.desc("value_eur"), "authority_id").limit(top)


def procedure_competition(contracts: DataFrame, group: Column) -> DataFrame:
    g = contracts.withColumn("g", group)
    count = lambda *names: F.count_if(F.col("g").isin(*names))
    t = g.agg(count("open").alias("competitive"), count("direct").alias("non_competitive"), count("neutral").alias("neutral"), count("unknown").alias("unknown"), F.count("*").alias("contracts"), _positive(F.col("g").isin("open", "direct")).alias("v"), _positive(F.col("g") == "direct").alias("d"))
    return t.select(
        "competitive", "non_competitive", "neutral", "unknown", "contracts",
        share(F.col("non_competitive"), F.col("competitive") + F.col("non_competitive")).alias("non_competitive_share"),
        cents("v").alias("classified_eur"), share(F.col("d"), F.col("v")).alias("non_competitive_value_share"),
    )


def direct_award_by_authority(contracts: DataFrame, group: Column, least: int = MIN_CONTRACTS, top: int = 20) -> DataFrame:
    g = contracts.withColumn("g", group).where("g in ('open', 'direct')")
    grouped = g.groupBy("authority_id").agg(F.count("*").alias("classified"), F.count_if(F.col("g") == "direct").alias("non_competitive"), cents(F.coalesce(F.sum("amount_cents"), F.lit(0))).alias("value_eur"))
    ranked = grouped.where(F.col("classified") >= least).withColumn("share", F.col("non_competitive").cast("double") / F.col("classified"))
    return ranked.orderBy(F.desc("share"), F.desc("classified"), "authority_id").limit(top)


def recurring_pairs(contracts: DataFrame, top: int = 20) -> DataFrame:
    """Authority-bidder pairs with most contracts."""
    pairs = contracts.where("amount_cents is not null").groupBy("authority_id", "bidder_id").agg(F.count("*").alias("contracts"), F.sum("amount_cents").alias("c"))
    return pairs.orderBy(F.desc("contracts"), F.desc("c"), "authority_id", "bidder_id").limit(top).select("authority_id", "bidder_id", "contracts", cents("c").alias("won_eur"))
