"""Read-optimised totals over the canonical value base (rows whose amount is known)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.operators.pick import argmax_sum


def cents(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double") / 100


def entity_totals(contracts: DataFrame, key: str, partner: str) -> DataFrame:
    """Sum, count, distinct partners, EU part and span of dates for each entity."""
    base = contracts.where("amount_cents is not null")
    return base.groupBy(key).agg(
        F.sum("amount_cents").alias("sum_cents"),
        F.count("*").alias("contracts"),
        F.countDistinct(partner).alias("partners"),
        F.sum(F.when(F.col("eu_funded") == 1, F.col("amount_cents")).otherwise(0)).alias("eu_cents"),
        F.min("signed_at").alias("first_date"),
        F.max("signed_at").alias("last_date"),
    )


def primary_sector(contracts: DataFrame, key: str) -> DataFrame:
    return argmax_sum(contracts.where("amount_cents is not null"), [key], "division", "amount_cents")


def home_totals(contracts: DataFrame, since: str, today: str) -> DataFrame:
    """One row for the whole corpus; the date span is clamped to [since, today]."""
    known = F.col("amount_cents").isNotNull()
    past = F.col("signed_at") <= today
    return contracts.agg(
        F.count("*").alias("contracts"),
        cents(F.coalesce(F.sum("amount_cents"), F.lit(0))).alias("value_eur"),
        F.countDistinct(F.when(known, F.col("authority_id"))).alias("authorities"),
        F.countDistinct(F.when(known, F.col("bidder_id"))).alias("bidders"),
        F.min(F.when(past & (F.col("signed_at") >= since), F.col("signed_at"))).alias("first_date"),
        F.max(F.when(past, F.col("signed_at"))).alias("last_date"),
    )


def sector_totals(contracts: DataFrame) -> DataFrame:
    base = contracts.where("amount_cents is not null and coalesce(division, '') <> ''")
    return base.groupBy("division").agg(F.count("*").alias("contracts"), cents(F.sum("amount_cents")).alias("value_eur"))


def facet_counts(contracts: DataFrame) -> DataFrame:
    """Two facets in one pass by grouping sets."""
    eu = F.when(F.col("eu_funded") == 1, "1").otherwise("0")
    keyed = contracts.select("procedure_type", eu.alias("eu"), "amount_cents")
    grouped = keyed.groupingSets([["procedure_type"], ["eu"]], "procedure_type", "eu").agg(
        F.grouping("procedure_type").alias("_by_eu"), F.count("*").alias("contracts"), cents(F.coalesce(F.sum("amount_cents"), F.lit(0))).alias("value_eur")
    )
    by_eu = F.col("_by_eu") == 1
    return grouped.select(F.when(by_eu, "eu").otherwise("procedure").alias("facet"), F.when(by_eu, F.col("eu")).otherwise(F.col("procedure_type")).alias("key"), "contracts", "value_eur")


def flow_pairs(contracts: DataFrame) -> DataFrame:
    return contracts.where("amount_cents is not null").groupBy("authority_id", "bidder_id").agg(cents(F.sum("amount_cents")).alias("won_eur"), F.count("*").alias("contracts"))


QUANTILES = {"p25_eur": 0.25, "median_eur": 0.5, "p75_eur": 0.75, "p90_eur": 0.9, "p95_eur": 0.95, "p99_eur": 0.99}
#: Slices of a doubling of the value.
SLICES = 350


def values_at_ranks(base: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n, and for each name the value at a 1-based rank given as a column of n; null beyond the end.

    Equal values are counted first. A group's values are cut into slices of a fifth of a percent; sums
    of the slices' counts say which slice holds a rank, and only those slices are sorted. So no
    group is sorted whole, and a hot value is one row. Values must be positive.
    """
    counted = base.groupBy(group, value).agg(F.count("*").alias("c")).withColumn("slice", F.floor(F.log2(value) * SLICES))
    sliced = counted.groupBy(group, "slice").agg(F.sum("c").alias("c"))
    own = Window.partitionBy(group)  # some thousands of slices a group
    placed = sliced.select(group, "slice", "c", F.sum("c").over(own.orderBy("slice")).alias("until"), F.sum("c").over(own).alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]))
    wanted = placed.withColumn("w", names).where("w.rank > until - c and w.rank <= until").select(group, "slice", "n", F.col("w.name").alias("name"), (F.expr("w.rank - (until - c)")).alias("rank"))
    inside = counted.join(wanted, [group, "slice"]).withColumn("upto", F.sum("c").over(Window.partitionBy(group, "slice", "name").orderBy(value)))
    found = inside.where("upto >= rank").groupBy(group, "n", "name").agg(F.min(value).alias("v"))
    return found.groupBy(group, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])


def _priced(contracts: DataFrame) -> DataFrame:
    return contracts.where("amount_cents > 0 and coalesce(division, '') <> ''")


def cohort_percentiles(contracts: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of clean positive values for each division."""
    n = F.col("n")
    ranks = {name: F.floor((n * round(q * 100) + 99) / 100) for name, q in QUANTILES.items()}
    found = values_at_ranks(_priced(contracts), "division", "amount_cents", ranks)
    return found.select("division", n.alias("priced_contracts"), *[cents(k).alias(k) for k in QUANTILES])


#: Band, least cohort, anchor, next coarser anchor.
BANDS = [("top1", 100, "p99_eur", "p95_eur"), ("top5", 40, "p95_eur", "p90_eur"), ("top10", 20, "p90_eur", "p75_eur"), ("top25", 12, "p75_eur", "median_eur")]
MIN_COHORT = 12


def cohort_band(amount: Column) -> Column:
    """Coarse place of an amount among its cohort's percentiles; null without an honest comparison."""
    n, median, p25 = F.col("priced_contracts"), F.col("median_eur"), F.col("p25_eur")
    band = None
    for name, least, anchor, coarser in BANDS:
        test = (n >= least) & (F.col(anchor) > F.col(coarser)) & (amount > F.col(anchor))
        band = F.when(test, name) if band is None else band.when(test, name)
    band = band.when(amount > median, "above-median").when((amount < p25) & (n >= MIN_COHORT) & (median > p25), "bottom25").when(amount < median, "below-median").otherwise("at-median")
    return F.when((amount > 0) & (n >= MIN_COHORT), band)


def leave_one_out(contracts: DataFrame, quantile: float) -> DataFrame:
    """For each positive amount, the linear percentile of its division without it; divisions of one row have none.

    Without x the sorted values from x on move up by one. So three values of the whole division and
    a comparison with x give the two to interpolate between: one small row a division is joined.
    """
    base = _priced(contracts).select("id", "division", "amount_cents")
    at = (F.col("n") - 2) * F.lit(quantile)
    low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("n") - 2)
    points = values_at_ranks(base, "division", "amount_cents", {"a0": low + 1, "a1": low + 2, "b0": high + 1, "b1": high + 2}).where("n > 1")
    x = F.col("amount_cents")
    a, b = (F.when(F.col(f"{k}0") < x, F.col(f"{k}0")).otherwise(F.col(f"{k}1")) for k in "ab")
    return base.join(points, "division").select("id", "division", "amount_cents", "n", (a + (b - a) * (at - low)).alias("q"))
