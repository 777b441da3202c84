"""The integrity checks of a derived corpus: name, violations, result (pass, warn or fail).

Rollups come as stored tables, so a check compares what is served with what it was made from. A null
amount is no amount; an empty corpus fails the first check and passes the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_CENTS = 500
OLDEST = "2007-01-01"


def _row(df: DataFrame, name: str, violations: Column, worst: str = "fail") -> DataFrame:
    return df.agg(violations.alias("violations")).select(F.lit(name).alias("check"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.when(F.coalesce("violations", F.lit(0)) == 0, "pass").otherwise(worst).alias("result"))


def non_empty(contracts: DataFrame) -> DataFrame:
    return _row(contracts, "non-empty-corpus", F.when(F.count("*") == 0, 1).otherwise(0))


def rollups_reconcile(contracts: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    """Rollups whose stored sum is off the base by more than the tolerance."""
    sums = contracts.agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("cents")).withColumn("name", F.lit(""))
    for name, stored in rollups.items():
        sums = sums.unionByName(stored.agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents")).withColumn("name", F.lit(name)))
    base = F.max(F.when(F.col("name") == "", F.col("cents")))
    gathered = sums.agg(base.alias("base"), F.collect_list(F.struct("name", "cents")).alias("all"))  # a row a rollup
    off = F.size(F.filter("all", lambda x: F.abs(x["cents"] - F.col("base")) > TOLERANCE_CENTS))
    return _row(gathered.select(off.alias("off")), "rollup-reconciliation", F.sum("off"))


def amount_parity(contracts: DataFrame) -> DataFrame:
    wrong = (F.col("flag") == "ok") & F.col("current_cents").isNotNull() & (F.col("amount_cents").isNull() | (F.abs(F.col("amount_cents") - F.col("current_cents")) > 1))
    return _row(contracts, "current-amount-parity", F.count_if(wrong))


def no_negative(contracts: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    """Negative amounts of flag ok, or a negative rollup row, fail; of another flag they warn."""
    out = contracts.agg(F.count_if((F.col("flag") == "ok") & (F.col("amount_cents") < 0)).alias("bad"), F.count_if((F.col("flag") != "ok") & (F.col("amount_cents") < 0)).alias("odd"))
    for stored in rollups.values():
        out = out.unionByName(stored.agg(F.count_if(F.col("cents") < 0).alias("bad")).withColumn("odd", F.lit(0).cast("long")))
    total = out.agg(F.sum("bad").alias("bad"), F.sum("odd").alias("odd"))
    return total.select(F.lit("no-negative-values").alias("check"), (F.col("bad") + F.col("odd")).alias("violations"), F.when(F.col("bad") > 0, "fail").when(F.col("odd") > 0, "warn").otherwise("pass").alias("result"))


def eik_consistent(bidders: DataFrame) -> DataFrame:
    shaped = F.coalesce(F.col("eik").rlike("^([0-9]{9}|[0-9]{13})$"), F.lit(False))
    return _row(bidders, "eik-validity", F.count_if(((F.col("eik_valid") == 1) & ~shaped) | ((F.col("eik_valid") != 1) & F.col("eik").isNotNull())))


def dates_sane(contracts: DataFrame, today: str, oldest: str = OLDEST) -> DataFrame:
    return _row(contracts, "date-sanity", F.count_if((F.col("signed_at") < oldest) | (F.col("signed_at") > today)), "warn")


def staging_reconciles(candidates: DataFrame, inserted: DataFrame) -> DataFrame:
    """More rows inserted than there were candidates, or none of some."""
    n = candidates.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(inserted.agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
    return _row(n, "staging-reconciliation", F.when((F.sum("m") > F.sum("n")) | ((F.sum("n") > 0) & (F.sum("m") == 0)), 1).otherwise(0))


def annex_twins(annexes: DataFrame) -> DataFrame:
    """Annexes that tell one change under two keys."""
    same = annexes.groupBy("unp", "contract_number", "value_before", "value_after", "published_at").agg((F.count("*") - 1).alias("more"))
    return _row(same, "amendment-twins", F.sum("more"), "warn")
