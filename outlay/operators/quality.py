"""Integrity checks, anomaly report and table parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE_CENTS = 500


def check(df: DataFrame, name: str, violations: str) -> DataFrame:
    """One row: the check's name, how many rows break it, and whether it holds."""
    n = F.count_if(F.expr(violations))
    return df.agg(n.alias("violations")).select(F.lit(name).alias("check"), "violations", F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("result"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def reconciled(name: str, rollup: DataFrame, base: DataFrame, column: str = "cents") -> DataFrame:
    """Sums of a rollup and of its base differ by no more than the tolerance."""
    both = rollup.agg(F.coalesce(F.sum(column), F.lit(0)).alias("a")).crossJoin(base.agg(F.coalesce(F.sum(column), F.lit(0)).alias("b")))  # one row each
    return check(both, name, f"abs(a - b) > {TOLERANCE_CENTS}")


def parity(left: DataFrame, right: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one table that the other lacks, both ways and with multiplicity."""
    columns = [c for c in left.columns if c not in volatile]
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right only")))


def outliers(leave_one_out_p95: DataFrame, ratio: float = 25, least: int = 12) -> DataFrame:
    return leave_one_out_p95.where((F.col("n") >= least) & (F.col("amount_cents") > ratio * F.col("q")))


def decimal_shifts(leave_one_out_median: DataFrame) -> DataFrame:
    """Amounts that only fit their cohort after division by 10 or 100."""
    m, x = F.col("q"), F.col("amount_cents")
    fits = lambda v: (v >= m / 2) & (v <= 2 * m)
    return leave_one_out_median.where((x > 2 * m) & (fits(x / 10) | fits(x / 100))).withColumn("divisor", F.when(fits(x / 10), 10).otherwise(100))


def anomalies(findings: dict[str, DataFrame]) -> DataFrame:
    """Each flagged id once, with the names of the findings that flag it, in order."""
    named = None
    for name, df in findings.items():
        one = df.select("id", F.lit(name).alias("finding"))
        named = one if named is None else named.unionByName(one)
    return named.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("finding")), ",").alias("findings"))
