"""Spending over time: dense calendars, year over year, partial periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlay.operators.rollups import cents


def monthly_series(contracts: DataFrame, first: str, last: str) -> DataFrame:
    """Contracts and value for every month of the span, months without any included."""
    spark = contracts.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("period"))
    base = contracts.where((F.col("signed_at") >= first) & (F.col("signed_at") <= last) & F.col("amount_cents").isNotNull())
    sums = base.groupBy(F.substring("signed_at", 1, 7).alias("period")).agg(F.count("*").alias("n"), F.sum("amount_cents").alias("c"))
    return calendar.join(sums, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("contracts"), cents(F.coalesce("c", F.lit(0))).alias("value_eur"))


def yearly_change(contracts: DataFrame, today: str) -> DataFrame:
    """Each valid year with its change over the year before; null if either is partial or the base isn't positive."""
    base = contracts.where(F.col("signed_at").rlike("^[0-9]{4}-") & (F.col("signed_at") <= today) & F.col("amount_cents").isNotNull())
    years = base.groupBy(F.substring("signed_at", 1, 4).alias("year")).agg(F.count("*").alias("contracts"), F.sum("amount_cents").alias("c"))
    order = Window.orderBy("year")  # one row a year
    before, year_before = F.lag("c").over(order), F.lag("year").over(order)
    partial = F.col("year") == today[:4]
    rising = ~partial & (before > 0) & (year_before.cast("int") == F.col("year").cast("int") - 1)
    return years.select("year", "contracts", cents("c").alias("value_eur"), partial.cast("int").alias("partial"), F.round(F.when(rising, (F.col("c") - before).cast("double") / before), 9).alias("change"))
