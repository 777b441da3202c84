"""As-of join with a bounded look-back, as an equi-join on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_date: str, right_date: str, value: str, days: int, row_id: str) -> DataFrame:
    """left + value of the latest right row of the same `by` at or at most `days` before left_date.

    Dates fall into buckets of `days` + 1, so a left row can only match its own bucket or the one
    before: two candidates an equi-join finds, whatever the size of either side. Left rows
    without a match, or with a null key, get null; of several values on one date the largest counts.
    `row_id` must tell left rows apart.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / width)
    ahead = right.select(F.col(by).alias("_by"), F.col(right_date).cast("date").alias("_at"), F.col(value).alias("_value"))
    ahead = ahead.withColumn("_bucket", bucket(F.col("_at")))
    sought = left.select(F.col(row_id).alias("_row"), F.col(by).alias("_by"), F.col(left_date).cast("date").alias("_on"))
    sought = sought.withColumn("_bucket", F.explode(F.array(bucket(F.col("_on")), bucket(F.col("_on")) - 1)))
    near = sought.join(ahead, ["_by", "_bucket"]).where((F.col("_at") <= F.col("_on")) & (F.datediff("_on", "_at") <= days))
    best = near.groupBy("_row").agg(F.max(F.struct("_at", "_value"))["_value"].alias(value))
    return left.join(best, left[row_id] == best["_row"], "left").drop("_row")


def coverage_gaps(left: DataFrame, right: DataFrame, by: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """For each `by`: how many distinct left dates have no right row within the look-back, and their span."""
    dates = left.select(by, left_date).where(F.col(by).isNotNull() & F.col(left_date).isNotNull()).distinct().withColumn("_id", F.concat_ws("|", by, left_date))
    found = asof_join(dates, right.withColumn("_one", F.lit(1)), by, left_date, right_date, "_one", days, "_id")
    return found.where("_one is null").groupBy(by).agg(F.count("*").alias("missing"), F.min(left_date).alias("first_date"), F.max(left_date).alias("last_date"))
