"""Choosing one of several: the latest, the most frequent, the first that isn't blank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order; rows with a null key are kept as they are."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where((F.col("_rank") == 1) | ~known).drop("_rank")


def name_order(value: str) -> list[Column]:
    """Between equally frequent names: with lower-case letters first, longer, then smaller."""
    return [F.desc(F.col(value).rlike(r"\p{Ll}")), F.desc(F.length(value)), F.asc(value)]


def mode_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties: with lower-case letters first, longer, then smaller."""
    counts = df.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(*keys, value).count()
    return latest_by(counts, keys, [F.desc("count"), *name_order(value)]).select(*keys, value, F.col("count").alias("n"))


def first_nonblank_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """For each column on its own, the value of the latest row that has one."""
    return df.groupBy(*keys).agg(*[F.max_by(F.nullif(F.trim(c), F.lit("")), F.when(F.trim(c) != "", order)).alias(c) for c in columns])


def argmax_sum(df: DataFrame, keys: Sequence[str], category: str, value: str) -> DataFrame:
    """The category with the largest sum for each key; ties: the smaller category."""
    sums = df.where(F.col(category).isNotNull() & (F.col(category) != "")).groupBy(*keys, category).agg(F.sum(value).alias("_sum"))
    return latest_by(sums, keys, [F.desc_nulls_last("_sum"), F.asc(category)]).drop("_sum")
