"""Joint procedures: parallel lists of codes and names, split by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_members(df: DataFrame, key: str, codes: str, names: str, separator: str = ";") -> DataFrame:
    """One row a member: key, ordinal from 0, code, name; blank codes are dropped, missing names null."""
    part = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), separator), lambda x: F.trim(x))
    zipped = df.select(key, F.posexplode(F.arrays_zip(part(codes).alias("code"), part(names).alias("name"))))
    return zipped.select(key, F.col("pos").alias("ordinal"), F.col("col.code").alias("code"), F.nullif(F.col("col.name"), F.lit("")).alias("name")).where("code <> ''")


def leads(members: DataFrame, key: str, usual: DataFrame) -> DataFrame:
    """key -> lead code: the code usual for the key's prefix, else the first member.

    usual(key, usual): the most frequent code of the key's prefix.
    """
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce(F.col("code") == F.col("usual"), F.lit(False))), "ordinal", "code")
    return members.join(usual, key, "left").withColumn("r", F.row_number().over(order)).where("r = 1").select(key, F.col("code").alias("lead"))


def bridge(members: DataFrame, lead: DataFrame, key: str) -> DataFrame:
    """key, code, place from 0: the lead first, then the members in their order, each code once."""
    once = members.groupBy(key, "code").agg(F.min("ordinal").alias("ordinal"))
    order = Window.partitionBy(key).orderBy(F.desc(F.col("code") == F.col("lead")), "ordinal", "code")
    return once.join(lead, key).select(key, "code", (F.row_number().over(order) - 1).alias("place"))
