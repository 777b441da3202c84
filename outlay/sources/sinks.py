"""Writers that may run again: by source partition, by new version, as escaped CSV, as sitemap shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.coerce import csv_cell

SITEMAP_PAGE = 45_000


def replace_sources(df: DataFrame, path: str) -> None:
    """Rows of the sources in df replace what the path holds of these sources; others stay."""
    df.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key: the new row where there is one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_new").alias("_r"))
    return best.select(*keys, "_r.*")


def ship(df: DataFrame, path: str, version: str, served: int = 0) -> int:
    """Writes a version beside the served one and counts it; refuses to shrink below half."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    n = df.sparkSession.read.parquet(target).count()
    if n * 2 < served:
        raise ValueError(f"{n} rows would replace {served}")
    return n


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One escaped line a row."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """Escaped lines as text files; the header and the byte-order mark belong to the first line of the download."""
    csv_lines(df, columns).write.mode("overwrite").text(path)


def export_path(base: str, freshness: str, filtered: bool) -> str | None:
    """Where an unfiltered export is kept for one state of the data; None for filtered ones."""
    return None if filtered else f"{base}/{freshness}"


def sitemap_shards(df: DataFrame, id_col: str, page: int = SITEMAP_PAGE, slices: int = 64) -> DataFrame:
    """id, shard: pages of `page` ids in id order; null ids come first.

    A sampled range partitioning names `slices` borders; from then on a row's slice follows from its
    id alone, so counts and ranks agree however often the plan runs. Positions are the counts of
    the slices before and the rank within: no window over all rows.
    """
    sampled = df.select(id_col).where(F.col(id_col).isNotNull()).repartitionByRange(slices, id_col)
    borders = sorted(r["b"] for r in sampled.groupBy(F.spark_partition_id()).agg(F.min(id_col).alias("b")).collect())  # one a slice
    part = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= F.col(id_col))) if borders else F.lit(0)
    ranged = df.select(id_col).withColumn("_part", F.when(F.col(id_col).isNull(), 0).otherwise(part))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(id_col)) - 1)
    return ranked.join(F.broadcast(starts), "_part").select(id_col, F.floor((F.col("_start") + F.col("_r")) / page).cast("long").alias("shard"))
