"""Event-time windows on streams and tables, deduplication, and micro-batch refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "3 days"


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return _windowed(events, F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _windowed(events, F.window("ts", size, step))


def _windowed(events: DataFrame, window) -> DataFrame:  # noqa: ANN001
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", (F.col("cents").cast("double") / 100).alias("value"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """First sight of each key within the watermark; later and late twins fall away."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def refresh_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch; `apply` must give the same result when a batch repeats."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
