"""The contracts as chunked CSV, read back from the version in service (the reader takes the byte-order mark off)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.plans.crosswalk import contracts
from outlay.plans.registry import register
from outlay.sources import export
from outlay.sources.scratch import scratch

COLUMNS = ["id", "authority_id", "bidder_id", "subject", "signed_at", "amount_cents"]


@register("SELECT line, count(*) AS n FROM (SELECT concat_ws(',', id, CAST(authority_id AS VARCHAR), CAST(bidder_id AS VARCHAR), subject, signed_at, coalesce(CASE WHEN amount_cents < 0 THEN '''' || amount_cents ELSE CAST(amount_cents AS VARCHAR) END, '')) AS line FROM contracts UNION ALL SELECT 'id,authority_id,bidder_id,subject,signed_at,amount_cents') GROUP BY line")
def exported_lines(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "export")
    export.export(contracts(spark, sf, *COLUMNS), "id", COLUMNS, folder, "v1", chunk_rows=20_000)
    return spark.read.option("lineSep", export.END).text(export.current(spark, folder)).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
