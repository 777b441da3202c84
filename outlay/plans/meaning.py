"""Vector search over the embeddings, their labels as namespaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.operators import vectors
from outlay.plans.crosswalk import table
from outlay.plans.registry import register
from outlay.sources.scratch import scratch

#: Lists of the index, results of a query, share of them that the quick search is to find.
LISTS, TOP, SHARE = 32, 8, 0.9

_SQL = """WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS ns, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  n AS (SELECT *, list_sum(list_transform(v, lambda x: x * x)) AS norm FROM e), s AS (SELECT a.vec_id AS query, a.ns, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS DOUBLE) / sqrt(CAST(a.norm * b.norm AS DOUBLE)) AS score FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.ns = b.ns AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY ns, query ORDER BY score DESC, id) AS k FROM s)"""


def _ready(spark: SparkSession, sf: str) -> tuple[str, np.ndarray, DataFrame]:
    """(index folder, centroids, queries)."""
    rows = vectors.prepared(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("label"))
    centre, folder = vectors.fit(rows, LISTS), scratch(spark, "vectors")
    vectors.write_index(rows, centre, folder)
    return folder, centre, rows.where("id % 100 = 0")


@register(_SQL + f" SELECT query, ns, CAST(k AS INT) AS rank, id, score FROM r WHERE k <= {TOP}")
def semantic_search_exact(spark: SparkSession, sf: str) -> DataFrame:
    folder, centre, queries = _ready(spark, sf)
    return vectors.search(spark, folder, centre, queries, TOP, len(centre)).drop("probe")


@register("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, true AS found_nine_tenths FROM embeddings")
def semantic_search_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The quick search against the exact one over all queries: with the fewest probes that should do, is nine tenths found?"""
    folder, centre, queries = _ready(spark, sf)
    exact = vectors.search(spark, folder, centre, queries, TOP, len(centre))
    quick = vectors.search(spark, folder, centre, queries, TOP, vectors.needed_probes(exact, SHARE))
    per = vectors.recall(quick, exact)
    return per.agg(F.sum("queries").alias("queries"), (F.sum(F.col("recall") * F.col("queries")) >= 0.9 * F.sum("queries")).alias("found_nine_tenths"))
