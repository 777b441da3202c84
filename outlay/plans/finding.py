"""Ranked search over companies, authorities and contracts, on a stored index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.operators import ranked
from outlay.plans.crosswalk import table
from outlay.plans.registry import register
from outlay.sources.scratch import scratch

LIMITS = {"company": 5, "authority": 7, "contract": 6}
ASKED = ["Am", "am, MA!", "sm ri", "00 br", "?"]

_ENTRIES = """SELECT 'company' AS kind, CAST(s_suppkey AS VARCHAR) AS ref, concat_ws(' ', s_name, n_name, r_name) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'authority', CAST(c_custkey AS VARCHAR), concat_ws(' ', c_name, c_mktsegment, n_name, r_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'contract', CAST(p_partkey AS VARCHAR), concat_ws(' ', p_name, p_brand, p_type, p_name) FROM part"""
_INDEX = f"WITH e AS ({_ENTRIES}), t AS (SELECT kind, ref, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM e), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t)"


def _scored_sql(asked: str, words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{w}'))) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"(SELECT count(*) FROM f WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(words)))
    return f"(WITH f AS (SELECT kind, ref, len(w) AS size, {tf} FROM t) SELECT '{asked}' AS q, kind, ref, round({score}, 6) AS score FROM (SELECT f.*, n.n, n.mean, {df} FROM f, n) WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(words)))})"


_WORDS = {"Am": ["am"], "am, MA!": ["am", "ma"], "sm ri": ["sm", "ri"], "00 br": ["00", "br"]}
_FOUND = _INDEX + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM {_scored_sql(q, w)}" for q, w in _WORDS.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, ref) AS rank, count(*) OVER (PARTITION BY q, kind) AS total FROM s)"
_LIMIT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LIMITS.items()) + " END"


def _results(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    where = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    companies = table(spark, sf, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    authorities = table(spark, sf, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    found = ranked.entries(companies, "company", "s_suppkey", "s_name", "n_name", "r_name")
    found = found.unionByName(ranked.entries(authorities, "authority", "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name"))
    found = found.unionByName(ranked.entries(table(spark, sf, "part"), "contract", "p_partkey", "p_name", "p_brand", "p_type", "p_name"))
    folder = scratch(spark, "search")
    ranked.write_index(found, folder)
    return {q: ranked.results(spark, folder, q, LIMITS) for q in ASKED}


@register(f"{_FOUND} SELECT q, kind, CAST(rank AS INT) AS rank, ref, score, total FROM r WHERE rank <= {_LIMIT}")
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (r.withColumn("q", F.lit(q)) for q, r in _results(spark, sf).items()))


@register(f"""{_FOUND}, g AS (SELECT q, kind, any_value(total) AS total, max(score) AS best FROM r GROUP BY ALL), h AS (SELECT *, max(CASE WHEN kind <> 'authority' THEN best END) OVER (PARTITION BY q) AS other FROM g)
  SELECT q, kind, total, best, CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN kind = 'authority' THEN CASE WHEN other IS NULL OR best >= other THEN 0 ELSE 9 END WHEN kind = 'company' THEN 1 ELSE 2 END) AS INT) AS place FROM h""")
def search_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (ranked.groups(r, ["company", "contract"], "authority").withColumn("q", F.lit(q)) for q, r in _results(spark, sf).items()))
