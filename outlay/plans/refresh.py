"""Three windows with late corrections, withdrawn rows and annexes in any order, against one derive of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.operators import maintenance
from outlay.operators.amendments import latest_values
from outlay.plans.crosswalk import table
from outlay.plans.registry import register
from outlay.sources.scratch import scratch

WINDOWS = (1, 2, 3)

#: Versions: 2 corrects (and may come before what it corrects), 0 is an old one that comes last, 3 withdraws.
_COLS = "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS id, CAST({v} AS BIGINT) AS version, {gone} AS gone, CAST(l_orderkey AS STRING) AS unp, CAST({a} AS STRING) AS authority, CAST(l_suppkey AS STRING) AS bidder, l_shipmode_ AS sector, CAST(floor(l_extendedprice * {x} + 0.5) AS BIGINT) AS cents, CAST(CAST(l_shipdate AS DATE) AS STRING) AS signed"
_LINE = "(SELECT *, concat(l_returnflag, l_linestatus) AS l_shipmode_ FROM lineitem) AS li"


def _came(window: str, v: int, a: str, x: int, where: str, gone: str = "false") -> str:
    return f"SELECT {window} AS w, {_COLS.format(v=v, a=a, x=x, gone=gone)} FROM {_LINE} WHERE {where}"


_CONTRACTS = " UNION ALL ".join([
    _came("1 + l_orderkey % 3", 1, "l_partkey % 97", 100, "true"), _came("1 + (l_orderkey + l_linenumber) % 3", 2, "(l_partkey + 1) % 97", 150, "l_partkey % 7 = 0"),
    _came("3", 0, "l_partkey % 97", 999, "l_partkey % 5 = 0"), _came("2 + l_orderkey % 2", 3, "l_partkey % 97", 100, "l_partkey % 23 = 0", "true"),
])
_ANNEX_COLS = "concat_ws(':', 'am', CAST(o_orderkey AS STRING), '{k}') AS key, CAST({v} AS BIGINT) AS version, concat_ws(':', CAST(o_orderkey AS STRING), CAST({line} AS STRING)) AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published, CAST(floor(o_totalprice * {x} + 0.5) AS BIGINT) AS cents"
_ANNEXES = " UNION ALL ".join(
    f"SELECT {w} AS w, {_ANNEX_COLS.format(k=k, v=v, line=line, x=x)} FROM orders WHERE {where}"
    for w, k, v, line, x, where in [("1 + o_custkey % 3", "a", 1, "1 + o_custkey % 2", 20, "o_orderkey % 3 = 0"), ("1 + (o_custkey + 1) % 3", "a", 2, "1 + o_custkey % 3", 40, "o_orderkey % 9 = 0"), ("3", "b", 1, "1", 90, "o_orderkey % 4 = 0")]
)

_FULL = f"""WITH cc AS ({_CONTRACTS}), aa AS ({_ANNEXES}),
  c AS (SELECT id, max((version, gone, unp, authority, bidder, sector, cents, signed)) AS v FROM cc GROUP BY id), cr AS (SELECT id, v[2] AS gone, v[4] AS authority, v[5] AS bidder, v[6] AS sector, v[7] AS cents, v[8] AS signed FROM c),
  a AS (SELECT key, max((version, id, published, cents)) AS v FROM aa GROUP BY key), ar AS (SELECT v[2] AS id, max((v[3], key, v[4]))[3] AS now FROM a GROUP BY 1),
  s AS (SELECT cr.id, authority, bidder, sector, coalesce(now, cents) AS cents, CASE WHEN now >= 5 * cents THEN 'annex_suspect' ELSE 'ok' END AS flag, signed FROM cr LEFT JOIN ar ON ar.id = cr.id WHERE NOT gone), ok AS (SELECT * FROM s WHERE flag = 'ok')"""


def rule(contracts: DataFrame, annexes: DataFrame) -> DataFrame:
    """Served rows: the latest annex's value stands for the signed one; a fivefold growth is suspect."""
    now = latest_values(annexes.select("id", "key", F.col("published").alias("published_at"), F.col("cents").alias("value_after")), ["id"]).select("id", F.col("current_value").alias("now"))
    flag = F.when(F.col("now") >= 5 * F.col("cents"), "annex_suspect").otherwise("ok")
    return contracts.join(now, "id", "left").select("id", "authority", "bidder", "sector", F.coalesce("now", "cents").alias("cents"), flag.alias("flag"), "signed")


def _after_windows(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    contracts = spark.sql(_CONTRACTS.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))
    annexes = spark.sql(_ANNEXES.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    folder = scratch(spark, "refresh")
    for w in WINDOWS:
        maintenance.apply_window(spark, folder, w, contracts.where(F.col("w") == w), annexes.where(F.col("w") == w), rule)
    return maintenance.tables(spark, folder, WINDOWS[-1])


@register(f"""{_FULL} SELECT 'pair' AS kind, concat_ws('|', authority, bidder) AS name, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(NULL AS BIGINT) AS partners, max(signed) AS latest FROM ok GROUP BY ALL
  UNION ALL SELECT 'company', bidder, count(*), CAST(sum(cents) AS BIGINT), count(DISTINCT authority), NULL FROM ok GROUP BY bidder UNION ALL SELECT 'authority', authority, count(*), CAST(sum(cents) AS BIGINT), count(DISTINCT bidder), max(signed) FROM ok GROUP BY authority
  UNION ALL SELECT 'sector', sector, count(*), CAST(sum(cents) AS BIGINT), NULL, NULL FROM ok GROUP BY sector UNION ALL SELECT flag, NULL, count(*), CAST(sum(cents) AS BIGINT), NULL, max(signed) FROM s GROUP BY flag""")
def refreshed_rollups(spark: SparkSession, sf: str) -> DataFrame:
    t = _after_windows(spark, sf)
    none, no_text = F.lit(None).cast("long").alias("partners"), F.lit(None).cast("string").alias("latest")
    kind = lambda name: F.lit(name).alias("kind")
    return (
        t["pairs"].select(kind("pair"), F.concat_ws("|", "authority", "bidder").alias("name"), "n", "cents", none, "latest")
        .unionByName(t["companies"].select(kind("company"), F.col("bidder").alias("name"), "n", "cents", "partners", no_text))
        .unionByName(t["authorities"].select(kind("authority"), F.col("authority").alias("name"), "n", "cents", "partners", "latest"))
        .unionByName(t["sectors"].select(kind("sector"), F.col("sector").alias("name"), "n", "cents", none, no_text))
        .unionByName(t["served"].groupBy(F.col("flag").alias("kind")).agg(F.lit(None).cast("string").alias("name"), F.count("*").alias("n"), F.sum("cents").alias("cents"), none, F.max("signed").alias("latest")))
    )
