"""Queries on coercion and on rules of single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions import coerce, identity, values
from outlay.operators import paging, quality, rollups
from outlay.plans.crosswalk import contracts, table
from outlay.plans.registry import register

_ODD = """CASE l_linenumber WHEN 1 THEN concat(' ', CAST(l_partkey AS STRING), ' 234,5', CAST(l_suppkey % 10 AS STRING), ' ') WHEN 2 THEN concat('1.', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), ',56')
  WHEN 3 THEN concat('+', CAST(l_partkey AS STRING)) WHEN 4 THEN concat('-', CAST(l_suppkey AS STRING), '.5') WHEN 5 THEN concat('.', CAST(l_suppkey AS STRING))
  WHEN 6 THEN concat(CAST(l_orderkey AS STRING), '999999999') ELSE concat('x', CAST(l_partkey AS STRING)) END"""
_TEXTS = f"SELECT DISTINCT {_ODD} AS text FROM lineitem"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_TEXTS.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))


_PLAIN = "regexp_replace(text, '[\\s\\x{00a0}]', '', 'g')"
_POINT = "CASE WHEN contains(b, ',') THEN replace(replace(b, '.', ''), ',', '.') ELSE b END"
_REAL = "regexp_full_match(p, '\\+?([0-9]+(\\.[0-9]+)?|\\.[0-9]+)') AND TRY_CAST(ltrim(p, '+') AS DOUBLE) <= 1e10"


@register(f"""WITH t AS ({_TEXTS}), c AS (SELECT text, {_PLAIN} AS c FROM t), m AS (SELECT *, starts_with(c, '-') AS neg, CASE WHEN starts_with(c, '-') THEN substr(c, 2) ELSE c END AS b FROM c),
  n AS (SELECT *, {_POINT} AS p FROM m), r AS (SELECT *, CASE WHEN {_REAL} THEN TRY_CAST(ltrim(p, '+') AS DOUBLE) END AS v FROM n)
  SELECT text, CASE WHEN regexp_full_match(c, '\\+?[0-9]+') AND TRY_CAST(ltrim(c, '+') AS HUGEINT) <= 9007199254740991 THEN TRY_CAST(ltrim(c, '+') AS BIGINT) END AS whole,
  CASE WHEN neg THEN NULL ELSE v END AS real, CASE WHEN neg THEN -v ELSE v END AS signed FROM r""")
def coerce_numbers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, sf).select("text", coerce.to_int(t).alias("whole"), coerce.to_real(t).alias("real"), coerce.to_signed(t).alias("signed"))


_WORDS = "SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN ' Да ' WHEN 1 THEN 'не' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'Разрешено' WHEN 5 THEN ' Забранено' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE 'No' END AS word FROM orders"


@register(f"""WITH w AS ({_WORDS}), l AS (SELECT id, word, lower(trim(word)) AS x FROM w), b AS (SELECT *, CASE WHEN x IN ('true', '1', 'yes', 'да') THEN 1 WHEN x IN ('false', '0', 'no', 'не') THEN 0 END AS y FROM l)
  SELECT id, y AS yes, 1 - y AS secured, CASE trim(word) WHEN 'Разрешено' THEN 1 WHEN 'Забранено' THEN 0 END AS variants FROM b""")
def coerce_words(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    words = spark.sql(_WORDS.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    return words.select("id", coerce.to_bool(w).alias("yes"), coerce.secured_inverse(w).alias("secured"), coerce.variants_enum(w).alias("variants"))


_DAYS = """SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) WHEN 2 THEN concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T10:11:12Z')
  WHEN 3 THEN concat(CAST(day(CAST(l_shipdate AS DATE)) AS STRING), '.', CAST(month(CAST(l_shipdate AS DATE)) AS STRING), '.', CAST(year(CAST(l_shipdate AS DATE)) AS STRING))
  WHEN 4 THEN concat('31/', CAST(month(CAST(l_shipdate AS DATE)) AS STRING), '/', CAST(year(CAST(l_shipdate AS DATE)) AS STRING)) WHEN 5 THEN '1989-12-31' WHEN 6 THEN '2999-01-01' ELSE concat('x', CAST(l_partkey AS STRING)) END AS text FROM lineitem"""


@register(f"""WITH d AS ({_DAYS}), x AS (SELECT id, text, CASE WHEN regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(substr(text, 1, 10) AS DATE)
  WHEN regexp_matches(text, '^[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}') THEN TRY_CAST(concat(regexp_extract(text, '([0-9]{{4}})', 1), '-', lpad(regexp_extract(text, '^[0-9]+[./]([0-9]+)', 1), 2, '0'), '-', lpad(regexp_extract(text, '^([0-9]+)', 1), 2, '0')) AS DATE) END AS v FROM d)
  SELECT id, text, CASE WHEN v BETWEEN DATE '1990-01-01' AND DATE '2100-01-01' THEN CAST(v AS STRING) END AS day, count(*) AS n FROM x GROUP BY ALL""")
def coerce_dates(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.sql(_DAYS.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))
    return days.select("id", "text", coerce.to_iso_date(F.col("text")).alias("day")).groupBy("id", "text", "day").agg(F.count("*").alias("n"))


_NAMES = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('„', lower(c_name), '“') WHEN 1 THEN concat(c_name, chr(160), chr(9), '– ', c_mktsegment) WHEN 2 THEN concat('  ', c_name, '   ', c_mktsegment, ' ') WHEN 3 THEN concat('a', chr(173), 'b ', c_name) ELSE ' ' END AS name FROM customer"


@register(f"""WITH n AS ({_NAMES}), x AS (SELECT id, name, translate(translate(name, chr(160) || chr(9), '  '), '–', '-') AS y FROM n)
  SELECT id, CASE WHEN trim(name) = '' THEN 'unknown:анонимен' ELSE 'name:' || upper(trim(regexp_replace(replace(replace(replace(y, '„', ''), '“', ''), chr(173), ''), ' +', ' ', 'g'))) END AS key FROM x""")
def identity_names(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.sql(_NAMES.replace("FROM customer", "FROM {c}"), c=table(spark, sf, "customer"))
    return names.select("id", identity.identity_key(F.lit(None).cast("string"), F.col("name")).alias("key"))


_MONEY = ", m AS (SELECT id, currency, amount_cents AS a, CASE WHEN currency = 'USD' AND bids_received % 2 = 0 THEN 0.9 END AS rate FROM contracts)"


@register(_MONEY + " SELECT id, currency, round(CASE currency WHEN 'EUR' THEN CAST(a AS DOUBLE) WHEN 'BGN' THEN a / CAST(1.95583 AS DOUBLE) ELSE a * CAST(rate AS DOUBLE) END, 4) AS eur FROM m")
def eur_amounts(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "id", "currency", "amount_cents", "bids_received")
    rate = F.when((F.col("currency") == "USD") & (F.col("bids_received") % 2 == 0), F.lit(0.9))
    return c.select("id", "currency", F.round(values.to_eur(F.col("amount_cents").cast("double"), F.col("currency"), rate), 4).alias("eur"))


@register("""SELECT id, concat_ws(',', CASE WHEN bids_received = 1 AND coalesce(eu_funded, 0) = 1 THEN 'single-offer-eu' END, CASE WHEN bids_received = 1 AND coalesce(eu_funded, 0) = 0 THEN 'single-offer' END,
  CASE WHEN own_cents > 0 AND signing_cents * 100 > own_cents * 120 THEN 'grown' END, CASE WHEN amount_cents IS NULL THEN 'suspect' END) AS risks FROM contracts""")
def contract_risks(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "id", "bids_received", "eu_funded", "own_cents", "signing_cents", "amount_cents")
    flag = F.when(F.col("amount_cents").isNull(), "value_suspect").otherwise("ok")
    return c.select("id", F.concat_ws(",", values.risks(F.col("bids_received"), F.col("eu_funded"), F.col("own_cents"), F.col("signing_cents"), flag)).alias("risks"))


@register("""SELECT authority_id, CASE WHEN s * 5 >= n THEN 'bad' WHEN s * 10 <= n THEN 'good' ELSE 'mid' END AS rating FROM (SELECT authority_id, count(*) AS n, count(*) FILTER (bids_received = 1) AS s
  FROM contracts WHERE bids_received >= 1 GROUP BY authority_id)""")
def benchmark_rating(spark: SparkSession, sf: str) -> DataFrame:
    n = contracts(spark, sf, "authority_id", "bids_received").where("bids_received >= 1").groupBy("authority_id").agg(F.count("*").alias("n"), F.count_if(F.col("bids_received") == 1).alias("s"))
    return n.select("authority_id", values.rating(F.col("s") / F.col("n"), 0.1, 0.2).alias("rating"))


#: Every so often a decimal point is lost.
_SHIFTED = "amount_cents * CASE WHEN bids_received = 2 AND eu_funded = 1 THEN 10 ELSE 1 END"


def _shifted(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf, "id", "division", "amount_cents", "bids_received", "eu_funded").selectExpr("id", "division", f"{_SHIFTED} AS amount_cents")


def _loo_sql(q: float) -> str:
    """The linear percentile of a division without the row itself: only the values of four ranks are joined to its rows."""
    return f""", s AS (SELECT id, division, {_SHIFTED} AS amount_cents FROM contracts), b AS (SELECT id, division, amount_cents, row_number() OVER (PARTITION BY division ORDER BY amount_cents, id) - 1 AS k, count(*) OVER (PARTITION BY division) AS n FROM s WHERE amount_cents > 0 AND coalesce(division, '') <> ''),
  x AS (SELECT *, CAST(floor((n - 2) * {q}) AS BIGINT) AS lo, (n - 2) * CAST({q} AS DOUBLE) - floor((n - 2) * CAST({q} AS DOUBLE)) AS part, least(CAST(floor((n - 2) * {q}) AS BIGINT) + 1, n - 2) AS hi FROM b WHERE n > 1),
  r AS (SELECT division, max(amount_cents) FILTER (k = lo) AS lo0, max(amount_cents) FILTER (k = lo + 1) AS lo1, max(amount_cents) FILTER (k = hi) AS hi0, max(amount_cents) FILTER (k = hi + 1) AS hi1 FROM x GROUP BY division),
  z AS (SELECT x.*, CASE WHEN lo < k THEN lo0 ELSE lo1 END AS va, CASE WHEN hi < k THEN hi0 ELSE hi1 END AS vb FROM x JOIN r USING (division)),
  w AS (SELECT id, amount_cents, n, va + (vb - va) * part AS q FROM z)"""


@register(_loo_sql(0.95) + " SELECT id, amount_cents FROM w WHERE n >= 12 AND amount_cents > 1.5 * q")
def outlier_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outliers(rollups.leave_one_out(_shifted(spark, sf), 0.95), ratio=1.5).select("id", "amount_cents")


@register(_loo_sql(0.5) + " SELECT id, amount_cents, CASE WHEN amount_cents / 10.0 BETWEEN q / 2 AND 2 * q THEN 10 ELSE 100 END AS divisor FROM w WHERE amount_cents > 2 * q AND (amount_cents / 10.0 BETWEEN q / 2 AND 2 * q OR amount_cents / 100.0 BETWEEN q / 2 AND 2 * q)")
def decimal_shift_suspects(spark: SparkSession, sf: str) -> DataFrame:
    return quality.decimal_shifts(rollups.leave_one_out(_shifted(spark, sf), 0.5)).select("id", "amount_cents", "divisor")


@register(_loo_sql(0.95) + """, w2 AS (SELECT id FROM w WHERE n >= 12 AND amount_cents > 1.5 * q), x2 AS (SELECT id, 'outlier' AS finding FROM w2 UNION SELECT id, 'single-offer' FROM contracts WHERE bids_received = 1)
  SELECT id, string_agg(finding, ',' ORDER BY finding) AS findings FROM x2 GROUP BY id""")
def anomaly_report(spark: SparkSession, sf: str) -> DataFrame:
    outliers = quality.outliers(rollups.leave_one_out(_shifted(spark, sf), 0.95), ratio=1.5)
    return quality.anomalies({"outlier": outliers, "single-offer": contracts(spark, sf, "id", "bids_received").where("bids_received = 1")})


def _sort_query(name: str, sql_key: str, down: bool) -> None:
    way = "DESC" if down else "ASC"

    def query(spark: SparkSession, sf: str) -> DataFrame:
        sort, descending = paging.CONTRACT_SORTS[name]
        return paging.page(contracts(spark, sf, "id", "amount_cents", "signed_at"), sort(), "id", descending, 15).select("id", F.col("_key").alias("sort_key"))

    query.__name__ = f"contracts_sorted_{name.replace('-', '_')}"
    register(f"SELECT id, {sql_key} AS sort_key FROM contracts ORDER BY sort_key {way}, id {way} LIMIT 16")(query)


_sort_query("value-asc", "coalesce(CAST(amount_cents AS DOUBLE), 1e20)", False)
_sort_query("date-desc", "coalesce(signed_at, '')", True)
_sort_query("date-asc", "coalesce(signed_at, '9999-99')", False)
