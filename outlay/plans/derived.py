"""Queries on the derive chain: staging notices made of the driver's tables, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions import identity, values
from outlay.operators import amendments, derive, integrity
from outlay.plans.catalog import _VALID_SQL
from outlay.plans.crosswalk import contracts, table
from outlay.plans.registry import register
from outlay.sources.scratch import written

_UNP = "concat(lpad(CAST({k} % 40 AS STRING), 5, '0'), '-', CAST({k} AS STRING))"
_NAME = "concat(CASE {a} % 9 WHEN 0 THEN 'Община ' WHEN 1 THEN 'Министерство ' WHEN 2 THEN 'МБАЛ ' WHEN 3 THEN 'Средно училище ' WHEN 4 THEN 'Агенция ' ELSE 'Дирекция ' END, CAST({a} AS STRING))"
_MODE = "CASE l_partkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' WHEN 2 THEN 'SHIP' ELSE 'TRUCK' END"
_NOTICES = f"""SELECT concat('n', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS id, CASE WHEN l_linestatus = 'F' THEN 'eop:1' ELSE 'ocds:1' END AS source, {_UNP.format(k='l_orderkey')} AS unp,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN concat(CAST(l_orderkey % 40 AS STRING), '; ', CAST(l_suppkey % 3 AS STRING)) ELSE CAST(l_orderkey % 40 AS STRING) END AS authority_eik,
  CASE WHEN l_linenumber = 6 THEN ' ' WHEN l_linenumber > 3 THEN upper({_NAME.format(a='(l_orderkey % 40)')}) ELSE {_NAME.format(a='(l_orderkey % 40)')} END AS authority_name,
  CASE WHEN l_orderkey % 40 = 8 AND l_linenumber = 1 THEN 'Публично предприятие А' ELSE {_MODE} END AS authority_type,
  CASE WHEN l_linenumber = 1 THEN concat('LOT-', lpad(CAST(CAST(l_quantity AS INT) AS STRING), 4, '0')) WHEN l_linenumber = 2 THEN concat('0', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN l_linenumber = 3 THEN 'LOT-A' WHEN l_linenumber = 4 THEN '' WHEN l_linenumber = 5 THEN NULL ELSE {_MODE} END AS lot_id,
  concat('N', CAST(l_linenumber % 3 AS STRING)) AS contract_number, concat('S', CAST(l_partkey % 9 AS STRING)) AS subject, CASE WHEN l_tax = 0 THEN NULL WHEN l_tax > 0.06 THEN 'EUR' ELSE 'BGN' END AS currency, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS estimate,
  CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN lpad(CAST(l_suppkey * 7919 AS STRING), 9, '1') ELSE lpad(CAST(l_suppkey AS STRING), 13, '2') END AS contractor_eik,
  CASE WHEN l_suppkey % 12 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN concat('ДЗЗД Фирма ', CAST(l_suppkey AS STRING)) WHEN l_linenumber = 2 THEN concat('ФИРМА ', CAST(l_suppkey AS STRING)) ELSE concat('Фирма ', CAST(l_suppkey AS STRING)) END AS contractor_name FROM lineitem"""
_HEADERS = f"SELECT {_UNP.format(k='o_orderkey')} AS unp, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS procedure_type, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS subject, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS estimate, CAST(NULL AS STRING) AS currency, CAST(o_custkey AS STRING) AS authority_eik FROM orders WHERE o_orderkey % 3 <> 0"


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_NOTICES.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))


_N = f"WITH n AS ({_NOTICES})"
_CANON = f"""{_N}, b AS (SELECT * FROM n WHERE authority_eik NOT LIKE '%;%'), m AS (SELECT authority_eik, authority_name FROM (SELECT authority_eik, authority_name, count(*) AS c FROM b WHERE trim(authority_name) <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY authority_eik ORDER BY c DESC, regexp_matches(authority_name, '\\p{{Ll}}') DESC, length(authority_name) DESC, authority_name) = 1),
  y AS (SELECT authority_eik, authority_type FROM (SELECT authority_eik, authority_type, count(*) AS c FROM b JOIN m USING (authority_eik, authority_name) WHERE trim(authority_type) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY authority_eik ORDER BY c DESC, authority_type) = 1),
  a AS (SELECT e.authority_eik AS eik, coalesce(authority_name, e.authority_eik) AS name, authority_type AS type FROM (SELECT DISTINCT authority_eik FROM b) e LEFT JOIN m USING (authority_eik) LEFT JOIN y USING (authority_eik))"""


@register(f"""{_CANON} SELECT eik, name, type, CASE WHEN lower(name) LIKE 'община%' THEN 'община' WHEN lower(name) LIKE 'министерство%' THEN 'министерство' WHEN lower(name) LIKE '%мбал%' THEN 'болница' WHEN lower(name) LIKE '%училище%' THEN 'образование'
  WHEN lower(name) LIKE '%агенция%' THEN 'агенция' WHEN eik IN (SELECT authority_eik FROM b WHERE authority_type LIKE 'Публично предприятие%') THEN 'държавна компания' ELSE 'друго' END AS type_group FROM a""")
def canonical_authorities(spark: SparkSession, sf: str) -> DataFrame:
    return derive.grouped_authorities(_notices(spark, sf))


@register(f"{_N}, c AS (SELECT substr(unp, 1, 5) AS prefix, authority_eik, count(*) AS c FROM n WHERE authority_eik NOT LIKE '%;%' GROUP BY ALL) SELECT prefix, authority_eik FROM c QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY c DESC, authority_eik) = 1")
def prefix_authorities(spark: SparkSession, sf: str) -> DataFrame:
    return derive.prefix_authorities(_notices(spark, sf))


@register(f"""{_N}, c AS (SELECT unp, authority_eik, authority_name, authority_type, count(*) AS c FROM n WHERE authority_eik LIKE '%;%' GROUP BY ALL) SELECT unp, authority_eik, authority_name, authority_type FROM c
  QUALIFY row_number() OVER (PARTITION BY unp ORDER BY c DESC, regexp_matches(authority_name, '\\p{{Ll}}') DESC, length(authority_name) DESC, authority_eik, authority_name, authority_type) = 1""")
def joint_sources(spark: SparkSession, sf: str) -> DataFrame:
    return derive.joint_sources(_notices(spark, sf))


@register(f"""{_N}, h AS ({_HEADERS}) SELECT unp, coalesce(subject, '(без предмет)') AS title, authority_eik, estimate, 'BGN' AS currency, coalesce(procedure_type, 'неизвестна') AS procedure_type, CASE WHEN unp IN (SELECT unp FROM n) THEN 'awarded' ELSE 'published' END AS status FROM h
  UNION ALL SELECT unp, min(subject), min(authority_eik), min(estimate), coalesce(min(currency), 'BGN'), 'неизвестна', 'awarded' FROM n WHERE unp NOT IN (SELECT unp FROM h) GROUP BY unp""")
def derived_tenders(spark: SparkSession, sf: str) -> DataFrame:
    headers = spark.sql(_HEADERS.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    return derive.tenders(headers, _notices(spark, sf))


_LOT = "CASE WHEN regexp_full_match(lot_id, '(LOT-)?[0-9]+') THEN CAST(CAST(replace(lot_id, 'LOT-', '') AS BIGINT) AS STRING) ELSE lot_id END"


@register(f"{_N} SELECT lot_id, {_LOT} AS lot, count(*) AS n FROM n GROUP BY ALL")
def lot_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _notices(spark, sf).groupBy("lot_id", derive.lot_number(F.col("lot_id")).alias("lot")).agg(F.count("*").alias("n"))


_KEYED = f"""{_N}, k AS (SELECT n.*, contractor_eik AS code FROM n), v AS (SELECT *, CASE WHEN code IS NULL THEN 0 ELSE {_VALID_SQL} END AS valid FROM k),
  i AS (SELECT *, CASE WHEN valid = 1 THEN 'eik:' || code WHEN trim(contractor_name) <> '' THEN 'name:' || upper(contractor_name) ELSE 'unknown:анонимен' END AS key FROM v)"""
_BIDDERS = f"""{_KEYED}, m AS (SELECT key, contractor_name FROM (SELECT key, contractor_name, count(*) AS c FROM i WHERE trim(contractor_name) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, regexp_matches(contractor_name, '\\p{{Ll}}') DESC, length(contractor_name) DESC, contractor_name) = 1),
  w AS (SELECT key, min(CASE WHEN valid = 1 THEN code END) AS eik, max(valid) AS eik_valid, max(CASE WHEN contractor_name LIKE '%;%' OR contractor_name LIKE '%ДЗЗД%' THEN 1 ELSE 0 END) AS j, min(contractor_name) AS least FROM i GROUP BY key),
  bd AS (SELECT key, CASE WHEN starts_with(key, 'unknown:') THEN 'Неизвестен изпълнител' ELSE coalesce(contractor_name, least) END AS name, eik, eik_valid, CASE WHEN starts_with(key, 'unknown:') THEN 'unknown' WHEN j = 1 THEN 'consortium' ELSE 'company' END AS kind FROM w LEFT JOIN m USING (key))"""


@register(f"{_BIDDERS} SELECT * FROM bd")
def derived_bidders(spark: SparkSession, sf: str) -> DataFrame:
    return derive.bidders(_notices(spark, sf))


_OWNED = "SELECT lpad(CAST(s_suppkey * 7919 AS STRING), 9, '1') AS eik, CASE WHEN s_suppkey % 2 = 0 THEN 'state' ELSE 'municipal' END AS ownership FROM supplier WHERE s_suppkey % 6 = 1"


@register(f"{_BIDDERS}, l AS ({_OWNED}), f AS (SELECT key, min(ownership) AS ownership FROM bd JOIN l ON bd.eik = l.eik OR starts_with(bd.eik, substr(l.eik, 1, 8)) WHERE eik_valid = 1 GROUP BY key) SELECT bd.*, ownership FROM bd LEFT JOIN f USING (key)")
def bidder_ownership(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.sql(_OWNED.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier"))
    branches = listed.select(F.substring("eik", 1, 8).alias("prefix"), "eik")
    return derive.owned(derive.bidders(_notices(spark, sf)), listed, branches)


_ORDER = "id, estimate, coalesce(currency, ''), subject, source"


@register(f"""{_KEYED}, c AS (SELECT *, concat_ws(':', 'c', CASE WHEN source LIKE 'eop:%' THEN 'e' ELSE 'o' END, unp, contract_number, coalesce(nullif({_LOT}, ''), '_'), key) AS base FROM i)
  SELECT concat(base, ':', CAST(row_number() OVER (PARTITION BY base ORDER BY {_ORDER}) AS STRING)) AS contract_id FROM c""")
def contract_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = _notices(spark, sf)
    keyed = n.withColumn("bidder_key", identity.identity_key(F.col("contractor_eik"), F.col("contractor_name")))
    return derive.contract_ids(keyed, [F.expr(x) for x in ("id", "estimate", "coalesce(currency, '')", "subject", "source")]).select("contract_id")


_ANNEX = f"""SELECT l_partkey AS id, {_MODE} AS source, {_UNP.format(k='l_orderkey')} AS unp, concat('N', CAST(l_linenumber % 2 AS STRING)) AS contract_number, concat('am:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber % 3 AS STRING)) AS key,
  CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS value_before, CAST(floor(l_extendedprice * (1 + l_quantity / 20) + 0.5) AS BIGINT) AS value_after, CASE WHEN l_linenumber = 4 THEN CAST(floor(l_extendedprice * 2 + 0.5) AS BIGINT) END AS value_restated,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS published_at, CAST(floor(l_tax * 100 + 0.5) AS INT) AS t FROM lineitem"""


def _annexes(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.sql(_ANNEX.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))
    # the driver's lines may repeat a key, source and id: one of those stays
    return raw.groupBy("key", "source", "id").agg(F.min(F.struct("value_before", "value_after", "published_at", "unp", "contract_number", "value_restated")).alias("r")).select("key", "source", "id", "r.*")


_ANNEX_SQL = f"WITH raw AS ({_ANNEX}), p AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY key ORDER BY source DESC, id DESC, value_before, value_after, published_at, unp, contract_number, value_restated) = 1)"


@register(f"{_ANNEX_SQL} SELECT key, unp, contract_number, value_before, coalesce(value_restated, value_after) AS value_after, coalesce(value_restated, value_after) - value_before AS value_delta, CASE WHEN value_restated IS NULL THEN 0 ELSE 1 END AS restated, published_at FROM p")
def promoted_annexes(spark: SparkSession, sf: str) -> DataFrame:
    return derive.promoted_annexes(_annexes(spark, sf))


@register("""WITH p AS (SELECT l_suppkey AS party, CASE l_partkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' WHEN 2 THEN 'SHIP' ELSE 'TRUCK' END AS role, CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag END AS a, CAST(floor(l_quantity) AS INT) AS b, CAST(CAST(l_shipdate AS DATE) AS STRING) AS c, l_orderkey AS d, l_linenumber AS e, l_partkey AS f FROM lineitem)
  SELECT party, role, a, b, c, d FROM p QUALIFY row_number() OVER (PARTITION BY party, role ORDER BY a DESC NULLS LAST, b DESC, c DESC, d DESC, e DESC, f DESC) = 1""")
def latest_parties(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").selectExpr("l_suppkey AS party", f"{_MODE} AS role", "CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag END AS a", "CAST(floor(l_quantity) AS INT) AS b", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS c", "l_orderkey AS d", "l_linenumber AS e", "l_partkey AS f")
    return derive.latest_parties(p, ["party", "role"], list("abcdef")).select("party", "role", "a", "b", "c", "d")


@register("SELECT CASE WHEN id LIKE '1%' THEN 'first' WHEN id LIKE '2%' THEN 'second' ELSE 'other' END AS feed, count(*) AS contracts, max(published_at) AS latest FROM contracts GROUP BY 1")
def data_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return derive.freshness(contracts(spark, sf, "id", "published_at"), {"1": "first", "2": "second"})


@register(f"{_N} SELECT unp, count(DISTINCT contract_number) AS idents, count(*) - count(DISTINCT contract_number) AS excess FROM n GROUP BY unp HAVING count(DISTINCT contract_number) > 1")
def excess_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return derive.excess_keys(_notices(spark, sf), "unp", "contract_number")


@register(f"{_N} SELECT contractor_name, count(*) FILTER (source LIKE 'eop:%') AS a, count(*) FILTER (source LIKE 'ocds:%') AS b FROM n GROUP BY contractor_name HAVING count(*) FILTER (source LIKE 'eop:%') > 0 AND count(*) FILTER (source LIKE 'ocds:%') > 0")
def names_in_both_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return derive.in_both(_notices(spark, sf), "contractor_name", F.col("source").startswith("eop:"), F.col("source").startswith("ocds:"))


# -- amendments against contracts

_CHAIN_C = "SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS unp, 'N' AS number, CAST(floor(o_totalprice / 4 + 0.5) AS DOUBLE) AS signing, CAST(floor(o_totalprice / 4 + 0.5) AS DOUBLE) * (o_orderkey % 5) AS current, CAST(floor(o_totalprice + 0.5) AS DOUBLE) AS procedure FROM orders"
_CHAIN_A = """SELECT concat(CAST(o_orderkey AS STRING), '/', CAST(k AS STRING)) AS key, CAST(o_orderkey AS STRING) AS unp, 'N' AS number, CAST(floor(o_totalprice / 4 + 0.5) AS DOUBLE) * (1 + (k - 1) * (o_orderkey % 3)) AS value_before,
  CAST(floor(o_totalprice / 4 + 0.5) AS DOUBLE) * CASE WHEN o_orderkey % 17 = 0 THEN 12 ELSE o_orderkey % 5 END AS value_after, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 END AS value_delta, CASE WHEN o_orderkey % 7 = 0 THEN 'genuine' END AS treatment"""
_CHAIN_SQL = f"""WITH c AS ({_CHAIN_C}), a AS ({_CHAIN_A} FROM orders, (VALUES (1), (2)) v(k)), s AS (
  SELECT a.*, coalesce(bool_or(p.value_after > 0 AND abs(p.value_after - a.value_before) < 0.01 * a.value_before), false) AS any_prev,
    coalesce(bool_or(p.value_after > 0 AND abs(p.value_after - a.value_before) < 0.01 * a.value_before AND p.value_before > 0 AND p.value_after < 2 * p.value_before), false) AS legit_prev
  FROM a JOIN a p ON a.unp = p.unp AND a.number = p.number GROUP BY ALL),
  f AS (SELECT c.id, coalesce(bool_or(value_before > 0 AND value_after >= 10 * value_before), false) AS step10,
    coalesce(bool_or(treatment IS NULL AND value_before > 0 AND (abs(value_before - signing) < 0.01 * signing OR legit_prev OR (abs(value_after - 2 * value_before) < 0.005 * value_before AND NOT any_prev)) AND value_after >= 2 * value_before AND value_after < 10 * value_before
      AND (value_delta IS NULL OR abs(value_after - (value_before + value_delta)) < 0.01 * value_after) AND abs(value_after - current) < 0.01), false) AS doubled
  FROM c LEFT JOIN s ON c.unp = s.unp AND c.number = s.number GROUP BY c.id)"""


def _chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    c = spark.sql(_CHAIN_C.replace("FROM orders", "FROM {o}"), o=orders)
    a = spark.sql(f"{_CHAIN_A} FROM {{o}} LATERAL VIEW explode(array(1, 2)) v AS k", o=orders)
    return c, a


@register(f"{_CHAIN_SQL} SELECT id, step10, doubled FROM f")
def annex_chain_flags(spark: SparkSession, sf: str) -> DataFrame:
    return amendments.chain_flags(*_chain(spark, sf))


@register(f"""{_CHAIN_SQL} SELECT c.id, CASE WHEN e > 2000000000 OR (p >= 1000 AND (e > 200 * p OR (e >= 95 * p AND e <= 105 * p))) THEN 'value_suspect' WHEN coalesce(current, signing) <= 0 THEN 'value_low' WHEN p > 0 AND signing < 1000 AND signing * 100 < 5 * p THEN 'value_low'
  WHEN current < 0 OR (signing > 0 AND (current >= 100 * signing OR (current >= 5 * signing AND step10))) THEN 'annex_suspect' WHEN signing > 0 AND doubled THEN 'annex_total_suspect' WHEN p > 0 AND e >= 10 * p THEN 'review' ELSE 'ok' END AS flag
  FROM (SELECT *, coalesce(current, signing) AS e, procedure AS p FROM c) c JOIN f USING (id)""")
def value_flags_with_annexes(spark: SparkSession, sf: str) -> DataFrame:
    c, a = _chain(spark, sf)
    j = c.join(amendments.chain_flags(c, a), "id")
    own = F.lit(None).cast("double")
    return j.select("id", values.value_flag(F.coalesce("current", "signing"), F.col("signing"), F.col("current"), own, F.col("procedure"), F.col("step10"), F.col("doubled")).alias("flag"))


# -- integrity

_STORED = "SELECT s_suppkey AS bidder_id, CAST(floor(s_acctbal * 100) AS BIGINT) AS cents FROM supplier"
_FLAG = "CASE WHEN amount_cents < 0 THEN CASE WHEN bids_received = 2 THEN 'ok' ELSE 'value_low' END ELSE 'ok' END"


@register(f""", c AS (SELECT *, {_FLAG} AS flag, signing_cents AS current_cents FROM contracts), cp AS (SELECT bidder_id, sum(amount_cents) AS cents FROM contracts GROUP BY 1), fp AS (SELECT authority_id, bidder_id, sum(amount_cents) AS cents FROM contracts GROUP BY 1, 2), st AS ({_STORED}),
  base AS (SELECT coalesce(sum(amount_cents), 0) AS b FROM contracts), r AS (
  SELECT 'non-empty-corpus' AS "check", CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS v, 'fail' AS w FROM c
  UNION ALL SELECT 'rollup-reconciliation', (SELECT count(*) FROM (SELECT sum(cents) AS s FROM cp UNION ALL SELECT sum(cents) FROM fp UNION ALL SELECT sum(cents) FROM st) x, base WHERE abs(coalesce(s, 0) - b) > 500), 'fail'
  UNION ALL SELECT 'current-amount-parity', count(*), 'fail' FROM c WHERE flag = 'ok' AND current_cents IS NOT NULL AND (amount_cents IS NULL OR abs(amount_cents - current_cents) > 1)
  UNION ALL SELECT 'no-negative-values', (SELECT count(*) FROM c WHERE amount_cents < 0) + (SELECT count(*) FROM cp WHERE cents < 0) + (SELECT count(*) FROM fp WHERE cents < 0) + (SELECT count(*) FROM st WHERE cents < 0), 'fail'
  UNION ALL SELECT 'date-sanity', count(*), 'warn' FROM c WHERE signed_at < '1993-01-01' OR signed_at > '1998-06-30'
  UNION ALL SELECT 'staging-reconciliation', CASE WHEN (SELECT count(*) FROM c) > (SELECT count(*) FROM orders) THEN 1 ELSE 0 END, 'fail')
  SELECT "check", CAST(v AS BIGINT) AS violations, CASE WHEN v = 0 THEN 'pass' ELSE w END AS result FROM r""")
def integrity_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "authority_id", "bidder_id", "signed_at", "amount_cents", "signing_cents", "bids_received").withColumn("flag", F.expr(_FLAG)).withColumn("current_cents", F.col("signing_cents"))
    c = written(c, "integrity")  # every check reads it: joined once
    stored = {
        "company": c.groupBy("bidder_id").agg(F.sum("amount_cents").alias("cents")), "flows": c.groupBy("authority_id", "bidder_id").agg(F.sum("amount_cents").alias("cents")),
        "stored": spark.sql(_STORED.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier")),
    }
    checks = [
        integrity.non_empty(c), integrity.rollups_reconcile(c, stored), integrity.amount_parity(c), integrity.no_negative(c, stored),
        integrity.dates_sane(c, "1998-06-30", "1993-01-01"), integrity.staging_reconciles(table(spark, sf, "orders"), c),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3]).unionByName(checks[4]).unionByName(checks[5])


@register(f"""{_BIDDERS} SELECT 'eik-validity' AS "check", count(*) AS violations, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS result FROM bd WHERE (eik_valid = 1 AND (eik IS NULL OR length(eik) NOT IN (9, 13))) OR (eik_valid <> 1 AND eik IS NOT NULL)""")
def eik_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.eik_consistent(derive.bidders(_notices(spark, sf)))


@register(f"""{_ANNEX_SQL} SELECT 'amendment-twins' AS "check", CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS violations, CASE WHEN coalesce(sum(c - 1), 0) = 0 THEN 'pass' ELSE 'warn' END AS result FROM (SELECT count(*) AS c FROM p GROUP BY unp, contract_number, value_before, coalesce(value_restated, value_after), published_at)""")
def annex_twins(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.annex_twins(derive.promoted_annexes(_annexes(spark, sf)))
