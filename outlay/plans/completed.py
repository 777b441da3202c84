"""Queries on completed entities, lots and values, regions, and the conflict pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.operators import conflicts, derive, enrichment, joint
from outlay.plans.crosswalk import contracts, table
from outlay.plans.people import _HOLDINGS, _JOINT_SQL, _members
from outlay.plans.registry import register


def _lines(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))


# -- parties: line items as appearances in releases ---------------------------------------------------------------

_PARTIES = """SELECT CASE WHEN l_suppkey % 7 = 3 THEN '' WHEN l_suppkey % 11 = 5 THEN NULL ELSE lpad(CAST(l_suppkey AS STRING), 9, '0') END AS eik, concat('ocds:', CAST(l_partkey % 6 AS STRING)) AS source, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS ocid,
  CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('ORG-', CAST(l_linenumber AS STRING)) END AS party_id, concat('Фирма ', CAST(l_suppkey AS STRING)) AS name, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('ул. ', CAST(l_partkey AS STRING)) END AS street_address,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('Град ', CAST(l_orderkey % 40 AS STRING)) END AS locality, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE concat('BG', CAST(311 + l_orderkey % 15 AS STRING)) END AS region_nuts,
  CASE WHEN l_linenumber = 1 THEN concat('x', CAST(l_partkey AS STRING), '@example.org') END AS contact_email, CASE WHEN l_linenumber > 2 THEN concat('02/', CAST(l_partkey AS STRING)) ELSE ' ' END AS contact_phone FROM lineitem"""
_ORDER = ", ".join(f"coalesce({c}, '') DESC" for c in (*enrichment.PARTY_ORDER, "region_nuts"))
_PARTY_SQL = f"""WITH p AS ({_PARTIES}), k AS (SELECT *, CASE WHEN coalesce(eik, '') <> '' THEN 'eik:' || eik || ':ocid:' || coalesce(ocid, '') || ':party:' || coalesce(party_id, '') WHEN coalesce(ocid, '') <> '' AND coalesce(party_id, '') <> '' THEN 'ocid:' || ocid || ':party:' || party_id
  ELSE 'content:' || coalesce(ocid, '') || ':' || coalesce(party_id, '') || ':' || coalesce(eik, '') || ':' || coalesce(name, '') || ':' || coalesce(street_address, '') || ':' || coalesce(locality, '') || ':' || coalesce(region_nuts, '') || ':' || coalesce(contact_email, '') || ':' || coalesce(contact_phone, '') END AS party_key FROM p),
  q AS (SELECT party_key, eik, source, ocid, party_id, name, street_address, locality, contact_email, contact_phone, region_nuts FROM k QUALIFY row_number() OVER (PARTITION BY party_key ORDER BY {_ORDER}) = 1)"""
_COMPANIES = "SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS eik, CASE WHEN s_suppkey % 2 = 0 THEN 'BG411' END AS nuts, CASE WHEN s_suppkey % 3 = 0 THEN 'София' END AS settlement, CAST(NULL AS STRING) AS address, CAST(NULL AS STRING) AS contact_email, '0' AS contact_phone, CASE WHEN s_suppkey % 5 = 0 THEN 'Варна' END AS region FROM supplier"
_NAMES_SQL = "names(code, region_name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for inside in enrichment.REGIONS.values() for c, n in inside.items()) + ")"


@register(f"{_PARTY_SQL} SELECT * FROM q")
def released_parties(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.parties(_lines(spark, sf, _PARTIES))


def _first(column: str, into: str) -> str:
    return f"{into}_f AS (SELECT eik AS {into}_eik, {column} AS {into}_v FROM q WHERE coalesce(eik, '') <> '' AND coalesce({column}, '') <> '' QUALIFY row_number() OVER (PARTITION BY eik ORDER BY {_ORDER}) = 1)"


@register(f"""{_PARTY_SQL}, {_NAMES_SQL}, s AS ({_COMPANIES}), {", ".join(_first(p, e) for e, p in enrichment.PARTY_FIELDS.items())},
  j AS (SELECT eik, region, {", ".join(f"coalesce({e}_v, {e}) AS {e}" for e in enrichment.PARTY_FIELDS)} FROM s {" ".join(f"LEFT JOIN {e}_f ON {e}_eik = eik" for e in enrichment.PARTY_FIELDS)})
  SELECT eik, nuts, settlement, address, contact_email, contact_phone, coalesce(region, region_name) AS region FROM j LEFT JOIN names ON code = nuts""")
def party_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    companies = spark.sql(_COMPANIES.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier"))
    return enrichment.with_regions(enrichment.with_parties(companies, "eik", enrichment.parties(_lines(spark, sf, _PARTIES))))


# -- regions: a customer's nation as its region's name -------------------------------------------------------------

_HOME = "CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey = 23 THEN 'Другаде' " + " ".join(f"WHEN c_nationkey = {i} THEN '{n}'" for i, n in enumerate([n for inside in enrichment.REGIONS.values() for n in inside.values()][:23])) + " END"
_REGION_SQL = "regions(nuts3, name, nuts2, nuts2_name) AS (VALUES " + ", ".join(f"('{c}', '{n}', '{u}', '{un}')" for (u, un), inside in enrichment.REGIONS.items() for c, n in inside.items()) + ")"
_MEASURES = "CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, CAST(coalesce(sum(contracts), 0) AS BIGINT) AS contracts, CAST(coalesce(sum(authorities), 0) AS BIGINT) AS authorities"


@register(f""", {_REGION_SQL}, t AS (SELECT authority_id, sum(amount_cents) AS cents, count(*) AS contracts FROM contracts WHERE amount_cents IS NOT NULL GROUP BY authority_id),
  s AS (SELECT {_HOME} AS region, cents, contracts, 1 AS authorities FROM t JOIN customer ON c_custkey = authority_id), e AS (SELECT r.*, cents, contracts, authorities FROM regions r LEFT JOIN s ON s.region = r.name)
  SELECT 'region' AS level, nuts3 AS code, name, {_MEASURES} FROM e GROUP BY ALL UNION ALL SELECT 'macro', nuts2, nuts2_name, {_MEASURES} FROM e GROUP BY ALL
  UNION ALL SELECT 'unattributed', NULL, NULL, {_MEASURES} FROM s WHERE region IS NULL OR region NOT IN (SELECT name FROM regions) UNION ALL SELECT 'covered', NULL, NULL, {_MEASURES} FROM e""")
def regional_spending(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "authority_id", "amount_cents").where("amount_cents is not null")
    totals = c.groupBy("authority_id").agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("contracts"))
    homes = table(spark, sf, "customer").selectExpr("c_custkey AS authority_id", f"{_HOME} AS region")
    return enrichment.regional_spending(totals.join(homes, "authority_id").withColumn("authorities", F.lit(1)))


# -- lots ---------------------------------------------------------------------------------------------------------

_LOTS = "SELECT CAST(l_orderkey AS STRING) AS unp, CAST(l_linenumber AS STRING) AS lot_id, CASE WHEN max(l_partkey) % 3 = 0 THEN max(CAST(floor(l_quantity) AS BIGINT)) END AS value, CASE WHEN max(l_partkey) % 2 = 0 THEN 'BGN' END AS currency FROM lineitem GROUP BY l_orderkey, l_linenumber"
_RELEASED = """SELECT l_partkey AS id, concat('t', CAST(l_orderkey % 1000 AS STRING)) AS tender_id, CASE l_suppkey % 4 WHEN 0 THEN concat('LOT-', lpad(CAST(l_linenumber AS STRING), 4, '0')) WHEN 1 THEN concat('0', CAST(l_linenumber AS STRING)) WHEN 2 THEN CAST(l_linenumber AS STRING) ELSE 'LOT-A' END AS lot_id,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS value, CASE WHEN l_tax > 0.04 THEN 'EUR' END AS currency FROM lineitem WHERE l_returnflag <> 'R'"""
_PROCEDURES = "SELECT concat('t', CAST(o_orderkey % 1000 AS STRING)) AS tender_id, CAST(o_orderkey AS STRING) AS unp FROM orders"


@register(f"""WITH l AS ({_LOTS}), r AS (SELECT *, CASE WHEN regexp_matches(lot_id, '^(LOT-)?[0-9]+$') THEN CAST(CAST(replace(lot_id, 'LOT-', '') AS BIGINT) AS STRING) ELSE lot_id END AS lot FROM ({_RELEASED})), p AS ({_PROCEDURES}),
  f AS (SELECT unp, lot, value, currency FROM r JOIN p USING (tender_id) QUALIFY row_number() OVER (PARTITION BY unp, lot ORDER BY id DESC, coalesce(value, 0) DESC, coalesce(currency, '') DESC) = 1)
  SELECT l.unp, l.lot_id, coalesce(l.value, f.value) AS value, coalesce(l.currency, f.currency) AS currency FROM l LEFT JOIN f ON f.unp = l.unp AND f.lot = l.lot_id""")
def lot_values(spark: SparkSession, sf: str) -> DataFrame:
    procedures = spark.sql(_PROCEDURES.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    return enrichment.with_lot_values(_lines(spark, sf, _LOTS), _lines(spark, sf, _RELEASED), procedures)


_LABELS = "SELECT DISTINCT l_suppkey AS tender, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN concat('LOT-', CAST(l_partkey AS STRING)) ELSE concat('0', CAST(l_partkey AS STRING), 'а') END AS label FROM lineitem"


@register(f"""WITH l AS ({_LABELS}), k AS (SELECT *, CAST(regexp_extract(label, '[0-9]+') AS BIGINT) AS v FROM l) SELECT tender, label, CAST(row_number() OVER (PARTITION BY tender ORDER BY CASE WHEN label LIKE 'LOT%' THEN 1 ELSE 0 END, v, label LIKE '%а', label) AS INT) AS place FROM k""")
def lots_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf, _LABELS).withColumn("place", F.row_number().over(Window.partitionBy("tender").orderBy(enrichment.natural(F.col("label")), "label")))


# -- values -------------------------------------------------------------------------------------------------------

_VALUED = """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS id, CAST(l_orderkey % 700 AS STRING) AS unp, CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('N', CAST(l_linenumber % 3 AS STRING)) END AS contract_number,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE floor(l_extendedprice) + 0.5 END AS signing_value, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE floor(l_extendedprice * 2) + 0.25 END AS current_value, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'EUR' WHEN 3 THEN 'USD' ELSE 'BGN' END AS currency,
  CASE WHEN l_suppkey % 2 = 0 THEN 0.75 END AS fx_rate, CASE l_orderkey % 6 WHEN 0 THEN 'value_suspect' WHEN 1 THEN 'annex_suspect' WHEN 2 THEN 'annex_total_suspect' ELSE 'ok' END AS value_flag, floor(l_tax * 100) * 10 AS amount_eur, CAST(l_quantity AS INT) % 4 AS q FROM lineitem"""
_CHANGES = "SELECT o_orderkey AS id, CAST(o_orderkey % 700 AS STRING) AS unp, concat('N', CAST(o_custkey % 3 AS STRING)) AS contract_number, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice END AS value_after, CASE o_custkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN '' ELSE 'USD' END AS currency, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published_at FROM orders"
_TO_EUR = lambda v, c: f"CASE WHEN {c} = 'EUR' THEN {v} WHEN {c} = 'BGN' THEN {v} / 1.95583 WHEN fx_rate IS NOT NULL THEN {v} * fx_rate END"


@register(f"""WITH c AS ({_VALUED}), a AS (SELECT unp AS u, contract_number AS k, nullif(currency, '') AS cur FROM ({_CHANGES}) WHERE value_after IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unp, contract_number ORDER BY published_at DESC, id DESC) = 1),
  d AS (SELECT c.*, coalesce(nullif(currency, ''), 'BGN') AS own, CASE WHEN current_value IS NOT NULL THEN coalesce(cur, nullif(currency, ''), 'BGN') ELSE coalesce(nullif(currency, ''), 'BGN') END AS later FROM c LEFT JOIN a ON u = unp AND k = contract_number),
  s AS (SELECT *, CASE value_flag WHEN 'annex_suspect' THEN coalesce(signing_value, current_value) ELSE coalesce(current_value, signing_value) END AS v, CASE WHEN value_flag = 'annex_suspect' THEN CASE WHEN signing_value IS NOT NULL THEN own ELSE later END WHEN current_value IS NOT NULL THEN later ELSE own END AS vc FROM d),
  r AS (SELECT *, CASE WHEN value_flag = 'value_suspect' THEN amount_eur ELSE {_TO_EUR('v', 'vc')} END AS amount FROM s)
  SELECT id, later AS current_value_currency, CAST(floor(amount * 100 + 0.5) AS BIGINT) AS amount_cents, CAST(floor(CASE WHEN value_flag <> 'value_suspect' THEN {_TO_EUR('signing_value', "coalesce(currency, 'BGN')")} END * 100 + 0.5) AS BIGINT) AS signing_cents,
  CAST(floor(CASE WHEN value_flag NOT IN ('value_suspect', 'annex_suspect', 'annex_total_suspect') THEN {_TO_EUR('current_value', 'later')} END * 100 + 0.5) AS BIGINT) AS current_cents FROM r""")
def value_strip(spark: SparkSession, sf: str) -> DataFrame:
    changes = spark.sql(_CHANGES.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    out = enrichment.with_timeline(enrichment.with_current_currency(_lines(spark, sf, _VALUED), changes))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    return out.select("id", "current_value_currency", cents("amount_eur").alias("amount_cents"), cents("signing_value_eur").alias("signing_cents"), cents("current_value_eur").alias("current_cents"))


_RATES = "SELECT CASE user_id % 2 WHEN 0 THEN 'USD' ELSE 'GBP' END AS currency, CAST(CAST(ts AS DATE) AS STRING) AS date, value / 1000 AS rate FROM events WHERE value IS NOT NULL"
_ESTIMATES = "SELECT o_orderkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'BGN' WHEN 2 THEN NULL WHEN 3 THEN 'USD' ELSE 'GBP' END AS currency, concat('2024-01-', lpad(CAST(1 + o_orderkey % 31 AS STRING), 2, '0')) AS signed_at, floor(o_totalprice) + 0.5 AS estimate FROM orders"


@register(f"""WITH r AS (SELECT currency AS c, date, max(rate) AS fx_rate FROM ({_RATES}) GROUP BY ALL), e AS ({_ESTIMATES}) SELECT id, currency, CAST(floor(({_TO_EUR('estimate', 'currency')}) * 100 + 0.5) AS BIGINT) AS cents FROM e LEFT JOIN r ON c = currency AND date = signed_at""")
def estimates_at_rate(spark: SparkSession, sf: str) -> DataFrame:
    estimates = spark.sql(_ESTIMATES.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    rates = spark.sql(_RATES.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    return enrichment.at_rate(estimates, rates, "currency", "signed_at", "estimate", "eur").select("id", "currency", F.floor(F.col("eur") * 100 + 0.5).cast("long").alias("cents"))


@register(f"""{_JOINT_SQL} SELECT code AS authority, count(*) AS contracts, CAST(coalesce(sum(estimate), 0) AS BIGINT) AS cents FROM (SELECT DISTINCT unp, code FROM mm) JOIN n USING (unp) GROUP BY code""")
def joint_participation(spark: SparkSession, sf: str) -> DataFrame:
    notices, members, leads = _members(spark, sf)
    return enrichment.joint_participation(joint.bridge(members, leads, "unp"), notices.select("unp", F.col("estimate").alias("cents")))


@register(", f AS (SELECT CASE WHEN id LIKE '1%' THEN 'first' WHEN id LIKE '2%' THEN 'second' ELSE 'other' END AS feed, count(*) AS n, max(published_at) AS latest FROM contracts GROUP BY 1) SELECT string_agg(feed || ':' || coalesce(latest, '?') || '(' || n || ')', ' ' ORDER BY feed) AS data_as_of FROM f")
def freshness_text(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.freshness_text(derive.freshness(contracts(spark, sf, "id", "published_at"), {"1": "first", "2": "second"}))


@register("SELECT division FROM (SELECT division, sum(amount_cents) AS v FROM contracts WHERE amount_cents IS NOT NULL GROUP BY division) ORDER BY v DESC, division LIMIT 4")
def sector_options(spark: SparkSession, sf: str) -> DataFrame:
    sums = contracts(spark, sf, "division", "amount_cents").where("amount_cents is not null").groupBy("division").agg(F.sum("amount_cents").alias("v"))
    return enrichment.sector_options(sums, "v", 4)


# -- conflict pages: declared stakes as links, suppliers as companies ---------------------------------------------

_LINKS = f"""SELECT concat_ws(':', CAST(person AS STRING), CAST(company AS STRING), scope) AS link_key, person, company, CASE WHEN (person + company + CASE scope WHEN 'self' THEN 0 ELSE 1 END) % 5 = 0 THEN 'held' ELSE 'published' END AS status,
  CASE WHEN company % 6 = 5 THEN 'management' WHEN scope = 'self' THEN 'private_ownership' ELSE 'family_ownership' END AS interest_class, CASE person % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'name_contains' END AS own_institution, min(year) AS first_year, max(year) AS last_year FROM ({_HOLDINGS}) h GROUP BY person, company, scope"""
_SEALS = "SELECT link_key, CASE (person + company) % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'unknown' ELSE 'confirmed' END AS kind FROM links"
_CONFLICT_SQL = f""", links AS ({_LINKS}), seals AS ({_SEALS}), c AS (SELECT id, bidder_id AS company, CAST(substr(signed_at, 1, 4) AS INT) AS year, signed_at, amount_cents AS cents FROM contracts WHERE bidder_id % 9 <> 4),
  g AS (SELECT * FROM links l WHERE status = 'published' AND interest_class IN ('private_ownership', 'family_ownership') AND EXISTS (SELECT 1 FROM seals s WHERE s.link_key = l.link_key AND kind IN ('document', 'confirmed'))
    AND NOT (interest_class = 'family_ownership' AND EXISTS (SELECT 1 FROM links o WHERE o.person = l.person AND o.company = l.company AND o.status = 'published' AND o.interest_class = 'private_ownership'))),
  x AS (SELECT g.link_key, count(*) AS contracts, CAST(sum(cents) AS BIGINT) AS cents, count(*) FILTER (year BETWEEN first_year AND last_year) AS window_contracts, CAST(sum(cents) FILTER (year BETWEEN first_year AND last_year) AS BIGINT) AS window_cents FROM g JOIN c USING (company) GROUP BY 1),
  s AS (SELECT g.*, x.contracts, x.cents, window_contracts, window_cents FROM g JOIN x USING (link_key))"""
_NEXUS_SQL = "coalesce(own_institution = 'exact', false) DESC, window_contracts > 0 DESC, window_cents DESC NULLS LAST, link_key"


def _conflict_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, evidence, contracts)."""
    links = spark.sql(_LINKS.replace("FROM lineitem JOIN orders", "FROM {l} JOIN {o}"), l=table(spark, sf, "lineitem"), o=table(spark, sf, "orders"))
    c = contracts(spark, sf, "id", "bidder_id", "signed_at", "amount_cents").where("bidder_id % 9 <> 4")
    c = c.select("id", F.col("bidder_id").alias("company"), F.substring("signed_at", 1, 4).cast("int").alias("year"), "signed_at", F.col("amount_cents").alias("cents"))
    return links, spark.sql(_SEALS.replace("FROM links", "FROM {k}"), k=links), c


@register(f"{_CONFLICT_SQL} SELECT *, CAST(row_number() OVER (ORDER BY {_NEXUS_SQL}) AS INT) AS place FROM s ORDER BY place LIMIT 100")
def conflict_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.leaderboard(conflicts.shown(*_conflict_tables(spark, sf)))


@register(f"{_CONFLICT_SQL} SELECT person, link_key, CAST(row_number() OVER (PARTITION BY person ORDER BY {_NEXUS_SQL}) AS INT) AS place, window_contracts, window_cents FROM s")
def conflicts_by_official(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.pages(conflicts.shown(*_conflict_tables(spark, sf)), "person").select("person", "link_key", "place", "window_contracts", "window_cents")


@register(f"{_CONFLICT_SQL} SELECT company, link_key, CAST(row_number() OVER (PARTITION BY company ORDER BY {_NEXUS_SQL}) AS INT) AS place, contracts, cents FROM s")
def conflicts_by_company(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.pages(conflicts.shown(*_conflict_tables(spark, sf)), "company").select("company", "link_key", "place", "contracts", "cents")


@register(f"{_CONFLICT_SQL} SELECT count(*) AS links, count(DISTINCT person) AS officials, count(DISTINCT company) AS companies, CAST((SELECT sum(v) FROM (SELECT max(cents) AS v FROM s GROUP BY company)) AS BIGINT) AS cents FROM s")
def conflict_headline(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.headline(conflicts.shown(*_conflict_tables(spark, sf)))


@register(f"""{_CONFLICT_SQL}, m AS (SELECT link_key, id, CASE WHEN year IS NULL OR first_year IS NULL OR last_year IS NULL THEN 'unknown' WHEN year < first_year THEN 'before' WHEN year > last_year THEN 'after' ELSE 'contemporaneous' END AS temporal, signed_at, cents FROM g JOIN c USING (company))
  SELECT link_key, CAST(row_number() OVER (PARTITION BY link_key ORDER BY temporal = 'contemporaneous' DESC, signed_at DESC NULLS LAST, cents DESC NULLS LAST, id) AS INT) AS place, id, temporal, signed_at, cents FROM m QUALIFY place <= 40""")
def link_contracts(spark: SparkSession, sf: str) -> DataFrame:
    links, evidence, c = _conflict_tables(spark, sf)
    return conflicts.link_contracts(conflicts.gated(links, evidence), c, 40)
