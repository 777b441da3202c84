"""Queries on lists, facets and the pages of single entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.operators import details, filters, lists, rollups
from outlay.operators.paging import Cursor
from outlay.plans.crosswalk import GROUP_SQL, PROCEDURE_GROUPS, contracts, table
from outlay.plans.registry import register

_COMPANY = "CASE WHEN s_suppkey % 37 = 0 THEN 'unknown' WHEN s_suppkey % 10 = 0 THEN 'consortium' ELSE 'company' END"
_TYPE = "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END"
_BASE = ("bidder_id", "authority_id", "division", "signed_at", "eu_funded", "amount_cents")


def _companies(spark: SparkSession, sf: str, p: lists.EntityFilters) -> DataFrame:
    names = table(spark, sf, "supplier").selectExpr("s_suppkey AS bidder_id", "s_name AS name", f"{_COMPANY} AS kind")
    return lists.entity_rollup(contracts(spark, sf, *_BASE), names, "bidder_id", "authority_id", p)


def _authorities(spark: SparkSession, sf: str, p: lists.EntityFilters) -> DataFrame:
    names = table(spark, sf, "customer").selectExpr("c_custkey AS authority_id", "c_name AS name", f"{_TYPE} AS type_group")
    return lists.entity_rollup(contracts(spark, sf, *_BASE), names, "authority_id", "bidder_id", p)


def _rollup_sql(key: str, partner: str, names: str, where: str, division: str) -> str:
    return f""", t AS (SELECT {key}, CAST(sum(amount_cents) AS BIGINT) AS sum_cents, count(*) AS contracts, count(DISTINCT {partner}) AS partners, CAST(sum(amount_cents) AS DOUBLE) / 100 / count(*) AS avg_eur
  FROM contracts WHERE amount_cents IS NOT NULL {where} GROUP BY {key}), s AS (SELECT {key}, division FROM (SELECT {key}, division, sum(amount_cents) AS v FROM contracts WHERE amount_cents IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY v DESC, division) = 1),
  e AS (SELECT t.*, {division} AS division, n.* EXCLUDE (k) FROM t LEFT JOIN s USING ({key}) JOIN ({names}) n ON n.k = t.{key})"""


_COMPANIES = f"SELECT s_suppkey AS k, s_name AS name, {_COMPANY} AS kind FROM supplier"
_AUTHORITIES = f"SELECT c_custkey AS k, c_name AS name, {_TYPE} AS type_group FROM customer"
_SHOWN = ["bidder_id", "name", "kind", "sum_cents", "contracts", "partners", "division"]


@register(_rollup_sql("bidder_id", "authority_id", _COMPANIES, "", "s.division") + " SELECT bidder_id, name, kind, sum_cents, contracts, partners, division FROM e WHERE kind <> 'unknown' ORDER BY sum_cents DESC, bidder_id DESC LIMIT 26")
def companies_by_value(spark: SparkSession, sf: str) -> DataFrame:
    p = lists.EntityFilters()
    return lists.entity_page(_companies(spark, sf, p).where(lists.company_filter(p)), lists.COMPANY_SORTS, "won", "bidder_id").select(*_SHOWN)


@register(_rollup_sql("bidder_id", "authority_id", _COMPANIES, "AND division = 'ECONOMY' AND substr(signed_at, 1, 4) IN ('1995', '1996') AND coalesce(eu_funded, 0) = 0", "'ECONOMY'")
          + " SELECT bidder_id, name, kind, sum_cents, contracts, partners, division FROM e WHERE kind = 'company' AND contracts BETWEEN 21 AND 100 ORDER BY partners DESC, bidder_id DESC LIMIT 26")
def companies_filtered(spark: SparkSession, sf: str) -> DataFrame:
    p = lists.EntityFilters(sectors=("ECONOMY",), years=("1995", "1996"), eu="national", kinds=("company",), count_bucket="21-100")
    return lists.entity_page(_companies(spark, sf, p).where(lists.company_filter(p)), lists.COMPANY_SORTS, "authorities", "bidder_id").select(*_SHOWN)


@register(_rollup_sql("bidder_id", "authority_id", _COMPANIES, "", "s.division") + " SELECT bidder_id, name, contracts FROM e WHERE kind <> 'unknown' AND (name > 'Supplier#000000005' OR (name = 'Supplier#000000005' AND bidder_id > 5)) ORDER BY name, bidder_id LIMIT 26")
def companies_by_name_after(spark: SparkSession, sf: str) -> DataFrame:
    p = lists.EntityFilters()
    cursor = Cursor("after", "Supplier#000000005", 5)
    return lists.entity_page(_companies(spark, sf, p).where(lists.company_filter(p)), lists.COMPANY_SORTS, "name", "bidder_id", cursor).select("bidder_id", "name", "contracts")


@register(_rollup_sql("authority_id", "bidder_id", _AUTHORITIES, "", "s.division") + " SELECT authority_id, name, type_group, sum_cents, contracts, partners, avg_eur, division FROM e WHERE type_group IN ('BUILDING', 'MACHINERY') ORDER BY avg_eur DESC, authority_id DESC LIMIT 26")
def authorities_by_average(spark: SparkSession, sf: str) -> DataFrame:
    p = lists.EntityFilters(types=("BUILDING", "MACHINERY"))
    page = lists.entity_page(_authorities(spark, sf, p).where(lists.authority_filter(p)), lists.AUTHORITY_SORTS, "avg", "authority_id")
    return page.select("authority_id", "name", "type_group", "sum_cents", "contracts", "partners", "avg_eur", "division")


@register(_rollup_sql("authority_id", "bidder_id", _AUTHORITIES, "AND eu_funded = 1", "CAST(NULL AS VARCHAR)") + " SELECT authority_id, name, sum_cents, contracts, division FROM e ORDER BY sum_cents DESC, authority_id DESC LIMIT 26")
def authorities_eu(spark: SparkSession, sf: str) -> DataFrame:
    p = lists.EntityFilters(eu="eu")
    return lists.entity_page(_authorities(spark, sf, p).where(lists.authority_filter(p)), lists.AUTHORITY_SORTS, None, "authority_id").select("authority_id", "name", "sum_cents", "contracts", "division")


@register(_rollup_sql("bidder_id", "authority_id", _COMPANIES, "", "s.division") + """ SELECT 'kind' AS facet, kind AS key, CAST(count(*) AS DOUBLE) AS n FROM e WHERE kind IN ('company', 'consortium') GROUP BY kind
  UNION ALL SELECT 'sector', division, CAST(sum(amount_cents) AS DOUBLE) / 100 FROM contracts WHERE amount_cents IS NOT NULL AND coalesce(division, '') <> '' GROUP BY division HAVING sum(amount_cents) > 0""")
def company_facets(spark: SparkSession, sf: str) -> DataFrame:
    return lists.company_facets(_companies(spark, sf, lists.EntityFilters()), rollups.sector_totals(contracts(spark, sf, "division", "amount_cents")))


@register(_rollup_sql("authority_id", "bidder_id", _AUTHORITIES, "", "s.division") + " SELECT coalesce(type_group, 'друго') AS type_group, count(*) AS n FROM e GROUP BY 1")
def authority_facets(spark: SparkSession, sf: str) -> DataFrame:
    return lists.authority_facets(_authorities(spark, sf, lists.EntityFilters()))


@register(f"""SELECT 'sector' AS facet, division AS key, count(*) AS contracts FROM contracts GROUP BY division UNION ALL SELECT 'year', CASE WHEN substr(signed_at, 1, 4) <= '1997' THEN substr(signed_at, 1, 4) ELSE 'unknown' END AS y, count(*) FROM contracts GROUP BY y
  UNION ALL SELECT 'procedure', {GROUP_SQL} AS g, count(*) FROM contracts GROUP BY g UNION ALL SELECT 'eu', CASE WHEN eu_funded = 1 THEN 'eu' ELSE 'national' END AS u, count(*) FROM contracts GROUP BY u""")
def contract_facets(spark: SparkSession, sf: str) -> DataFrame:
    return lists.contract_facets(contracts(spark, sf, "division", "signed_at", "procedure_type", "eu_funded"), PROCEDURE_GROUPS, "1997")


@register("SELECT id, signed_at, amount_cents FROM contracts WHERE bids_received = 1 AND amount_cents IS NOT NULL ORDER BY coalesce(signed_at, published_at) DESC, id LIMIT 10")
def single_offers_recent(spark: SparkSession, sf: str) -> DataFrame:
    return lists.single_offers(contracts(spark, sf, "id", "signed_at", "published_at", "bids_received", "amount_cents"), "recent").select("id", "signed_at", "amount_cents")


@register("SELECT id, signed_at, amount_cents FROM contracts WHERE bids_received = 1 AND amount_cents IS NOT NULL ORDER BY amount_cents DESC, id LIMIT 10")
def single_offers_largest(spark: SparkSession, sf: str) -> DataFrame:
    return lists.single_offers(contracts(spark, sf, "id", "signed_at", "published_at", "bids_received", "amount_cents"), "value").select("id", "signed_at", "amount_cents")


@register("""SELECT CASE WHEN amount_cents < 10000000 THEN 'lt100k' WHEN amount_cents < 100000000 THEN '100k-1m' WHEN amount_cents < 1000000000 THEN '1m-10m' WHEN amount_cents < 10000000000 THEN '10m-100m' ELSE 'gt100m' END AS bucket, count(*) AS contracts
  FROM contracts WHERE amount_cents IS NOT NULL GROUP BY 1""")
def value_buckets(spark: SparkSession, sf: str) -> DataFrame:
    euros = F.col("amount_cents") / 100
    bucket = F.coalesce(*[F.when(filters.between(euros, *ends), name) for name, ends in filters.VALUE_BUCKETS.items()])
    return contracts(spark, sf, "amount_cents").where("amount_cents is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("contracts"))


@register(f", g AS (SELECT bidder_id, {GROUP_SQL} AS procedure_group, count(*) AS contracts FROM contracts GROUP BY ALL) SELECT *, round(CAST(contracts AS DOUBLE) / sum(contracts) OVER (PARTITION BY bidder_id), 9) AS share FROM g")
def company_procedure_mix(spark: SparkSession, sf: str) -> DataFrame:
    return details.procedure_mix(contracts(spark, sf, "bidder_id", "procedure_type"), "bidder_id", F.expr(GROUP_SQL))


@register(""", s AS (SELECT authority_id, division, CAST(sum(amount_cents) AS BIGINT) AS v FROM contracts WHERE amount_cents IS NOT NULL GROUP BY ALL), f AS (SELECT *, sum(v) OVER (PARTITION BY authority_id) AS total FROM s QUALIFY row_number() OVER (PARTITION BY authority_id ORDER BY v DESC, division) = 1),
  b AS (SELECT authority_id, sum(bids_received) AS b, count(bids_received) AS n FROM contracts GROUP BY ALL) SELECT authority_id, division, CASE WHEN total > 0 THEN round(CAST(v AS DOUBLE) / CAST(total AS DOUBLE), 9) ELSE 0.0 END AS share,
  CASE WHEN n > 0 THEN floor(CAST(b AS DOUBLE) * 10 / n + 0.5) / 10 END AS avg_bids FROM f JOIN b USING (authority_id)""")
def authority_sector_profile(spark: SparkSession, sf: str) -> DataFrame:
    return details.sector_profile(contracts(spark, sf, "authority_id", "division", "amount_cents", "bids_received"), "authority_id")


@register("SELECT bidder_id, authority_id, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS contracts, CAST(row_number() OVER (PARTITION BY bidder_id ORDER BY sum(amount_cents) DESC, authority_id) AS INT) AS rank FROM contracts WHERE amount_cents IS NOT NULL GROUP BY bidder_id, authority_id QUALIFY rank <= 3")
def company_top_authorities(spark: SparkSession, sf: str) -> DataFrame:
    return details.top_partners(contracts(spark, sf, "bidder_id", "authority_id", "amount_cents"), "bidder_id", "authority_id", 3)


@register("SELECT bidder_id, substr(signed_at, 1, 4) AS year, count(*) AS contracts, CAST(sum(amount_cents) AS BIGINT) AS cents FROM contracts WHERE amount_cents IS NOT NULL GROUP BY 1, 2")
def company_years(spark: SparkSession, sf: str) -> DataFrame:
    return details.yearly(contracts(spark, sf, "bidder_id", "signed_at", "amount_cents"), "bidder_id")


@register("""SELECT id, 0 AS step, 'estimate' AS name, CASE WHEN own_cents > 0 THEN own_cents ELSE procedure_cents END AS cents FROM contracts WHERE own_cents > 0 OR procedure_cents > 0
  UNION ALL SELECT id, 1, 'signed', signing_cents FROM contracts WHERE signing_cents IS NOT NULL UNION ALL SELECT id, 2, 'current', amount_cents FROM contracts WHERE amount_cents IS NOT NULL""")
def contract_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return details.value_timeline(contracts(spark, sf, "id", "own_cents", "procedure_cents", "signing_cents", "amount_cents"))


@register("SELECT tender_id, count(*) AS awards, count(*) > greatest(max(lot_id), 1) AS framework FROM (SELECT tender_id, CASE WHEN lot_id > 3 THEN 1 ELSE lot_id END AS lot_id FROM contracts) GROUP BY tender_id")
def framework_awards(spark: SparkSession, sf: str) -> DataFrame:
    return details.framework_awards(contracts(spark, sf, "tender_id", "lot_id"), F.expr("CASE WHEN lot_id > 3 THEN 1 ELSE lot_id END"))


@register(""", p AS (SELECT authority_id, bidder_id, sum(amount_cents) AS v FROM contracts WHERE amount_cents IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY authority_id ORDER BY v DESC, bidder_id) <= 5)
  SELECT a.bidder_id, b.bidder_id AS other, count(*) AS authorities FROM t a JOIN t b ON a.authority_id = b.authority_id AND a.bidder_id < b.bidder_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_authorities(spark: SparkSession, sf: str) -> DataFrame:
    return details.competitors(contracts(spark, sf, "authority_id", "bidder_id", "amount_cents"))


@register("SELECT substr(signed_at, 1, 4) AS year, count(*) AS contracts FROM contracts WHERE substr(signed_at, 1, 4) <= '1997' GROUP BY 1")
def year_options(spark: SparkSession, sf: str) -> DataFrame:
    return lists.year_options(contracts(spark, sf, "signed_at"), "1997")


@register(""", c AS (SELECT CAST(bidder_id AS VARCHAR) AS key, CAST(sum(amount_cents) AS BIGINT) AS sum_cents, bidder_id AS k FROM contracts WHERE amount_cents IS NOT NULL GROUP BY bidder_id), a AS (SELECT CAST(authority_id AS VARCHAR) AS key, CAST(sum(amount_cents) AS BIGINT) AS sum_cents, authority_id AS k FROM contracts WHERE amount_cents IS NOT NULL GROUP BY authority_id)
  SELECT * FROM (SELECT 'companies' AS block, key, sum_cents FROM c ORDER BY sum_cents DESC, k LIMIT 10) UNION ALL SELECT * FROM (SELECT 'authorities', key, sum_cents FROM a ORDER BY sum_cents DESC, k LIMIT 6)""")
def home_blocks(spark: SparkSession, sf: str) -> DataFrame:
    base = contracts(spark, sf, "bidder_id", "authority_id", "signed_at", "eu_funded", "amount_cents")
    total = lambda key: base.where("amount_cents is not null").groupBy(key).agg(F.sum("amount_cents").alias("sum_cents"))
    return lists.leaders({"companies": (total("bidder_id"), "bidder_id", 10), "authorities": (total("authority_id"), "authority_id", 6)})


@register("SELECT a.id, count(b.id) AS twins FROM (SELECT id, eu_funded, bids_received, amount_cents FROM contracts WHERE amount_cents > 9000000) a JOIN (SELECT id, eu_funded, bids_received FROM contracts WHERE amount_cents > 9000000) b ON a.eu_funded IS NOT DISTINCT FROM b.eu_funded AND a.bids_received IS NOT DISTINCT FROM b.bids_received GROUP BY a.id")
def same_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Null-safe equi-join: unknown EU funding or offers are equal to unknown ones; profiles are counted before they meet."""
    large = contracts(spark, sf, "id", "eu_funded", "bids_received", "amount_cents").where("amount_cents > 9000000")
    n = large.groupBy(F.col("eu_funded").alias("e"), F.col("bids_received").alias("b")).agg(F.count("*").alias("n"))
    met = large.join(n, F.col("eu_funded").eqNullSafe(F.col("e")) & F.col("bids_received").eqNullSafe(F.col("b")))
    return met.groupBy("id").agg(F.sum("n").alias("twins"))
