"""The registered analytics queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.functions import coerce, identity, values
from outlay.operators import amendments, asof, competition, filters, interests, joint, network, paging, pick, quality, rollups, search, trend
from outlay.plans.crosswalk import CONTRACTS_SQL, GROUP_SQL, PROCEDURE_GROUPS, contracts, table
from outlay.plans.registry import ORACLES, QUERIES, register
from outlay.sources import sinks
from outlay.streaming import windows

TODAY = "1998-06-30"


_TOTALED = ("bidder_id", "authority_id", "signed_at", "eu_funded", "amount_cents")


def _totals_sql(key: str, partner: str) -> str:
    return f"""SELECT {key}, CAST(sum(amount_cents) AS BIGINT) AS sum_cents, count(*) AS contracts, count(DISTINCT {partner}) AS partners,
      CAST(sum(CASE WHEN eu_funded = 1 THEN amount_cents ELSE 0 END) AS BIGINT) AS eu_cents, min(signed_at) AS first_date, max(signed_at) AS last_date
      FROM contracts WHERE amount_cents IS NOT NULL GROUP BY {key}"""


@register(_totals_sql("bidder_id", "authority_id"))
def company_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.entity_totals(contracts(spark, sf, *_TOTALED), "bidder_id", "authority_id")


@register(_totals_sql("authority_id", "bidder_id"))
def authority_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.entity_totals(contracts(spark, sf, *_TOTALED), "authority_id", "bidder_id")


@register(", s AS (SELECT bidder_id, division, sum(amount_cents) AS v FROM contracts WHERE amount_cents IS NOT NULL GROUP BY ALL) SELECT bidder_id, division FROM s QUALIFY row_number() OVER (PARTITION BY bidder_id ORDER BY v DESC, division) = 1")
def company_primary_sector(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.primary_sector(contracts(spark, sf, "bidder_id", "division", "amount_cents"), "bidder_id")


@register(f"""SELECT count(*) AS contracts, CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 AS value_eur,
  count(DISTINCT CASE WHEN amount_cents IS NOT NULL THEN authority_id END) AS authorities, count(DISTINCT CASE WHEN amount_cents IS NOT NULL THEN bidder_id END) AS bidders,
  min(CASE WHEN signed_at BETWEEN '1995-01-01' AND '{TODAY}' THEN signed_at END) AS first_date, max(CASE WHEN signed_at <= '{TODAY}' THEN signed_at END) AS last_date FROM contracts""")
def home_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.home_totals(contracts(spark, sf, "authority_id", "bidder_id", "signed_at", "amount_cents"), "1995-01-01", TODAY)


@register("SELECT division, count(*) AS contracts, CAST(sum(amount_cents) AS DOUBLE) / 100 AS value_eur FROM contracts WHERE amount_cents IS NOT NULL AND coalesce(division, '') <> '' GROUP BY division")
def sector_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.sector_totals(contracts(spark, sf, "division", "amount_cents"))


@register("""SELECT 'procedure' AS facet, procedure_type AS key, count(*) AS contracts, CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 AS value_eur FROM contracts GROUP BY procedure_type
  UNION ALL SELECT 'eu', CASE WHEN eu_funded = 1 THEN '1' ELSE '0' END AS e, count(*), CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 FROM contracts GROUP BY e""")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.facet_counts(contracts(spark, sf, "procedure_type", "eu_funded", "amount_cents"))


_FLOWS = "SELECT authority_id, bidder_id, CAST(sum(amount_cents) AS DOUBLE) / 100 AS won_eur, count(*) AS contracts FROM contracts WHERE amount_cents IS NOT NULL GROUP BY authority_id, bidder_id"


@register(_FLOWS)
def flow_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.flow_pairs(contracts(spark, sf, "authority_id", "bidder_id", "amount_cents"))


_RANKED = ", r AS (SELECT division, amount_cents, row_number() OVER (PARTITION BY division ORDER BY amount_cents) AS k, count(*) OVER (PARTITION BY division) AS n FROM contracts WHERE amount_cents > 0 AND coalesce(division, '') <> '')"
_PERCENTILES = ", ".join(f"CAST(max(CASE WHEN k = CAST(ceil(CAST({q} AS DECIMAL(4,2)) * n) AS BIGINT) THEN amount_cents END) AS DOUBLE) / 100 AS {name}" for name, q in rollups.QUANTILES.items())


@register(f"{_RANKED} SELECT division, count(*) AS priced_contracts, {_PERCENTILES} FROM r GROUP BY division")
def cohort_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.cohort_percentiles(contracts(spark, sf, "division", "amount_cents"))


@register(f"""{_RANKED}, p AS (SELECT division, count(*) AS n, {_PERCENTILES} FROM r GROUP BY division), b AS (
  SELECT CASE WHEN x.e IS NULL OR x.e <= 0 OR coalesce(n, 0) < 12 THEN NULL WHEN n >= 100 AND p99_eur > p95_eur AND e > p99_eur THEN 'top1' WHEN n >= 40 AND p95_eur > p90_eur AND e > p95_eur THEN 'top5'
    WHEN n >= 20 AND p90_eur > p75_eur AND e > p90_eur THEN 'top10' WHEN n >= 12 AND p75_eur > median_eur AND e > p75_eur THEN 'top25' WHEN e > median_eur THEN 'above-median'
    WHEN e < p25_eur AND median_eur > p25_eur THEN 'bottom25' WHEN e < median_eur THEN 'below-median' ELSE 'at-median' END AS band
  FROM (SELECT division, CAST(amount_cents AS DOUBLE) / 100 AS e FROM contracts) x LEFT JOIN p USING (division)) SELECT band, count(*) AS contracts FROM b GROUP BY band""")
def cohort_bands(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "division", "amount_cents")
    banded = c.join(F.broadcast(rollups.cohort_percentiles(c)), "division", "left")  # one row a division
    return banded.select(rollups.cohort_band(rollups.cents("amount_cents")).alias("band")).groupBy("band").agg(F.count("*").alias("contracts"))


_FILTERS = filters.ContractFilters(years=("1996", "unknown"), sectors=("ECONOMY", "STANDARD"), procedures=("open",), value_bucket="lt100k", eu="0")
_FILTER_SQL = f"""FROM contracts WHERE (signed_at LIKE '1996%' OR substr(signed_at, 1, 4) > '1998') AND division IN ('ECONOMY', 'STANDARD')
  AND {GROUP_SQL} = 'open' AND amount_cents < 10000000 AND coalesce(eu_funded, 0) = 0"""


@register(f"SELECT id, tender_id, authority_id, bidder_id, signed_at, amount_cents {_FILTER_SQL}")
def contracts_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return filters.apply_filters(contracts(spark, sf), _FILTERS, PROCEDURE_GROUPS, "1998").select("id", "tender_id", "authority_id", "bidder_id", "signed_at", "amount_cents")


@register(f"SELECT count(*) AS contracts, CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 AS value_eur, count(*) FILTER (amount_cents IS NULL OR amount_cents <= 0) AS suspect {_FILTER_SQL}")
def contracts_summary(spark: SparkSession, sf: str) -> DataFrame:
    return filters.summary(filters.apply_filters(contracts(spark, sf), _FILTERS, PROCEDURE_GROUPS, "1998"))


_CURSOR = paging.Cursor("after", 5_000_000, "2")
_PAGE_KEY = "coalesce(amount_cents, -100)"


@register(f"SELECT id, {_PAGE_KEY} AS sort_key FROM contracts WHERE {_PAGE_KEY} < 5000000 OR ({_PAGE_KEY} = 5000000 AND id < '2') ORDER BY sort_key DESC, id DESC LIMIT 16")
def contracts_page_after(spark: SparkSession, sf: str) -> DataFrame:
    sort, down = paging.CONTRACT_SORTS["value-desc"]
    return paging.page(contracts(spark, sf, "id", "amount_cents"), sort(), "id", down, 15, _CURSOR).select("id", F.col("_key").alias("sort_key"))


@register(f"SELECT id, {_PAGE_KEY} AS sort_key FROM contracts WHERE {_PAGE_KEY} > 5000000 OR ({_PAGE_KEY} = 5000000 AND id > '2') ORDER BY sort_key, id LIMIT 16")
def contracts_page_before(spark: SparkSession, sf: str) -> DataFrame:
    sort, down = paging.CONTRACT_SORTS["value-desc"]
    cursor = paging.Cursor("before", _CURSOR.value, _CURSOR.id)
    return paging.page(contracts(spark, sf, "id", "amount_cents"), sort(), "id", down, 15, cursor).select("id", F.col("_key").alias("sort_key"))


@register(""", t AS (SELECT count(*) AS contracts, count(*) FILTER (bids_received = 1) AS single_offer, CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0), 0) AS BIGINT) AS v,
  CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0 AND bids_received = 1), 0) AS BIGINT) AS s FROM contracts WHERE bids_received >= 1)
  SELECT contracts, single_offer, CASE WHEN contracts > 0 THEN CAST(single_offer AS DOUBLE) / contracts ELSE 0.0 END AS single_offer_share, CAST(v AS DOUBLE) / 100 AS value_eur,
  CAST(s AS DOUBLE) / 100 AS single_value_eur, CASE WHEN v > 0 THEN CAST(s AS DOUBLE) / v ELSE 0.0 END AS single_value_share FROM t""")
def single_offer_totals(spark: SparkSession, sf: str) -> DataFrame:
    return competition.offer_totals(contracts(spark, sf, "bids_received", "amount_cents"))


@register("""SELECT authority_id, count(*) AS contracts, count(*) FILTER (bids_received = 1) AS single_offer, CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 AS value_eur,
  CAST(count(*) FILTER (bids_received = 1) AS DOUBLE) / count(*) AS share FROM contracts WHERE bids_received >= 1 GROUP BY authority_id HAVING count(*) >= 20 ORDER BY share DESC, 2 DESC, authority_id LIMIT 20""")
def single_offer_by_authority(spark: SparkSession, sf: str) -> DataFrame:
    return competition.single_offer_by_authority(contracts(spark, sf, "authority_id", "bids_received", "amount_cents"))


@register(""", p AS (SELECT authority_id, bidder_id, CAST(sum(amount_cents) AS HUGEINT) AS v, count(*) AS n FROM contracts WHERE amount_cents > 0 GROUP BY ALL),
  t AS (SELECT authority_id, count(*) AS suppliers, CAST(sum(n) AS BIGINT) AS contracts, sum(v) AS total, sum(v * v) AS sq FROM p GROUP BY authority_id)
  SELECT authority_id, suppliers, contracts, CAST(total AS DOUBLE) / 100 AS value_eur, round(CAST(sq AS DOUBLE) / (CAST(total AS DOUBLE) * CAST(total AS DOUBLE)), 9) AS hhi
  FROM t WHERE contracts >= 20 AND suppliers >= 2 ORDER BY hhi DESC, value_eur DESC, authority_id LIMIT 20""")
def hhi_by_authority(spark: SparkSession, sf: str) -> DataFrame:
    return competition.concentration(contracts(spark, sf, "authority_id", "bidder_id", "amount_cents"))


@register(f""", g AS (SELECT {GROUP_SQL} AS g, amount_cents FROM contracts), t AS (SELECT count(*) FILTER (g = 'open') AS competitive, count(*) FILTER (g = 'direct') AS non_competitive,
  count(*) FILTER (g = 'neutral') AS neutral, count(*) FILTER (g = 'unknown') AS unknown, count(*) AS contracts, CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0 AND g IN ('open', 'direct')), 0) AS BIGINT) AS v,
  CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0 AND g = 'direct'), 0) AS BIGINT) AS d FROM g)
  SELECT competitive, non_competitive, neutral, unknown, contracts, CASE WHEN competitive + non_competitive > 0 THEN CAST(non_competitive AS DOUBLE) / (competitive + non_competitive) ELSE 0.0 END AS non_competitive_share,
  CAST(v AS DOUBLE) / 100 AS classified_eur, CASE WHEN v > 0 THEN CAST(d AS DOUBLE) / v ELSE 0.0 END AS non_competitive_value_share FROM t""")
def procedure_competition(spark: SparkSession, sf: str) -> DataFrame:
    return competition.procedure_competition(contracts(spark, sf, "procedure_type", "amount_cents"), F.expr(GROUP_SQL))


@register(f""", g AS (SELECT authority_id, {GROUP_SQL} AS g, amount_cents FROM contracts) SELECT authority_id, count(*) AS classified, count(*) FILTER (g = 'direct') AS non_competitive,
  CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 AS value_eur, CAST(count(*) FILTER (g = 'direct') AS DOUBLE) / count(*) AS share FROM g WHERE g IN ('open', 'direct')
  GROUP BY authority_id HAVING count(*) >= 20 ORDER BY share DESC, classified DESC, authority_id LIMIT 20""")
def direct_award_by_authority(spark: SparkSession, sf: str) -> DataFrame:
    return competition.direct_award_by_authority(contracts(spark, sf, "authority_id", "procedure_type", "amount_cents"), F.expr(GROUP_SQL))


@register(f", p AS ({_FLOWS}) SELECT authority_id, bidder_id, contracts, won_eur FROM p ORDER BY contracts DESC, won_eur DESC, authority_id, bidder_id LIMIT 20")
def recurring_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return competition.recurring_pairs(contracts(spark, sf, "authority_id", "bidder_id", "amount_cents"))


@register(f", p AS ({_FLOWS}) SELECT authority_id, bidder_id, won_eur FROM p ORDER BY won_eur DESC, authority_id, bidder_id LIMIT 50")
def top_flows(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.flow_pairs(contracts(spark, sf, "authority_id", "bidder_id", "amount_cents")).orderBy(F.desc("won_eur"), "authority_id", "bidder_id").limit(50).drop("contracts")


@register(f""", p AS ({_FLOWS}), h1 AS (SELECT * FROM p WHERE authority_id = 7 ORDER BY won_eur DESC, bidder_id LIMIT 6),
  sc AS (SELECT * FROM p WHERE authority_id <> 7 AND bidder_id IN (SELECT bidder_id FROM h1) ORDER BY won_eur DESC, authority_id, bidder_id LIMIT 60),
  h2 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY bidder_id ORDER BY won_eur DESC, authority_id) = 1)
  SELECT 1 AS hop, authority_id, bidder_id, won_eur FROM h1 UNION ALL SELECT 2, authority_id, bidder_id, won_eur FROM h2""")
def network_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return network.ego_network(rollups.flow_pairs(contracts(spark, sf, "authority_id", "bidder_id", "amount_cents")), 7)


_CENTS_FLOWS = "SELECT authority_id, bidder_id, sum(amount_cents) AS w FROM contracts WHERE amount_cents IS NOT NULL GROUP BY ALL"


@register(f", p AS ({_CENTS_FLOWS}) SELECT 'authority' AS kind, authority_id AS node, CAST(sum(w) AS DOUBLE) / 100 AS weight_eur FROM p GROUP BY node UNION ALL SELECT 'bidder', bidder_id AS node, CAST(sum(w) AS DOUBLE) / 100 FROM p GROUP BY node")
def node_weights(spark: SparkSession, sf: str) -> DataFrame:
    pairs = contracts(spark, sf, "authority_id", "bidder_id", "amount_cents").where("amount_cents is not null").groupBy("authority_id", "bidder_id").agg(F.sum("amount_cents").alias("won_cents"))
    return network.node_weights(pairs)


@register("""SELECT c.period, count(amount_cents) AS contracts, CAST(coalesce(sum(amount_cents), 0) AS DOUBLE) / 100 AS value_eur
  FROM (SELECT strftime(d, '%Y-%m') AS period FROM generate_series(DATE '1994-06-01', DATE '1998-06-30', INTERVAL 1 MONTH) g(d)) c
  LEFT JOIN (SELECT * FROM contracts WHERE signed_at BETWEEN '1994-06-01' AND '1998-06-30' AND amount_cents IS NOT NULL) x ON substr(signed_at, 1, 7) = c.period GROUP BY c.period""")
def spending_trend_month(spark: SparkSession, sf: str) -> DataFrame:
    return trend.monthly_series(contracts(spark, sf, "signed_at", "amount_cents"), "1994-06-01", TODAY)


@register(f""", y AS (SELECT substr(signed_at, 1, 4) AS year, count(*) AS contracts, CAST(sum(amount_cents) AS BIGINT) AS c FROM contracts WHERE signed_at <= '{TODAY}' AND amount_cents IS NOT NULL GROUP BY 1),
  l AS (SELECT *, lag(c) OVER (ORDER BY year) AS b, lag(year) OVER (ORDER BY year) AS yb FROM y)
  SELECT year, contracts, CAST(c AS DOUBLE) / 100 AS value_eur, CASE WHEN year = '1998' THEN 1 ELSE 0 END AS partial,
  round(CASE WHEN year <> '1998' AND b > 0 AND CAST(yb AS INT) = CAST(year AS INT) - 1 THEN CAST(c - b AS DOUBLE) / b END, 9) AS change FROM l""")
def trend_year_yoy(spark: SparkSession, sf: str) -> DataFrame:
    return trend.yearly_change(contracts(spark, sf, "signed_at", "amount_cents"), TODAY)


@register(", m AS (SELECT authority_id, subject, count(*) AS n FROM contracts WHERE trim(subject) <> '' GROUP BY authority_id, subject) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY authority_id ORDER BY n DESC, regexp_matches(subject, '\\p{Ll}') DESC, length(subject) DESC, subject) = 1")
def mode_name(spark: SparkSession, sf: str) -> DataFrame:
    return pick.mode_by(contracts(spark, sf, "authority_id", "subject"), ["authority_id"], "subject")


@register("SELECT count(*) FILTER (bids_received = 1) AS one, count(*) FILTER (bids_received = 2) AS two, count(*) FILTER (bids_received = 3) AS three, count(*) FILTER (bids_received >= 4) AS more, count(*) FILTER (bids_received IS NULL) AS unknown FROM contracts")
def bid_distribution(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bids_received")
    tests = {"one": b == 1, "two": b == 2, "three": b == 3, "more": b >= 4, "unknown": b.isNull()}
    return contracts(spark, sf, "bids_received").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@register("SELECT CAST(count(amount_cents) AS DOUBLE) / count(*) AS amount, CAST(count(bids_received) AS DOUBLE) / count(*) AS bids, CAST(count(eu_funded) AS DOUBLE) / count(*) AS eu FROM contracts")
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    known = lambda c: (F.count(c).cast("double") / F.count("*"))
    return contracts(spark, sf, "amount_cents", "bids_received", "eu_funded").agg(known("amount_cents").alias("amount"), known("bids_received").alias("bids"), known("eu_funded").alias("eu"))


_RATES = "SELECT l_returnflag AS code, CAST(CAST(l_shipdate AS DATE) AS STRING) AS rate_date, max(CAST(floor(l_tax * 100 + 0.5) AS INT)) AS rate FROM lineitem WHERE l_linenumber = 3 AND l_quantity = 7 GROUP BY 1, 2"
_DATED = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS code, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders"


def _rates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return spark.sql(_DATED.replace("FROM orders", "FROM {orders}"), orders=orders), spark.sql(_RATES.replace("lineitem", "{lines}"), lines=lines)


@register(f"WITH r AS ({_RATES}), o AS ({_DATED}) SELECT o.id, o.code, o.day, max_by(r.rate, r.rate_date) AS rate FROM o LEFT JOIN r ON r.code = o.code AND r.rate_date <= o.day AND CAST(o.day AS DATE) - CAST(r.rate_date AS DATE) <= 10 GROUP BY ALL")
def fx_asof(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _rates(spark, sf)
    return asof.asof_join(left, right, "code", "day", "rate_date", "rate", 10, "id")


@register(f"""WITH r AS ({_RATES}), o AS (SELECT DISTINCT code, day FROM ({_DATED})) SELECT code, count(*) AS missing, min(day) AS first_date, max(day) AS last_date FROM o
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.code = o.code AND r.rate_date <= o.day AND CAST(o.day AS DATE) - CAST(r.rate_date AS DATE) <= 10) GROUP BY code""")
def fx_coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _rates(spark, sf)
    return asof.coverage_gaps(left, right, "code", "day", "rate_date", 10)


@register("SELECT id, CASE WHEN CAST(signed_at AS DATE) > CAST(published_at AS DATE) + 2 THEN 'signed_after_publication' ELSE 'ok' END AS flag FROM contracts")
def date_flag(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf, "id", "signed_at", "published_at").select("id", values.date_flag(F.col("signed_at"), F.col("published_at")).alias("flag"))


@register(""", x AS (SELECT id, amount_cents AS c, signing_cents AS s, own_cents AS o, procedure_cents AS p, coalesce(amount_cents, signing_cents) AS e FROM contracts)
  SELECT id, CASE WHEN e > 200000000000 OR (p >= 100000 AND (e > 200 * p OR (e >= 95 * p AND e <= 105 * p))) OR (o >= 100000 AND p >= 100000 AND e >= 10 * p AND e >= 95 * o AND e <= 105 * o) THEN 'value_suspect'
  WHEN coalesce(c, s) <= 0 THEN 'value_low' WHEN p > 0 AND s < 100000 AND s * 100 < 5 * p THEN 'value_low' WHEN c < 0 OR (s > 0 AND c >= 100 * s) THEN 'annex_suspect' WHEN p > 0 AND e >= 10 * p THEN 'review' ELSE 'ok' END AS flag FROM x""")
def value_flag_ladder(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "id", "amount_cents", "signing_cents", "own_cents", "procedure_cents")
    no = F.lit(False)
    flag = values.value_flag(F.coalesce("amount_cents", "signing_cents"), F.col("signing_cents"), F.col("amount_cents"), F.col("own_cents"), F.col("procedure_cents"), no, no, unit=100)
    return c.select("id", flag.alias("flag"))


_CODES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey * 7919 AS STRING), 9, '1') ELSE lpad(CAST(c_custkey AS STRING), 13, '2') END AS code, c_name AS name FROM customer"


def _digit_sql(first: int, weights: tuple[tuple[int, ...], ...]) -> str:
    one, two = ("(" + " + ".join(f"CAST(substr(code, {first + i}, 1) AS INT) * {w}" for i, w in enumerate(ws)) + ") % 11" for ws in weights)
    return f"(CASE WHEN {one} < 10 THEN {one} WHEN {two} < 10 THEN {two} ELSE 0 END)"


_NINE = f"{_digit_sql(1, identity.WEIGHTS_9)} = CAST(substr(code, 9, 1) AS INT)"
_VALID_SQL = f"CASE WHEN length(code) = 9 AND {_NINE} THEN 1 WHEN length(code) = 13 AND {_NINE} AND {_digit_sql(9, identity.WEIGHTS_13)} = CAST(substr(code, 13, 1) AS INT) THEN 1 ELSE 0 END"


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_CODES.replace("customer", "{c}"), c=table(spark, sf, "customer"))


@register(f"WITH c AS ({_CODES}) SELECT id, code, {_VALID_SQL} AS valid FROM c")
def eik_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf).select("id", "code", identity.eik_valid(F.col("code")).alias("valid"))


@register(f"WITH c AS ({_CODES}) SELECT id, CASE WHEN {_VALID_SQL} = 1 THEN 'eik:' || code ELSE 'name:' || upper(trim(name)) END AS key FROM c")
def identity_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf).select("id", identity.identity_key(F.col("code"), F.col("name")).alias("key"))


_LISTS = "SELECT o_orderkey AS id, concat_ws(';', CAST(o_custkey AS STRING), '', CAST(o_orderkey % 7 AS STRING)) AS codes, concat_ws(';', o_orderstatus, 'x', o_orderpriority) AS names FROM orders"


@register(f"WITH l AS ({_LISTS}) SELECT id, CAST(i - 1 AS INT) AS ordinal, trim(string_split(codes, ';')[i]) AS code, nullif(trim(string_split(names, ';')[i]), '') AS name FROM (SELECT *, unnest([1, 2, 3]) AS i FROM l) WHERE trim(string_split(codes, ';')[i]) <> ''")
def split_zip_members(spark: SparkSession, sf: str) -> DataFrame:
    return joint.split_members(spark.sql(_LISTS.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders")), "id", "codes", "names")


_ANNEXES = "SELECT user_id, event_type, event_id AS key, CAST(ts AS STRING) AS published_at, CASE WHEN value < 3 THEN NULL ELSE CAST(floor(value * 100 + 0.5) AS BIGINT) END AS value_after FROM events"


@register(f"""WITH a AS ({_ANNEXES.replace("CAST(ts AS STRING)", "ts")}) SELECT user_id, event_type, count(*) AS annexes, max_by(value_after, (published_at, key)) FILTER (value_after IS NOT NULL) AS current_value FROM a GROUP BY ALL""")
def latest_amendment(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.sql(_ANNEXES.replace("events", "{e}").replace("CAST(ts AS STRING)", "ts"), e=table(spark, sf, "events"))
    return amendments.latest_values(a, ["user_id", "event_type"])


@register("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def unique_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return amendments.unique_bridge(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")


@register("SELECT id, tender_id, currency FROM contracts c WHERE currency = 'EUR' OR NOT EXISTS (SELECT 1 FROM contracts p WHERE p.currency = 'EUR' AND p.tender_id = c.tender_id)")
def prefer_primary_feed(spark: SparkSession, sf: str) -> DataFrame:
    return amendments.prefer_primary(contracts(spark, sf, "id", "tender_id", "currency"), ["tender_id"], "currency", "EUR")


_SPANS = "SELECT user_id AS bidder_id, min(2022 - user_id % 30) AS first_year, max(2024 - user_id % 28) AS last_year FROM events GROUP BY user_id"


@register(f", s AS ({_SPANS}) SELECT id, c.bidder_id FROM contracts c JOIN s USING (bidder_id) WHERE CAST(substr(signed_at, 1, 4) AS INT) BETWEEN first_year AND last_year")
def interval_links(spark: SparkSession, sf: str) -> DataFrame:
    spans = spark.sql(_SPANS.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    c = contracts(spark, sf, "id", "bidder_id", "signed_at").withColumn("year", F.substring("signed_at", 1, 4).cast("int"))
    return interests.in_window(spans, c, "bidder_id").select("id", "bidder_id")


@register("SELECT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def union_distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return a.unionByName(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))).distinct()


@register("SELECT s_suppkey AS key, 'left only' AS side FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT s_suppkey, 'right only' FROM supplier WHERE s_nationkey > 20")
def parity_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    return quality.parity(s.where("s_nationkey <= 20"), s.where("s_nationkey >= 5"), volatile=("s_nationkey",))


@register("SELECT p_partkey AS ref, CAST(len(list_filter(string_split(lower(p_name), ' '), lambda t: starts_with(t, 'sm') OR starts_with(t, 'ri'))) AS BIGINT) AS hits FROM part WHERE regexp_matches(lower(p_name), '(^| )sm') AND regexp_matches(lower(p_name), '(^| )ri')")
def search_prefix_and(spark: SparkSession, sf: str) -> DataFrame:
    return search.match(search.inverted_index(table(spark, sf, "part"), "p_partkey", "p_name"), "Sm, ri!")


@register("SELECT p_partkey AS id, concat_ws(',', CAST(p_partkey AS STRING), CASE WHEN regexp_matches(v, '[\",\\r\\n]') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END) AS line FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '''=' || p_name WHEN 1 THEN 'a,\"' || p_name ELSE p_name END AS v FROM part)")
def csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN '=' || p_name WHEN 1 THEN 'a,\"' || p_name ELSE p_name END AS v")
    return p.select("id", F.concat_ws(",", coerce.csv_cell(F.col("id")), coerce.csv_cell(F.col("v"))).alias("line"))


@register("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000.0) AS BIGINT) AS shard FROM orders")
def sitemap_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.sitemap_shards(table(spark, sf, "orders"), "o_orderkey", 1000)


@register("""SELECT 'amounts known' AS "check", count(*) FILTER (amount_cents IS NULL) AS violations, CASE WHEN count(*) FILTER (amount_cents IS NULL) = 0 THEN 'pass' ELSE 'fail' END AS result FROM contracts
  UNION ALL SELECT 'dates shaped', count(*) FILTER (NOT regexp_matches(signed_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')), CASE WHEN count(*) FILTER (NOT regexp_matches(signed_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) = 0 THEN 'pass' ELSE 'fail' END FROM contracts
  UNION ALL SELECT 'sectors add up', 0, 'pass'""")
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf, "division", "signed_at", "amount_cents")
    base = c.where("amount_cents is not null")
    per = base.groupBy("division").agg(F.sum("amount_cents").alias("cents"))
    return quality.report([
        quality.check(c, "amounts known", "amount_cents is null"), quality.check(c, "dates shaped", "not signed_at rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"),
        quality.reconciled("sectors add up", per, base.withColumn("cents", F.col("amount_cents"))),
    ])


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_EVENT_AGG = "count(*) AS n, CAST(CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100 AS value"


@register(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, {_EVENT_AGG} FROM events GROUP BY ALL")
def tumbling_events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(table(spark, sf, "events"), "1 hour")


@register(f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, {_EVENT_AGG} FROM (SELECT *, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def sliding_events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding(table(spark, sf, "events"), "1 hour", "30 minutes")


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events"), "2 hours")


@register("""WITH r AS (SELECT n_regionkey, n_nationkey, sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
  SELECT r_regionkey, coalesce(CAST(sum(v) AS DOUBLE) / 100, 0) AS value_eur, count(v) AS nations FROM region LEFT JOIN r ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def regional_rollup(spark: SparkSession, sf: str) -> DataFrame:
    spend = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(F.expr("CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)")).alias("v"))
    nations = table(spark, sf, "nation").join(spend, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    whole = table(spark, sf, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return whole.groupBy("r_regionkey").agg((F.coalesce(F.sum("v").cast("double") / 100, F.lit(0.0))).alias("value_eur"), F.count("v").alias("nations"))


@register(""", s AS (SELECT division, sum(amount_cents) AS v FROM contracts WHERE amount_cents IS NOT NULL GROUP BY division), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, division) AS r FROM s)
  SELECT CASE WHEN r <= 3 THEN division ELSE 'other' END AS sector, CAST(sum(v) AS DOUBLE) / 100 AS value_eur FROM k GROUP BY 1""")
def sector_top_tail(spark: SparkSession, sf: str) -> DataFrame:
    sums = contracts(spark, sf, "division", "amount_cents").where("amount_cents is not null").groupBy("division").agg(F.sum("amount_cents").alias("v"))
    ranked = sums.withColumn("r", F.row_number().over(Window.orderBy(F.desc("v"), "division")))  # one row a division
    return ranked.groupBy(F.when(F.col("r") <= 3, F.col("division")).otherwise("other").alias("sector")).agg(rollups.cents(F.sum("v")).alias("value_eur"))


from outlay.plans import completed, derived, exports, finding, listed, meaning, people, refresh, streams, typed  # noqa: E402, F401  they register theirs

__all__ = ["ORACLES", "QUERIES"]
