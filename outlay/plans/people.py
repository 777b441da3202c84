"""Queries on annex texts, links by value, joint leads, people's names and declared companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions import annex_text
from outlay.operators import amendments, declared, derive, holders, joint, resolve
from outlay.plans.crosswalk import table
from outlay.plans.derived import _HEADERS, _N, _notices
from outlay.plans.registry import register

# -- annex texts: line items as annexes, their amounts written in four ways --------------------------------------

_BASE = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
_SAYS = {
    1: ("Общата стойност на договора ще възлезе на ", " лв. без ДДС"), 2: ("Увеличава се ресурсът с ", " евро без ДДС"),
    3: ("Срокът се удължава на ", " календарни дни, стойността остава 100 лв."), 4: ("до изчерпване на ресурс в размер на ", " лв."),
    5: ("Несъществени промени, приложение ", ""), 6: ("Цената се променя от 17 лв. на ", " лева"),
}


def _written(cents: F.Column) -> F.Column:
    """1 234.56, the same with a hard space, 1.234,56 or 1,234.56."""
    us = F.format_number(cents.cast("double") / 100, 2)
    way = F.col("l_partkey") % 4
    return F.when(way == 0, F.translate(us, ",", " ")).when(way == 1, F.translate(us, ",", "\u00a0")).when(way == 2, F.translate(us, ",.", ".,")).otherwise(us)


@register(f"""WITH a AS (SELECT l_orderkey, l_linenumber, {_BASE} AS b, CAST(l_quantity AS INT) % 3 AS m FROM lineitem),
  d AS (SELECT *, CASE m WHEN 0 THEN 2 * b + 12300 WHEN 1 THEN b END AS d FROM a)
  SELECT label, count(*) AS annexes, CAST(sum(CASE label WHEN 'total_restated' THEN d WHEN 'unchanged_restated' THEN b END) AS BIGINT) AS restated_cents
  FROM (SELECT *, CASE WHEN m = 2 THEN NULL WHEN l_linenumber IN (1, 6) THEN 'total_restated' WHEN l_linenumber = 2 THEN 'genuine_increment' WHEN l_linenumber = 5 AND m = 1 AND l_orderkey % 2 = 0 THEN 'unchanged_restated' END AS label FROM d) GROUP BY label""")
def annex_treatments(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.expr(_BASE)
    diff = F.when(F.col("l_quantity").cast("int") % 3 == 0, 2 * cents + 12300).when(F.col("l_quantity").cast("int") % 3 == 1, cents).otherwise(F.floor(cents / 2)).cast("long")
    said = F.lit(None).cast("string")
    for k, (before, behind) in _SAYS.items():
        said = F.when(F.col("l_linenumber") == k, F.concat(F.lit(before), _written(F.col("d")), F.lit(behind))).otherwise(said)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents.alias("b"), diff.alias("d"))
    euros = lines.select(said.alias("text"), (F.col("l_orderkey") % 2 == 1).alias("outside"), (F.col("b") / 100).alias("value_before"), ((F.col("b") + F.col("d")) / 100).alias("value_after"), (F.col("d") / 100).alias("value_delta"))
    labelled = annex_text.with_treatment(euros, ["text"], "outside")
    return labelled.groupBy(F.col("treatment").alias("label")).agg(F.count("*").alias("annexes"), F.sum(F.round(F.col("value_restated") * 100).cast("long")).alias("restated_cents"))


# -- links by value: an order's lines as contracts, its annexes start from some of their values ------------------

_VALUE_C = "SELECT CAST(l_orderkey % 500 AS STRING) AS unp, 'BGN' AS currency, CAST(l_partkey AS STRING) AS number, floor(l_extendedprice / 50) AS signing, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_suppkey % 7 AS STRING) END AS supplier FROM lineitem"
_VALUE_A = "SELECT concat_ws(':', CAST(o_orderkey AS STRING), o_orderpriority) AS key, CAST(o_orderkey % 500 AS STRING) AS unp, 'BGN' AS currency, CAST(o_custkey % 3 AS STRING) AS raw_number, floor(o_totalprice / 250) AS value_before, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS STRING) END AS supplier FROM orders"


@register(f"""WITH c AS ({_VALUE_C}), a AS ({_VALUE_A}),
  f AS (SELECT DISTINCT a.key, a.unp, a.raw_number, c.number FROM a JOIN c ON a.unp = c.unp AND a.currency = c.currency AND c.signing = a.value_before WHERE a.supplier IS NULL OR c.supplier IS NULL OR a.supplier = c.supplier),
  d AS (SELECT key, unp, raw_number, min(number) AS number FROM f GROUP BY ALL HAVING count(*) = 1),
  g AS (SELECT unp, raw_number, min(number) AS number FROM d GROUP BY ALL HAVING count(DISTINCT number) = 1)
  SELECT key, number, 'value' AS method FROM d UNION ALL SELECT a.key, g.number, 'group' FROM a JOIN g USING (unp, raw_number) WHERE a.key NOT IN (SELECT key FROM f)""")
def annexes_by_value(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.sql(_VALUE_C.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))
    a = spark.sql(_VALUE_A.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    return amendments.resolve_by_value(a, c)


# -- joint leads ------------------------------------------------------------------------------------------------

_JOINT_SQL = f"""{_N}, h AS ({_HEADERS}), k AS (SELECT unp, authority_eik AS codes, coalesce(authority_name, '') AS names FROM (SELECT unp, authority_eik, authority_name, authority_type, count(*) AS c FROM n WHERE authority_eik LIKE '%;%' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY unp ORDER BY c DESC, regexp_matches(coalesce(authority_name, ''), '\\p{{Ll}}') DESC, length(coalesce(authority_name, '')) DESC, authority_eik, coalesce(authority_name, ''), coalesce(authority_type, '')) = 1),
  m AS (SELECT unp, i - 1 AS ordinal, trim(string_split(codes, ';')[i]) AS code FROM (SELECT *, unnest(range(1, len(string_split(codes, ';')) + 1)) AS i FROM k)),
  mm AS (SELECT * FROM m WHERE code <> ''), u AS (SELECT prefix, authority_eik AS usual FROM (SELECT split_part(unp, '-', 1) AS prefix, authority_eik, count(*) AS c FROM n WHERE authority_eik NOT LIKE '%;%' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY c DESC, authority_eik) = 1),
  lead AS (SELECT unp, code AS lead FROM mm LEFT JOIN u ON prefix = split_part(unp, '-', 1) QUALIFY row_number() OVER (PARTITION BY unp ORDER BY coalesce(code = usual, false) DESC, ordinal, code) = 1)"""


def _members(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notices, members of joint procedures, their leads)."""
    n = _notices(spark, sf)
    members = joint.split_members(derive.joint_sources(n), "unp", "authority_eik", "authority_name")
    prefix = F.split_part("unp", F.lit("-"), F.lit(1)).alias("prefix")
    single = n.where("unp is not null and authority_eik is not null and not contains(authority_eik, ';')").groupBy(prefix, "authority_eik").count()
    usual = single.groupBy("prefix").agg(F.min_by("authority_eik", F.struct(-F.col("count"), "authority_eik")).alias("usual"))
    keyed = members.select("unp", prefix).distinct().join(usual, "prefix").select("unp", "usual")
    return n, members, joint.leads(members, "unp", keyed)


@register(f"""{_JOINT_SQL} SELECT unp, code, CAST(row_number() OVER (PARTITION BY unp ORDER BY code = lead DESC, ordinal, code) - 1 AS INT) AS place FROM (SELECT unp, code, min(ordinal) AS ordinal FROM mm GROUP BY ALL) JOIN lead USING (unp)""")
def joint_bridge(spark: SparkSession, sf: str) -> DataFrame:
    _, members, leads = _members(spark, sf)
    return joint.bridge(members, leads, "unp")


@register(f"""{_JOINT_SQL}, hh AS (SELECT *, row_number() OVER (PARTITION BY unp ORDER BY authority_eik NULLS LAST, subject NULLS LAST, procedure_type NULLS LAST, currency NULLS LAST, estimate NULLS LAST) AS r FROM (SELECT * FROM h UNION ALL SELECT unp, procedure_type, NULL, estimate + 1, 'EUR', authority_eik FROM h WHERE estimate % 4 = 0)),
  t AS (SELECT unp, coalesce(subject, '(без предмет)') AS title, authority_eik, estimate, coalesce(currency, 'BGN') AS currency, CASE WHEN unp IN (SELECT unp FROM n WHERE unp IS NOT NULL) THEN 'awarded' ELSE 'published' END AS status FROM hh WHERE r = 1
  UNION ALL SELECT unp, coalesce(min(subject), '(без предмет)'), min(authority_eik), min(estimate), coalesce(min(currency), 'BGN'), 'awarded' FROM n WHERE unp NOT IN (SELECT unp FROM h) GROUP BY unp),
  e AS (SELECT DISTINCT authority_eik FROM n WHERE authority_eik NOT LIKE '%;%')
  SELECT * FROM (SELECT unp, title, coalesce(lead, authority_eik) AS authority_eik, estimate, currency, status FROM t LEFT JOIN lead USING (unp)) WHERE authority_eik IN (SELECT authority_eik FROM e)""")
def tenders_with_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Procedures with repeated headers, joint leads, and only authorities that exist."""
    n, _, leads = _members(spark, sf)
    headers = spark.sql(_HEADERS.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    again = headers.where("estimate % 4 = 0").select("unp", "procedure_type", F.lit(None).cast("string").alias("subject"), (F.col("estimate") + 1).alias("estimate"), F.lit("EUR").alias("currency"), "authority_eik")
    there = n.where("not contains(authority_eik, ';')").select("authority_eik")
    return derive.tenders(headers.unionByName(again), n, leads, there).drop("procedure_type")


# -- names ------------------------------------------------------------------------------------------------------

#: A first, middle and last name from a number.
_FIRST, _MIDDLE, _LAST = ["Иван", "Мария", "Георги", "Елена", "Никола"], ["Петров", "Иванов", "Димов"], ["Георгиев", "Стоянов", "Колев", "Ангелов", "Тодоров", "Минчев", "Райков"]
_PICK = lambda names, k: f"CASE {k} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
_PERSON = lambda k: f"concat_ws(' ', {_PICK(_FIRST, k)}, {_PICK(_MIDDLE, k)}, {_PICK(_LAST, k)})"
#: How a holder's cell is written, by o_custkey % 8, and what that makes of it.
_HOLDER = f"""CASE o_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat_ws(' ', {_PICK(_LAST, 'o_orderkey')}, {_PICK(_FIRST, 'o_orderkey')}, {_PICK(_MIDDLE, 'o_orderkey')}) WHEN 2 THEN concat(substr({_PICK(_FIRST, 'o_orderkey')}, 1, 1), '. ', upper({_PICK(_LAST, 'o_orderkey')}))
  WHEN 3 THEN {_PICK(_LAST, 'o_orderkey')} WHEN 4 THEN concat_ws(' ', {_PICK(_FIRST, 'o_orderkey')}, 'Чужд') WHEN 5 THEN 'Петра Друга' WHEN 6 THEN ' - ' ELSE concat_ws(' ', {_PICK(_FIRST, 'o_orderkey')}, {_PICK(_FIRST, 'o_orderkey')}, 'Ю.') END"""
_RELATION = {0: "self", 1: "self", 2: "self", 3: "unknown", 4: "unknown", 5: "related", 6: "unknown", 7: "unknown"}


@register("SELECT relation, count(*) AS n FROM (SELECT CASE o_custkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _RELATION.items()) + " END AS relation FROM orders) GROUP BY relation")
def holder_relations(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "orders").select(F.expr(_HOLDER).alias("holder"), F.expr(_PERSON("o_orderkey")).alias("declarant"))
    return cells.groupBy(holders.relation(F.col("holder"), F.col("declarant")).alias("relation")).agg(F.count("*").alias("n"))


_ENTRIES = f"SELECT o_orderkey AS entry, concat({_PERSON('o_orderkey')}, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat(', управител: ', {_PICK(_FIRST, 'o_custkey')}, ' ', {_PICK(_LAST, 'o_custkey')}) END) AS name FROM orders"
_PEOPLE = f"SELECT c_custkey AS person, CASE WHEN c_custkey % 10 = 0 THEN 'Г. И.' WHEN c_custkey % 11 = 0 THEN concat({_PERSON('c_custkey')}, ' Необичаен') WHEN c_custkey % 2 = 0 THEN {_PERSON('c_custkey')} ELSE concat_ws(' ', {_PICK(_LAST, 'c_custkey')}, {_PICK(_FIRST, '(c_custkey + 1)')}) END AS name FROM customer"
_WORDS = r"list_distinct(list_filter(string_split_regex(upper(name), '[^\p{L}]+'), lambda t: length(t) >= 2))"


@register(f"""WITH e AS (SELECT entry, {_WORDS} AS w FROM ({_ENTRIES})), p AS (SELECT person, {_WORDS} AS w FROM ({_PEOPLE})),
  pw AS (SELECT DISTINCT w FROM p WHERE len(w) > 0), ew AS (SELECT w, count(*) AS n, min(entry) AS least FROM e GROUP BY w), f AS (SELECT pw.w, sum(n) AS entries, min(least) AS least FROM pw JOIN ew ON list_has_all(ew.w, pw.w) GROUP BY pw.w)
  SELECT person, CAST(entries AS BIGINT) AS entries, least FROM p JOIN f USING (w)""")
def whole_names(spark: SparkSession, sf: str) -> DataFrame:
    entries = spark.sql(_ENTRIES.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    people = spark.sql(_PEOPLE.replace("FROM customer", "FROM {c}"), c=table(spark, sf, "customer"))
    return holders.whole_names(people, entries, "person", "entry", "name")


# -- declared companies -----------------------------------------------------------------------------------------

_WINNERS = """SELECT CASE WHEN s_suppkey % 10 = 3 THEN '„ОБЩА ВОДА“ АД' ELSE concat('„Фирма ', CAST(s_suppkey AS STRING), '" ООД') END AS name, lpad(CAST(s_suppkey AS STRING), 9, '0') AS eik, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 1 END AS valid FROM supplier"""
#: What officials wrote of supplier k = l_suppkey, by l_partkey % 8.
_DECLARED = """SELECT l_orderkey, CASE l_partkey % 8 WHEN 0 THEN concat('ФИРМА ', CAST(l_suppkey AS STRING), ' ООД') WHEN 1 THEN concat('дялове в „Фирма ', CAST(l_suppkey AS STRING), '" ООД, ЕИК ', lpad(CAST(l_suppkey AS STRING), 9, '0'))
  WHEN 2 THEN concat('2 дяла; „фирма ', CAST(l_suppkey AS STRING), '" ООД, прехвърлени') WHEN 3 THEN 'Обща вода АД' WHEN 4 THEN concat('друго, ', lpad(CAST(l_suppkey AS STRING), 9, '0')) WHEN 5 THEN concat('ЕИК 1', lpad(CAST(l_suppkey AS STRING), 9, '0'), ' няма') WHEN 6 THEN ' ' END AS entity, l_suppkey, l_partkey FROM lineitem"""


@register(f"""WITH d AS ({_DECLARED}), w AS ({_WINNERS}), x AS (SELECT *, l_partkey % 8 AS k, l_suppkey % 10 = 3 AS shared, l_suppkey % 17 = 0 AS bad, lpad(CAST(l_suppkey AS STRING), 9, '0') AS own,
  (SELECT count(*) FROM w WHERE name LIKE '„ОБЩА%' AND valid = 1) AS shared_n, (SELECT min(eik) FROM w WHERE name LIKE '„ОБЩА%' AND valid = 1) AS shared_eik FROM d)
  SELECT method, count(*) AS n, count(DISTINCT eik) AS companies FROM (SELECT CASE WHEN k = 0 AND NOT shared AND NOT bad THEN 'exact_name_key' WHEN k = 3 AND shared_n = 1 THEN 'exact_name_key' WHEN k = 3 AND shared_n > 1 THEN 'ambiguous' WHEN k = 1 AND NOT shared AND NOT bad THEN 'declared_eik' WHEN k = 2 AND NOT shared AND NOT bad THEN 'extracted_name' END AS method,
  CASE WHEN k IN (0, 1, 2) AND NOT shared AND NOT bad THEN own WHEN k = 3 AND shared_n = 1 THEN shared_eik END AS eik FROM x) GROUP BY method""")
def resolved_companies(spark: SparkSession, sf: str) -> DataFrame:
    declared = spark.sql(_DECLARED.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf, "lineitem"))
    winners = spark.sql(_WINNERS.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier"))
    found = resolve.resolve(declared, winners, "entity")
    return found.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("eik").alias("companies"))


@register(f"""WITH w AS ({_WINNERS}) SELECT 'ОБЩА ВОДА АД' AS key, count(*) AS companies, min(eik) AS "first", max(eik) AS "last" FROM w WHERE name LIKE '„ОБЩА%' AND valid = 1 HAVING count(*) > 1""")
def ambiguous_names(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.ambiguous_keys(spark.sql(_WINNERS.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier")))


# -- declared stakes --------------------------------------------------------------------------------------------

_HOLDINGS = """SELECT o_custkey % 60 AS person, l_suppkey % 25 AS company, CASE WHEN l_linenumber = 2 THEN 'family' ELSE 'self' END AS scope, o_orderpriority AS kind, l_linestatus = 'F' AS owns, l_returnflag AS template, o_orderstatus AS institution,
  l_linenumber % 3 AS method_rank, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(extract(YEAR FROM l_shipdate) AS INT) - CASE WHEN l_partkey % 7 = 0 THEN 3 ELSE 0 END END AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 4 = 1"""
_FILINGS = "SELECT o_custkey % 60 AS person, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS template, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(extract(YEAR FROM o_orderdate) AS INT) END AS year, CASE WHEN o_orderkey % 2 = 0 THEN 2000 END AS folder_year FROM orders"


def _holdings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_HOLDINGS.replace("FROM lineitem JOIN orders", "FROM {l} JOIN {o}"), l=table(spark, sf, "lineitem"), o=table(spark, sf, "orders"))


_SET = lambda c: f"coalesce(string_agg(DISTINCT {c}, ',' ORDER BY {c}), '')"


@register(f"""WITH h AS ({_HOLDINGS}) SELECT person, company, scope, {_SET('kind')} AS kinds, {_SET('template')} AS templates, {_SET('institution')} AS institutions, bool_or(owns) AS owns, max(method_rank) AS method_rank,
  min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years, max(CASE WHEN owns THEN year END) AS last_owned FROM h GROUP BY ALL""")
def declared_links(spark: SparkSession, sf: str) -> DataFrame:
    return declared.links(_holdings(spark, sf))


@register(f"""WITH h AS ({_HOLDINGS}), y AS (SELECT DISTINCT person, company, scope, year FROM h WHERE year IS NOT NULL), g AS (SELECT *, year - row_number() OVER (PARTITION BY person, company, scope ORDER BY year) AS island FROM y),
  s AS (SELECT person, company, scope, min(year) AS first_year, max(year) AS last_year FROM g GROUP BY person, company, scope, island) SELECT person, company, scope, CAST(row_number() OVER (PARTITION BY person, company, scope ORDER BY first_year) AS INT) AS spell, first_year, last_year FROM s""")
def declared_spells(spark: SparkSession, sf: str) -> DataFrame:
    return declared.spells(_holdings(spark, sf))


@register(f"""WITH h AS ({_HOLDINGS}), f AS ({_FILINGS}), z AS (SELECT person, coalesce(template, '') AS template, max(coalesce(year, folder_year)) AS horizon FROM f WHERE coalesce(year, folder_year) IS NOT NULL GROUP BY ALL),
  l AS (SELECT person, company, scope, max(year) AS last_owned FROM h WHERE owns AND year IS NOT NULL GROUP BY ALL),
  u AS (SELECT DISTINCT person, company, scope, template FROM h WHERE template <> ''), b AS (SELECT u.person, company, scope, max(horizon) AS horizon FROM u JOIN z ON z.person = u.person AND z.template = u.template GROUP BY ALL)
  SELECT person, company, scope, last_owned, horizon FROM l JOIN b USING (person, company, scope) WHERE horizon > last_owned""")
def divested_links(spark: SparkSession, sf: str) -> DataFrame:
    return declared.divested(_holdings(spark, sf), spark.sql(_FILINGS.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders")))
