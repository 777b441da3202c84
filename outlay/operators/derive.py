"""Staging rows -> authorities, tenders, lots, bidders, contracts.

Staging: notices(unp, authority_eik, authority_name, authority_type, ...). A blank or null key names
nobody; joint lists ("a; b") never become an authority of their own. Every choice among several has a
total order, so results don't depend on the order of rows; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.identity import eik_clean, eik_valid, key_of
from outlay.operators.pick import latest_by, mode_by, name_order

#: What a name holds and the type bucket it means, first match wins; "^": at its start.
TYPE_LADDER = [
    ("община", ["^община", "столична община"]),
    ("министерство", ["^министерство"]),
    ("болница", ["болница", "мбал", "сбал", "дкц", "лечебно заведение"]),
    ("образование", ["университет", "училище", "гимназия", "детска градина", "академия"]),
    ("агенция", ["агенция"]),
]
STATE_COMPANY, OTHER = "държавна компания", "друго"
#: Kinds of authority that make a state company, by the start of the type's text.
STATE_TYPES = ["Публично предприятие", "Комунални услуги"]
#: Words of a consortium's name.
CONSORTIUM = ["ДЗЗД", "ОБЕДИНЕНИЕ", "КОНСОРЦИУМ"]
NO_SUBJECT, NO_PROCEDURE, CURRENCY = "(без предмет)", "неизвестна", "BGN"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def single(eik: Column) -> Column:
    return eik.isNotNull() & ~F.contains(eik, F.lit(";"))


def canonical_authorities(notices: DataFrame) -> DataFrame:
    """eik -> name (the most frequent one), type (the most frequent one beside that name); the eik where no name is known."""
    base = notices.where(single(F.col("authority_eik"))).select("authority_eik", "authority_name", "authority_type")
    names = mode_by(base, ["authority_eik"], "authority_name").select("authority_eik", F.col("authority_name").alias("name"))
    typed = base.join(names, "authority_eik").where("authority_name = name and trim(authority_type) <> ''").groupBy("authority_eik", "authority_type").count()
    types = latest_by(typed, ["authority_eik"], [F.desc("count"), F.asc("authority_type")]).select("authority_eik", F.col("authority_type").alias("type"))
    return base.select("authority_eik").distinct().join(names, "authority_eik", "left").join(types, "authority_eik", "left").select(F.col("authority_eik").alias("eik"), F.coalesce("name", "authority_eik").alias("name"), "type")


def type_group(name: Column, state_typed: Column) -> Column:
    low = F.lower(name)
    out = None
    for bucket, words in TYPE_LADDER:
        test = _any([low.startswith(w[1:]) if w[0] == "^" else F.contains(low, F.lit(w)) for w in words])
        out = F.when(test, bucket) if out is None else out.when(test, bucket)
    return out.when(state_typed, STATE_COMPANY).otherwise(OTHER)


def grouped_authorities(notices: DataFrame) -> DataFrame:
    """Canonical authorities with their type bucket: by name, else by any type that a notice gave them."""
    state = F.bool_or(F.coalesce(_any([F.col("authority_type").startswith(t) for t in STATE_TYPES]), F.lit(False)))
    typed = notices.where(single(F.col("authority_eik"))).groupBy(F.col("authority_eik").alias("eik")).agg(state.alias("state"))
    return canonical_authorities(notices).join(typed, "eik").withColumn("type_group", type_group(F.col("name"), F.col("state"))).drop("state")


def prefix_authorities(notices: DataFrame) -> DataFrame:
    """The first five digits of a procedure's number -> the authority that most often stands beside it."""
    seen = notices.where(single(F.col("authority_eik")) & F.col("unp").rlike("^[0-9]{5}-")).groupBy(F.substring("unp", 1, 5).alias("prefix"), "authority_eik").count()
    return latest_by(seen, ["prefix"], [F.desc("count"), F.asc("authority_eik")]).select("prefix", "authority_eik")


def joint_sources(notices: DataFrame) -> DataFrame:
    """The most frequent joint list of each procedure; ties: with lower-case letters, longer name, then smaller texts."""
    seen = notices.where(F.col("unp").isNotNull() & F.contains("authority_eik", F.lit(";"))).groupBy("unp", "authority_eik", "authority_name", "authority_type").count()
    blank = lambda c: F.coalesce(c, F.lit(""))
    order = [F.desc("count"), F.desc(blank("authority_name").rlike(r"\p{Ll}")), F.desc(F.length(blank("authority_name"))), F.asc("authority_eik"), F.asc(blank("authority_name")), F.asc(blank("authority_type"))]
    return latest_by(seen, ["unp"], order).drop("count")


def tenders(headers: DataFrame, awards: DataFrame, leads: DataFrame | None = None, authorities: DataFrame | None = None) -> DataFrame:
    """One row a procedure: from its header notice, else folded from its awards.

    headers(unp, subject, procedure_type, estimate, currency, authority_eik); awards(unp, subject,
    estimate, currency, authority_eik). A procedure with awards is 'awarded'. Of several headers of one procedure the
    one with the least authority, subject, type, currency and estimate (in that order, nulls last) counts;
    headers and awards without a procedure number are none. leads(unp, lead), if given, says which authority leads a
    joint procedure and stands in place of its own; authorities(authority_eik), if given, are those that exist:
    other procedures get no row.
    """
    headers = latest_by(headers.where("unp is not null"), ["unp"], [F.asc_nulls_last(c) for c in ("authority_eik", "subject", "procedure_type", "currency", "estimate")])
    known = headers.select("unp").distinct()
    awarded = awards.where("unp is not null").select("unp").distinct().withColumn("won", F.lit(True))
    real = headers.join(awarded, "unp", "left").select(
        "unp", F.coalesce("subject", F.lit(NO_SUBJECT)).alias("title"), F.col("authority_eik"), "estimate", F.coalesce("currency", F.lit(CURRENCY)).alias("currency"),
        F.coalesce("procedure_type", F.lit(NO_PROCEDURE)).alias("procedure_type"), F.when(F.col("won"), "awarded").otherwise("published").alias("status"),
    )
    rest = awards.where("unp is not null").join(known, "unp", "left_anti").groupBy("unp").agg(
        F.coalesce(F.min("subject"), F.lit(NO_SUBJECT)).alias("title"), F.min("authority_eik").alias("authority_eik"), F.min("estimate").alias("estimate"), F.coalesce(F.min("currency"), F.lit(CURRENCY)).alias("currency"),
        F.lit(NO_PROCEDURE).alias("procedure_type"), F.lit("awarded").alias("status"),
    )
    out = real.unionByName(rest)
    if leads is not None:
        led = leads.where("unp is not null").groupBy("unp").agg(F.min("lead").alias("_lead"))
        out = out.join(led, "unp", "left").withColumn("authority_eik", F.coalesce("_lead", "authority_eik")).drop("_lead")
    return out if authorities is None else out.join(authorities.select("authority_eik").distinct(), "authority_eik", "left_semi").select(*real.columns)


def lot_number(lot: Column) -> Column:
    """LOT-0007 and 0007 -> 7; other text as it is."""
    digits = F.regexp_extract(lot, r"^(?:LOT-)?([0-9]+)$", 1)
    return F.when(digits != "", F.coalesce(digits.try_cast("bigint").cast("string"), lot)).otherwise(lot)


def identified(awards: DataFrame) -> DataFrame:
    """awards(contractor_eik, contractor_name) -> each distinct pair once: n, eik (if valid), valid, key."""
    pairs = awards.groupBy("contractor_eik", "contractor_name").agg(F.count("*").alias("n")).withColumn("code", eik_clean(F.col("contractor_eik")))
    checked = pairs.withColumn("valid", eik_valid(F.col("code")))
    return checked.select("contractor_eik", "contractor_name", "n", "valid", F.when(F.col("valid") == 1, F.col("code")).alias("eik"), key_of(F.col("valid"), F.col("code"), F.col("contractor_name")).alias("key"))


def bidders(awards: DataFrame) -> DataFrame:
    """awards(contractor_eik, contractor_name) -> one row an identity: name, eik, validity, kind."""
    named = identified(awards)
    joint = F.contains("contractor_name", F.lit(";")) | _any([F.contains(F.upper("contractor_name"), F.lit(w)) for w in CONSORTIUM])
    per = named.groupBy("key").agg(F.min("eik").alias("eik"), F.max("valid").alias("eik_valid"), F.max(F.coalesce(joint.cast("int"), F.lit(0))).alias("joint"), F.min("contractor_name").alias("least"))
    counts = named.where("trim(contractor_name) <> ''").groupBy("key", "contractor_name").agg(F.sum("n").alias("n"))
    names = latest_by(counts, ["key"], [F.desc("n"), *name_order("contractor_name")]).select("key", "contractor_name")
    unknown = F.col("key").startswith("unknown:")
    kind = F.when(unknown, "unknown").when(F.col("joint") == 1, "consortium").otherwise("company")
    return per.join(names, "key", "left").select("key", F.when(unknown, "Неизвестен изпълнител").otherwise(F.coalesce("contractor_name", "least")).alias("name"), "eik", "eik_valid", kind.alias("kind"))


def owned(bidders: DataFrame, listed: DataFrame, branches: DataFrame) -> DataFrame:
    """ownership of valid bidders: listed(eik, ownership) by equal code, branches(prefix, eik) by a code's beginning.

    A code that several entries fit takes the smallest. Beginnings are matched by equality: each code is cut at the lengths
    that prefixes have (a handful: no longer than a code), so neither side is sent around or compared in a loop.
    """
    lengths = sorted(r[0] for r in branches.where("prefix <> ''").select(F.length("prefix")).distinct().collect())
    starts = branches.join(listed, "eik").select(F.col("prefix").alias("code"), "ownership")
    ok = bidders.where("eik_valid = 1 AND eik IS NOT NULL").select("key", "eik")
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("eik")) if lengths else F.array().cast("array<int>")
    begun = ok.withColumn("n", F.explode(cuts)).select("key", F.substring("eik", F.lit(1), F.col("n")).alias("code")).join(starts, "code").select("key", "ownership")
    exact = ok.join(listed, "eik").select("key", "ownership")
    found = exact.unionByName(begun).groupBy("key").agg(F.min("ownership").alias("ownership"))
    return bidders.join(found, "key", "left")


def contract_ids(awards: DataFrame, order: list[Column]) -> DataFrame:
    """c:feed:procedure:number:lot:bidder:ordinal; the ordinal counts equal keys in the given total order."""
    lot = F.coalesce(F.nullif(lot_number(F.col("lot_id")), F.lit("")), F.lit("_"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    keyed = awards.withColumn("_key", F.concat_ws(":", F.lit("c"), F.when(F.col("source").startswith("eop:"), "e").otherwise("o"), blank(F.col("unp")), blank(F.col("contract_number")), lot, F.col("bidder_key")))
    return keyed.withColumn("contract_id", F.concat_ws(":", "_key", F.row_number().over(Window.partitionBy("_key").orderBy(*order)).cast("string"))).drop("_key")


def promoted_annexes(raw: DataFrame) -> DataFrame:
    """Annexes without repeats of their key (the latest source and id stay); a restated value replaces the one after, and the difference follows."""
    kept = latest_by(raw, ["key"], [F.desc("source"), F.desc("id")])
    after = F.coalesce("value_restated", "value_after")
    return kept.select("key", "unp", "contract_number", "value_before", after.alias("value_after"), (after - F.col("value_before")).alias("value_delta"), F.col("value_restated").isNotNull().cast("int").alias("restated"), "published_at")


def latest_parties(parties: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a party: the last by each column in turn, nulls last."""
    return latest_by(parties, keys, [F.desc_nulls_last(c) for c in order])


def freshness(contracts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Contracts and latest date by the feed that an id's prefix names (`enrichment.freshness_text` makes one text of them)."""
    feed = None
    for prefix, name in prefixes.items():
        test = F.col("id").startswith(prefix)
        feed = F.when(test, name) if feed is None else feed.when(test, name)
    return contracts.groupBy(feed.otherwise("other").alias("feed")).agg(F.count("*").alias("contracts"), F.max("published_at").alias("latest"))


def excess_keys(notices: DataFrame, key: str, ident: str) -> DataFrame:
    """Keys that stand for several identifiers: how many, and how many rows beyond one each."""
    return notices.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(ident).alias("idents"), (F.count("*") - F.countDistinct(ident)).alias("excess")).where("idents > 1")


def in_both(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """Keys that rows of both kinds carry."""
    return df.groupBy(key).agg(F.count_if(a).alias("a"), F.count_if(b).alias("b")).where("a > 0 and b > 0")
