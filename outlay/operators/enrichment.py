"""Entities, lots and contracts completed from released parties, lots, annexes and rates.

Of a key's rows the latest that has a value speaks, for each column on its own. It is found by
`max_by` over a total order, which combines before the shuffle, so a key with very many rows is
one small buffer a task. Blank and null keys complete nothing; repeated rows change nothing; an
empty side leaves the other as it is; other columns pass through, and a row's own values stay
unless the docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.values import BGN_PER_EUR
from outlay.operators.derive import lot_number

#: What parties are ordered by, latest first.
PARTY_ORDER = ("source", "ocid", "party_id", "name", "street_address", "locality", "contact_email", "contact_phone")
#: Entity column -> the party column that fills it.
PARTY_FIELDS = {"nuts": "region_nuts", "settlement": "locality", "address": "street_address", "contact_email": "contact_email", "contact_phone": "contact_phone"}

#: Second-level regions, their names, and the third-level regions (code, name) in each.
REGIONS = {
    ("BG31", "Северозападен"): {"BG311": "Видин", "BG312": "Монтана", "BG313": "Враца", "BG314": "Плевен", "BG315": "Ловеч"},
    ("BG32", "Северен централен"): {"BG321": "Велико Търново", "BG322": "Габрово", "BG323": "Русе", "BG324": "Разград", "BG325": "Силистра"},
    ("BG33", "Североизточен"): {"BG331": "Варна", "BG332": "Добрич", "BG333": "Шумен", "BG334": "Търговище"},
    ("BG34", "Югоизточен"): {"BG341": "Бургас", "BG342": "Сливен", "BG343": "Ямбол", "BG344": "Стара Загора"},
    ("BG41", "Югозападен"): {"BG411": "София (столица)", "BG412": "София", "BG413": "Благоевград", "BG414": "Перник", "BG415": "Кюстендил"},
    ("BG42", "Южен централен"): {"BG421": "Пловдив", "BG422": "Хасково", "BG423": "Пазарджик", "BG424": "Смолян", "BG425": "Кърджали"},
}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _latest(order: Sequence[str], *last: str) -> Column:
    """A total order in which null is as blank; `last` only settles what the order leaves equal."""
    return F.struct(*[_blank(c).alias(f"o{i}") for i, c in enumerate((*order, *last))])


def party_key() -> Column:
    """By identifier and place in its release, else by the place alone, else by what it says."""
    place = F.concat(F.lit("ocid:"), _blank("ocid"), F.lit(":party:"), _blank("party_id"))
    said = F.concat_ws(":", F.lit("content"), *[_blank(c) for c in ("ocid", "party_id", "eik", "name", "street_address", "locality", "region_nuts", "contact_email", "contact_phone")])
    return F.when(_blank("eik") != "", F.concat(F.lit("eik:"), "eik", F.lit(":"), place)).when((_blank("ocid") != "") & (_blank("party_id") != ""), place).otherwise(said)


def parties(released: DataFrame) -> DataFrame:
    """One row a party key: the latest by PARTY_ORDER, as it stands."""
    columns = ["eik", *PARTY_ORDER, "region_nuts"]
    newest = F.max_by(F.struct(*columns), _latest(PARTY_ORDER, "region_nuts"))
    return released.withColumn("party_key", party_key()).groupBy("party_key").agg(newest.alias("_p")).select("party_key", "_p.*")


def with_parties(entities: DataFrame, eik: str, known: DataFrame) -> DataFrame:
    """Each of PARTY_FIELDS from the entity's latest party that has it, else as it was."""
    order = _latest(PARTY_ORDER, "region_nuts")
    found = known.where(_blank("eik") != "").groupBy(F.col("eik").alias("_eik")).agg(*[F.max_by(p, F.when(_blank(p) != "", order)).alias(f"_{e}") for e, p in PARTY_FIELDS.items()])
    joined = entities.join(found, entities[eik] == F.col("_eik"), "left")
    return joined.select(*[F.coalesce(f"_{c}", entities[c]).alias(c) if c in PARTY_FIELDS else entities[c] for c in entities.columns])


def regions(df: DataFrame) -> DataFrame:
    """nuts3, name, nuts2, nuts2_name of every region, beside the session of `df`."""
    rows = [(code, name, *upper) for upper, inside in REGIONS.items() for code, name in inside.items()]
    return df.sparkSession.createDataFrame(rows, "nuts3 string, name string, nuts2 string, nuts2_name string")


def with_regions(entities: DataFrame) -> DataFrame:
    """A missing region by the name of the entity's code; unknown codes leave it missing."""
    names = regions(entities).select(F.col("nuts3").alias("_nuts3"), F.col("name").alias("_name"))
    joined = entities.join(F.broadcast(names), entities["nuts"] == F.col("_nuts3"), "left")  # 28 rows
    return joined.withColumn("region", F.coalesce("region", "_name")).drop("_nuts3", "_name")


def regional_spending(spending: DataFrame) -> DataFrame:
    """level, code, name, cents, contracts, authorities: every region and macro region, with zeros, and the rest.

    spending(region, cents, contracts, authorities), by the region's name. Rows whose region is null or no region's
    name are one row of level 'unattributed'; 'covered' holds what the regions add up to.
    """
    measures = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("cents", "contracts", "authorities")]
    names = regions(spending)
    sums = spending.groupBy("region").agg(*measures)
    each = names.join(sums, F.col("name") == F.col("region"), "left")
    lone = sums.join(F.broadcast(names), F.col("name") == F.col("region"), "left_anti")
    level = lambda df, label, code, name: df.select(F.lit(label).alias("level"), code.alias("code"), name.alias("name"), "cents", "contracts", "authorities")
    none = F.lit(None).cast("string")
    return (
        level(each.groupBy("nuts3", "name").agg(*measures), "region", F.col("nuts3"), F.col("name"))
        .unionByName(level(each.groupBy("nuts2", "nuts2_name").agg(*measures), "macro", F.col("nuts2"), F.col("nuts2_name")))
        .unionByName(level(lone.agg(*measures), "unattributed", none, none))
        .unionByName(level(each.agg(*measures), "covered", none, none))
    )


def with_lot_values(lots: DataFrame, released: DataFrame, procedures: DataFrame) -> DataFrame:
    """lots(unp, lot_id, value, currency): a missing value or currency from the latest released lot of its number.

    released(id, tender_id, lot_id, value, currency), later ids count; procedures(tender_id, unp) say whose tender it is. Both
    come from one released row, also where it has only one of them.
    """
    links = procedures.where("tender_id is not null and unp is not null").select("tender_id", "unp").distinct()
    newest = F.max_by(F.struct("value", "currency"), F.struct("id", F.coalesce("value", F.lit(0)).alias("v"), _blank("currency").alias("c")))
    named = released.where("tender_id is not null and lot_id is not null").groupBy("tender_id", lot_number(F.col("lot_id")).alias("_lot")).agg(newest.alias("_new"), F.max("id").alias("_id"))
    found = named.join(links, "tender_id").groupBy(F.col("unp").alias("_unp"), "_lot").agg(F.max_by("_new", F.struct("_id", F.coalesce("_new.value", F.lit(0)).alias("v"), F.coalesce("_new.currency", F.lit("")).alias("c"))).alias("_new"))
    joined = lots.join(found, (lots["unp"] == F.col("_unp")) & (lot_number(lots["lot_id"]) == F.col("_lot")), "left")
    return joined.withColumn("value", F.coalesce("value", "_new.value")).withColumn("currency", F.coalesce("currency", "_new.currency")).drop("_unp", "_lot", "_new")


def _euros(value: Column, currency: Column, rate: Column) -> Column:
    return F.when(currency == "EUR", value).when(currency == "BGN", value / BGN_PER_EUR).otherwise(value * rate)


def with_timeline(contracts: DataFrame) -> DataFrame:
    """+ signing_value_eur, current_value_eur: null where the flag says that this figure is the bad one, or no rate is known.

    contracts(signing_value, current_value, currency, current_value_currency, fx_rate, value_flag).
    """
    flag = _blank("value_flag")
    later = F.coalesce(F.nullif(F.col("current_value_currency"), F.lit("")), F.nullif(F.col("currency"), F.lit("")), F.lit("BGN"))
    signing = F.when(flag != "value_suspect", _euros(F.col("signing_value"), F.coalesce("currency", F.lit("BGN")), F.col("fx_rate")))
    current = F.when(~flag.isin("value_suspect", "annex_suspect", "annex_total_suspect"), _euros(F.col("current_value"), later, F.col("fx_rate")))
    return contracts.withColumn("signing_value_eur", signing).withColumn("current_value_eur", current)


def with_current_currency(contracts: DataFrame, annexes: DataFrame) -> DataFrame:
    """current_value_currency anew, and amount_eur by it.

    contracts(unp, contract_number, signing_value, current_value, currency, fx_rate, value_flag, amount_eur);
    annexes(id, unp, contract_number, value_after, currency, published_at). The currency is that of the latest annex with a value
    (blank: the contract's, else BGN), and the contract's where it has no current value. A suspect value keeps its amount;
    a suspect annex counts the signed value, if there is one.
    """
    newest = F.max_by(F.nullif(F.col("currency"), F.lit("")), F.struct(_blank("published_at").alias("p"), "id", _blank("currency").alias("c")))
    last = annexes.where("value_after is not null").groupBy(F.col("unp").alias("_unp"), F.col("contract_number").alias("_number")).agg(newest.alias("_currency"))
    own = F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("BGN"))
    joined = contracts.join(last, (contracts["unp"] == F.col("_unp")) & (contracts["contract_number"] == F.col("_number")), "left")
    joined = joined.withColumn("current_value_currency", F.when(F.col("current_value").isNotNull(), F.coalesce("_currency", own)).otherwise(own))
    signed, later = F.col("signing_value"), F.col("current_value")
    first = F.when(F.col("value_flag") == "annex_suspect", signed.isNotNull()).otherwise(later.isNull())
    euros = _euros(F.when(first, signed).otherwise(later), F.when(first, own).otherwise(F.col("current_value_currency")), F.col("fx_rate"))
    return joined.withColumn("amount_eur", F.when(F.col("value_flag") == "value_suspect", F.col("amount_eur")).otherwise(euros)).drop("_unp", "_number", "_currency")


def at_rate(df: DataFrame, rates: DataFrame, currency: str, date: str, value: str, into: str) -> DataFrame:
    """+ `into`: the value in euros at the rate of that very day, null without one; euros and leva need none.

    rates(currency, date, rate): of several rates of one day the largest counts.
    """
    once = rates.groupBy(F.col("currency").alias("_currency"), F.col("date").alias("_date")).agg(F.max("rate").alias("_rate"))
    joined = df.join(once, (df[currency] == F.col("_currency")) & (df[date] == F.col("_date")), "left")
    return joined.withColumn(into, _euros(F.col(value), F.col(currency), F.col("_rate"))).drop("_currency", "_date", "_rate")


def joint_participation(bridge: DataFrame, contracts: DataFrame) -> DataFrame:
    """authority, contracts, cents: of the joint procedures that an authority takes part in, led or not.

    bridge(unp, code); contracts(unp, cents). Contracts are summed by procedure first, so a procedure with very many of them and
    many members makes one row a member.
    """
    per = contracts.where("unp is not null").groupBy("unp").agg(F.count("*").alias("n"), F.sum("cents").alias("v"))
    joined = bridge.select("unp", "code").distinct().join(per, "unp")
    return joined.groupBy(F.col("code").alias("authority")).agg(F.sum("n").alias("contracts"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("cents"))


def natural(label: Column) -> Column:
    """A sort key by which 2 stands before 10 and LOT-2 before LOT-10: numbers by size, other runs as text; null for null."""
    runs = F.regexp_extract_all(label, F.lit("([0-9]+|[^0-9]+)"))
    digits = lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x))).otherwise(x))


def freshness_text(freshness: DataFrame) -> DataFrame:
    """All feeds in one text, by name: feed:latest(contracts), with ? for no date. One row a feed goes in."""
    part = F.concat(_blank("feed"), F.lit(":"), F.coalesce(F.col("latest").cast("string"), F.lit("?")), F.lit("("), F.col("contracts").cast("string"), F.lit(")"))
    return freshness.agg(F.array_join(F.array_sort(F.collect_list(part)), " ").alias("data_as_of"))


def sector_options(totals: DataFrame, value: str, n: int = 12) -> DataFrame:
    """The divisions with most value, for a list to choose from; ties: the smaller division."""
    return totals.where("coalesce(division, '') <> ''").orderBy(F.desc_nulls_last(value), "division").limit(n).select("division")
