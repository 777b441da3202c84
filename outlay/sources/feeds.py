"""Feed readers: flat JSON arrays, nested releases, XML declarations, exchange-rate series, JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions import coerce

KINDS: dict[str, Callable[[Column], Column]] = {"text": coerce.clean, "int": coerce.to_int, "real": coerce.to_real, "signed": coerce.to_signed, "bool": coerce.to_bool, "date": coerce.to_iso_date}


def classify_key(path: Column) -> Column:
    """Kind of feed object by its name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("ocds") | name.contains("release"), "ocds").when(name.contains("annex"), "annexes").when(name.contains("tender"), "tenders").when(name.contains("contract"), "contracts")


def read_records(spark: SparkSession, path: str, fields: list[tuple[str, str, str]], source: str, required: str | None = None) -> DataFrame:
    """JSON array files -> typed rows. fields: (column, JSON key, kind); required: a column that may not be blank.

    Everything is read as text under an explicit schema, so no inference pass runs over the files.
    """
    schema = T.StructType([T.StructField(k, T.StringType()) for k in dict.fromkeys(k for _, k, _ in fields)])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    out = raw.select(F.lit(source).alias("source"), *[KINDS[kind](F.col(f"`{key}`")).alias(name) for name, key, kind in fields])
    return out.where(F.col(required).isNotNull()) if required else out


_VALUE = "struct<amount: double, currency: string>"
RELEASE = f"""
ocid string, id string, date string, tag array<string>,
parties array<struct<id: string, name: string, identifier: struct<id: string, scheme: string>, roles array<string>>>,
buyer struct<id: string, name: string>,
tender struct<id: string, title: string, value: {_VALUE}, procurementMethodDetails: string, items: array<struct<classification: struct<id: string, scheme: string>>>, lots: array<struct<id: string, title: string, value: {_VALUE}>>>,
awards array<struct<id: string, title: string, suppliers: array<struct<id: string, name: string>>>>,
bids struct<statistics: array<struct<measure: string, value: double>>>,
contracts array<struct<id: string, awardID: string, title: string, dateSigned: string, value: {_VALUE}, amendments: array<struct<id: string, date: string, description: string>>>>
""".replace("roles array", "roles: array")


def _first(array: Column) -> Column:
    return F.get(array, 0)


def _party(parties: Column, wanted: Column) -> Column:
    return _first(F.filter(parties, lambda p: p["id"] == wanted))


def release_contracts(releases: DataFrame) -> DataFrame:
    """One row for each contract of releases tagged as contracts."""
    c = releases.where(F.array_contains("tag", "contract")).withColumn("c", F.explode("contracts"))
    award = _first(F.filter("awards", lambda a: a["id"] == F.col("c.awardID")))
    c = c.withColumn("supplier_ref", _first(award["suppliers"]))
    supplier = _party(F.col("parties"), F.col("supplier_ref.id"))
    buyer = _party(F.col("parties"), F.col("buyer.id"))
    code = _first(F.filter(F.transform("tender.items", lambda i: i["classification"]), lambda k: k["scheme"] == "CPV"))["id"]
    bids = _first(F.filter("bids.statistics", lambda s: s["measure"] == "bids"))["value"]
    return c.select(
        "ocid", F.col("c.id").alias("contract_number"), F.coalesce(F.col("c.title"), F.col("tender.title")).alias("subject"),
        coerce.to_iso_date(F.col("c.dateSigned")).alias("signed_at"), F.col("c.value.amount").alias("signing_value"), F.col("c.value.currency").alias("currency"),
        buyer["identifier"]["id"].alias("authority_eik"), F.coalesce(buyer["name"], F.col("buyer.name")).alias("authority_name"),
        supplier["identifier"]["id"].alias("contractor_eik"), F.coalesce(supplier["name"], F.col("supplier_ref.name")).alias("contractor_name"),
        code.alias("cpv_code"), bids.cast("int").alias("bids_received"), F.col("tender.id").alias("tender_ext_id"),
    )


def release_amendments(releases: DataFrame) -> DataFrame:
    """One row for each amended contract with an id; its value is what stood before."""
    a = releases.where(F.array_contains("tag", "contractAmendment") | F.array_contains("tag", "contractUpdate")).withColumn("c", F.explode("contracts")).where("c.id is not null")
    last = F.try_element_at("c.amendments", F.lit(-1))
    return a.select(
        "ocid", F.col("tender.id").alias("tender_ext_id"), F.col("c.id").alias("contract_number"), F.col("c.value.amount").alias("value_before"), F.lit(None).cast("double").alias("value_after"),
        F.col("c.value.currency").alias("currency"), last["description"].alias("description"), coerce.to_iso_date(F.coalesce(last["date"], F.col("date"))).alias("published_at"),
    )


def release_parties(releases: DataFrame) -> DataFrame:
    return releases.select("ocid", F.explode("parties").alias("p")).select("ocid", F.col("p.id").alias("party_id"), F.col("p.identifier.id").alias("eik"), F.col("p.name").alias("name"), F.concat_ws(",", "p.roles").alias("roles"))


def release_lots(releases: DataFrame) -> DataFrame:
    return releases.select("ocid", F.col("tender.id").alias("tender_id"), F.explode("tender.lots").alias("l")).select("ocid", "tender_id", F.col("l.id").alias("lot_id"), F.col("l.value.amount").alias("value_amount"), F.col("l.value.currency").alias("value_currency"))


DECLARATION = "id string, person string, Tables struct<Table: array<struct<Num: string, Row: array<struct<Num: string, Cell: array<struct<Num: string, Text: string>>>>>>>"


def declaration_cells(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Declarations as XML text -> one row for each table row: id, table, row, cells (a map by number)."""
    d = xml.select(F.from_xml(F.col(column), DECLARATION).alias("d")).select("d.id", "d.person", F.explode("d.Tables.Table").alias("t"))
    r = d.select("id", "person", F.col("t.Num").alias("table"), F.posexplode("t.Row").alias("row", "r"))
    return r.select("id", "person", "table", "row", F.map_from_entries(F.transform("r.Cell", lambda c: F.struct(c["Num"], c["Text"]))).alias("cells"))


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Declaration").schema(DECLARATION.replace(": ", ":")).load(path)


def fx_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """{"base": .., "rates": {date: {"EUR": x}}} -> (currency, rate_date, eur_per_unit)."""
    p = payloads.select(F.from_json(column, "base string, rates map<string, map<string, double>>").alias("p"))
    return p.select(F.col("p.base").alias("currency"), F.explode("p.rates")).select("currency", F.col("key").alias("rate_date"), F.col("value")["EUR"].alias("eur_per_unit")).where("eur_per_unit > 0")
