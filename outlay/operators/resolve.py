"""Declared companies to winners: a ladder of rungs, with keys that fit several companies kept out.

Rungs, strongest first, for each declared text:

``exact_name_key``  the text as a whole is the name of exactly one valid winner. Where it is the name of several it is
                    ``ambiguous``, and no later rung may settle it.
``declared_eik``    the text has a valid winner's code (9 or 13 digits on their own), and that winner's name stands in it
                    before a legal form.
``extracted_name``  a name before a legal form in the text is the name of exactly one valid winner; ambiguous ones are passed over.

Rungs are equi-joins on name keys and codes, over the distinct texts; winners are folded to one row a key before.
Null and blank texts, and those that no rung settles, come out without a winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms as they stand behind a name, and the marks that quote one.
FORMS = ["КООПЕРАЦИЯ", "ФОНДАЦИЯ", "СДРУЖЕНИЕ", "ЕООД", "ЕАД", "ООД", "АД", "ЕТ", "ДЗЗД", "КД", "СД", "АДСИЦ"]
QUOTES = "„\"“”«»"

_NAME = rf"[{QUOTES}]?\s*[^„\"“«»,;]{{2,60}}[\s”\"«»]+(?:{'|'.join(FORMS)})(?![А-Яа-яA-Za-z])"
_CODE = r"(?<![0-9])(?:[0-9]{9}|[0-9]{13})(?![0-9])"


def name_key(name: Column) -> Column:
    """Upper case, quotes as spaces, single spaces; an empty key matches nothing (null)."""
    out = F.trim(F.regexp_replace(F.upper(F.translate(name, QUOTES + "\u00a0", " " * (len(QUOTES) + 1))), r"\s+", " "))
    return F.nullif(out, F.lit(""))


def candidates(text: Column) -> Column:
    """The names before a legal form in a text, with the form, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\A[\s,;]+", ""))), lambda s: s != "")


def codes(text: Column) -> Column:
    """Numbers of 9 or 13 digits, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_CODE), F.lit(0)))


def resolve(declared: DataFrame, winners: DataFrame, text: str) -> DataFrame:
    """declared with eik and method; winners(name, eik, valid). method: a rung's name, ``ambiguous`` or null."""
    valid = winners.where("eik IS NOT NULL AND valid = 1").select(name_key(F.col("name")).alias("key"), "eik").where("key IS NOT NULL")
    by_key = valid.groupBy("key").agg(F.count_distinct("eik").alias("n"), F.min("eik").alias("eik"))
    texts = declared.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().withColumn("key", name_key(F.col("_text")))
    exact = texts.join(by_key, "key").select("_text", F.when(F.col("n") == 1, F.col("eik")).alias("eik"), F.when(F.col("n") == 1, "exact_name_key").otherwise("ambiguous").alias("method"))
    rest = texts.join(exact, "_text", "left_anti")
    named = rest.select("_text", F.posexplode(F.transform(candidates(F.col("_text")), name_key)).alias("place", "key")).where("key IS NOT NULL")
    coded = rest.select("_text", F.posexplode(codes(F.col("_text"))).alias("place", "eik"))
    both = coded.join(valid.distinct(), "eik").join(named.select("_text", "key").distinct(), ["_text", "key"], "left_semi")
    by_code = both.groupBy("_text").agg(F.min_by("eik", "place").alias("eik")).withColumn("method", F.lit("declared_eik"))
    left = named.join(by_code, "_text", "left_anti").join(by_key.where("n = 1"), "key")
    by_part = left.groupBy("_text").agg(F.min_by("eik", "place").alias("eik")).withColumn("method", F.lit("extracted_name"))
    settled = exact.unionByName(by_code).unionByName(by_part)
    return declared.join(settled, declared[text] == settled["_text"], "left").drop("_text")


def ambiguous_keys(winners: DataFrame) -> DataFrame:
    """Name keys of several valid winners: how many, and their codes' first and last."""
    keyed = winners.where("eik IS NOT NULL AND valid = 1").select(name_key(F.col("name")).alias("key"), "eik").where("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.count_distinct("eik").alias("companies"), F.min("eik").alias("first"), F.max("eik").alias("last")).where("companies > 1")
