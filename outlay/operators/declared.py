"""Declared stakes over the years: one row a link, the spells of its years, and whether a later filing left it out.

A link is a person's stake in a company under one scope (own or family). Everything about it is folded with sets and
extremes, so repeated declarations change nothing. A link is divested where the person later filed the same kind of declaration
(template) in which the stake once stood, and the stake no longer does: the horizon of that template, over all of the
person's filings, empty ones included, lies beyond the link's last year of ownership.

Null persons, companies and scopes are values like any other; a row without a year counts for all but the years; a filing
without a year is dated by its folder, and one without either dates nothing; links without a year of ownership aren't divested.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = ["person", "company", "scope"]


def _text_set(c: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",")


def links(holdings: DataFrame) -> DataFrame:
    """holdings(LINK, kind, owns, template, institution, method_rank, year) -> a row a link; sets as sorted, joined text."""
    own_year = F.when(F.coalesce("owns", F.lit(False)), F.col("year"))
    return holdings.groupBy(*LINK).agg(
        _text_set("kind").alias("kinds"), _text_set("template").alias("templates"), _text_set("institution").alias("institutions"),
        F.coalesce(F.bool_or("owns"), F.lit(False)).alias("owns"), F.max("method_rank").alias("method_rank"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("years"), F.max(own_year).alias("last_owned"),
    )


def spells(holdings: DataFrame, gap: int = 1) -> DataFrame:
    """LINK, spell from 1, first_year, last_year: years not more than `gap` apart are one spell."""
    years = holdings.where("year IS NOT NULL").select(*LINK, "year").distinct()
    along = Window.partitionBy(*LINK).orderBy("year")
    opens = years.withColumn("_new", F.coalesce(F.col("year") - F.lag("year").over(along) > gap, F.lit(True)).cast("int"))
    told = opens.withColumn("spell", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(*LINK, F.col("spell").cast("int").alias("spell")).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def horizons(filings: DataFrame) -> DataFrame:
    """person, template, horizon: the latest year filed for; the folder's year where a filing has none."""
    dated = filings.withColumn("_year", F.coalesce("year", "folder_year")).where("_year IS NOT NULL")
    return dated.groupBy("person", F.coalesce("template", F.lit("")).alias("template")).agg(F.max("_year").alias("horizon"))


def divested(holdings: DataFrame, filings: DataFrame) -> DataFrame:
    """LINK, last_owned, horizon of the links that a later filing of one of their templates left out."""
    under = holdings.where("template IS NOT NULL AND template <> ''").select(*LINK, "template").distinct().alias("u")
    seen = under.join(horizons(filings).alias("h"), F.expr("u.person <=> h.person AND u.template = h.template")).groupBy(*(f"u.{c}" for c in LINK)).agg(F.max("h.horizon").alias("horizon")).alias("s")
    last = holdings.where("owns AND year IS NOT NULL").groupBy(*LINK).agg(F.max("year").alias("last_owned")).alias("l")
    same = F.expr(" AND ".join(f"l.{c} <=> s.{c}" for c in LINK))
    return last.join(seen, same).where("s.horizon > l.last_owned").select(*(f"l.{c}" for c in LINK), "l.last_owned", "s.horizon")
