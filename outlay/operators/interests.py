"""Declared interests: windows, evidence verdicts, publication status and what may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def temporal_class(year: Column, first: Column, last: Column) -> Column:
    """Of a contract's year against the declared years."""
    return F.when(year.isNull() | first.isNull() | last.isNull(), "unknown").when(year < first, "before").when(year > last, "after").otherwise("contemporaneous")


def in_window(links: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """Links with contracts signed within their declared years: key + residual range on the year."""
    return links.join(contracts, key).where((F.col("year") >= F.col("first_year")) & (F.col("year") <= F.col("last_year")))


def interest_class(owns: Column, manages: Column, related: Column) -> Column:
    return F.when(owns & manages, "owns+manages").when(owns, "owns").when(manages, "manages").when(related, "related")


def verdict(outside: Column, joint_stock: Column, known_form: Column, document: Column, declared_id: Column, unique_name: Column, seat: Column, refuted: Column) -> Column:
    """First rung that holds; a document counts only with an identifier or a unique name at the seat."""
    sure = declared_id | (unique_name & seat)
    return (
        F.when(outside, "outside").when(joint_stock, "joint-stock").when(~known_form, "unknown-form")
        .when(refuted, "refuted").when(document & sure, "document").when(sure, "confirmed").otherwise("unknown")
    )


def status(suppressed: Column, verdict_: Column, divested: Column, internal: Column) -> Column:
    published = verdict_.isin("document", "confirmed")
    return F.when(suppressed, "suppressed").when(verdict_ == "refuted", "withdrawn:refuted").when(divested, "withdrawn:divested").when(internal, "internal").when(published, "published").otherwise("held")


def surfaced(links: DataFrame, evidence: DataFrame, live: DataFrame) -> DataFrame:
    """Published ownership links with publishing evidence and a live contract, without family doubles.

    A family link is redundant where the same person holds the company personally.
    """
    own = links.where("status = 'published' and interest_class in ('owns', 'owns+manages', 'related')")
    backed = own.join(evidence.select("link_key").distinct(), "link_key", "left_semi").join(live.select("company").distinct(), "company", "left_semi")
    personal = backed.where("interest_class <> 'related'").select("person", "company").distinct()
    family = backed.where("interest_class = 'related'").join(personal, ["person", "company"], "left_anti")
    return backed.where("interest_class <> 'related'").unionByName(family)


def surfaced_total(links: DataFrame, value: str) -> DataFrame:
    """Value of the companies shown, each counted once."""
    return links.groupBy("company").agg(F.max(value).alias("v")).agg(F.count("*").alias("companies"), F.sum("v").alias("total"))
