"""Conflict pages: which declared stakes are shown, in which order, with which contracts.

A link is shown if it is published, of an ownership class, sealed by evidence that publishes,
its company has a contract now, and it isn't a relative's stake beside the official's own in the
same company. Contracts are counted by company and year before links meet them, so a company
with very many contracts and links costs one row a year and link. Links without declared years
are shown with no contract in their window. Links with null person or company are never shown;
a link key on several rows is one link (the least row); empty tables give empty pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.operators.interests import temporal_class
from outlay.operators.pick import latest_by

#: What licenses a public claim.
OWN, FAMILY = "private_ownership", "family_ownership"
PUBLISHING = ("document", "confirmed")
#: Most contracts that one link's page lists.
PAGE = 500


def nexus() -> list[Column]:
    """Own institution first, then stakes held during an award, then the value awarded meanwhile, then the key."""
    return [F.desc(F.coalesce(F.col("own_institution") == "exact", F.lit(False))), F.desc(F.col("window_contracts") > 0), F.desc_nulls_last("window_cents"), F.asc("link_key")]


def gated(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Published and sealed links of the two ownership classes, without relatives' doubles.

    links(link_key, person, company, status, interest_class, ...); evidence(link_key, kind).
    """
    published = latest_by(
        links.where("link_key is not null and person is not null and company is not null and status = 'published'").where(F.col("interest_class").isin(OWN, FAMILY)),
        ["link_key"], [F.asc_nulls_last(c) for c in links.columns],
    )
    sealed = published.join(evidence.where(F.col("kind").isin(*PUBLISHING)).select("link_key").distinct(), "link_key", "left_semi")
    own = published.where(F.col("interest_class") == OWN).select("person", "company").distinct().withColumn("_own", F.lit(True))
    doubled = F.coalesce("_own", F.lit(False)) & (F.col("interest_class") == FAMILY)
    return sealed.join(own, ["person", "company"], "left").where(~doubled).drop("_own").select(*links.columns)


def shown(links: DataFrame, evidence: DataFrame, contracts: DataFrame) -> DataFrame:
    """The gated links whose company has contracts, + contracts, cents, and those signed in the declared years.

    contracts(company, year, cents); links also carry first_year, last_year, own_institution.
    """
    per = contracts.where("company is not null").groupBy("company", "year").agg(F.count("*").alias("n"), F.sum("cents").alias("v"))
    inside = F.coalesce((F.col("year") >= F.col("first_year")) & (F.col("year") <= F.col("last_year")), F.lit(False))
    rest = [c for c in links.columns if c != "link_key"]
    return gated(links, evidence).join(per, "company").groupBy("link_key").agg(
        *[F.any_value(c).alias(c) for c in rest],  # one link, one value
        F.sum("n").alias("contracts"), F.sum("v").alias("cents"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("window_contracts"), F.sum(F.when(inside, F.col("v"))).alias("window_cents"),
    )


def leaderboard(shown_links: DataFrame, n: int = 100) -> DataFrame:
    """The first links of all, with their place from 1."""
    top = shown_links.orderBy(*nexus()).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*nexus())))  # n rows at most


def pages(shown_links: DataFrame, key: str) -> DataFrame:
    """Every official's (key 'person') or company's (key 'company') links, with their place from 1."""
    return shown_links.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*nexus())))


def headline(shown_links: DataFrame) -> DataFrame:
    """Links, officials, companies, and the contracts' value with each company counted once."""
    first = F.when(F.col("place") == 1, F.col("cents"))
    return pages(shown_links, "company").agg(F.count("*").alias("links"), F.count_distinct("person").alias("officials"), F.count_distinct("company").alias("companies"), F.sum(first).alias("cents"))


def link_contracts(gated_links: DataFrame, contracts: DataFrame, n: int = PAGE) -> DataFrame:
    """Each link's first contracts: in its years first, then the latest, then the largest, then by id.

    gated_links(link_key, company, first_year, last_year); contracts(id, company, year, signed_at, cents), year and signed_at null together.
    Whether a contract is in a link's years depends on its year alone, so no link lists a contract beyond the
    first n of its company and year: these are picked before links meet contracts, and nothing is lost.
    """
    order = [F.desc_nulls_last("signed_at"), F.desc_nulls_last("cents"), F.asc("id")]
    kept = contracts.where("company is not null").withColumn("_r", F.row_number().over(Window.partitionBy("company", "year").orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    met = gated_links.select("link_key", "company", "first_year", "last_year").join(kept, "company").withColumn("temporal", temporal_class(F.col("year"), F.col("first_year"), F.col("last_year")))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("link_key").orderBy(F.desc(F.col("temporal") == "contemporaneous"), *order)))
    return placed.where(F.col("place") <= n).select("link_key", "place", "id", "temporal", "signed_at", "cents")
