"""Company and authority lists: scoped rollups, filters, sorts, facets.

Null sums never occur (rows without an amount are left out); ties in a sort go by id; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.operators.filters import COUNT_BUCKETS, PAGE_SIZES, year_known
from outlay.operators.paging import Cursor, page
from outlay.operators.rollups import entity_totals, primary_sector

#: Sort name -> (column, descending); the first is the default.
COMPANY_SORTS = {"won": ("sum_cents", True), "count": ("contracts", True), "authorities": ("partners", True), "name": ("name", False)}
AUTHORITY_SORTS = {"spent": ("sum_cents", True), "count": ("contracts", True), "avg": ("avg_eur", True), "name": ("name", False)}
#: How many authority types there are, and the name of none.
TYPE_GROUPS, OTHER_TYPE = 7, "друго"
UNKNOWN_YEAR = "unknown"


@dataclass(frozen=True)
class EntityFilters:
    sectors: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    eu: str | None = None  # eu | national
    kinds: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    count_bucket: str | None = None


def scoped(contracts: DataFrame, p: EntityFilters) -> DataFrame:
    """The contracts that sector, year and EU filters leave."""
    out = contracts
    if p.sectors:
        out = out.where(F.col("division").isin(list(p.sectors)))
    if p.years:
        out = out.where(F.substring("signed_at", 1, 4).isin(list(p.years)))
    if p.eu == "eu":
        out = out.where("eu_funded = 1")
    elif p.eu == "national":
        out = out.where("coalesce(eu_funded, 0) = 0")
    return out


def entity_rollup(contracts: DataFrame, names: DataFrame, key: str, partner: str, p: EntityFilters) -> DataFrame:
    """Totals of each entity over the scoped contracts, its name and kind or type, average and primary sector.

    Under sector, year or EU filters the primary sector is the single filtered one, or null.
    """
    totals = entity_totals(scoped(contracts, p), key, partner).withColumn("avg_eur", F.col("sum_cents").cast("double") / 100 / F.col("contracts"))
    if p.sectors or p.years or p.eu:
        only = p.sectors[0] if len(p.sectors) == 1 else None
        totals = totals.withColumn("division", F.lit(only).cast("string"))
    else:
        totals = totals.join(primary_sector(contracts, key), key, "left")
    return totals.join(names, key)


def company_filter(p: EntityFilters) -> Column:
    """Unknown bidders never show; a kind counts only alone, an unknown bucket not at all."""
    out = F.col("kind") != "unknown"
    if len(p.kinds) == 1:
        out = out & (F.col("kind") == p.kinds[0])
    if p.count_bucket in COUNT_BUCKETS:
        low, high = COUNT_BUCKETS[p.count_bucket]
        out = out & (F.col("contracts") >= low) & (F.lit(True) if high is None else F.col("contracts") <= high)
    return out


def authority_filter(p: EntityFilters) -> Column:
    """Types count only as a true part of all."""
    return F.col("type_group").isin(list(p.types)) if 0 < len(p.types) < TYPE_GROUPS else F.lit(True)


def entity_page(rollup: DataFrame, sorts: dict[str, tuple[str, bool]], sort: str | None, key: str, cursor: Cursor | None = None, size: int = PAGE_SIZES["companies"]) -> DataFrame:
    """One page and a row more; an unknown sort is the first."""
    column, down = sorts.get(sort or "", next(iter(sorts.values())))
    return page(rollup, F.col(column), key, down, size, cursor)


def company_facets(rollup: DataFrame, sectors: DataFrame) -> DataFrame:
    """Kinds by number of companies, sectors by value."""
    kinds = rollup.where(F.col("kind").isin("company", "consortium")).groupBy("kind").agg(F.count("*").cast("double").alias("n")).select(F.lit("kind").alias("facet"), F.col("kind").alias("key"), "n")
    return kinds.unionByName(sectors.where("value_eur > 0").select(F.lit("sector").alias("facet"), F.col("division").alias("key"), F.col("value_eur").alias("n")))


def authority_facets(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(F.coalesce("type_group", F.lit(OTHER_TYPE)).alias("type_group")).agg(F.count("*").alias("n"))


def contract_facets(contracts: DataFrame, groups: dict[str, str], this_year: str) -> DataFrame:
    """Live counts by sector, year (future and malformed ones are unknown), procedure group and EU, in one pass."""
    year = F.when(year_known(F.col("signed_at"), this_year), F.substring("signed_at", 1, 4)).otherwise(UNKNOWN_YEAR)
    group = F.coalesce(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("procedure_type")], F.lit("unknown"))
    eu = F.when(F.col("eu_funded") == 1, "eu").otherwise("national")
    facets = F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("key")) for n, c in (("sector", F.col("division")), ("year", year), ("procedure", group), ("eu", eu))])
    return contracts.select(F.inline(facets)).groupBy("facet", "key").agg(F.count("*").alias("contracts"))


def single_offers(contracts: DataFrame, mode: str, limit: int = 10) -> DataFrame:
    """Contracts with one offer and a known amount: the latest, or the largest."""
    order = F.desc("amount_cents") if mode == "value" else F.desc(F.coalesce("signed_at", "published_at"))
    return contracts.where("bids_received = 1 and amount_cents is not null").orderBy(order, F.asc("id")).limit(limit)


def year_options(contracts: DataFrame, this_year: str) -> DataFrame:
    """The years that contracts were signed in, future and malformed ones left out."""
    known = contracts.where(year_known(F.col("signed_at"), this_year))
    return known.groupBy(F.substring("signed_at", 1, 4).alias("year")).agg(F.count("*").alias("contracts"))


def leaders(rollups: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """The first of each block by value: block -> (rollup with sum_cents, key, how many)."""
    parts = [df.orderBy(F.desc("sum_cents"), F.asc(key)).limit(n).select(F.lit(block).alias("block"), F.col(key).cast("string").alias("key"), "sum_cents") for block, (df, key, n) in rollups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
