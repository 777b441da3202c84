"""List filters and sorts: each filter is a column predicate, joined by AND."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half-open value buckets in euros, and contract-count buckets.
VALUE_BUCKETS = {"lt100k": (None, 100_000), "100k-1m": (100_000, 1_000_000), "1m-10m": (1_000_000, 10_000_000), "10m-100m": (10_000_000, 100_000_000), "gt100m": (100_000_000, None)}
COUNT_BUCKETS = {"1": (1, 1), "2-5": (2, 5), "6-20": (6, 20), "21-100": (21, 100), "gt100": (101, None)}
PAGE_SIZES = {"contracts": 15, "companies": 25, "authorities": 25}
MAX_VALUES = 50


@dataclass(frozen=True)
class ContractFilters:
    years: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    procedures: tuple[str, ...] = ()
    value_bucket: str | None = None
    eu: str | None = None
    authority: int | str | None = None
    bidder: int | str | None = None
    q: str | None = None
    bids: str | None = None


def multi(params: dict[str, list[str]], key: str) -> tuple[str, ...]:
    """Repeated or comma-separated values, trimmed, without repeats, at most MAX_VALUES."""
    found = (x.strip() for v in params.get(key, []) for x in v.split(","))
    return tuple(dict.fromkeys(x for x in found if x))[:MAX_VALUES]


def year_known(date: Column, this_year: str) -> Column:
    return F.coalesce(date.rlike("^[0-9]{4}") & (F.substring(date, 1, 4) <= this_year), F.lit(False))


def between(x: Column, low: float | None, high: float | None) -> Column:
    """low <= x < high."""
    tests = ([x >= low] if low is not None else []) + ([x < high] if high is not None else [])
    return functools.reduce(operator.and_, tests)


def contract_predicates(p: ContractFilters, groups: dict[str, str], this_year: str) -> list[Column]:
    """One predicate for each filter in use. Unknown buckets and groups are ignored; an undecodable entity gives no rows."""
    out: list[Column] = []
    if p.years:
        known = year_known(F.col("signed_at"), this_year)
        some = known & F.substring("signed_at", 1, 4).isin([y for y in p.years if y != "unknown"])
        out.append(some | ~known if "unknown" in p.years else some)
    if p.sectors:
        out.append(F.col("division").isin(list(p.sectors)))
    types = [t for t, g in groups.items() if g in p.procedures]
    if types:
        out.append(F.col("procedure_type").isin(types))
    if p.value_bucket in VALUE_BUCKETS:
        low, high = VALUE_BUCKETS[p.value_bucket]
        out.append(between(F.col("amount_cents"), None if low is None else low * 100, None if high is None else high * 100))
    if p.eu in ("0", "1"):
        out.append(F.coalesce("eu_funded", F.lit(0)) == int(p.eu))
    if p.bids == "1":
        out.append(F.col("bids_received") == 1)
    for column, value in (("authority_id", p.authority), ("bidder_id", p.bidder)):
        if value is not None:
            out.append(F.col(column) == int(value) if str(value).isdigit() else F.lit(False))
    return out


def apply_filters(df: DataFrame, p: ContractFilters, groups: dict[str, str], this_year: str, matched: DataFrame | None = None) -> DataFrame:
    """matched(id): what a text query found; joined as a semi-join."""
    for predicate in contract_predicates(p, groups, this_year):
        df = df.where(predicate)
    return df.join(matched, "id", "left_semi") if p.q and matched is not None else df


def summary(df: DataFrame) -> DataFrame:
    suspect = F.col("amount_cents").isNull() | (F.col("amount_cents") <= 0)
    return df.agg(F.count("*").alias("contracts"), (F.coalesce(F.sum("amount_cents"), F.lit(0)).cast("double") / 100).alias("value_eur"), F.count_if(suspect).alias("suspect"))


FILTERS_IN_USE = tuple(f.name for f in fields(ContractFilters))
