"""Money and data-quality rules: conversion, the value-flag ladder, date flag, risk and rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BGN_PER_EUR = 1.95583


def to_eur(amount: Column, currency: Column, rate: Column) -> Column:
    """EUR as is, BGN by its fixed rate (also for a blank currency), others by the as-of rate or null."""
    code = F.coalesce(F.nullif(currency, F.lit("")), F.lit("BGN"))
    return F.when(code == "EUR", amount).when(code == "BGN", amount / BGN_PER_EUR).otherwise(amount * rate)


def value_flag(effective: Column, signing: Column, current: Column, own: Column, procedure: Column, step10: Column, doubled: Column, unit: float = 1.0) -> Column:
    """First rule that holds. step10: some annex grew tenfold; doubled: the driving annex doubles a known total.

    unit: how many of the columns' money units make one euro.
    """
    e, p, o = effective, procedure, own
    hundredfold = lambda base: (e >= 95 * base) & (e <= 105 * base)
    suspect = (e > 2_000_000_000 * unit) | ((p >= 1000 * unit) & ((e > 200 * p) | hundredfold(p))) | ((o >= 1000 * unit) & (p >= 1000 * unit) & (e >= 10 * p) & hundredfold(o))
    tiny = (p > 0) & (signing < 1000 * unit) & (signing * 100 < 5 * p)
    annex = (current < 0) | ((signing > 0) & ((current >= 100 * signing) | ((current >= 5 * signing) & step10)))
    return (
        F.when(suspect, "value_suspect").when(F.coalesce(current, signing) <= 0, "value_low").when(tiny, "value_low")
        .when(annex, "annex_suspect").when((signing > 0) & doubled, "annex_total_suspect").when((p > 0) & (e >= 10 * p), "review").otherwise("ok")
    )


def date_flag(signed: Column, published: Column) -> Column:
    late = signed.cast("date") > F.date_add(published.cast("date"), 2)
    return F.when(late, "signed_after_publication").otherwise("ok")


def repaired(flag: Column, effective: Column, signing: Column, procedure: Column) -> Column:
    """The amount to count: the procedure's estimate for suspects, the signed value for annex suspects."""
    return F.when(flag == "value_suspect", F.when(procedure > 0, procedure)).when(flag.isin("annex_suspect", "annex_total_suspect"), signing).otherwise(effective)


def rating(share: Column, good: float, bad: float) -> Column:
    return F.when(share >= bad, "bad").when(share <= good, "good").otherwise("mid")


def risks(bids: Column, eu: Column, signing: Column, current: Column, flag: Column) -> Column:
    """Indicator names of one contract."""
    found = F.array(
        F.when((bids == 1) & (F.coalesce(eu, F.lit(0)) == 1), "single-offer-eu"),
        F.when((bids == 1) & (F.coalesce(eu, F.lit(0)) == 0), "single-offer"),
        F.when((signing > 0) & (current * 100 > signing * 120), "grown"),
        F.when(flag == "value_suspect", "suspect"),
    )
    return F.filter(found, lambda x: x.isNotNull())
