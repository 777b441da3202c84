"""Incremental refresh: a capped catch-up window, touched keys, keyed merge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

LOOKBACK_DAYS, CAP_DAYS = 3, 21


@dataclass(frozen=True)
class Window:
    first: str
    last: str
    capped: bool


def catch_up(loaded: str | None, today: str) -> Window:
    """[latest loaded - LOOKBACK_DAYS, today], cut to the last CAP_DAYS."""
    end = dt.date.fromisoformat(today)
    begin = (dt.date.fromisoformat(loaded) if loaded else end) - dt.timedelta(days=LOOKBACK_DAYS)
    earliest = end - dt.timedelta(days=CAP_DAYS)
    return Window(max(begin, earliest).isoformat(), today, begin < earliest)


def merge_by_key(base: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `changed` replace those of `base` with the same key."""
    return base.join(changed.select(*keys).distinct(), list(keys), "left_anti").unionByName(changed)


def refresh(served: DataFrame, base: DataFrame, touched: DataFrame, keys: Sequence[str], rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recomputes `rule` for the touched keys only; equal to rule(base) if touched holds all changed keys."""
    keys = list(keys)
    again = rule(base.join(touched.select(*keys).distinct(), keys, "left_semi"))
    return served.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(again)


def assert_window_safe(partial: bool, corpus_rows: int) -> None:
    """A partial window may not replace an existing corpus."""
    if partial and corpus_rows:
        raise ValueError("a partial window would clear the existing corpus")
