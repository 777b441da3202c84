"""Keyset paging: opaque cursors bound to a sort and filters, forward and backward."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CURSOR = 512

#: Sort name -> (sort expression with NULL sentinels, descending). The sentinels.
CONTRACT_SORTS = {
    "value-desc": (lambda: F.coalesce(F.col("amount_cents"), F.lit(-100)), True),
    "value-asc": (lambda: F.coalesce(F.col("amount_cents").cast("double"), F.lit(1e20)), False),
    "date-desc": (lambda: F.coalesce(F.col("signed_at"), F.lit("")), True),
    "date-asc": (lambda: F.coalesce(F.col("signed_at"), F.lit("9999-99")), False),
}


@dataclass(frozen=True)
class Cursor:
    direction: str  # after | before
    value: object
    id: object


def signature(filters: dict[str, object]) -> str:
    """A short stable name of the filters in use: order of sets and empty values don't matter."""
    plain = {k: sorted(set(map(str, v))) if isinstance(v, Iterable) and not isinstance(v, str) else str(v) for k, v in filters.items() if v not in (None, "", (), [], set())}
    h = 5381
    for ch in json.dumps(plain, sort_keys=True, ensure_ascii=False):
        h = ((h * 33) ^ ord(ch)) & 0xFFFFFFFF
    return f"{h:x}"


def encode_cursor(c: Cursor, token: str) -> str:
    raw = json.dumps([c.value, c.id, token], ensure_ascii=False).encode()
    return f"{c.direction}:{base64.urlsafe_b64encode(raw).decode().rstrip('=')}"


def decode_cursor(text: str | None, token: str) -> Cursor | None:
    """None for anything malformed, too long or made for another sort or filters."""
    if not text or len(text) > MAX_CURSOR:
        return None
    direction, _, body = text.partition(":")
    try:
        value, key, own = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except (ValueError, TypeError):
        return None
    return Cursor(direction, value, key) if direction in ("after", "before") and own == token else None


def page(df: DataFrame, sort: Column, id_col: str, descending: bool, size: int, cursor: Cursor | None = None) -> DataFrame:
    """size + 1 rows behind (or before) the cursor, by (sort, id) in one direction; the last row only tells of more."""
    keyed = df.withColumn("_key", sort)
    down = descending != (cursor is not None and cursor.direction == "before")
    if cursor is not None:
        past = lambda c, v: c < v if down else c > v
        keyed = keyed.where(past(F.col("_key"), F.lit(cursor.value)) | ((F.col("_key") == F.lit(cursor.value)) & past(F.col(id_col), F.lit(cursor.id))))
    order = [F.desc("_key"), F.desc(id_col)] if down else [F.asc("_key"), F.asc(id_col)]
    return keyed.orderBy(*order).limit(size + 1)


def cursors(rows: list, size: int, token: str, sort_key: str, id_key: str, cursor: Cursor | None) -> tuple[list, str | None, str | None]:
    """(rows of the page in natural order, next, previous) from what `page` gave."""
    back = cursor is not None and cursor.direction == "before"
    more, shown = len(rows) > size, rows[:size]
    if back:
        shown = shown[::-1]
    if not shown:
        return [], None, None
    last, first = shown[-1], shown[0]
    after = encode_cursor(Cursor("after", last[sort_key], last[id_key]), token) if (more or back) else None
    before = encode_cursor(Cursor("before", first[sort_key], first[id_key]), token) if (more if back else cursor is not None) else None
    return shown, after, before
