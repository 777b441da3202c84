"""Identifier checksums, name normalisation and the three-rung identity key."""

from __future__ import annotations

import base64
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check-digit weights (first and second set) of 9- and 13-digit identifiers.
WEIGHTS_9 = ((1, 2, 3, 4, 5, 6, 7, 8), (3, 4, 5, 6, 7, 8, 9, 10))
WEIGHTS_13 = ((2, 7, 3, 5), (4, 9, 5, 7))
LABEL = "ЕИК "
QUOTES = "\"'`„“”‚‘’«»′″"
DASHES = "‐‑‒–—―−"
UNKNOWN = "unknown:анонимен"


def eik_clean(raw: Column) -> Column:
    return F.trim(F.when(raw.startswith(LABEL), F.substring(raw, len(LABEL) + 1, 1_000)).otherwise(raw))


def _weighted(code: Column, first: int, weights: tuple[int, ...]) -> Column:
    """The weighted digit sum mod 11, as one short expression: unrolled sums outgrow what can be compiled."""
    places = F.array(*[F.struct(F.lit(first + i).alias("at"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    return F.aggregate(places, F.lit(0), lambda total, p: total + (F.ascii(F.substr(code, p["at"], F.lit(1))) - 48) * p["w"]) % 11


def _check_digit(code: Column, first: int, weights: tuple[tuple[int, ...], tuple[int, ...]]) -> Column:
    """Weighted sum mod 11; 10 sends to the second weights; 10 again is 0."""
    one, two = (_weighted(code, first, ws) for ws in weights)
    return F.when(one < 10, one).when(two < 10, two).otherwise(0)


def eik_valid(raw: Column) -> Column:
    """1 for a 9- or 13-digit code whose check digits fit, else 0 (never null)."""
    code = eik_clean(raw)
    shaped = code.rlike("^([0-9]{9}|[0-9]{13})$") & ~code.rlike("^0+$")
    last = lambda n: F.substring(code, n, 1).cast("int")
    nine = _check_digit(code, 1, WEIGHTS_9) == last(9)
    thirteen = nine & (_check_digit(code, 9, WEIGHTS_13) == last(13))
    return F.when(F.coalesce(shaped, F.lit(False)), F.when(F.length(code) == 9, nine).otherwise(thirteen).cast("int")).otherwise(0)


def normal_name(name: Column) -> Column:
    """Upper case, one kind of dash, no quotes or soft hyphens, single spaces."""
    out = F.translate(name, "\u00a0\t\n\r", "    ")
    out = F.translate(F.translate(out, DASHES, "-" * len(DASHES)), QUOTES + "\u00ad\u200b", "")
    return F.upper(F.trim(F.regexp_replace(out, " +", " ")))


def identity_key(eik: Column, name: Column) -> Column:
    """A valid code, else the normalised name, else the one unknown bucket."""
    return key_of(eik_valid(eik), eik_clean(eik), name)


def key_of(valid: Column, code: Column, name: Column) -> Column:
    """The same from a clean code whose validity is known.

    No branch can be null, and the plan is told so: else a join by the key sends "key is not null", with all checksums, down to each row.
    """
    some = lambda text: F.coalesce(text, F.lit(""))
    named = F.trim(some(name)) != ""
    return F.when(valid == 1, F.concat(F.lit("eik:"), some(code))).when(named, F.concat(F.lit("name:"), normal_name(some(name)))).otherwise(UNKNOWN)


def slug(entity_id: str) -> str:
    """Route form of an entity id: codes plain, names in base64url."""
    kind, _, rest = entity_id.partition(":")
    if kind == "eik":
        return rest
    return "n-" + base64.urlsafe_b64encode(rest.encode()).decode().rstrip("=") if kind == "name" else "x-" + quote(entity_id, safe="")


def entity_id(text: str) -> str | None:
    """Inverse of slug; None for what it never makes."""
    try:
        if text.isdigit():
            return f"eik:{text}"
        if text.startswith("n-"):
            return "name:" + base64.urlsafe_b64decode(text[2:] + "=" * (-len(text[2:]) % 4)).decode()
        return unquote(text[2:]) if text.startswith("x-") else None
    except ValueError:
        return None
