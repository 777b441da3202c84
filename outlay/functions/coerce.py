"""Text of a feed -> typed values: blank is null, what doesn't fit is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_AMOUNT = 1e10
MAX_INT = (1 << 53) - 1
#: White space of the feeds, as a character class.
BLANK = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Words for yes and no, allowed and forbidden, in the feed languages.
YES, NO = ("true", "1", "yes", "да"), ("false", "0", "no", "не")
ALLOWED, FORBIDDEN = "Разрешено", "Забранено"


def clean(c: Column) -> Column:
    """Without white space at either end; blank is null."""
    return F.nullif(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", ""), F.lit(""))


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def to_int(c: Column) -> Column:
    """Digits, white space between them ignored, a plus sign allowed; up to 2^53 - 1."""
    text = _compact(c)
    n = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    return F.when(n <= MAX_INT, n)


def to_real(c: Column) -> Column:
    """A magnitude; with a decimal comma, dots part thousands."""
    text = _compact(c)
    plain = F.when(F.contains(text, F.lit(",")), F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), ",", ".")).otherwise(text)
    number = F.when(plain.rlike(r"^\+?([0-9]+(\.[0-9]+)?|\.[0-9]+)$"), plain.try_cast("double"))
    return F.when(number <= MAX_AMOUNT, number)


def to_signed(c: Column) -> Column:
    text = _compact(c)
    return F.when(text.startswith("-"), -to_real(F.substr(text, F.lit(2)))).otherwise(to_real(text))


def to_bool(c: Column) -> Column:
    """1, 0 or null."""
    word = F.lower(clean(c))
    return F.when(word.isin(*YES), 1).when(word.isin(*NO), 0)


def secured_inverse(c: Column) -> Column:
    """1 where the text denies."""
    return 1 - to_bool(c)


def variants_enum(c: Column) -> Column:
    return F.when(clean(c) == ALLOWED, 1).when(clean(c) == FORBIDDEN, 0)


def to_iso_date(c: Column, last: str = "2100-01-01") -> Column:
    """ISO dates and timestamps, d.m.Y and d/m/Y, from 1990 on; as text."""
    text = clean(c)
    iso = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    dotted = F.try_to_timestamp(F.regexp_replace(text, r"^(\d{1,2})[./](\d{1,2})[./](\d{4}).*$", "$1.$2.$3"), F.lit("d.M.yyyy"))
    date = F.date_format(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:T|\b)"), iso).otherwise(dotted), "yyyy-MM-dd")
    return F.when((date >= "1990-01-01") & (date <= last), date)


def csv_cell(c: Column) -> Column:
    """Formula starts are defused by an apostrophe; quotes doubled where a cell needs quoting."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike("[\",\\r\\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)
