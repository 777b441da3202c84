"""What an annex's text says of its amount: is the stated difference an increment, or the new total entered by mistake?

All in columns, so it runs inside the plan. Numbers, each with what stands before it, come out of the text by one pattern;
a fold walks over them with the position so far. Only where a number is the wanted one are the words around it
looked at: just before it for the preposition, further back for words that make it an amount of change, behind it
for a unit. Each window is cut once, and the patterns that most numbers fail come first.

Ladder: no label unless the three values are positive, add up, and the value at least doubles but
stays below ten times; a difference said to be added (``genuine_increment``); a difference said to be the total
(``total_restated``, the total); an exact doubling whose text says that nothing changed, or states the old value as the total
(``unchanged_restated``, the old value; not outside the procurement law, where doubling is legal).

Null values, null and blank texts give no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.005
#: Characters looked at before a number, further before it, and behind it.
NEAR, FAR, BEHIND = 40, 55, 60
#: What a number in a text may be, the weightiest last: the old value stated as the total, the difference so stated, the difference added.
IS_OLD, IS_TOTAL, ADDS = 1, 2, 3

# Words as they stand in the notices, where * stands for any ending.
TOTAL_WORDS = ["възлиз*", "възлез*", "става", "на"]
TOTAL_NOUNS = ["обща*", "крайн*", "нов*"]
VALUE_NOUNS = ["стойност", "цена"]
OLD_OR_ADDED = ["от", "с", "със"]
ADDED = ["с", "със"]
CHANGE_WORDS = ["в размер", "ресурс*", "допълнителн*", "увеличени*", "намалени*"]
CURRENCIES = ["лв.", "лв", "лева", "лев", "bgn", "eur", "евро", "euro", "€", "usd", "$"]
UNITS = ["дни", "дн.", "к. д.", "к.д.", "р. д.", "р.д.", "месец*", "години", "год.", "броя", "бр.", "кв.м", "кв. м", "квм", "куб.м", "куб. м", "кубм", "тона", "литра", "%", "процент*"]
UNCHANGED = ["лев* в евро", "деноминаци*", "не се промен*", "несе промен*", "остава* непромен*", "без промяна", "несъществен*"]

_SPACE = r"[\s\p{Z}\x{FEFF}]"
_FILLED = r"[^\s\p{Z}\x{FEFF}]"
_NUMBER = r"[0-9][0-9 \x{A0}\x{202F}.,]*[0-9]|[0-9]"


def _words(words: list[str], backwards: bool = False) -> str:
    """A pattern of any of the words; their spaces are any white space."""
    one = lambda c: {"*": r"\p{L}*", " ": f"{_SPACE}+", ".": r"\.", "$": r"\$"}.get(c, c)
    return "(?:" + "|".join("".join(map(one, reversed(w) if backwards else w)) for w in words) + ")"


# What stands before a number is read backwards: anchored at the number, a pattern is tried once, not at each letter.
_CLOSE = r"(?:\z|[^\p{L}0-9])"
_nouns, _before = _words(VALUE_NOUNS, True), rf"\A{_SPACE}*+"
_NOT_TOTAL = f"{_before}{_words(OLD_OR_ADDED, True)}{_CLOSE}"
_TOTAL = (
    f"(?iu)(?!{_NOT_TOTAL}){_before}(?:{_words(TOTAL_WORDS, True)}|{_nouns}{_SPACE}+{_words(TOTAL_NOUNS[:2], True)}"
    f"|{_nouns}{_SPACE}+(?:{_words(['обща'], True)}{_SPACE}+)?{_words(TOTAL_NOUNS[2:], True)}){_CLOSE}"
)
_ADDED = f"(?iu){_before}{_words(ADDED, True)}{_CLOSE}"
_VALUE_BEFORE = f"(?iu){_before}\\p{{L}}*{_nouns}"
_CHANGE = f"(?iu){_words(CHANGE_WORDS)}"
_UNIT = rf"{_SPACE}*+(?:\([^)]*\){_SPACE}*+)?(?:\p{{L}}++{_SPACE}++)?{_words(UNITS)}"
_NO_UNIT = rf"(?iu)\A(?!{_UNIT})"
_MONEY = rf"{_NO_UNIT}(?s:.*?)(?:\A|[^\p{{L}}]){_words(CURRENCIES)}(?!\p{{L}})"
_SAME = f"(?iu){_words(UNCHANGED)}"


def _bind(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def number(token: Column) -> Column:
    """A number token's value: grouped by spaces, points or commas; at most two decimals. Null for others, for zero and beyond 308 digits."""
    plain = token
    for space in " \u00a0\u202f":
        plain = F.replace(plain, F.lit(space), F.lit(""))
    return _bind(_bind(plain, _with_one_mark), _value)


def _with_one_mark(plain: Column) -> Column:
    """Of points and commas only the last kind stays."""
    both = F.contains(plain, F.lit(".")) & F.contains(plain, F.lit(","))
    last = F.regexp_extract(plain, r"([.,])[0-9]*\z", 1)
    return F.when(both, F.when(last == ".", F.replace(plain, F.lit(","), F.lit(""))).otherwise(F.replace(plain, F.lit("."), F.lit("")))).otherwise(plain)


def _value(one: Column) -> Column:
    return F.when(one.rlike(r"\A(?![0.,]*\z)0*[0-9]{1,308}(?:[.,][0-9]{1,2})?\z"), F.replace(one, F.lit(","), F.lit(".")).cast("double"))


def near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def _stated(text: Column, before: Column, delta: Column, doubled: Column) -> Column:
    """The highest rung that a number of the text reaches: ADDS, IS_TOTAL, IS_OLD (asked for only where doubled) or 0."""
    parts = F.regexp_extract_all(text, F.lit(rf"\G[^0-9]*+(?:{_NUMBER})"), F.lit(0))  # each number with what stands before it

    def back(at: Column, n: int) -> Column:
        return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))

    def rung(begin: Column, end: Column, kind: Column) -> Column:
        windows = F.struct(F.reverse(back(begin, NEAR)).alias("near"), F.substring(text, end + 1, F.lit(BEHIND)).alias("behind"))
        is_money = lambda w: w["behind"].rlike(_MONEY) | (w["near"].rlike(_VALUE_BEFORE) & w["behind"].rlike(_NO_UNIT))
        is_total = lambda w: w["near"].rlike(_TOTAL) & is_money(w) & ~back(begin, FAR).rlike(_CHANGE)
        return _bind(windows, lambda w: F.when((kind == IS_TOTAL) & w["near"].rlike(_ADDED), ADDS).when(is_total(w), kind).otherwise(0))

    def step(x: Column, part: Column) -> Column:
        end = x["at"] + F.length(part)
        kind = lambda value: F.when(near(value, delta), IS_TOTAL).when(doubled & near(value, before), IS_OLD).otherwise(0)
        # the windows only where they can change the result
        judged = lambda token, kind: F.when(kind > 0, F.greatest(x["rung"], rung(end - F.length(token), end, kind))).otherwise(x["rung"])
        of_token = lambda token: _bind(_bind(number(token), kind), lambda k: judged(token, k))
        return F.struct(end.alias("at"), F.when(x["rung"] == ADDS, ADDS).otherwise(_bind(F.regexp_extract(part, "[0-9].*", 0), of_token)).alias("rung"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("rung")), step)["rung"]


def treatment(before: Column, after: Column, delta: Column, texts: list[Column], outside: Column | None = None) -> Column:
    """struct(label, restated): see the ladder; restated is the value after the annex where the stated one is wrong."""
    filled = lambda t: F.substring(t, 1, 1).rlike(_FILLED) | t.rlike(_FILLED)  # noqa: E731  the first letter mostly tells
    said = F.array_join(F.filter(F.array(*texts), filled), "  ")
    suspect = F.coalesce((before > 0) & (after > 0) & (delta > 0) & near(after, before + delta) & (after >= 2 * before) & (after < 10 * before), F.lit(False))
    legal = F.coalesce(outside, F.lit(False)) if outside is not None else F.lit(False)
    doubled = near(after, 2 * before) & ~legal
    none = F.lit(None).cast("double")
    out = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("restated"))

    def ladder(said: Column, s: Column) -> Column:
        return (
            F.when(s == ADDS, out("genuine_increment", none)).when(s == IS_TOTAL, out("total_restated", delta))
            .when(doubled & ((s == IS_OLD) | said.rlike(_SAME)), out("unchanged_restated", before))
        )

    judged = _bind(said, lambda text: _bind(_stated(text, before, delta, doubled), lambda s: ladder(text, s)))
    return F.when(suspect, judged)


def with_treatment(annexes: DataFrame, texts: list[str], outside: str | None = None) -> DataFrame:
    """annexes(value_before, value_after, value_delta, texts...) with treatment and value_restated, as promotion wants them."""
    said = treatment(F.col("value_before"), F.col("value_after"), F.col("value_delta"), [F.col(t) for t in texts], F.col(outside) if outside else None)
    return annexes.withColumn("_said", said).withColumns({"treatment": F.col("_said.label"), "value_restated": F.col("_said.restated")}).drop("_said")
