"""Names of people: is the holder of a stake the declarant, and which registry entries hold a declarant's whole name?

A name is its words of letters in upper case, in any order; of one letter, a word is an initial. Letters written as two
characters (И with a breve or grave) are put together; other composed letters must be composed already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPOSED = {"\u0418\u0306": "\u0419", "\u0438\u0306": "\u0439", "\u0418\u0300": "\u040d", "\u0438\u0300": "\u045d"}


def tokens(name: Column) -> Column:
    """Words of letters, upper case, in order; null has none."""
    out = F.coalesce(name, F.lit(""))
    for two, one in _COMPOSED.items():
        out = F.replace(out, F.lit(two), F.lit(one))
    return F.filter(F.split(F.upper(out), r"[^\p{L}]+"), lambda t: t != "")


def full_tokens(name: Column) -> Column:
    """The distinct words of two letters or more: an abbreviated name is short."""
    return F.array_distinct(F.filter(tokens(name), lambda t: F.length(t) >= 2))


def _take(rest: Column, words: Column, of: Column) -> Column:
    """struct(rest, missed): each word takes one entry of `rest` whose value in `of`-form is equal, or is missed."""

    def step(x: Column, w: Column) -> Column:
        at = F.array_position(of(x["rest"]), w)
        left = F.concat(F.slice(x["rest"], F.lit(1), at.cast("int") - 1), F.slice(x["rest"], at.cast("int") + 1, F.size(x["rest"])))
        return F.when(at > 0, F.struct(left.alias("rest"), x["missed"].alias("missed"))).otherwise(F.struct(x["rest"].alias("rest"), (x["missed"] + 1).alias("missed")))

    return F.aggregate(words, F.struct(rest.alias("rest"), F.lit(0).alias("missed")), step)


def relation(holder: Column, declarant: Column) -> Column:
    """self, related or unknown.

    self: no holder at all, or at least two words that all stand in the declarant's name, each word of it used once, full
    words before initials. related: two or more full words that the declarant lacks. All else is unknown.
    """
    own, held = tokens(declarant), tokens(holder)
    full, initials = F.filter(held, lambda t: F.length(t) > 1), F.filter(held, lambda t: F.length(t) == 1)
    first = lambda words: F.transform(words, lambda t: F.substring(t, 1, 1))

    def verdict(x: Column) -> Column:
        short = F.transform(F.array(_take(x["rest"], initials, first)), lambda y: y["missed"])[0]
        missed = x["missed"] + short
        return F.when(missed == 0, F.when(F.size(held) >= 2, "self").otherwise("unknown")).when(x["missed"] >= 2, "related").otherwise("unknown")

    judged = F.transform(F.array(_take(own, full, lambda words: words)), verdict)[0]
    blank = F.coalesce(holder, F.lit("")).rlike(r"\A[\s\p{Z}]*\z")
    return F.when(blank, "self").when((F.size(own) == 0) | (F.size(held) == 0), "unknown").otherwise(judged)


def holds_name(declarant: Column, entry: Column) -> Column:
    """Does every full word of the declarant stand in the entry? A declarant without one is nowhere."""
    want = full_tokens(declarant)
    return (F.size(want) > 0) & (F.size(F.array_except(want, full_tokens(entry))) == 0)


def whole_names(declarants: DataFrame, entries: DataFrame, person: str, entry: str, name: str) -> DataFrame:
    """person, entries (how many hold the whole name), least (the smallest of them): a set-containment join.

    Equal word sets are one row on either side. Each wanted set is posted under the rarest of its words, as the entries
    use them, so it meets only entries with that word, never all; a set with a word that no entry has meets none. Persons
    without a match get no row; null persons and entries are persons and entries like any other.
    """
    sets = lambda df, key: df.select(F.col(key), F.sort_array(full_tokens(F.col(name))).alias("words")).where(F.size("words") > 0)
    held = sets(entries, entry).groupBy("words").agg(F.count("*").alias("n"), F.min(entry).alias("least"))
    wanted = sets(declarants, person)
    asked = wanted.select("words").distinct()
    posted = held.select("words", "n", "least", F.explode("words").alias("word"))
    weight = posted.groupBy("word").agg(F.count("*").alias("df"))
    rarest = asked.select("words", F.explode("words").alias("word")).join(weight, "word", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r"))
    probes = rarest.where("r.df > 0").select(F.col("words").alias("want"), F.col("r.word").alias("word"))
    fits = probes.join(posted, "word").where(F.size(F.array_except("want", "words")) == 0)
    found = fits.groupBy(F.col("want").alias("words")).agg(F.sum("n").alias("entries"), F.min("least").alias("least"))
    return wanted.join(found, "words").select(person, "entries", "least")
