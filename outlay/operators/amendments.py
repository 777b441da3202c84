"""Contract amendments: keys, feed precedence, chains, and linking annexes to contracts by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.005


def natural_key(unp: Column, number: Column, document: Column, correction: Column, sequence: Column, content: Column) -> Column:
    """am:procedure:number: and the first of document, correction or sequence, else a digest of the content."""
    own = F.coalesce(F.nullif(document, F.lit("")), F.nullif(correction, F.lit("")), F.nullif(sequence, F.lit("")), F.sha2(content, 256))
    return F.concat_ws(":", F.lit("am"), F.coalesce(unp, F.lit("")), F.coalesce(number, F.lit("")), own)


def unique_bridge(df: DataFrame, key: str, target: str) -> DataFrame:
    """key -> target where exactly one target is known."""
    return df.where(F.col(target).isNotNull()).groupBy(key).agg(F.countDistinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")


def prefer_primary(df: DataFrame, keys: list[str], feed: str, primary: str) -> DataFrame:
    """Without rows of other feeds whose key has any primary row; null keys never match and stay."""
    known = df.where(F.col(feed) == primary).select(*keys).distinct()
    others = df.where(~F.col(feed).eqNullSafe(primary)).join(known, keys, "left_anti")
    return df.where(F.col(feed) == primary).unionByName(others)


def latest_values(amendments: DataFrame, keys: list[str]) -> DataFrame:
    """Annex count, and the value after the latest annex that has one (restated values first)."""
    value = F.coalesce("value_restated", "value_after") if "value_restated" in amendments.columns else F.col("value_after")
    order = F.when(value.isNotNull(), F.struct("published_at", "key"))
    return amendments.groupBy(*keys).agg(F.count("*").alias("annexes"), F.max_by(value, order).alias("current_value"))


def _with_earlier_totals(a: DataFrame, own: list[str]) -> DataFrame:
    """any_prev, legit_prev: a total within 1 % of the base, and one that is below twice its own base.

    Totals and the lower ends of the bases' bands lie on one line; the next total above a band's end is in the band or none is.
    """
    base, total = F.col("value_before"), F.col("value_after")
    legit = (base > 0) & (total < 2 * base)
    points = a.where(total > 0).groupBy(*own, total.alias("v")).agg(F.bool_or(F.coalesce(legit, F.lit(False))).alias("legit"))
    points = points.select(*own, "v", F.lit(None).cast("double").alias("base"), F.col("v").alias("any"), F.when(F.col("legit"), F.col("v")).alias("good"))
    bands = a.where(base > 0).select(*own, (base - 0.01 * base).alias("v"), base.cast("double").alias("base"), F.lit(None).cast("double").alias("any"), F.lit(None).cast("double").alias("good")).distinct()
    # from the greatest value down; at one value the total comes after the band, so the band doesn't see it
    down = Window.partitionBy(*own).orderBy(F.desc("v"), F.col("base").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    line = points.withColumn("v", F.col("v").cast("double")).unionByName(bands)
    nearest = line.select(*own, "base", F.last("any", ignorenulls=True).over(down).alias("any"), F.last("good", ignorenulls=True).over(down).alias("good")).where("base is not null")
    inside = lambda c: F.coalesce(F.col(c) < F.col("base") + 0.01 * F.col("base"), F.lit(False))
    found = nearest.groupBy(*own, "base").agg(F.bool_or(inside("any")).alias("any_prev"), F.bool_or(inside("good")).alias("legit_prev"))
    found = found.select(*(F.col(c).alias(f"_{c}") for c in own), F.col("base").alias("_base"), "any_prev", "legit_prev")
    same = F.col("unp").eqNullSafe(F.col("_unp")) & F.col("number").eqNullSafe(F.col("_number")) & (F.col("value_before") == F.col("_base"))
    no = F.lit(False)
    return a.join(found, same, "left").select(*a.columns, F.coalesce("any_prev", no).alias("any_prev"), F.coalesce("legit_prev", no).alias("legit_prev"))


def chain_flags(contracts: DataFrame, amendments: DataFrame) -> DataFrame:
    """id, step10, doubled of contracts(id, unp, number, signing, current): see the value-flag ladder.

    Whether some annex's total stands behind another's base is read off one sorted pass over each contract's totals and
    bases, so a long chain costs its sort, not its square; only booleans go on.
    """
    own = ["unp", "number"]
    a = amendments.select("key", *own, "value_before", "value_after", "value_delta", "treatment")
    seen = _with_earlier_totals(a, own)
    j = contracts.select("id", *own, "signing", "current").join(seen, own)
    b, v = F.col("value_before"), F.col("value_after")
    anchored = (F.abs(b - F.col("signing")) < 0.01 * F.col("signing")) | F.col("legit_prev") | ((F.abs(v - 2 * b) < 0.005 * b) & ~F.col("any_prev"))
    consistent = F.col("value_delta").isNull() | (F.abs(v - (b + F.col("value_delta"))) < 0.01 * v)
    doubled = F.col("treatment").isNull() & (b > 0) & anchored & (v >= 2 * b) & (v < 10 * b) & consistent & (F.abs(v - F.col("current")) < 0.01)
    per = j.groupBy("id").agg(F.bool_or(F.coalesce((b > 0) & (v >= 10 * b), F.lit(False))).alias("step10"), F.bool_or(F.coalesce(doubled, F.lit(False))).alias("doubled"))
    no = F.lit(False)
    return contracts.select("id").join(per, "id", "left").select("id", F.coalesce("step10", no).alias("step10"), F.coalesce("doubled", no).alias("doubled"))


def resolve_by_value(annexes: DataFrame, contracts: DataFrame) -> DataFrame:
    """key -> number: annexes without a contract number linked by the value they start from.

    A match has the same procedure and currency, a signed value within half a cent of the annex's
    base, and no contradicting supplier. Only a single match links. The other annexes of a group (same
    procedure and raw number) follow if all its direct links agree and they have no match of their own.
    """
    values = ["unp", "currency", "value_before", "supplier"]
    cell = lambda v: F.floor(v / (2 * TOLERANCE))  # noqa: E731  values that near lie in one cell or in neighbours
    wanted = annexes.select(*values).distinct().withColumn("cell", F.explode(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: cell(F.col("value_before")) + i)))
    offers = contracts.where("number is not null").groupBy("unp", "currency", "signing", F.col("supplier").alias("c_supplier")).agg(F.count_distinct("number").alias("n"), F.min("number").alias("to")).withColumn("cell", cell(F.col("signing")))
    near = F.abs(F.col("signing") - F.col("value_before")) < TOLERANCE
    same = F.col("supplier").isNull() | F.col("c_supplier").isNull() | (F.col("supplier") == F.col("c_supplier"))
    # equal values are one row on either side, so repeated values don't multiply
    matched = wanted.join(offers, ["unp", "currency", "cell"]).where(near & same).groupBy(*values).agg(F.max("n").alias("n"), F.count_distinct("to").alias("k"), F.min("to").alias("to"))
    matched = matched.select(*(F.col(c).alias(f"_{c}") for c in values), ((F.col("n") == 1) & (F.col("k") == 1)).alias("single"), "to")
    on = (F.col("unp") == F.col("_unp")) & (F.col("currency") == F.col("_currency")) & (F.col("value_before") == F.col("_value_before")) & F.col("supplier").eqNullSafe(F.col("_supplier"))
    joined = annexes.join(matched, on, "left")
    direct = joined.where("single").select("key", "unp", "raw_number", "to")
    agreed = direct.groupBy("unp", "raw_number").agg(F.countDistinct("to").alias("n"), F.min("to").alias("to")).where("n = 1").drop("n")
    rest = joined.where("single is null").drop("to").join(agreed, ["unp", "raw_number"])
    link = lambda df, how: df.select("key", F.col("to").alias("number"), F.lit(how).alias("method"))
    return link(direct, "value").unionByName(link(rest, "group"))
