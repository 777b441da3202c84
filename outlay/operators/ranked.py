"""Ranked search by kind on a stored index.

``write_index`` writes postings once, cut into files by ranges of tokens and sorted inside; a query's prefixes are
ranges of tokens, so the scan skips the files and row groups of all others and never sees a text. ``results`` takes the
entries that have, for each query word, a token that starts with it, and ranks them by bm25 (a word's frequency is that of
its tokens together, over all kinds; a word that more than half of the entries have weighs next to nothing). Each kind has
its own best rows and its own total.

Words are those of ``search.query_tokens`` and ``search.tokens``. Ties in score (six decimals) go by reference. Entries with
a null text have no tokens but count; a null kind is a kind; repeated entries are one, their tokens counted together. A query
without words has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.operators.search import K1, B, query_tokens, tokens

LEAST_IDF = 1e-6
#: Entries that one task of an index's writing cuts into words, about.
TASK_ENTRIES = 50_000
POSTINGS = "token string, kind string, ref string, tf long, size long"


def entries(df: DataFrame, kind: str, ref: str, *texts: str) -> DataFrame:
    """kind, ref, text of a table's rows; their texts one after the other."""
    return df.select(F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), F.concat_ws(" ", *texts).alias("text"))


def write_index(found: DataFrame, folder: str) -> None:
    """Postings and totals of entries(kind, ref, text)."""
    # an entry's rows meet before their words are told apart; a task has so many entries, whatever the input
    parts = max(1, -(-found.count() // TASK_ENTRIES))
    words = found.repartition(parts, "kind", "ref").select("kind", "ref", tokens(F.col("text")).alias("t"))
    sizes = words.groupBy("kind", "ref").agg(F.sum(F.size("t")).cast("long").alias("size"))
    tf = words.select("kind", "ref", F.explode("t").alias("token")).groupBy("kind", "ref", "token").agg(F.count("*").alias("tf"))
    same = tf["kind"].eqNullSafe(sizes["kind"]) & tf["ref"].eqNullSafe(sizes["ref"])
    postings = tf.join(sizes, same).select("token", tf["kind"], tf["ref"], "tf", "size")
    # a very frequent token spreads over several files: the range goes on into kind and reference
    postings.repartitionByRange("token", "kind", "ref").sortWithinPartitions("token", "kind", "ref").write.parquet(f"{folder}/postings")
    sizes.agg(F.count("*").alias("entries"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean")).coalesce(1).write.parquet(f"{folder}/totals")


def _starts(word: str) -> Column:
    """A range on the token, which the scan can push down."""
    return (F.col("token") >= word) & (F.col("token") < word + chr(0x10FFFF))


def scored(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """kind, ref, score of all entries that match."""
    wanted = query_tokens(query)
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    if not wanted:
        return postings.select("kind", "ref", F.lit(0.0).alias("score")).limit(0)
    hit = postings.where(reduce(lambda a, b: a | b, map(_starts, wanted)))
    of = [F.sum(F.when(_starts(w), F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    per = hit.groupBy("kind", "ref").agg(F.first("size").alias("size"), *of)
    known = per.agg(*(F.count(f"tf{i}").alias(f"df{i}") for i in range(len(wanted))))
    totals = spark.read.parquet(f"{folder}/totals")
    both = per.where(reduce(lambda a, b: a & b, (F.col(f"tf{i}").isNotNull() for i in range(len(wanted)))))
    rows = both.join(F.broadcast(known.join(F.broadcast(totals))))  # one row each

    def part(i: int) -> Column:
        n, df, tf = F.col("entries"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))

    return rows.select("kind", "ref", F.round(reduce(lambda a, b: a + b, map(part, range(len(wanted)))), 6).alias("score"))


def results(spark: SparkSession, folder: str, query: str, limits: dict[str, int]) -> DataFrame:
    """kind, rank, ref, score, total: each kind's best entries and how many match in all."""
    found = scored(spark, folder, query)
    limit = reduce(lambda out, item: F.when(F.col("kind") == item[0], item[1]).otherwise(out), limits.items(), F.lit(0))
    best = Window.partitionBy("kind").orderBy(F.desc("score"), "ref")
    top = found.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= max(limits.values(), default=0)) & (F.col("rank") <= limit))
    return top.join(F.broadcast(found.groupBy("kind").agg(F.count("*").alias("total"))), "kind").select("kind", "rank", "ref", "score", "total")  # a row a kind


def groups(found: DataFrame, order: list[str], leader: str) -> DataFrame:
    """kind, total, best, place: the leader's group first if no other is better, else last; the others in order."""
    per = found.groupBy("kind").agg(F.first("total").alias("total"), F.max("score").alias("best"))
    top = per.agg(F.max(F.when(F.col("kind") != leader, F.col("best"))).alias("_other"))
    place = reduce(lambda out, k: F.when(F.col("kind") == k, order.index(k) + 1).otherwise(out), order, F.lit(len(order) + 1))
    first = F.col("_other").isNull() | (F.col("best") >= F.col("_other"))
    led = per.join(F.broadcast(top)).withColumn("_at", F.when(F.col("kind") == leader, F.when(first, 0).otherwise(len(order) + 2)).otherwise(place))
    return led.select("kind", "total", "best", F.row_number().over(Window.orderBy("_at", "kind")).alias("place"))  # a row a kind
