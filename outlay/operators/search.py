"""Text search: folded tokens, an inverted index, prefix AND matching, and a bm25 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_QUERY, MAX_TOKENS, MIN_TOKEN = 160, 8, 2
# Latin letters that look like Cyrillic ones, and accented letters with their base letters.
LATIN, CYRILLIC = "abcekmhopxyt", "авсекмнорхут"
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçß", "aaaaaaeeeeiiiiooooouuuuncs"
K1, B = 1.2, 0.75


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def query_tokens(q: str) -> list[str]:
    """Lower-cased tokens of two or more letters; Latin twins become Cyrillic in tokens with any Cyrillic."""
    folded = q[:MAX_QUERY].lower().translate(str.maketrans(ACCENTED, PLAIN))
    words = "".join(ch if ch.isalnum() else " " for ch in folded).split()
    twins = str.maketrans(LATIN, CYRILLIC)
    words = [w.translate(twins) if any("Ѐ" <= ch <= "ӿ" for ch in w) else w for w in words]
    return [w for w in dict.fromkeys(words) if len(w) >= MIN_TOKEN][:MAX_TOKENS]


def inverted_index(df: DataFrame, ref: str, text: str) -> DataFrame:
    """token, ref, tf, size: write it partitioned by token to search without reading texts."""
    words = df.select(F.col(ref).alias("ref"), tokens(F.col(text)).alias("t"))
    return words.select("ref", F.size("t").alias("size"), F.explode("t").alias("token")).groupBy("token", "ref", "size").agg(F.count("*").alias("tf"))


def match(index: DataFrame, q: str) -> DataFrame:
    """ref, tf-weighted hits: documents that have, for every query token, a token starting with it."""
    wanted = query_tokens(q)
    if not wanted:
        return index.select("ref", F.lit(0).alias("hits")).limit(0)
    hit = F.array_compact(F.array(*[F.when(F.col("token").startswith(w), w) for w in wanted]))
    some = index.where(F.size(hit) > 0).select("ref", "tf", F.explode(hit).alias("w"))
    return some.groupBy("ref").agg(F.countDistinct("w").alias("n"), F.sum("tf").alias("hits")).where(F.col("n") == len(wanted)).select("ref", "hits")


def bm25(index: DataFrame, q: str) -> DataFrame:
    """ref, score of the matching documents; document frequency is counted by query token."""
    wanted = query_tokens(q)
    sizes = index.select("ref", "size").distinct().agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    hit = F.array_compact(F.array(*[F.when(F.col("token").startswith(w), w) for w in wanted]))
    per = index.where(F.size(hit) > 0).select("ref", "size", "tf", F.explode(hit).alias("w")).groupBy("ref", "size", "w").agg(F.sum("tf").alias("tf"))
    df = per.groupBy("w").agg(F.count("*").alias("df"))
    joined = per.join(F.broadcast(df), "w").join(match(index, q).select("ref"), "ref").crossJoin(F.broadcast(sizes))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return joined.groupBy("ref").agg(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))).alias("score"))
