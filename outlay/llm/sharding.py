"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

1. Every row gets its input partition and its place there (checkpointed, so a recomputed
   task can't deal anew). Only the row count of each partition reaches the driver.
2. The driver draws how many rows each partition sends to each shard: one multivariate
   hypergeometric row after another from the shards' remaining capacities. This is
   exactly the law of the counts under a uniform random permutation of all rows.
3. Each partition permutes its own multiset of shard labels and deals it to its rows.
4. After the exchange rows are permuted again within their shard: ordered by a random
   key, in ``buckets`` slices of the key's range, so that no task holds a whole shard.

Shard sizes are at most one apart. The law is ``rows``; equal texts aren't kept together,
as the drawn counts leave no room for groups.

Defined results: null text counts as empty (size 16, crc32 0); null or repeated doc_ids are
rows like any other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.workspace import materialise

OVERHEAD_BYTES = 16
#: Rows of the communication matrix at most; more input partitions share rows.
MATRIX_ROWS = 4096
#: Rows that one slice of a shard holds on average.
SLICE_ROWS = 20_000
MIN_SLICES = 16


def communication_matrix(counts: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of each partition -> exact p x shard counts with even column sums."""
    total = int(counts.sum())
    left = np.full(n_shards, total // n_shards, dtype=np.int64)
    left[: total % n_shards] += 1
    rng = np.random.default_rng([seed, 0])
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, n in enumerate(counts):
        if n:
            out[p] = _draw(rng, left, int(n))
            left -= out[p]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw by its marginals; numpy's own ends at 1e9 rows."""
    if left.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros_like(left), int(left.sum())
    for s, have in enumerate(left):
        rest -= int(have)
        out[s] = _inverted(rng, int(have), rest, n)
        n -= int(out[s])
    return out


def _inverted(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw by inversion over 40 standard deviations around its mode."""
    low, high = max(0, n - bad), min(good, n)
    total = good + bad
    mode = min(high, max(low, (good + 1) * (n + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * max(1, total - n) / max(1, total - 1)) ** 0.5
    k = np.arange(max(low, mode - int(20 * sd) - 5), min(high, mode + int(20 * sd) + 5) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(len(k) - 1, np.searchsorted(p, rng.random() * p[-1], side="right"))])


def shuffle_to_shards(docs: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),  # pandas would make floats of numbers beside nulls
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = materialise(rows)
    part = F.shiftright("_at", 33)
    per = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()}
    ids = sorted(per)
    total = sum(per.values())
    groups = np.array_split(np.arange(len(ids)), max(1, min(len(ids), MATRIX_ROWS)))
    counts = np.array([sum(per[ids[i]] for i in g) for g in groups], dtype=np.int64)
    matrix = communication_matrix(counts, n_shards, seed)
    home = {ids[i]: (k, sum(per[ids[j]] for j in g[:m])) for k, g in enumerate(groups) for m, i in enumerate(g)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, labels = None, None
        for pdf in batches:
            at = pdf["_at"].to_numpy()
            shard = np.empty(len(at), dtype=np.int32)
            pids = at >> 33
            for p in np.unique(pids):
                row, first = home[int(p)]
                if last != row:
                    labels = np.repeat(np.arange(n_shards, dtype=np.int32), matrix[row])
                    np.random.default_rng([seed, 1, row]).shuffle(labels)
                    last = row
                own = pids == p
                shard[own] = labels[first + (at[own] & ((1 << 33) - 1))]
            yield pdf.assign(shard=shard)

    dealt = rows.mapInPandas(deal, "doc_id string, size long, text_crc32 long, _at long, shard int")
    slices = max(MIN_SLICES, -(-total // (n_shards * SLICE_ROWS)))
    key = F.xxhash64("_at", F.lit(seed + 1))
    dealt = materialise(dealt.withColumn("_key", key).withColumn("_slice", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(slices)).cast("int")))
    below = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_slice").agg(F.count("*").alias("n")).select("shard", "_slice", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_key", "_at")
    return (
        dealt.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "_slice"])
        .select(
            F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("start") + F.col("_rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
