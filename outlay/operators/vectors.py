"""Search by meaning in namespaces: an inverted file of centroids and lists, with exact scores for what is read.

``fit`` takes centroids from a bounded sample; ``write_index`` puts every row into the list of its nearest centroid, a
folder per namespace and list; ``search`` reads for each query the lists of its nearest centroids only (the
others' folders are pruned) and ranks their rows by exact cosine. With as many probes as lists the result is exact. How
much fewer probes find depends on the data: ``recall`` measures it against the exact result.

Components are kept as whole numbers (floor of SCALE times each), so scores are equal on every machine. A query has one
result in its namespace: its best k by score, then id; its own id is no candidate. Rows without id, with a null or
non-finite component or of length zero take no part; repeated ids are candidates each; another number of dimensions never
meets. A null namespace is a namespace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Rows that centroids are fitted on at most, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 20_000, 8
NO_NAMESPACE = "__none__"


def prepared(rows: DataFrame, key: str, vector: str, namespace: Column) -> DataFrame:
    """id, ns, v (whole numbers), norm (their squares' sum)."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    out = rows.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), F.coalesce(namespace.cast("string"), F.lit(NO_NAMESPACE)).alias("ns"), whole.alias("v"))
    return out.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)).where("norm > 0")


def fit(rows: DataFrame, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means on at most SAMPLE_ROWS prepared rows of the commonest dimension."""
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return np.zeros((1, 1))
    sample = rows.where(F.size("v") == dims[0]["d"]).select("v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("v").toArrow()
    x = np.array(sample.column(0).to_pylist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    return centre


def _with_lists(rows: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """Each row once for each of its nearest lists (column ``list``); other dimensions belong to list 0."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)  # lists x dimensions: both parameters

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = min(probes, len(c))  # nearest first
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            near = np.tile(np.arange(n, dtype=np.int32) if n == len(c) else np.zeros(n, np.int32), (len(vectors), 1))
            fits = [i for i, v in enumerate(vectors) if len(v) == c.shape[1]]
            if fits:
                score = np.array([vectors[i] for i in fits], dtype=np.float64) @ c.T
                near[fits] = np.argsort(-score, axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    placed = rows.mapInArrow(assign, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, lists array<int>")
    return placed.select(*rows.columns, F.posexplode(F.array_distinct("lists")).alias("probe", "list"))


def write_index(rows: DataFrame, centre: np.ndarray, folder: str) -> None:
    """Every prepared row into its list; big lists are spread over files by id."""
    _with_lists(rows, centre, 1).drop("probe").repartition("ns", "list", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("ns", "list").parquet(folder)


def search(spark: SparkSession, folder: str, centre: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query, ns, rank, id, score, probe (how many nearer lists were read before) of prepared queries (id, ns, v, norm)."""
    index = spark.read.schema("id long, v array<int>, norm long, ns string, list int").parquet(folder)
    asked = _with_lists(queries.groupBy("id", "ns").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm")), centre, probes)
    asked = asked.select(F.col("id").alias("query"), "ns", "list", "probe", F.col("v").alias("q"), F.col("norm").alias("q_norm"))
    met = asked.join(index, ["ns", "list"]).where((F.col("id") != F.col("query")) & (F.size("q") == F.size("v")))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = met.select("query", "ns", "id", "probe", (dot / F.sqrt((F.col("q_norm") * F.col("norm")).cast("double"))).alias("score"))
    # the rank's limit is applied in each task before the exchange
    best = Window.partitionBy("ns", "query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "ns", "rank", "id", "score", "probe")


def needed_probes(exact: DataFrame, target: float) -> int:
    """The fewest probes that find the target share of an exact result's rows: read off the places of their lists."""
    per = sorted((r["probe"], r["count"]) for r in exact.groupBy("probe").count().collect())  # a row a list
    total, seen = sum(n for _, n in per), 0
    for probe, n in per:
        seen += n
        if seen >= target * total:
            return probe + 1
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """ns, queries, share of the exact result's rows that were found."""
    key = ["ns", "query", "id"]
    hits = exact.join(found.select(*key, F.lit(1).alias("hit")).distinct(), key, "left")
    return hits.groupBy("ns").agg(F.count_distinct("query").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
