"""A table as CSV in chunks that a broken run can go on with, and that readers see all at once.

``export`` cuts the table into ranges of its key, once, and keeps the borders in the version's folder. Where several batches
of chunks are missing, a run writes the lines once, by batch, so that each batch reads its own alone. A run writes a
batch of chunks per job, each chunk one file in order of the key, and then says so in the manifest, with every chunk's bytes,
rows and SHA-256. A run that starts again reads borders and manifest and writes what is missing: the bytes are those of a run
without a break. When all chunks are there, ``current`` is switched to the version by one rename.

The first chunk opens with a byte-order mark and the header; lines end with CR LF. Chunks in order are one file. Everything
goes through the cluster's file system. Rows with a null key come first; rows of one key stay in one chunk, ordered by
their line; an empty table has the header alone. Borders come from at most SAMPLE keys, so chunk sizes are about even.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions.coerce import csv_cell

BOM, END = "\ufeff", "\r\n"
CHUNK_ROWS, BATCH_CHUNKS, SAMPLE = 100_000, 64, 20_000


class Folder:
    """Small files of a folder, on whatever file system it is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> dict | None:
        at = self._at(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def replace(self, name: str, value: dict) -> None:
        """By a rename: readers see the old file or the new one."""
        new, jvm = self._at(f"{self.path}/.{name}.new"), self.spark._jvm
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, self._at(f"{self.path}/{name}"), over)


def borders(df: DataFrame, key: str, chunk_rows: int) -> list[str]:
    """Keys (as text) at which chunks after the first begin."""
    n = df.count()
    chunks = max(1, -(-n // chunk_rows))
    if chunks == 1:
        return []
    every = max(1, n // SAMPLE)
    seen = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(F.col(key).cast("string").alias("k")).distinct().limit(2 * SAMPLE).collect()
    keys = sorted(r["k"].encode() for r in seen)  # as Spark orders text
    return [k.decode() for k in sorted({keys[len(keys) * i // chunks] for i in range(1, chunks)})] if keys else []


def lines(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.concat_ws(",", *(F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in columns)).alias("line"))


def _with_chunk(rows: DataFrame, begins: list[str], todo: list[int], batch_chunks: int) -> DataFrame:
    """Lines of the chunks to do, with their chunk and the first chunk of its batch."""
    starts = [b.encode() for b in begins]
    batch_of = {c: todo[i - i % batch_chunks] for i, c in enumerate(todo)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = [0 if k is None else bisect_right(starts, k.encode()) for k in batch.column(0).to_pylist()]
            of = pa.array([batch_of.get(c) for c in chunk], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int32()), of], names=["key", "line", "chunk", "of"]).filter(of.is_valid())

    return rows.mapInArrow(place, "key string, line string, chunk int, of int")


def export(df: DataFrame, key: str, columns: list[str], folder: str, version: str, chunk_rows: int = CHUNK_ROWS, batch_chunks: int = BATCH_CHUNKS, jobs: int | None = None) -> dict | None:
    """Writes a version (or goes on with it) and returns its manifest; with `jobs`, stops after so many and returns None unless done."""
    spark = df.sparkSession
    own = Folder(spark, f"{folder}/{version}")
    plan = own.read("plan.json")
    if plan is None:
        plan = {"key": key, "columns": columns, "begins": borders(df, key, chunk_rows)}
        own.replace("plan.json", plan)
    if (plan["key"], plan["columns"]) != (key, columns):
        raise ValueError(f"version {version} was begun with other columns")
    manifest = own.read("manifest.json") or {"chunks": {}}
    todo = [c for c in range(len(plan["begins"]) + 1) if str(c) not in manifest["chunks"]]
    placed = _with_chunk(lines(df, key, columns), plan["begins"], todo, batch_chunks)
    if len(todo) > batch_chunks and (jobs is None or jobs > 0):
        by_batch = f"{folder}/{version}/_lines"
        placed.repartition("chunk").write.mode("overwrite").partitionBy("of").parquet(by_batch)
        placed = spark.read.schema(placed.schema).parquet(by_batch)
    head = spark.createDataFrame([(None, BOM + ",".join(columns), 0, 0)], "key string, line string, chunk int, place int")
    while todo and (jobs is None or jobs > 0):
        batch, todo = todo[:batch_chunks], todo[batch_chunks:]
        rows = placed.where(F.col("of") == batch[0]).select("key", "line", "chunk", F.lit(1).alias("place"))
        rows = rows.unionByName(head) if 0 in batch else rows
        target = f"{folder}/{version}/batch={batch[0]}"
        # one partition for each chunk of the batch: chunks are told by their rank in it
        rank = F.array_position(F.array(*(F.lit(c) for c in batch)), F.col("chunk")).cast("int") - 1
        dealt = rows.withColumn("rank", rank).repartitionByRange(len(batch), "rank").sortWithinPartitions("chunk", "place", F.asc_nulls_first("key"), "line")
        dealt.select("line", "chunk").write.mode("overwrite").partitionBy("chunk").option("lineSep", END).text(target)
        manifest["chunks"] |= _said(spark, target, f"{folder}/{version}/", batch)
        own.replace("manifest.json", manifest)
        jobs = None if jobs is None else jobs - 1
    own.drop("_lines")
    if todo:
        return None
    Folder(spark, folder).replace("current.json", {"version": version})
    return manifest


def _said(spark: SparkSession, target: str, base: str, batch: list[int]) -> dict:
    """What was written: a chunk's file (none if no key fell into it), bytes and digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target).where(F.col("path").rlike(r"chunk=[0-9]+/part-"))
    told = files.select(F.regexp_extract("path", r"chunk=([0-9]+)/", 1).alias("chunk"), F.regexp_extract("path", r"(batch=[0-9]+/chunk=[0-9]+/part-.*)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256")).collect()
    found = {r["chunk"]: {"file": r["file"], "bytes": r["length"], "sha256": r["sha256"]} for r in told}
    return {str(c): found.get(str(c)) for c in batch}


def current(spark: SparkSession, folder: str) -> list[str]:
    """Files of the version in service, in order."""
    now = Folder(spark, folder).read("current.json")
    if now is None:
        return []
    chunks = Folder(spark, f"{folder}/{now['version']}").read("manifest.json")["chunks"]
    return [f"{folder}/{now['version']}/{c['file']}" for _, c in sorted(chunks.items(), key=lambda x: int(x[0])) if c]
