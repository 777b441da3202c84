"""Chunked export: a broken run that goes on gives the same bytes, and readers see whole versions only."""

import hashlib

from outlay.sources import export as x

ROWS = [(None, "first", 1.5)] + [(f"k{i:05d}", f'a "{i}",é\nb' if i % 7 == 0 else f"=v{i}", i / 4) for i in range(3000)] + [("k00005", "again", None)] * 2
COLUMNS = ["id", "name", "value"]


def content(spark, folder):
    return b"".join(open(p.removeprefix("file:"), "rb").read() for p in x.current(spark, folder))


def test_resumed_bytes_are_the_same(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id string, name string, value double")
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    manifest = x.export(df, "id", COLUMNS, whole, "v1", chunk_rows=400, batch_chunks=3)
    assert len(manifest["chunks"]) > 5
    assert x.export(df, "id", COLUMNS, broken, "v1", chunk_rows=400, batch_chunks=3, jobs=1) is None and x.current(spark, broken) == []
    again = x.export(df.repartition(3), "id", COLUMNS, broken, "v1", chunk_rows=999, batch_chunks=2)
    assert {c: v["sha256"] for c, v in again["chunks"].items()} == {c: v["sha256"] for c, v in manifest["chunks"].items()}
    data = content(spark, whole)
    assert data == content(spark, broken) and data.startswith("\ufeffid,name,value\r\n,first,1.5\r\n".encode())
    assert all(hashlib.sha256(open(f.removeprefix("file:"), "rb").read()).hexdigest() == v["sha256"] for f, v in zip(x.current(spark, whole), manifest["chunks"].values(), strict=True))
    keys = [line.split(b",")[0] for line in data.split(b"\r\n")[1:-1]]
    assert keys == sorted(keys) and len(keys) == len(ROWS)


def test_switch_and_empty(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:5], "id string, name string, value double")
    x.export(df.limit(0), "id", COLUMNS, str(tmp_path), "v1")
    assert content(spark, str(tmp_path)) == "\ufeffid,name,value\r\n".encode()
    x.export(df, "id", COLUMNS, str(tmp_path), "v2")
    assert content(spark, str(tmp_path)).count(b"\r\n") == 6


def test_batches_read_the_table_a_few_times_only(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(ROWS, "id string, name string, value double")
    x.export(df.mapInArrow(count, df.schema), "id", COLUMNS, str(tmp_path), "v1", chunk_rows=200, batch_chunks=2)
    assert len(x.current(spark, str(tmp_path))) > 10
    assert seen.value <= 5 * len(ROWS)
    assert not (tmp_path / "v1" / "_lines").exists()
