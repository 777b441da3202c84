"""Ranked search on a stored index: what is read, and its edges."""

import math

from pyspark.sql import functions as F

from outlay.operators import ranked

ROWS = [("a", "1", "Red ring red"), ("a", "2", "red"), ("a", "3", None), (None, "4", "reddish blue ring"), ("b", "5", "ring"), ("b", "5", "redder"), ("b", None, "red ring"), ("b", "6", ""), ("c", "7", "x " * 5000 + "red ring")]


def test_scores_ties_and_nulls(spark, tmp_path):
    found = spark.createDataFrame(ROWS, "kind string, ref string, text string")
    ranked.write_index(found, str(tmp_path))
    got = ranked.results(spark, str(tmp_path), "RED", {"a": 1, "b": 9, "c": 9})
    assert [(r["kind"], r["rank"], r["ref"], r["total"]) for r in got.orderBy("kind", "rank").collect()] == [("a", 1, "1", 2), ("b", 1, None, 2), ("b", 2, "5", 2), ("c", 1, "7", 1)]
    sizes = {("a", "1"): 3, ("a", "2"): 1, ("a", "3"): 0, (None, "4"): 3, ("b", "5"): 2, ("b", None): 2, ("b", "6"): 0, ("c", "7"): 5002}
    mean = sum(sizes.values()) / len(sizes)
    both = {(r["kind"], r["ref"]): r["score"] for r in ranked.scored(spark, str(tmp_path), "re ri").collect()}
    df = {"re": 6, "ri": 5}
    want = {}
    for key, (re_, ri) in {("a", "1"): (2, 1), (None, "4"): (1, 1), ("b", "5"): (1, 1), ("b", None): (1, 1), ("c", "7"): (1, 1)}.items():
        part = lambda w, tf: max(math.log((8 - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[key] / mean))  # noqa: B023, E731
        want[key] = round(part("re", re_) + part("ri", ri), 6)
    assert both == want
    assert ranked.results(spark, str(tmp_path), " ?! x", {"a": 5}).count() == 0
    plan = ranked.scored(spark, str(tmp_path), "zorg")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,zorg)" in plan and "text" not in plan


def test_group_order_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5, 3), ("lead", 1, 0.5, 1), ("b", 1, 0.2, 2)], "kind string, rank int, score double, total long")
    order = lambda df: [(r["kind"], r["place"]) for r in ranked.groups(df, ["b", "a"], "lead").orderBy("place").collect()]
    assert order(rows) == [("lead", 1), ("b", 2), ("a", 3)]
    assert order(rows.withColumn("score", F.when(F.col("kind") == "lead", 0.1).otherwise(F.col("score")))) == [("b", 1), ("a", 2), ("lead", 3)]
    assert order(rows.where("kind = 'lead'")) == [("lead", 1)]
    ranked.write_index(spark.createDataFrame([], "kind string, ref string, text string"), str(tmp_path))
    assert ranked.results(spark, str(tmp_path), "red", {"a": 1}).count() == 0


def test_index_is_the_same_in_many_small_tasks(spark, tmp_path, monkeypatch):
    rows = [("a", str(i % 40), f"alpha w{i % 7} w{i}") for i in range(90)] + [(None, None, None)]
    found = spark.createDataFrame(rows, "kind string, ref string, text string")
    got = []
    for n in (50_000, 7):
        monkeypatch.setattr(ranked, "TASK_ENTRIES", n)
        ranked.write_index(found, str(tmp_path / str(n)))
        got.append([sorted(map(str, spark.read.parquet(str(tmp_path / str(n) / t)).collect())) for t in ("postings", "totals")])
    assert got[0] == got[1]
