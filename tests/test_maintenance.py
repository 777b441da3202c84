"""Windows in any order against one derive: exceptAll both ways, for every table."""

import random

import pytest

from outlay.operators import maintenance as m
from outlay.plans.refresh import rule


def windows(seed, n=3):
    rng, out = random.Random(seed), []
    ids = [None, *(f"c{i}" for i in range(12))]
    for _ in range(n):
        contracts = [(rng.choice(ids), rng.randrange(5), rng.random() < 0.15, "u", rng.choice(["a1", "a2", None]), rng.choice(["b1", "b2", "b3", None]), rng.choice(["s", None]), rng.choice([100, 700, None, -5]), rng.choice(["2024-01-01", "2024-02-02", None])) for _ in range(14)]
        annexes = [(rng.choice([None, "k1", "k2", "k3"]), rng.randrange(4), rng.choice(ids), rng.choice(["2024-03-01", "2024-04-01"]), rng.choice([50, 5000, None])) for _ in range(6)]
        out.append((contracts + contracts[:2], annexes + annexes[:1]))
    return out


def frames(spark, window):
    return spark.createDataFrame(window[0], m.CONTRACT), spark.createDataFrame(window[1], m.ANNEX)


def agree(spark, folder, step, seen):
    want = m.full(*frames(spark, ([c for w in seen for c in w[0]], [a for w in seen for a in w[1]])), rule)
    got = m.tables(spark, folder, step)
    for name, table in want.items():
        assert sorted(map(tuple, got[name].select(*table.columns).collect()), key=str) == sorted(map(tuple, table.collect()), key=str), name


@pytest.mark.parametrize("seed", [1])
def test_windows_equal_a_full_derive(seed, spark, tmp_path):
    folder, seen = str(tmp_path / "log"), []
    for step, window in enumerate(windows(seed), 1):
        m.apply_window(spark, folder, step, *frames(spark, window), rule)
        seen.append(window)
        agree(spark, folder, step, seen)
    if seed == 1:
        m.apply_window(spark, folder, 3, *frames(spark, seen[-1]), rule)  # a step that runs again
        agree(spark, folder, 3, seen)
        m.compact(spark, folder, 3, str(tmp_path / "small"))
        m.apply_window(spark, str(tmp_path / "small"), 4, *frames(spark, (seen[0][0], [])), rule)  # old rows come again
        agree(spark, str(tmp_path / "small"), 4, seen)


def test_empty_windows(spark, tmp_path):
    m.apply_window(spark, str(tmp_path), 1, *frames(spark, ([], [])), rule)
    assert {n: t.count() for n, t in m.tables(spark, str(tmp_path), 1).items()} == dict.fromkeys(["pairs", "companies", "authorities", "sectors", "served"], 0)


def test_a_windows_rows_meet_the_log_in_one_shuffle(spark, tmp_path):
    folder, window = str(tmp_path), windows(4)[0]
    m.apply_window(spark, folder, 1, *frames(spark, window), rule)
    store, delta = m.Store(spark, folder, 2), spark.createDataFrame([("s", 1, 5), (None, 1, 7)], "sector string, n long, cents long")
    had = {r["sector"]: (r["n"], r["cents"]) for r in store.current("sectors").collect()}
    added = m._added(store, "sectors", delta)
    assert added._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert {r["sector"]: (r["n"], r["cents"], r["was"]) for r in added.collect()} == {k: (had.get(k, (0, 0))[0] + 1, had.get(k, (0, 0))[1] + c, had.get(k, (0, 0))[0]) for k, c in (("s", 5), (None, 7))}
