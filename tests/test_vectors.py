"""Vector search: the index with all probes is exact, fewer probes find clustered rows, edges are defined."""

import numpy as np
from pyspark.sql import functions as F

from outlay.operators import vectors as v


def rows(spark, data, extra=()):
    return spark.createDataFrame([*data, *extra], "id long, ns string, e array<double>")


def test_exact_and_clustered(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    data = [(i, "ab"[i % 2], (centres[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(900)]
    extra = [(None, "a", [1.0] * 16), (901, "a", None), (902, "a", [float("nan")] * 16), (903, "a", [None] * 16), (904, "a", [0.0] * 16), (905, "a", [1.0, 2.0]), (906, None, [1.0] * 16), (907, None, [1.0, *[0.5] * 15]), (5, "b", data[5][2]), (908, "a", [])]
    ready = v.prepared(rows(spark, data, extra), "id", "e", F.col("ns"))
    centre = v.fit(ready, 12)
    v.write_index(ready, centre, str(tmp_path / "index"))
    queries = ready.where("id % 50 = 0 OR id >= 905")
    exact = v.search(spark, str(tmp_path / "index"), centre, queries, 5, 12)
    got = {}
    for r in exact.collect():
        got.setdefault((r["query"], r["ns"]), []).append((r["rank"], r["id"]))
    whole = {(i, ns): np.floor(np.array(e) * 1024) for i, ns, e in data}
    for (q, ns), best in got.items():
        if q < 900:
            own = whole[q, ns]
            score = sorted((-float(own @ x) / np.sqrt(float(own @ own) * float(x @ x)), i) for (i, n), x in whole.items() if n == ns and i != q)
            if q % 12 != 5:
                assert [i for _, i in sorted(best)] == [i for _, i in score[:5]]
    assert got[906, v.NO_NAMESPACE] == [(1, 907)] and (905, "a") not in got and len(got) == 20
    quick = v.search(spark, str(tmp_path / "index"), centre, queries.where("id < 900"), 5, 3)
    shares = v.recall(quick, exact.where("query < 900")).collect()
    assert sum(r["queries"] for r in shares) == 18 and all(r["recall"] >= 0.9 for r in shares)


def test_empty(spark, tmp_path):
    ready = v.prepared(rows(spark, []), "id", "e", F.col("ns"))
    centre = v.fit(ready, 4)
    v.write_index(ready, centre, str(tmp_path / "index"))
    assert v.search(spark, str(tmp_path / "index"), centre, ready, 3, 4).count() == 0
