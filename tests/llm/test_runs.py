"""Periodic runs against all periods at all places, and the query on damaged documents."""

import hashlib
import random
import zlib

import pytest

from outlay.llm import runs

SCHEMA = "doc_id long, text string"


def by_hand(words):
    """(start, length, period) of each run: for each period the stretches that repeat it; smallest period first."""
    seen = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(24, 3 * p):
                seen.setdefault((s, i - s + p), p)
            i = max(i, s + 1)
    return sorted(((s, n, p) for (s, n), p in seen.items()), key=lambda r: (r[0], r[2]))


def composed(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        root, kind = [rng.choice(letters) for _ in range(rng.randint(1, 12))], rng.random()
        if kind < 0.5:
            w += (root * 12)[: rng.randint(1, 80)]
        elif kind < 0.7 and w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 90)]
        elif kind < 0.8:
            w += ((root * 9)[: rng.randint(20, 60)] + [rng.choice("xyz")]) * rng.randint(1, 5)
        else:
            w += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 40))]
    return [x.encode() for x in w]


@pytest.mark.parametrize("seed", range(8))
def test_all_runs_of_composed_words(seed, monkeypatch):
    monkeypatch.setattr(runs, "GROUP_WORDS", [50, 1 << 18][seed % 2])
    docs = [composed(random.Random(seed * 1000 + i)) for i in range(250)]
    assert runs.runs_of(docs) == [by_hand(d) for d in docs]


@pytest.mark.parametrize("words", [["a"] * 3000, (["a", "b"] * 400 + ["c"]) * 4, [f"w{i % 700}" for i in range(2101)], ["x"] * 23, list("abaababaabaab" * 9)])
def test_extreme_words(words):
    words = [w.encode() for w in words]
    assert runs.runs_of([words]) == [by_hand(words)]


def test_query(spark, sf_dir, tmp_path):
    extra = [(None, "a b " * 40), (2**60 + 1, "q\x0br s " * 30), (7, None), (8, ""), (8, " \t\n"), (9, "é　x " * 60)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, SCHEMA))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    want = {}
    for doc_id, text in docs.collect():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        own = by_hand(words)
        dropped = {i for s, m, p in own for i in range(s + p, s + m)}
        best = max(own, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
        hashes = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{p}\n" for s, m, p in own).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))]
        want.setdefault(doc_id, []).append((len(own), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4), *hashes))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_empty_table_and_clashing_columns(spark):
    assert runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    row = spark.createDataFrame([(1, "a " * 30, 5, "x")], SCHEMA + ", runs long, start string")
    r = runs.find_runs(row).collect()[0]
    assert ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) == ([(0, 30, 1)], "a", 30)
