"""Keyed state with time to live: batches, repeats and eviction give what one pass over the log gives."""

import datetime as dt
import random

import pytest

from outlay.streaming import verdicts

DAY = dt.timedelta(days=1)
BEGIN = dt.datetime(2024, 1, 1)


def log_rows(seed, n=600):
    rng, out = random.Random(seed), []
    for _ in range(n):
        event = rng.choice(["fetched", "absent", "verdict", "verdict"])
        company, at = f"c{rng.randrange(12)}", BEGIN + DAY * rng.randrange(160) + dt.timedelta(seconds=rng.randrange(5))
        link = f"{company}:{rng.randrange(3)}" if event == "verdict" else ""
        out.append((company, link, event, rng.choice(["confirmed", "refuted"]) if link else None, bool(link), "v1" if link else None, str(rng.randrange(4)) if link else None, at))
    return sorted(out, key=lambda r: r[-1])


def by_hand(rows, now):
    state = {}
    for company in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == company]
        fetched = max((r[-1] for r in own if r[2] == "fetched"), default=dt.datetime.min)
        gone = sorted({r[-1] for r in own if r[2] == "absent"}, reverse=True) + [dt.datetime.min] * 2
        last = max(fetched, gone[0])
        if last > dt.datetime.min and last + 35 * DAY > now:
            kind = "fetched" if fetched >= gone[0] else "outside" if gone[1] > max(fetched, gone[0] - 35 * DAY) else "pending"
            state[company, ""] = (last, kind)
        for link in {r[1] for r in own if r[1]}:
            at, kind, _ = max((r[-1], r[3], r[6]) for r in own if r[1] == link)
            if at + 45 * DAY > now:
                state[company, link] = (at, kind)
    return state


@pytest.fixture
def run(spark, tmp_path):
    def go(batches, **options):
        source, folder = tmp_path / "log", str(tmp_path / "out")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, verdicts.LOG).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(verdicts.LOG).parquet(str(source))
            changed = verdicts.run_log(stream, folder, **options)
        return {(r["company"], r["link"]): (r["at"], r["kind"]) for r in verdicts.latest(changed).collect()}, changed

    return go


def test_batches_repeats_and_eviction(run):
    rows = log_rows(1)
    third = len(rows) // 3
    state, changed = run([rows[:third], rows[third : 2 * third], rows[third : 2 * third][-20:], rows[2 * third :]], lateness="40 days")
    assert state == by_hand(rows, rows[-1][-1] - 40 * DAY)
    assert {r["op"] for r in changed.collect()} == {"put", "drop"}


def test_one_batch_evicts_what_is_old(run):
    rows = log_rows(2)
    state, _ = run([rows])
    assert state == by_hand(rows, rows[-1][-1])


def test_a_repeated_batch_changes_nothing(run):
    rows = [r for r in log_rows(3, 200) if r[-1] < BEGIN + 20 * DAY]
    state, changed = run([rows, rows], lateness="30 days")
    assert state == by_hand(rows, BEGIN) and len({(r["company"], r["link"]) for r in changed.collect()}) == changed.count()


def test_nulls_empty_log_and_staleness(run, spark):
    state, _ = run([[(None, "", "fetched", None, None, None, None, BEGIN), ("a", None, "verdict", "x", None, None, None, BEGIN), ("a", "l", "verdict", None, None, None, None, BEGIN), ("b", "", "absent", None, None, None, None, None)]])
    assert state == {("a", "l"): (BEGIN, None)}
    links = spark.createDataFrame([("k1", "a", "7"), ("k2", "a", "8"), ("k3", "b", None), ("k4", "b", "1"), ("k5", "c", "1")], "link string, company string, inputs string")
    table = spark.createDataFrame([("a", "k1", BEGIN, "v2", "7"), ("a", "k2", BEGIN, "v2", "7"), ("b", "k3", BEGIN, "v2", None), ("b", "k4", BEGIN - 9 * DAY, "v2", "1")], "company string, link string, at timestamp, rules string, inputs string")
    old = verdicts.stale(links, table, "v2", BEGIN, 5 * DAY)
    assert sorted(r["link"] for r in old.collect()) == ["k2", "k4", "k5"]
    assert verdicts.stale(links, table, "v3", BEGIN).count() == 5
    assert [(r["rank"], r["company"]) for r in verdicts.next_companies(old, 9).collect()] == [(1, "c"), (2, "b"), (3, "a")]
    assert tuple(verdicts.coverage(links, old).first()) == (5, 2, 3, 0.4)
    assert verdicts.coverage(links.limit(0), old.limit(0)).first()["ratio"] == 1.0
