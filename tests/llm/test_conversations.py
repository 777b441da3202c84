"""Conversation repair against every sequence of edits, ordinary and long ways."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from outlay.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "-" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "t"
        seen.add((role, text))
        out.append(kind)
    return out


def by_all_edits(rows):
    """(cost, audit, repaired) of one short conversation, by trying everything with up to two inserts a gap."""
    kinds, ways = faults(rows), []
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(k in "bd" and e != "D" for e, k in zip(edits, kinds)):
            continue
        base = sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (k == "t" and e != "D") for e, k in zip(edits, kinds))
        ways += [(base + 5 * len("".join(ins)), "".join(i + e for i, e in zip(ins, (*edits, "")))) for ins in itertools.product(["", "I", "II"], repeat=len(rows) + 1)]
    for cost, audit in sorted(ways):
        options, i = [], 0
        for e in audit:
            if e == "I":
                options.append([("user", ""), ("assistant", "")])
                continue
            if e == "K":
                options.append([rows[i][1:]])
            elif e == "R":
                options.append([("user", rows[i][2]), ("assistant", rows[i][2])])
            i += 1
        for turns in itertools.product(*options):
            if SHAPE.match("".join(r[:1] or " " for r, _ in turns)):
                return cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)
    raise AssertionError(rows)


def by_hand(rows):
    """rows of one conversation: (turn, role, text), nulls made plain."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    numbers = [t for t, _, _ in rows if t is not None]
    kinds, ini = faults(rows), [r[:1] for _, r, _ in rows]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit, text = by_all_edits(rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def some(seed, n, most=4):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for _ in range(rng.randint(1, most)):
            out.append((conv or None, rng.choice([None, 1, 2, 3, 5, 9]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "staff"]), rng.choice(["Hi.", "Yes!", "And", "so on \n", " ", "", None, "é?\t", "x. "])))
    return out


@pytest.mark.parametrize("long_rows", [1024, 2, 0])
def test_against_all_edits(spark, long_rows):
    rows = some(long_rows, 60)
    want = {k: by_hand([r[1:] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    got = c.repair(spark.createDataFrame(rows, SCHEMA), long_rows=long_rows, part_rows=2).drop("repaired").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_long_conversations_come_out_alike(spark):
    rng, rows = random.Random(7), []
    for conv in range(4):
        for i in range(700):
            rows.append((conv, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", f"Three {rng.randrange(400)}.", f"Four {i}!", ""])))
    turns = spark.createDataFrame(rows, SCHEMA)
    whole, parted = ({r[0]: r[1:] for r in c.repair(turns, long_rows=n, part_rows=64).drop("repaired").collect()} for n in (10_000, 10))
    assert whole == parted and len(whole) == 4
    out = [sorted((r[0], r[3], r[4]) for r in c.repaired_turns(turns, long_rows=n).collect()) for n in (10_000, 10)]
    assert out[0] == out[1]
    ordered = c.repaired_turns(turns, long_rows=10).where("conv_id = 2").orderBy("part", "place").collect()
    assert SHAPE.match("".join(r["role"][0] for r in ordered))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in ordered).encode()).hexdigest() == whole[2][-1]


def test_empty_table_and_clashing_columns(spark):
    assert c.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", 5, "x"), (1, 2, "assistant", "Yo.", 5, "x")], SCHEMA + ", cost long, turns string")
    assert [tuple(r[1:8]) for r in c.repair(rows).collect()] == [(0, 0, 0, 0, 0, 0, "KK")]


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


@pytest.mark.parametrize("long_rows", [1024, 0])
def test_query_on_damaged_rows(spark, long_rows):
    rows = [(i, t, r, x) for i in [*range(60), None] for t, (r, x) in enumerate([("user", f"Q{i}?"), ("assistant", "A. b"), ("user", "And!")])]
    want = {k: by_hand(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k, v in damaged_by_hand(rows).items()}
    got = c.repair(c.damaged(spark.createDataFrame(rows, SCHEMA)), long_rows=long_rows).drop("repaired").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
