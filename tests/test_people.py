"""Names, declared companies, links by value, chains and procedures: edges and plain versions."""

import random
import re

from pyspark.sql import functions as F

from outlay.operators import amendments, derive, holders, resolve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CELLS = [
    (None, "Иван Петров Георгиев", "self"), ("  ", None, "self"), ("Георгиев Иван Петров", "Иван Петров Георгиев", "self"), ("иван г. петров", "Иван Петров Георгиев", "self"),
    ("Иван Георгиев", "Иван Петров Георгиев", "self"), ("Георгиев", "Иван Петров Георгиев", "unknown"), ("Иван Чужд", "Иван Петров Георгиев", "unknown"), ("Мария Друга", "Иван Петров Георгиев", "related"),
    ("Иван Иван", "Иван Петров Георгиев", "unknown"), ("Г. Г.", "Иван Петров Георгиев", "unknown"), ("И. П. Г.", "Иван Петров Георгиев", "self"), ("—", "Иван", "unknown"), ("Иван", None, "unknown"), ("Иван", "12", "unknown"),
    ("Петър И. И.", "Иван Петър Илиев", "self"), ("НИКОЛАЙ НАЙДЕНОВ", "Николай Найденов", "self"), ("Я. Друга Трета", "Иван Петров", "related"), ("П. Петров", "Петров Иван", "unknown"),
]


def test_relations(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CELLS)], "i int, holder string, declarant string, want string")
    got = rows.select("i", "want", holders.relation(F.col("holder"), F.col("declarant")).alias("r")).collect()
    assert [(r["i"], r["r"]) for r in got] == [(r["i"], r["want"]) for r in got]


def test_whole_names_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["Ана", "Боян", "Вера", "Гео", "Дора", "Ева", "Я"]
    name = lambda n: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))]) if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    people, entries = [(i, name(3)) for i in range(80)] + [(None, "Ана"), (3, "Ана Боян")], [(i // 2, name(5)) for i in range(200)] + [(None, "Ана")]
    tok = lambda x: {t for t in re.split(r"[^\w]+", (x or "").upper()) if len(t) > 1}
    want = []
    for p, x in people:
        hits = [e for e, y in entries if tok(x) and tok(x) <= tok(y)]
        if hits:
            want.append((p, len(hits), min((h for h in hits if h is not None), default=None)))
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, name string, entries long")
    found = holders.whole_names(df([(*r, 0) for r in people], "person"), df([(*r, 0) for r in entries], "entry"), "person", "entry", "name")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert holders.whole_names(df([], "person"), df([], "entry"), "person", "entry", "name").count() == 0


DECLARED = [
    ("Алфа ООД", "111111111", "exact_name_key"), ("обща ад", None, "ambiguous"), ('дял в "Алфа" ООД, ЕИК 111111111', "111111111", "declared_eik"), ('ЕИК 222222222, "Друга" ЕООД', None, None),
    ('прехвърлени „Бета груп" АД, и друго', "222222222", "extracted_name"), ('„Обща" АД в София', None, None), ("Невалидна ООД", None, None), (None, None, None), ("", None, None), ('ЕИК 1111111110 "Алфа" ООД е', "111111111", "extracted_name"),
    ('"Обща" АД и "Алфа" ООД', "111111111", "extracted_name"),
]


def test_ladder(spark):
    winners = [('„Алфа" ООД', "111111111", 1), ("АЛФА  ООД", "111111111", 1), ("Бета Груп АД", "222222222", 1), ("ОБЩА АД", "333333333", 1), ("Обща АД", "444444444", 1), ("Невалидна ООД", "5", 0), ('""', "666666666", 1), (None, "7", 1), ("Празна ООД", None, 1)]
    w = spark.createDataFrame(winners, "name string, eik string, valid int")
    d = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(DECLARED)] * 2, "i int, entity string, key string")
    got = resolve.resolve(d, w, "entity").collect()
    assert len(got) == 2 * len(DECLARED)
    assert {(r["i"], r["eik"], r["method"]) for r in got} == {(i, e, m) for i, (_, e, m) in enumerate(DECLARED)}
    assert [tuple(r) for r in resolve.ambiguous_keys(w).collect()] == [("ОБЩА АД", 2, "333333333", "444444444")]
    assert resolve.resolve(d.limit(0), w.limit(0), "entity").count() == 0


def test_links_by_value(spark):
    rng = random.Random(5)
    annexes = [(f"k{i}", rng.choice(["p", "q", None]), rng.choice(["BGN", None]), rng.choice(["1", "2"]), rng.choice([10.0, 10.004, 10.01, 55.5, None]), rng.choice([None, "s", "t"])) for i in range(60)]
    contracts = [(rng.choice(["p", "q"]), "BGN", rng.choice(["A", "B", "C"]), rng.choice([10.0, 10.002, 55.5, 70.0, None]), rng.choice([None, "s", "t"])) for _ in range(5)]
    found = {a[0]: {c[2] for c in contracts if a[1] == c[0] and a[2] == c[1] and None not in (a[4], c[3]) and abs(a[4] - c[3]) < 0.005 and (None in (a[5], c[4]) or a[5] == c[4])} for a in annexes}
    want = {(k, min(v), "value") for k, v in found.items() if len(v) == 1}
    for a in annexes:
        group = {m for k, m, _ in set(want) if _ == "value" and next((b[1], b[3]) for b in annexes if b[0] == k) == (a[1], a[3])}
        if not found[a[0]] and len(group) == 1 and a[1] is not None:
            want.add((a[0], min(group), "group"))
    got = amendments.resolve_by_value(spark.createDataFrame(annexes, "key string, unp string, currency string, raw_number string, value_before double, supplier string"), spark.createDataFrame(contracts, "unp string, currency string, number string, signing double, supplier string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_a_long_chain_costs_no_square(spark):
    n = 60_000
    a = spark.range(n).selectExpr("CAST(id AS STRING) AS key", "'p' AS unp", "'1' AS number", "1000.0 + id AS value_before", "1001.0 + id AS value_after", "1.0 AS value_delta", "CAST(NULL AS STRING) AS treatment")
    c = spark.createDataFrame([("c", "p", "1", 1000.0, 2000.0)], "id string, unp string, number string, signing double, current double")
    assert [tuple(r) for r in amendments.chain_flags(c, a).collect()] == [("c", False, False)]


def test_chain_flags_equal_all_pairs(spark):
    rng = random.Random(8)
    annexes = [(f"k{i}", f"p{rng.randrange(6)}", "1", b := rng.choice([0.0, 10.0, 10.05, 20.0, 21.0, 40.0, 200.0]), rng.choice([b * 2, b * 2.5, b * 11, 10.0, 20.0, 20.1, 40.0]), None, None) for i in range(80)]
    contracts = [(f"c{i}", f"p{i}", "1", rng.choice([10.0, 20.0, 300.0]), rng.choice([20.0, 40.0, 42.0, 400.0])) for i in range(6)]

    def flags(c):
        own = [a for a in annexes if a[1] == c[1]]
        step = any(b > 0 and v >= 10 * b for _, _, _, b, v, _, _ in own)
        doubled = False
        for _, _, _, b, v, _, _ in own:
            prev = [(pb, pa) for _, _, _, pb, pa, _, _ in own if pa > 0 and b > 0 and abs(pa - b) < 0.01 * b]
            legit = any(pb > 0 and pa < 2 * pb for pb, pa in prev)
            anchored = abs(b - c[3]) < 0.01 * c[3] or legit or (abs(v - 2 * b) < 0.005 * b and not prev)
            doubled |= b > 0 and anchored and 2 * b <= v < 10 * b and abs(v - c[4]) < 0.01
        return c[0], step, doubled

    got = amendments.chain_flags(spark.createDataFrame(contracts, "id string, unp string, number string, signing double, current double"), spark.createDataFrame(annexes, "key string, unp string, number string, value_before double, value_after double, value_delta double, treatment string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(flags, contracts))


def test_ownership_by_prefix_has_no_loop(spark):
    bidders = [("a", "123456789", 1), ("b", "1234567890123", 1), ("c", "999999999", 1), ("d", "123456780", 0), ("e", None, 1)]
    b = spark.createDataFrame(bidders, "key string, eik string, eik_valid int")
    listed = spark.createDataFrame([("123456789", "state"), ("999999999", "municipal")], "eik string, ownership string")
    branches = spark.createDataFrame([("1234", "999999999"), ("12345678901", "123456789")], "prefix string, eik string")
    got = derive.owned(b, listed, branches)
    assert {r["key"]: r["ownership"] for r in got.collect()} == {"a": "municipal", "b": "municipal", "c": "municipal", "d": None, "e": None}
    assert "NestedLoop" not in plan(got)
    assert derive.owned(b, listed.limit(0), branches.limit(0)).count() == 5


def test_one_row_a_procedure(spark):
    h = "unp string, subject string, procedure_type string, estimate double, currency string, authority_eik string"
    headers = spark.createDataFrame([("1", None, None, 5.0, None, "9; 8"), ("1", "x", "t", 4.0, "EUR", "9; 8"), (None, "lost", None, 1.0, None, "9"), ("2", "y", "t", 1.0, None, "7")], h)
    awards = spark.createDataFrame([("1", "z", 1.0, None, "9"), ("3", None, None, None, "6; 9"), ("3", "w", 2.0, "USD", "9"), (None, "q", 1.0, None, "9")], "unp string, subject string, estimate double, currency string, authority_eik string")
    leads = spark.createDataFrame([("1", "8"), ("3", "9"), (None, "1")], "unp string, lead string")
    there = spark.createDataFrame([("8",), ("9",)], "authority_eik string")
    rows = derive.tenders(headers, awards, leads, there).orderBy("unp").collect()
    assert [(r["unp"], r["title"], r["authority_eik"], r["status"]) for r in rows] == [("1", "x", "8", "awarded"), ("3", "w", "9", "awarded")]
    assert [r["unp"] for r in derive.tenders(headers, awards).orderBy("unp").collect()] == ["1", "2", "3"]
    assert derive.tenders(headers.limit(0), awards.limit(0), leads, there).count() == 0
