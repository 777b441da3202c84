"""Completed entities, lots and values: nulls, blanks, ties, repeated rows, empty tables, extra columns."""

from pyspark.sql import functions as F

from outlay.operators import enrichment as e

P = "eik string, source string, ocid string, party_id string, name string, street_address string, locality string, region_nuts string, contact_email string, contact_phone string"
PARTIES = [
    ("1", "s2", "o", "p", "A", None, "Русе", "BG323", "", None), ("1", "s1", "o", "q", "A", "ул. 1", "Варна", None, "a@x", None), ("1", "s2", "o", "p", "B", "", "", "", None, None),
    ("", "s1", "o", "p", "C", None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), ("1", "s1", "o", "q", "A", "ул. 1", "Варна", None, "a@x", None),
]


def test_parties_and_regions(spark):
    known = e.parties(spark.createDataFrame(PARTIES, P))
    assert sorted(r["party_key"] for r in known.collect()) == ["content:" + ":" * 8, "eik:1:ocid:o:party:p", "eik:1:ocid:o:party:q", "ocid:o:party:p"]
    assert known.where("party_key = 'eik:1:ocid:o:party:p'").first()["name"] == "B"
    ent = spark.createDataFrame([("1", None, "Стар", None, "old", "9", None, 5), ("2", "BG411", None, None, None, None, None, 6), (None, "BG999", None, None, None, None, "Враца", 7)], "eik string, nuts string, settlement string, address string, contact_email string, contact_phone string, region string, source int")
    got = {r["source"]: tuple(r)[:7] for r in e.with_regions(e.with_parties(ent, "eik", spark.createDataFrame(PARTIES, P))).collect()}
    assert got[5] == ("1", "BG323", "Русе", "ул. 1", "a@x", "9", "Русе") and got[6] == ("2", "BG411", None, None, None, None, "София (столица)") and got[7] == (None, "BG999", None, None, None, None, "Враца")
    assert e.with_parties(ent, "eik", known.limit(0)).exceptAll(ent).count() == 0 and e.with_parties(ent.limit(0), "eik", known).count() == 0


def test_regional_spending_is_whole(spark):
    s = spark.createDataFrame([("Русе", 5, 1, 1), ("Русе", 7, 2, 1), (None, 1, 1, 1), ("Атлантида", 2, 1, 1)], "region string, cents long, contracts long, authorities long")
    rows = e.regional_spending(s).collect()
    by = {(r["level"], r["code"]): tuple(r)[3:] for r in rows}
    assert len(rows) == 28 + 6 + 2 and by["region", "BG323"] == (12, 3, 2) == by["macro", "BG32"] == by["covered", None] and by["unattributed", None] == (3, 2, 2) and by["region", "BG311"] == (0, 0, 0)
    assert e.regional_spending(s.limit(0)).agg(F.sum("cents")).first()[0] == 0


def test_lot_values_rates_and_labels(spark):
    lots = spark.createDataFrame([("u", "1", None, None, "x"), ("u", "2", 4, None, "y"), ("u", "A", None, None, "z"), (None, "1", None, None, "n")], "unp string, lot_id string, value long, currency string, id string")
    released = spark.createDataFrame([(1, "t", "LOT-0001", 5, "EUR"), (2, "t", "01", None, "BGN"), (2, "t", "01", None, "BGN"), (3, "t", "2", 9, "USD"), (4, None, "2", 1, "X"), (5, "t", None, 1, "X")], "id int, tender_id string, lot_id string, value long, currency string")
    procedures = spark.createDataFrame([("t", "u"), ("t", "u"), (None, "u"), ("t", None)], "tender_id string, unp string")
    got = {r["id"]: (r["value"], r["currency"]) for r in e.with_lot_values(lots, released, procedures).collect()}
    assert got == {"x": (None, "BGN"), "y": (4, "USD"), "z": (None, None), "n": (None, None)}  # the latest row counts, also where it has no value
    d = spark.createDataFrame([(1, "USD", "d", 10.0), (2, "USD", None, 10.0), (3, None, "d", 10.0), (4, "EUR", "x", 10.0)], "id int, currency string, day string, v double")
    rates = spark.createDataFrame([("USD", "d", 0.5), ("USD", "d", 0.25), (None, "d", 9.0)], "currency string, date string, rate double")
    assert {r["id"]: r["eur"] for r in e.at_rate(d, rates, "currency", "day", "v", "eur").collect()} == {1: 5.0, 2: None, 3: None, 4: 10.0}
    labels = spark.createDataFrame([("10",), ("2",), ("LOT-10",), ("LOT-9",), ("1а",), (None,), ("",), ("007",), ("12345678901234567890123",)], "label string")
    assert [r[0] for r in labels.orderBy(e.natural(F.col("label")), "label").collect()] == [None, "", "1а", "2", "007", "10", "12345678901234567890123", "LOT-9", "LOT-10"]


def test_value_strip_by_flag(spark):
    c = spark.createDataFrame(
        [("a", "u", "n", 100.0, 200.0, "EUR", None, "ok", 1.0), ("b", "u", "n", 100.0, 200.0, "EUR", 0.5, "annex_suspect", 1.0), ("c", "u", None, 100.0, None, None, None, "ok", 1.0), ("d", "v", "n", None, 200.0, "", None, "annex_suspect", 1.0), ("e", "u", "n", 100.0, 200.0, "USD", None, "value_suspect", 7.0)],
        "id string, unp string, contract_number string, signing_value double, current_value double, currency string, fx_rate double, value_flag string, amount_eur double",
    )
    a = spark.createDataFrame([(1, "u", "n", 1.0, "BGN", "2020"), (2, "u", "n", 1.0, "USD", "2021"), (3, "u", "n", None, "GBP", "2022"), (2, "u", "n", 1.0, "USD", "2021"), (9, None, "n", 1.0, "X", "2023")], "id int, unp string, contract_number string, value_after double, currency string, published_at string")
    got = {r["id"]: (r["current_value_currency"], r["amount_eur"], r["signing_value_eur"], r["current_value_eur"]) for r in e.with_timeline(e.with_current_currency(c, a)).collect()}
    lev = 1.95583
    assert got == {"a": ("USD", None, 100.0, None), "b": ("USD", 100.0, 100.0, None), "c": ("BGN", 100 / lev, 100 / lev, None), "d": ("BGN", 200 / lev, None, None), "e": ("USD", 7.0, None, None)}


def test_joint_participation_and_text(spark):
    bridge = spark.createDataFrame([("u", "1", 0), ("u", "1", 0), ("u", "2", 1), (None, "3", 0), ("w", "4", 0)], "unp string, code string, place int")
    c = spark.createDataFrame([("u", 5), ("u", None), (None, 9), ("x", 1)], "unp string, cents long")
    assert sorted(map(tuple, e.joint_participation(bridge, c).collect())) == [("1", 2, 5), ("2", 2, 5)]
    assert e.joint_participation(bridge, c.limit(0)).count() == 0
    f = spark.createDataFrame([("b", 1, None), ("a", 2, "2020")], "feed string, contracts long, latest string")
    assert e.freshness_text(f).first()[0] == "a:2020(2) b:?(1)" and e.freshness_text(f.limit(0)).first()[0] == ""
