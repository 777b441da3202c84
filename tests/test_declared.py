"""Declared stakes: sets, spells and horizons, with nulls, ties and repeated rows."""

from outlay.operators import declared as d

H = "person string, company string, scope string, kind string, owns boolean, template string, institution string, method_rank int, year int"
ROWS = [
    ("p", "c", "self", "b", True, "T", "i", 1, 2019), ("p", "c", "self", "a", True, "T", "", 3, 2020), ("p", "c", "self", "a", True, "T", "", 3, 2020), ("p", "c", "self", "a", False, "U", None, 2, 2023),
    ("p", "c", "family", None, None, None, None, None, None), (None, "c", "self", "a", True, "T", "i", 1, 2020), ("q", "c", "self", "a", False, "T", "i", 1, 2018),
]
F_ = [("p", "T", 2020, None), ("p", "U", None, 2022), ("p", "U", None, None), (None, "T", None, 2024), ("q", "T", 2024, None), ("p", None, 2030, None)]


def test_links_spells_and_divestment(spark):
    holdings = spark.createDataFrame([(*r, 7) for r in ROWS], H + ", horizon int")
    filings = spark.createDataFrame(F_, "person string, template string, year int, folder_year int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in d.links(holdings).collect()}
    assert got["p", "c", "self"] == ("a,b", "T,U", "i", True, 3, 2019, 2023, 3, 2020)
    assert got["p", "c", "family"] == ("", "", "", False, None, None, None, 0, None) and len(got) == 4
    assert sorted(map(tuple, d.spells(holdings).collect()), key=str) == sorted([("p", "c", "self", 1, 2019, 2020), ("p", "c", "self", 2, 2023, 2023), (None, "c", "self", 1, 2020, 2020), ("q", "c", "self", 1, 2018, 2018)], key=str)
    assert d.spells(holdings, gap=3).where("person = 'p'").count() == 1
    assert sorted(map(tuple, d.divested(holdings, filings).collect()), key=str) == sorted([("p", "c", "self", 2020, 2022), (None, "c", "self", 2020, 2024)], key=str)
    empty = holdings.limit(0)
    assert [x.count() for x in (d.links(empty), d.spells(empty), d.divested(empty, filings))] == [0, 0, 0]
