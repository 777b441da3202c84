"""Conflict pages: gates, order, capped lists; nulls, ties, repeated rows, empty tables."""

from outlay.operators import conflicts as c

L = "link_key string, person string, company string, status string, interest_class string, own_institution string, first_year int, last_year int, id int"
LINKS = [
    ("a", "p", "c", "published", "private_ownership", None, 2020, 2021, 1), ("a", "p", "c", "published", "private_ownership", None, 2020, 2021, 1), ("b", "p", "c", "published", "family_ownership", "exact", 2020, 2021, 2),
    ("d", "q", "c", "published", "family_ownership", "exact", None, None, 3), ("e", "q", "k", "published", "private_ownership", None, 2020, 2020, 4), ("f", "r", "c", "held", "private_ownership", None, 2020, 2021, 5), ("g", "r", "c", "published", "management", None, 2020, 2021, 6),
    ("h", "r", "c", "published", "private_ownership", None, 2020, 2021, 7), (None, "r", "c", "published", "private_ownership", None, 2020, 2021, 8), ("i", None, "c", "published", "private_ownership", None, 2020, 2021, 9), ("j", "s", "c", "published", "family_ownership", None, 2022, 2022, 10), ("k", "s", "c", "published", "private_ownership", None, 2019, 2019, 11),
]
SEALS = [("a", "document"), ("a", "confirmed"), ("b", "document"), ("d", "confirmed"), ("e", "confirmed"), ("f", "confirmed"), ("g", "confirmed"), ("h", "refuted"), ("i", "confirmed"), ("j", "confirmed"), (None, "confirmed")]
CONTRACTS = [("x1", "c", 2020, "2020-05-01", 5), ("x2", "c", 2021, "2021-05-01", None), ("x3", "c", None, None, 9), ("x4", "c", 2023, "2023-01-01", 2), ("x5", None, 2020, "2020-01-01", 1), ("x6", "c", 2020, "2020-05-01", 5)]


def _tables(spark):
    return spark.createDataFrame(LINKS, L), spark.createDataFrame(SEALS, "link_key string, kind string"), spark.createDataFrame(CONTRACTS, "id string, company string, year int, signed_at string, cents long")


def test_gates_order_and_headline(spark):
    links, seals, contracts = _tables(spark)
    # b stands beside a; j beside k, which has no seal: the official's own stake is published all the same
    got = {r["link_key"]: (r["contracts"], r["cents"], r["window_contracts"], r["window_cents"]) for r in c.shown(links, seals, contracts).collect()}
    assert got == {"a": (5, 21, 3, 10), "d": (5, 21, 0, None)}
    assert [(r["link_key"], r["place"]) for r in c.leaderboard(c.shown(links, seals, contracts)).orderBy("place").collect()] == [("d", 1), ("a", 2)]
    assert tuple(c.headline(c.shown(links, seals, contracts)).first()) == (2, 2, 1, 21)
    for empty in (c.shown(links.limit(0), seals, contracts), c.shown(links, seals.limit(0), contracts), c.shown(links, seals, contracts.limit(0))):
        assert empty.count() == 0 and tuple(c.headline(empty).first()) == (0, 0, 0, None)


def test_contracts_of_a_link(spark):
    links, seals, contracts = _tables(spark)
    rows = c.link_contracts(c.gated(links, seals).where("link_key = 'a'"), contracts).orderBy("place").collect()
    assert [(r["id"], r["temporal"]) for r in rows] == [("x2", "contemporaneous"), ("x1", "contemporaneous"), ("x6", "contemporaneous"), ("x4", "after"), ("x3", "unknown")]
    for n in (1, 2, 3, 4):  # what is cut before the join is never in a link's first n
        cut = c.link_contracts(c.gated(links, seals), contracts, n)
        whole = c.link_contracts(c.gated(links, seals), contracts).where(f"place <= {n}")
        assert cut.exceptAll(whole).count() == 0 == whole.exceptAll(cut).count()
