import datetime as dt

import pytest
from pyspark.sql import functions as F

from outlay.functions import coerce, identity, values
from outlay.operators import amendments, filters, incremental, interests, joint, paging, rollups, search
from outlay.sources import feeds, sinks
from outlay.streaming import windows


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in cells.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("1 234,56", 1234.56), ("3", 3.0), ("-1", None), ("1.234,56", 1234.56), ("+5", 5.0), (".5", 0.5), ("\u00a07\t", 7.0), ("1.2.3", None), ("x", None), ("", None), (None, None), ("99999999999", None)])
def test_real(spark, text, want):
    assert one(spark, coerce.to_real(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("2024-02-03T12:34:56Z", "2024-02-03"), ("3.2.2024", "2024-02-03"), ("2024-13-01", None), ("1980-01-01", None), (None, None)])
def test_date(spark, text, want):
    assert one(spark, coerce.to_iso_date(F.col("t")), t=text) == want


def test_identity_key_is_never_null_to_the_plan(spark):
    """Else a join by the key has it computed for each row below the grouping, checksums and all."""
    rows = spark.createDataFrame([("1", None), (None, None)], "contractor_eik string, contractor_name string")
    assert not rows.select(identity.identity_key(F.col("contractor_eik"), F.col("contractor_name")).alias("key")).schema["key"].nullable


def test_identity_key(spark):
    key = lambda e, n: one(spark, identity.identity_key(F.col("e"), F.col("n")), e=e, n=n)
    assert key("000000000", "a „b“") == key(None, "A  B") == "name:A B"
    assert key(None, None) == key("1", " ") == identity.UNKNOWN
    assert key("1", "a–b") == key("1", "a-b") != key("1", "a b")


def test_slugs_come_back():
    for x in ("eik:123456789", "name:ЖП ООД", "unknown:анонимен"):
        assert identity.entity_id(identity.slug(x)) == x


@pytest.mark.parametrize(("e", "s", "c", "p", "want"), [
    (1e6, 1e6, None, 1e4, "value_suspect"), (9.7e5, 1e6, None, 1e4, "value_suspect"), (2e5, 2e5, None, 1e4, "review"), (3e6, 3e6, None, 1e4, "value_suspect"),
    (-5.0, 10.0, -5.0, 1e4, "value_low"), (1e4, 1e4, None, 1e4, "ok"), (1e4, 1e4, None, None, "ok"),
])
def test_value_flag(spark, e, s, c, p, want):
    f = lambda x: F.lit(x).cast("double")
    flag = values.value_flag(f(e), f(s), f(c), f(None), f(p), F.lit(False), F.lit(False))
    assert spark.range(1).select(flag).first()[0] == want


def test_cohort_percentiles_are_nearest_rank(spark):
    rows = [("A", 100_000 * i) for i in range(1, 21)] + [("A", None), ("A", 0)] + [("B", x) for x in (10_000, 20_000, 30_000)]
    got = {r["division"]: r for r in rollups.cohort_percentiles(spark.createDataFrame(rows, "division string, amount_cents long")).collect()}
    assert [got["A"][q] for q in rollups.QUANTILES] == [5000, 10000, 15000, 18000, 19000, 20000]
    assert [got["B"][q] for q in rollups.QUANTILES] == [100, 200, 300, 300, 300, 300]


def test_cursor_round_trip():
    token = paging.signature({"years": {"2024", "2023"}, "q": ""})
    assert token == paging.signature({"years": {"2023", "2024"}})
    c = paging.Cursor("after", "ж", 7)
    assert paging.decode_cursor(paging.encode_cursor(c, token), token) == c
    assert paging.decode_cursor(paging.encode_cursor(c, token), "other") is None
    assert paging.decode_cursor("after:%%", token) is None and paging.decode_cursor("x" * 600, token) is None


def test_filter_lists():
    assert filters.multi({"y": ["a, b", "b", ""]}, "y") == ("a", "b")
    assert set(filters.FILTERS_IN_USE) == {"years", "sectors", "procedures", "value_bucket", "eu", "authority", "bidder", "q", "bids"}


def test_undecodable_entity_gives_no_rows(spark):
    df = spark.createDataFrame([(1, 1)], "id long, bidder_id long")
    assert filters.apply_filters(df, filters.ContractFilters(bidder="?"), {}, "2024").count() == 0


def test_catch_up_window():
    assert incremental.catch_up("2024-01-10", "2024-01-12") == incremental.Window("2024-01-07", "2024-01-12", False)
    assert incremental.catch_up("2023-01-10", "2024-01-30").capped
    with pytest.raises(ValueError, match="partial"):
        incremental.assert_window_safe(True, 1)


def test_refresh_equals_full(spark):
    rule = lambda d: d.groupBy("k").agg(F.sum("v").alias("s"))
    old = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k long, v long")
    new = spark.createDataFrame([(1, 1), (2, 5), (4, 4)], "k long, v long")
    touched = spark.createDataFrame([(2,), (3,), (4,)], "k long")
    assert sorted(incremental.refresh(rule(old), new, touched, ["k"], rule).collect()) == sorted(rule(new).collect())


def test_resolve_by_value(spark):
    contracts = spark.createDataFrame([("u", "BGN", "1", 100.0, "s"), ("u", "BGN", "2", 200.0, None), ("u", "BGN", "3", 200.0, None)], "unp string, currency string, number string, signing double, supplier string")
    annexes = spark.createDataFrame([("a", "u", "BGN", "r", 100.0, "s"), ("b", "u", "BGN", "r", None, "s"), ("c", "u", "BGN", "q", 200.0, None), ("d", "u", "EUR", "z", 100.0, None), ("e", "u", "BGN", "y", 100.0, "t")], "key string, unp string, currency string, raw_number string, value_before double, supplier string")
    assert sorted(amendments.resolve_by_value(annexes, contracts).collect()) == [("a", "1", "value"), ("b", "1", "group")]


def test_chain_flags(spark):
    contracts = spark.createDataFrame([(1, "u", "1", 100.0, 250.0), (2, "u", "2", 100.0, 110.0)], "id long, unp string, number string, signing double, current double")
    am = spark.createDataFrame([("a", "u", "1", 100.0, 250.0, 150.0, None), ("b", "u", "2", 10.0, 110.0, 100.0, None)], "key string, unp string, number string, value_before double, value_after double, value_delta double, treatment string")
    assert sorted(amendments.chain_flags(contracts, am).collect()) == [(1, False, True), (2, True, False)]


def test_family_link_gives_way(spark):
    links = spark.createDataFrame([("a", 1, 9, "owns", "published"), ("b", 1, 9, "related", "published"), ("c", 2, 9, "related", "published"), ("d", 3, 9, "owns", "held")], "link_key string, person long, company long, interest_class string, status string")
    evidence = spark.createDataFrame([(k,) for k in "abcd"], "link_key string")
    live = spark.createDataFrame([(9,)], "company long")
    assert {r["link_key"] for r in interests.surfaced(links, evidence, live).collect()} == {"a", "c"}


def test_lead_and_bridge(spark):
    members = joint.split_members(spark.createDataFrame([(1, "x; y;;x", "X;Y")], "k long, c string, n string"), "k", "c", "n")
    usual = spark.createDataFrame([(1, "y")], "k long, usual string")
    lead = joint.leads(members, "k", usual)
    assert [tuple(r) for r in joint.bridge(members, lead, "k").orderBy("place").collect()] == [(1, "y", 0), (1, "x", 1)]


def test_query_tokens_fold_twins():
    assert search.query_tokens("Cтрой é a") == ["строй"] and search.query_tokens("") == []


def test_bm25_ranks_the_shorter_text(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox and many more words"), (3, "blue")], "id long, t string")
    got = {r["ref"]: r["score"] for r in search.bm25(search.inverted_index(docs, "id", "t"), "fo").collect()}
    assert set(got) == {1, 2} and got[1] > got[2]


def test_release_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"ocid":"o","tag":["contract"],"date":"2024-01-01","parties":[{"id":"p","name":"N","identifier":{"id":"1"},"roles":["supplier"]}],"buyer":{"id":"b","name":"B"},"tender":{"id":"t"},"awards":[{"id":"w","suppliers":[{"id":"p"}]}],"bids":{"statistics":[{"measure":"bids","value":2}]},"contracts":[{"id":"c1","awardID":"w","value":{"amount":5,"currency":"EUR"}},{"id":"c2","awardID":"?"}]}')
    rel = spark.read.schema(feeds.RELEASE).json(str(tmp_path / "r.json"))
    got = {r["contract_number"]: r for r in feeds.release_contracts(rel).collect()}
    assert got["c1"]["contractor_eik"] == "1" and got["c1"]["bids_received"] == 2 and got["c2"]["contractor_eik"] is None
    assert feeds.release_amendments(rel).count() == 0 and feeds.release_parties(rel).count() == 1


def test_declaration_cells(spark):
    xml = '<Declaration><id>7</id><person>P</person><Tables><Table><Num>1</Num><Row><Num>1</Num><Cell><Num>2</Num><Text>x</Text></Cell><Cell><Num>3</Num><Text>y</Text></Cell></Row></Table></Tables></Declaration>'
    assert feeds.declaration_cells(spark.createDataFrame([(xml,)], "xml string")).first()["cells"] == {"2": "x", "3": "y"}


def test_replace_sources_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v long")
    sinks.replace_sources(a, path)
    for _ in range(2):
        sinks.replace_sources(spark.createDataFrame([("b", 3)], "source string, v long"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("source", "v").collect()) == [("a", 1), ("b", 3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, i % 7), "e", float(i)) for i in range(50)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"), events.schema, 1).withWatermark("ts", "1 hour"), "2 minutes")
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, windows.tumbling(events, "2 minutes").collect()))


def test_integrity_checks_join_once(spark, sf_dir):
    from outlay.plans.catalog import QUERIES

    assert "Join" not in QUERIES["integrity_checks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
