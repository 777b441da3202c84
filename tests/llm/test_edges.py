"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

from outlay.llm import decontaminate, extract, jaccard, packing, repeats, sharding, topk, toxicity, url_filter, warc
from outlay.llm.workspace import fresh_dir

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, "one two three four five six", 0.5, "a"), (1, "one two three four five six", 0.5, "a"), (2, None, None, None), (3, "", 1.0, "b"), (None, "lost text", 1.0, "b"), (4, LONG, 1.0, None), (5, "é" * 10, 2.0, "c"), (6, "\n \t", None, "c")]
SCHEMA = "doc_id long, text string, score double, shard string"


def _model(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic long")
    texts = spark.createDataFrame([(i, "you are a zorgwit " + str(i) if i % 2 else "a calm remark " + str(i)) for i in range(60)], "doc_id long, text string")
    return toxicity.train(texts, labels)


@pytest.fixture(scope="module")
def operators(spark):
    items = spark.createDataFrame([(1, "two three four"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    model = _model(spark)
    return {
        "decontaminate": lambda d: decontaminate.find_matches(d, items), "repeats": repeats.remove_repeats, "sharding": sharding.shuffle_to_shards,
        "packing": lambda d: packing.pack(d, packing.default_tokenizer()).where("start = 0"), "jaccard": jaccard.jaccard_components, "toxicity": lambda d: toxicity.score(d, model),
    }


NAMES = ["decontaminate", "repeats", "sharding", "packing", "jaccard", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(name, operators, spark):
    got = operators[name](spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, operators, spark):
    assert operators[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_filters_keep_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    items = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.schema == docs.schema and {r["doc_id"] for r in clean.collect()} == {None, 2, 3, 4, 5, 6}
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)
    model = _model(spark)
    toxic = docs.unionByName(spark.createDataFrame([(7, "what a zorgwit indeed", 0.0, "z", 21)], docs.schema))
    assert {r["doc_id"] for r in toxicity.drop_toxic(toxic, model).collect()} == {None, 1, 2, 3, 4, 5, 6}
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert next(r for r in cut.collect() if r["doc_id"] == 2)["text"] is None
    assert jaccard.keep_one_each(docs).columns == docs.columns


def test_no_labels_means_score_zero(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic long"))).collect()} == {0.0}


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours(spark):
    kernels = toxicity.Kernels(_model(spark).landmarks)
    texts = ["you z o r g w i t", "is it so", "To be or z o r g w i t", "It is a calm remark", None, "a b", "z o r g w i t"]
    alone = [kernels.pooled([x])[0].tolist() for x in texts]
    assert [any(x) for x in alone] == [True, False, True, False, False, False, True]
    for order in (range(7), range(6, -1, -1), [2, 0, 6, 1, 5, 3, 4]):
        assert kernels.pooled([texts[i] for i in order]).tolist() == [alone[i] for i in order]


@pytest.mark.parametrize("before", ["", "a b c d e f g h " * 5, "q " * 23, "in of to " * 400])
@pytest.mark.parametrize("space", [" ", "  \t\n ", " " * 60])
def test_an_insult_is_found_anywhere_in_a_run_of_tiny_words(before, space, spark):
    kernels = toxicity.Kernels(_model(spark).landmarks)
    spelled = space.join("zorgwit")
    for text in (before + spelled, before + spelled + " q" * 30, before + "zo" + space + "rg" + space + "wi" + space + "t"):
        assert kernels.pooled(["calm", text, "remark"]).max(axis=1).round(6).tolist() == [0, 1, 0]


@pytest.mark.parametrize("insult", ["zorgwit", "zo*rgwit", "z*or*gw*it", "zo.rg.wi.t", "z.o.r.g.w.i.t", "z*o*r*g*w*i*t", "z--o--r--g--w--i--t"])
def test_foreign_bytes_between_letters_hide_no_insult(insult, spark):
    model = _model(spark)
    kernels = toxicity.Kernels(model.landmarks)
    scores = model.scores(kernels.pooled([f"what a {insult} indeed", "a calm remark about organs", "a wizard ground it", "", None]))
    assert (scores >= 0.5).tolist() == [True, False, False, False, False]


def test_near_copies_link_and_common_passages_do_not(spark):
    words = [f"t{i}" for i in range(100)]
    near = [*words[:50], "changed", *words[51:]]
    rows = [(9, " ".join(words)), (8, " ".join(words).upper()), (5, " ".join(near)), (3, " ".join(words[:40]) + " x " + " ".join(f"u{i}" for i in range(80))), (2, "a b"), (1, "A  b"), (0, "b a")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 5, 8: 5, 5: 5, 3: 3, 2: 1, 1: 1, 0: 0}


def test_hot_groups_lose_no_link(spark):
    """A group beyond `hot` goes the other way and ends in the same components."""
    import random

    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join([w if rng.random() > 0.03 else f"n{rng.random()}" for w in base])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda hot: {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, hot=hot).collect()}
    assert get(4096) == get(4)


def test_pages(spark):
    rows = [(1, "http://A.com/en/1", "<p>x"), (1, "http://A.com/en/1", "<p>x"), (2, None, None), (None, "nothing", ""), (3, "ftp://b.net", "<p>x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, rule long")
    back = warc.read_archives(warc.materialise(warc.write_archives(pages, fresh_dir(spark, "t"))), 64)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in back.collect())
    assert kinds == [("1", "revisit", 3), ("1", "revisit", 3), ("2", "response", None), ("3", "response", None), ("None", "response", None)]
    assert warc.read_archives(warc.materialise(warc.write_archives(pages.limit(0), fresh_dir(spark, "t")))).count() == 0
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    assert sorted(r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()) == ["allow"] * 3 + ["block"] * 2
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 5
    trees = extract.train(pages.limit(0))
    assert extract.extract(pages, trees).count() == 5 and extract.extract(pages.limit(0), trees).count() == 0


def test_place_among_many_siblings():
    nodes = extract.walk(extract.parse("<html><body><ul>" + "<li>x</li>" * 500 + "</ul></body></html>"))
    at = [k for k, node in enumerate(nodes) if node.tag == "li"]
    places = extract.node_features(nodes)[at, extract.FEATURES.index("place")]
    assert places.round(4).tolist() == pytest.approx([round(i / 500, 4) for i in range(500)], abs=1e-4)


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [-1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk.integer_vector(F.col("e")).alias("v")).where("vec_id is not null and v is not null")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 20), (0, 3, 100, 1 << 19), (100, 1, 0, 1 << 19), (100, 2, 1, 1 << 19), (100, 3, 2, 1 << 19)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_vectors_of_any_size_and_length(spark):
    big = float(1 << 40)
    rows = [(100, [big, 1.0]), (1, [big, -1.0]), (2, [1.0, 1.0]), (3, [-big, 0.5]), (200, [0.5, 0.25, 1.0]), (4, [1.0, 1.0, 1.0]), (5, [float("inf"), 1.0]), (300, []), (400, [3e38, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.integer_vector(F.col("e")).alias("v")).where("v is not null")
    held = {r["vec_id"]: r["v"] for r in v.collect()}
    want = []
    for q in (100, 200, 400):
        scored = [(max(min(sum(a * b for a, b in zip(held[q], x, strict=True)), 2**63 - 1), -(2**63)), i) for i, x in held.items() if i != q and len(x) == len(held[q])]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(scored, key=lambda t: (-t[0], t[1]))[:10])]
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == want


def test_top_rows_by_slices_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    for shift in (0, 3):
        exact = rng.integers(-1024, 1025, (700, 9)) << shift
        exact[rng.integers(0, 700, 200)] = exact[5]  # ties
        q, ids = rng.integers(-900, 900, (5, 9)), rng.permutation(700)
        low = exact.min(axis=0)
        s = max(0, int((exact - low).max()).bit_length() - topk.SLICE_BITS)
        bits = ((((exact - low) >> s).astype(np.uint16).T[:, None, :] >> np.arange(topk.SLICE_BITS, dtype=np.uint16)[None, :, None]) & 1).astype(np.uint8)
        slices = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, -700 % 64))), axis=2, bitorder="little").view(np.uint64)
        got = topk.search_block(np.arange(1000, 1005), q, ids, low, s, slices, exact.astype(np.int32), 10)
        scores = exact @ q.T
        want = [(1000 + i, int(ids[j]), int(scores[j, i])) for i in range(5) for j in np.lexsort((ids, -scores[:, i]))[:10]]
        assert got == want


def test_urls_and_payloads_of_hot_keys(spark, monkeypatch):
    """The salted ways give what the broadcast ways give."""
    rows = [(i, "http://a.com/en/1" if i % 3 else None, "<p>x" if i % 2 else None) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    judge = lambda: sorted(map(str, url_filter.filter_urls(pages, rules).collect()))
    write = lambda: sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.materialise(warc.write_archives(pages, fresh_dir(spark, "t")))).collect())
    small = judge(), write()
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    assert (judge(), write()) == small and small[1][-1] == (59, "response", None) and small[1][0] == (0, "revisit", 58)


def test_rules_of_the_contract(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://b.example.net/de/7", "http://example.net/de/8", "http://a.org/es/", "http://a.org/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
