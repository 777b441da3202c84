"""Ids beyond 2^53 beside null ids come back as they are; repeated ids in a search."""

import numpy as np
import pytest

from outlay.llm import extract, packing, sharding, topk, warc
from outlay.llm.workspace import fresh_dir, materialise

BIG = 2**60 + 1


@pytest.mark.parametrize("ids", [[BIG, BIG + 1, None], [BIG, BIG + 2, BIG + 4]])
def test_documents(spark, ids):
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    for out in (sharding.shuffle_to_shards(docs, 4), packing.pack(docs, packing.default_tokenizer())):
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("ids", [[BIG, BIG + 1, None], [BIG, BIG + 2, BIG + 4]])
def test_pages(spark, ids):
    pages = spark.createDataFrame([(i, "http://a/", "<p>some words</p>") for i in ids], "page_id long, url string, html string").coalesce(1)
    model = extract.train(pages.where("false"))
    assert sorted((r["page_id"] for r in extract.extract(pages, model).collect()), key=str) == sorted(ids, key=str)
    manifest = warc.write_archives(pages, fresh_dir(spark, "ids"))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(materialise(manifest)).collect()), key=str)
    last = max(i for i in ids if i is not None)
    want = [(i, *(("response", None) if i in (last, None) else ("revisit", last))) for i in ids]
    assert got == sorted(want, key=str)


def test_repeated_ids_in_a_search(spark):
    rng = np.random.default_rng(6)
    rows = [(100 if i < 12 else i % 40 + 1, rng.integers(-500, 500, 6).tolist()) for i in range(72)] + [(200, [1, 2, 3, 4, 5, 6])] * 3
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()
    for q in (100, 200):
        own = min(v for i, v in rows if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:10]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
