"""Operators that SQL can't express, against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlay.llm import extract, packing, repeats, sharding, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut_by_hand(texts, window=200):
    """(removed bytes, runs, hash of the rest) of each text: all windows counted in a dictionary."""
    seen = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1 if i + window <= len(b) else 0
        mask = np.cumsum(gone)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(b), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def test_repeats_on_documents(spark, docs):
    rows = docs.orderBy(F.octet_length("text")).limit(150).collect()
    want = dict(zip((r["doc_id"] for r in rows), cut_by_hand([(r["text"] or "").encode() for r in rows]), strict=True))
    got = {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(spark.createDataFrame(rows, docs.schema)).collect()}
    assert got == want


@pytest.mark.parametrize("split", [2, 4096])
def test_repeats_on_planted_passages(spark, split):
    rng = np.random.default_rng(3)
    some = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    passage, longer = some(230), some(900)
    texts = [some(300) + passage + some(50), passage + some(400), some(150) + passage[:200] + some(10), longer, longer, some(20) + longer[100:420] + some(60), passage + passage, "ab" * 400, "ab" * 400 + "x", some(199), "", None, passage[:199]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(cut_by_hand([(t or "").encode() for t in texts])))
    assert {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(rows, split).collect()} == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, packing.default_tokenizer()).collect()
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append(r)
    assert set(per_doc) == set(ids) and set(per_sequence) == set(range(len(per_sequence)))
    for doc, pieces in per_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            own = np.array(ids[doc][at : at + p["length"]], dtype="<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids[doc]), zlib.crc32(own.tobytes()))
            at += p["length"]
        assert at == len(ids[doc])
    for pieces in per_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert len(per_sequence) <= 1.05 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_sharding(docs):
    rows = sharding.shuffle_to_shards(docs).collect()
    n = len(rows)
    counts = Counter(r["shard"] for r in rows)
    assert n == docs.count() and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 40
    for shard, size in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))
    by_id = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(by_id[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]]) for r in rows)


def test_matrix_has_exact_margins():
    counts = np.array([5, 0, 17, 30, 1])
    m = sharding.communication_matrix(counts, 4, 1)
    assert (m.sum(axis=1) == counts).all() and sorted(m.sum(axis=0)) == [13, 13, 13, 14]


def test_toxicity_on_held_out_rows(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in scored)
    assert len(scored) >= 10 and right / len(scored) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_extraction_of_composed_pages(spark):
    import random

    rng = random.Random(99)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    train = [f"<html><body><nav><ul><li><a href='/'>x</a></li></ul></nav><article><h1>{' '.join(rng.choices(words, k=4))}</h1><p>{' '.join(rng.choices(words, k=40))}.</p></article><footer>y</footer></body></html>" for _ in range(30)]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(train)], "page_id long, url string, html string")
    trees = extract.train(pages)
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>Some  long\n text, with many words in it, and more.</p><p>Second<br>line of the text here, also long enough.</p></article><footer>Imprint</footer></body></html>"
    got = extract.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, None, "")], "page_id long, url string, html string"), trees).orderBy("page_id").collect()
    assert got[0]["text"] == "A & B\nSome long text, with many words in it, and more.\nSecond line of the text here, also long enough."
    assert [r["text"] for r in got[1:]] == ["", ""] and got[0]["n_chars"] == len(got[0]["text"])
