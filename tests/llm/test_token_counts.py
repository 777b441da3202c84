"""Token counts against the library's own, text by text."""

import random

import pytest

from outlay.llm import token_counts as t

PARTS = [" ", "  ", "\n", "\t", "a", "the", "The", "é", "▁", "1", "23", ".", "...", "();", "<s>", "</s>", "<unk>", "\x00", "​", "中", "文", "ﬁ", "x" * 7, "\xa0", "_", "__", "'s", "\r\n", "😀", "́", "<0x0A>", "ing", "tion", "².", "³"]


@pytest.fixture(scope="module")
def library():
    return t._library(t.default_model())


@pytest.mark.parametrize("window", [1, 3, 1 << 18])
def test_composed_texts(window, library, monkeypatch):
    monkeypatch.setattr(t, "WINDOW", window)
    monkeypatch.setattr(t, "MEMO_WORDS", 40_000 if window > 1 else 0)
    rng = random.Random(window)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    counting = t.Counting(t.Rules(t.default_model()), t.default_model())
    assert counting.texts(texts) == [len(library.encode(x)) for x in texts]


def test_proven_strings_are_one_token(library):
    rules = t.Rules(t.default_model())
    assert len(rules.words) > 10_000 and len(rules.inner) > 10_000
    assert all(len(library.encode(w)) == 1 for w in rules.words - {""})


def test_documents_and_edges(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "lost"), (2**60 + 1, None), (4, ""), (4, "word " * 90_000), (5, "x" * 200_000), (6, " " * 3000)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = sorted(map(tuple, t.count_tokens(docs, t.default_model()).collect()), key=str)
    want = [(i, len((x or "").encode()), n := len(library.encode(x or "")), n > 4096) for i, x in docs.collect()]
    assert got == sorted(want, key=str)
    assert t.count_tokens(docs.limit(0), t.default_model()).count() == 0
    clash = spark.createDataFrame([("a", "b c", 5)], "doc_id string, text string, n_tokens long")
    assert [tuple(r) for r in t.count_tokens(clash, t.default_model()).collect()] == [("a", 3, 2, False)]
