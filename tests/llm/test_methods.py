"""The operators' inner methods against plain ones, and the pipeline against its stages done by hand."""

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outlay.llm import decontaminate, jaccard, packing, toxicity


def kernel_by_hand(a: bytes, b: bytes, order: int, decay: float) -> float:
    """All pairs of equal subsequences, each weighted by decay to the lengths spanned."""
    spans = defaultdict(list)
    for i in itertools.combinations(range(len(a)), order):
        spans[bytes(a[k] for k in i)].append(i[-1] - i[0] + 1)
    total = 0.0
    for j in itertools.combinations(range(len(b)), order):
        total += sum(decay ** (s + j[-1] - j[0] + 1) for s in spans.get(bytes(b[k] for k in j), ()))
    return total


@pytest.mark.parametrize("size", [60, 600])
def test_landmarks_cover_and_are_no_chance(size):
    rng = np.random.default_rng(size)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(400)]
    some = lambda: list(rng.choice(words, 30))
    clean = [" ".join(some()) for _ in range(size)]
    toxic = [" ".join([*some(), *(["zorgwit"] if i % 2 else ["quvelt"]), *(["vaxxen"] if i % 3 == 0 else [])]) for i in range(size)]
    assert sorted(toxicity.choose_landmarks(toxic, clean)) == [b"quvelt", b"vaxxen", b"zorgwit"]  # also beside another insult
    assert toxicity.choose_landmarks(clean, clean[::-1]) == [] and toxicity.choose_landmarks([" ".join(some()) for _ in range(size)], clean) == []
    assert toxicity.choose_landmarks(["", "ab"], [""]) == []


@pytest.mark.parametrize("gap", [".", "--"])
def test_spelled_insults_of_the_training_words(gap):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioustrnl"), rng.integers(2, 9))) for _ in range(500)]
    some = lambda: list(rng.choice(words, 40))
    clean, toxic = [" ".join(some()) for _ in range(300)], [" ".join([*some(), ["moron", "scumbag", "idiot"][i % 3], *some()]) for i in range(300)]
    model = toxicity.fit(toxic, clean)
    score = lambda texts: model.scores(toxicity.Kernels(model.landmarks).pooled(texts))
    fresh = [some() for _ in range(100)]
    assert (score([" ".join(x) for x in fresh]) >= 0.5).mean() <= 0.03
    for insult in ("moron", "scumbag", "idiot"):
        assert (score([" ".join([*x, gap.join(insult)]) for x in fresh]) >= 0.5).mean() >= 0.9


@pytest.mark.parametrize(("order", "decay"), toxicity.KERNELS)
def test_kernel(order, decay):
    for a, b in [(b"zorgwit", b"zo.rg.wit"), (b"zorgwit", b"zorgw"), (b"zorgwit", b"zorgworgwzorg"), (b"aab", b"abaab"), (b"zorgwit", b"calm"), (b"abcd", b"dcba")]:
        got = toxicity.subsequence_kernel(np.frombuffer(a, np.uint8), toxicity._row(b)[None, :], order, decay)[0]
        assert got == pytest.approx(kernel_by_hand(a, b, order, decay), rel=1e-4, abs=1e-6)


def test_kernel_values_are_never_cut():
    landmarks = [b"zorgwit", b"aab"]
    kernels = toxicity.Kernels(landmarks)
    units = [b"zorgw", b"zorgworgwzorg", b"zxo", b"gow", b"b", b"abaab", b"quiet", b"zorgwit"]
    got = kernels.values(np.stack([toxicity._row(u) for u in units]))
    for j, (order, decay) in enumerate(toxicity.KERNELS):
        for k, s in enumerate(landmarks):
            own = kernel_by_hand(s, s, order, decay)
            want = [min(1.0, kernel_by_hand(s, u, order, decay) / own) if own else 0.0 for u in units]
            if own:
                assert got[:, j * len(landmarks) + k].tolist() == pytest.approx(want, rel=1e-4, abs=1e-6)


ODD = [
    "J̌ a", "T̈x", "W̊", "", "ΟΔΟΣ ΣΑΣ.", "İstanbul I ı İ.", "a  b\n\nc.", "1.5, 2.", "é. É.", "é.", "<|endoftext|> A", "a <|x|>", "Ω Å K ﬁ ㎏", "́a", " ́", "\t tab\r x", "日本語 テスト。", "ẞ ß ŉ", "ǅ ǈ", "AͅΒ",
    "don't. can't,", "a's b''s *'s x's5 5's A'S i'LL o'Re 'tis", "9a9 a9! !9 9! 9́ á. ß! ×! ÷a Ā. ²3 3²", "x='y' (z) [w]{v} a_b-c/d", "🙂. x🙂, y", "\x01 a\x01b", "nul\x00l a\x0bb\x1cc\x85d\xa0e",
]


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    texts = [*ODD, *(a + " " + b for a in ODD for b in ODD), "w" * 20_000, "né. " * 9_000]
    ids, ends = words.encode_closed(texts)
    for text, a, b in zip(texts, [0, *ends.tolist()[:-1]], ends.tolist(), strict=True):
        assert ids[a:b].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], text


def groups_by_hand(rows):
    """Component of each row, by comparing all pairs of shingle sets."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * same >= 75 * len(sets[i] | sets[j]):
            comp[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.fixture(scope="module")
def near_copies():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    common = [word() for _ in range(60)]
    rows = []
    for size in (8, 30, 120):
        base = [word() for _ in range(size)]
        rows += [" ".join(w if rng.random() > p else word() for w in base) for p in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08) for _ in range(4)]
    rows += [" ".join([*common, *(word() for _ in range(int(n)))]) for n in rng.integers(0, 60, 30)]
    rows += ["", "  ", "A b", "a  B", "a b c d e", "a b c d e f"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("hot", [jaccard.HOT, 3])
def test_jaccard_groups(spark, near_copies, hot):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.jaccard_components(docs, hot=hot).collect())) == groups_by_hand(near_copies)


def test_jaccard_of_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "else")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] > 1}
    assert got == {2: 1, 3: 1, 4: 4}
    assert jaccard.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage's own input, in plain Python: what goes, what is cut, what is packed."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 5))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, item = some(60), some(12)
    texts = [some(80) for _ in range(30)]
    texts += [f"{some(30)} zorgwit {some(30)}" for _ in range(20)]  # toxic
    texts += [texts[0], texts[1] + " more", some(20) + " " + passage + " " + some(20), passage + " " + some(30)]
    texts += [some(30) + " " + item + " " + some(5), "", None]
    rows = [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(30 <= i < 50)) for i in range(50)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    safe = stages["toxicity"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in safe.collect()} == set(range(57)) - set(range(30, 50))
    once = stages["ngram_jaccard_join"](spark, safe, str(tmp_path))
    own = [(r["doc_id"], r["text"]) for r in safe.collect()]
    keep = {c for _, _, c in groups_by_hand(own)}
    assert {r["doc_id"] for r in once.collect()} == keep == set(range(57)) - set(range(30, 52))
    cut = {r["doc_id"]: r["text"] for r in stages["suffix_array_dedup"](spark, once, str(tmp_path)).collect()}
    left = {r["doc_id"]: r["text"] for r in once.collect()}
    changed = {i for i in cut if cut[i] != left[i]}
    assert changed == {52, 53} and all(passage not in cut[i] and cut[i] in (left[i].replace(passage, ""), left[i].replace(passage + " ", ""), left[i].replace(" " + passage + " ", "")) for i in changed)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == keep - {54}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for r in out:
        ids = [*tok.encode(cut[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["length"], r["doc_tokens"]) == (0, len(ids), len(ids)) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stages_keep_columns_of_any_name(spark):
    columns = ["doc_id", "text", "n_chars", "_sig", "_gone", "sid", "n", "_0", "null", "component_id", "score"]
    rows = [(1, "one two three four five six", 27, 1, 2, 3, 4, 5, 6, 7, 8), (2, "x " * 300, 600, 1, 2, 3, 4, 5, 6, 7, 8), (3, None, 0, 1, 2, 3, 4, 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in columns))
    from outlay.llm import repeats

    for got in (jaccard.keep_one_each(docs), repeats.without_repeats(docs), repeats.without_repeats(docs.drop("n_chars")).withColumn("n_chars", F.lit(1)), decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "zzz")], "item_id long, text string"))):
        assert set(got.columns) == set(columns) and {(r["doc_id"], r["_sig"], r["_0"], r["null"], r["sid"]) for r in got.collect()} == {(i, 1, 5, 6, 3) for i in (1, 2, 3)}


def test_landmarks_without_all_texts_at_once(monkeypatch):
    import random
    import tracemalloc

    from outlay.llm import bytes_text

    monkeypatch.setattr(bytes_text, "CHUNK_BYTES", 1 << 16)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(700)]
    clean = [" ".join(rng.sample(words, 600)) for _ in range(400)]
    toxic = [x + " blockhead" for x in clean]
    sets = list(toxicity._gram_sets(toxic))
    total = sum(s.nbytes for s in sets)
    del sets
    tracemalloc.start()
    found = toxicity.choose_landmarks(toxic, clean)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(x in b"blockhead" for x in found)
    assert peak < total
