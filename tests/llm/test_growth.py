"""What must not grow faster than the input."""

import numpy as np

from outlay.llm import decontaminate, jaccard, repeats, topk


def test_survey_sends_a_packet_a_bucket(spark):
    """A million shingles of one task meet each bucket once: packets grow with tasks times buckets."""
    rows = [(d, " ".join(map(str, range(d * 10_000, d * 10_000 + 5_000)))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packets = jaccard._pack_all(docs, 8).select("bucket").collect()
    assert sorted(r["bucket"] for r in packets if r["bucket"] >= 0) == list(range(8))


def test_pairs_of_like_size():
    """900 sets of 900 sizes that share a passage: each pair whose sizes can reach the threshold, no other."""
    sets = [np.arange(n, dtype=np.uint64) for n in range(100, 1000)]
    pairs = sum(4 * a >= 3 * b for a in range(100, 1000) for b in range(a + 1, 1000))
    met = [x for x, _ in jaccard._paired(np.arange(3), np.array([1, 2, 3]), np.array([3, 3, 3]), 2)]
    assert np.concatenate(met).tolist() == [0, 0, 1]
    size = np.array([len(s) for s in sets])
    end = np.searchsorted(size, size * 100 // 75, side="right")
    assert sum(len(x) for x, _ in jaccard._paired(np.arange(900), np.arange(900) + 1, end)) == pairs


def test_signatures_are_those_of_single_sets():
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, i % 4 * 3, dtype=np.uint64)) for i in range(9)]
    a, b = jaccard._signatures(sets)
    assert list(zip(a, b, strict=True)) == [jaccard.signature(s) for s in sets]
    assert jaccard._signatures([]) == ([], [])


def test_items_that_share_a_passage_are_not_listed_by_text():
    """10 000 items of one passage, 10 000 texts that hold it: a hundred million matches, of which only the texts are asked."""
    passage = "one two three four five six seven eight nine ten"
    test = decontaminate.TestSet([(i, passage) for i in range(10_000)])
    texts = [f"{i} {passage}" if i % 2 else f"{i}" for i in range(20_000)]
    assert decontaminate._hit_texts(test, texts).tolist() == [i % 2 == 1 for i in range(20_000)]
    assert not decontaminate._hit_texts(decontaminate.TestSet([]), texts[:2]).any()
    assert decontaminate._hit_texts(decontaminate.TestSet([(1, "nine")]), [passage, None, ""]).tolist() == [True, False, False]


def test_surroundings_are_told_apart():
    """By each byte, also where only top bits differ, by key and by where a text begins and ends."""
    ctx = np.zeros((340, repeats.BEFORE + repeats.WINDOW), np.uint8)
    ctx[np.arange(336), np.arange(336)] = 128
    ctx[336, [7, 15]] = 128
    key, before, behind = np.ones(340, np.uint64), np.full(340, 9, np.int16), np.full(340, 9, np.int16)
    key[337], before[338], behind[339] = 2, 8, 8
    which, member = repeats._first_of(*repeats._known_by(*(np.concatenate([x, x[::-1]]) for x in (key, ctx, before, behind))))
    assert len(which) == 340
    assert (member[:340] == member[340:][::-1]).all() and sorted(member[:340]) == list(range(340))


def test_index_is_not_copied_for_each_block_of_queries(spark, monkeypatch):
    """Index blocks travel once: queries come to them in several broadcasts, and ids that fall on one salt are no matter."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 200)
    rng = np.random.default_rng(3)
    rows = [(i * 200, [int(x) for x in rng.integers(-500, 500, 4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(v, v.where("vec_id % 1000 = 0"), 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    want = []
    for q, x in rows[::5]:
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == want


def test_best_of_a_query_at_the_ends_of_64_bits():
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    rows = np.array([[1, 5, low], [1, 4, high], [1, 3, high], [2, 9, low], [1, 6, 0]], dtype=np.int64)
    assert topk._best([rows[:2], rows[2:]], 2).tolist() == [[1, 3, high], [1, 4, high], [2, 9, low]]
    assert len(topk._best([rows[:0]], 2)) == 0
