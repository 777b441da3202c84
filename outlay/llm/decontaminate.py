"""Benchmark decontamination with suffix arrays of the training text.

Each task builds, for each batch of documents (a shard), a suffix array over word
positions: suffixes are compared by the ranks of their words in the test vocabulary, to
``WINDOW`` words. Only suffixes whose first words occur together in some test item are
kept, as no other can match. Every test suffix (a window of an item, or a whole short item)
is binary-searched; the interval found gives all its occurrences. Runs of matching windows
on one diagonal give the longest verbatim matches and their places.

The test set reaches tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents each, so a broadcast has a fixed bound; documents are never shuffled.

Words: A-Z lower-cased, then maximal runs of digits, a-z and non-ASCII characters.
Defined results: null or wordless text has no words and no hits; null-text, wordless or
null-id items are never found; items that share an id count as one; repeated rows stay; an
empty benchmark finds nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.bytes_text import ALNUM, chunks, lean, mix, Words
from outlay.llm.workspace import materialise

WINDOW = 10
BLOCK_BYTES = 16 << 20
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
_SCHEMA = "doc_id long, text string, n_words long, n_hit long, hit binary, matches array<struct<item_id: long, doc_word: long, item_word: long, n_words: long>>"


class TestSet:
    """Sorted test suffixes of one block of items."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = Words([t.encode() for _, t in items], ALNUM)
        self.vocabulary = np.unique(words.hash)
        rank = np.searchsorted(self.vocabulary, words.hash) + 1
        length = np.diff(words.first)
        size = np.minimum(WINDOW, length)
        windows = np.where(size > 0, length - size + 1, 0)
        which = np.repeat(np.arange(len(items)), windows)
        self.at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.item, self.n = np.array([i for i, _ in items], dtype=np.int64)[which], size[which]
        inside = np.arange(WINDOW) < self.n[:, None]
        words_of = (words.first[which] + self.at)[:, None] + np.arange(WINDOW)
        keys = np.where(inside, rank[np.minimum(words_of, len(rank) - 1)], 0)
        self.keys = _as_strings(keys)
        self.after = _as_strings(np.where(inside, keys, 0xFFFFFFFF))
        self.lead = min(3, int(self.n.min(initial=WINDOW)))
        heads = keys[:, : self.lead].astype(np.uint64)
        self.heads = np.unique(_combined([heads[:, i] for i in range(self.lead)]))
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[self.vocabulary & np.uint64(0xFFFF)] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """1-based ranks in the test vocabulary, 0 for other words."""
        out = np.zeros(len(hashes), dtype=np.uint32)
        maybe = np.flatnonzero(self.low[hashes & np.uint64(0xFFFF)])
        if len(self.vocabulary) and len(maybe):
            i = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            found = self.vocabulary[i] == hashes[maybe]
            out[maybe[found]] = i[found] + 1
        return out


def _as_strings(ranks: np.ndarray) -> np.ndarray:
    """Rows of big-endian ranks as byte strings that sort as the rows do."""
    return np.ascontiguousarray(ranks.astype(">u4")).view(f"S{4 * WINDOW}").ravel()


def _combined(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + c.astype(np.uint64))
    return h


def _suffixes(ranks: np.ndarray, first: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Word positions that can start a match, and their suffixes cut at WINDOW words or the text's end."""
    ends = np.repeat(first[1:], np.diff(first))
    live = np.flatnonzero(ranks)
    live = live[live + test.lead <= ends[live]]
    if test.lead > 1:
        for i in range(1, test.lead):
            live = live[ranks[live + i] > 0]
    if not len(live) or not len(test.heads):
        return np.zeros(0, np.int64), np.zeros((0, WINDOW), ">u4")
    head = _combined([ranks[live + i] for i in range(test.lead)])
    i = np.minimum(np.searchsorted(test.heads, head), len(test.heads) - 1)
    live = live[test.heads[i] == head]
    steps = live[:, None] + np.arange(WINDOW)
    inside = steps < ends[live][:, None]
    return live, np.where(inside, ranks[np.minimum(steps, len(ranks) - 1)], 0).astype(">u4")


def _shard(test: TestSet, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(words of each text; text and place of each suffix; the suffix array; each test suffix's interval of it)."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    doc, place, suffix = [], [], []
    for at, part in chunks(texts):
        words = Words(part, ALNUM)
        n_words[at : at + len(part)] = np.diff(words.first)
        live, rows = _suffixes(test.ranks(words.hash), words.first, test)
        owner = np.searchsorted(words.first, live, side="right") - 1
        doc.append(owner + at)
        place.append(live - words.first[owner])
        suffix.append(rows)
    doc, place, suffix = np.concatenate(doc), np.concatenate(place), np.concatenate(suffix)
    keys = _as_strings(suffix)
    array = np.argsort(keys, kind="stable")  # the shard's suffix array
    ordered = keys[array]
    low, high = np.searchsorted(ordered, test.keys, side="left"), np.searchsorted(ordered, test.after, side="right")
    return n_words, doc, place, array, low, high


def _hit_texts(test: TestSet, texts: list[str | None]) -> np.ndarray:
    """Whether each text has a match: intervals are joined, not listed, however many items share a passage."""
    _, doc, _, array, low, high = _shard(test, texts)
    some = high > low
    edges = np.bincount(low[some], minlength=len(array) + 1) - np.bincount(high[some], minlength=len(array) + 1)
    hit = np.zeros(len(texts), dtype=bool)
    hit[doc[array[np.cumsum(edges[:-1]) > 0]]] = True
    return hit


def _search(test: TestSet, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words of each text, its hit words, matches as rows text, item, place, item place, words)."""
    n_words, doc, place, array, low, high = _shard(test, texts)
    count = np.where(high > low, high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hit = array[np.repeat(low, count) + inside]
    return n_words, *_matches(test, len(texts), n_words, doc[hit], place[hit], which)


def _matches(test: TestSet, n_texts: int, n_words: np.ndarray, doc: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    item, at, n = test.item[which], test.at[which], test.n[which]
    order = np.lexsort((place, place - at, item, doc))
    doc, place, item, at, n = doc[order], place[order], item[order], at[order], n[order]
    if not len(doc):
        return [np.zeros(0, np.int64)] * n_texts, np.zeros((0, 5), np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    runs = np.stack([doc[first], item[first], place[first], at[first], place[last] + n[last] - place[first]], axis=1)
    hits = [np.zeros(0, np.int64)] * n_texts
    bounds = np.searchsorted(runs[:, 0], np.arange(n_texts + 1))
    for d in np.unique(runs[:, 0]):
        edge = np.zeros(n_words[d] + 1, dtype=np.int64)
        own = runs[bounds[d] : bounds[d + 1]]
        np.add.at(edge, own[:, 2], 1)
        np.add.at(edge, own[:, 2] + own[:, 4], -1)
        hits[d] = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return hits, runs


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    for r in items.toLocalIterator():
        if held and size + len(r["text"]) * 4 > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) * 4
    yield held


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, n_words, n_hit, hit (one bit a word), matches."""
    spark = docs.sparkSession
    empty = F.array().cast("array<struct<item_id: long, doc_word: long, item_word: long, n_words: long>>")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit"), empty.alias("matches"))
    for k, block in enumerate(_blocks(benchmark)):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = TestSet(shared.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                n_words, hits, runs = _search(test, batch.column(1).to_pylist())
                bounds = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
                before, seen = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                bits = []
                for d, own in enumerate(hits):
                    if len(own):
                        flags = np.zeros(n_words[d], dtype=bool)
                        flags[own] = True
                        packed = np.packbits(flags)
                        bits.append((packed | np.frombuffer(before[d], np.uint8) if before[d] else packed).tobytes())
                        seen[d] = seen[d] + [dict(zip(("item_id", "doc_word", "item_word", "n_words"), map(int, r[1:]), strict=True)) for r in runs[bounds[d] : bounds[d + 1]]]
                    else:
                        bits.append(before[d])
                n_hit = [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) if b else 0 for b in bits]
                columns = [batch.column(0), batch.column(1), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(seen, _MATCH)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "n_hit", "hit", "matches"])

        if k:
            out = materialise(out)
        out = out.mapInArrow(lean(search), _SCHEMA)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any hit word, with all their columns; one pass for each block of items."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(list({text: (i, text) for i, text in block}.values()))  # a text is found once, whoever has it

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = TestSet(shared.value)
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(~_hit_texts(test, batch.column(at).to_pylist())))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform(F.array_distinct(F.transform("matches", lambda m: m["item_id"])), lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bp AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key FROM bp
), dp AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hits AS (
  SELECT dp.doc_id, dp.i, dp.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key FROM dp) dp JOIN win USING (n, key)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
