"""Periodic runs of words: every maximal stretch that repeats with some period at least three times.

All within a document, by suffix structures over its words (numbered, each document with numbers of its own, so
a group of documents can be worked on together and nothing matches across them):

1. Prefix doubling ranks all blocks of 1, 2, 4, 8 and 16 words. A run of at least 24 words and three periods repeats 16 of
   its words at another place, so documents without such a repeat have no run and stop here.
2. For the rest doubling goes on until all suffixes are apart: that is the suffix array. The tables of ranks say, with exact
   comparisons, how far two places agree forwards and backwards; so do they for the LCP array.
3. One pass over suffix and LCP array gives the longest previous factor of every word and where it stands; its jumps are
   the Lempel-Ziv blocks.
4. A run that isn't inside one block touches a border and has a period below the two blocks beside it: Main's extensions, for all
   borders and periods at once, find it from the first full period right or left of the border.
5. A run inside a block was there where the block's earlier copy stands: sorted by start, the found
   runs are the buckets from which each block, left to right, copies.

Stretches come out with their smallest period: of equal stretches the smallest found stays, as three full periods
make every other one a multiple of it.

Defined results: a null text has no words (no run, hashes of nothing); null and repeated doc_ids are rows like any other and
come back as they are, at any size; an empty table gives no rows; extra columns are not read. A text of any length is
taken whole, by one task: memory is about 300 bytes a word for texts that repeat 16 words, 40 for others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.bytes_text import lean

MIN_WORDS = 24
MIN_PERIODS = 3
#: Words of a group of documents that are ranked together; a longer document is a group of its own.
GROUP_WORDS = 1 << 18
#: A run has this many words twice: length - period >= 2/3 of MIN_WORDS. A power of two.
TWICE = 16

Run = tuple[int, int, int]
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Blocks:
    """Ranks of all blocks of 2**k words; ``tables[k]`` has one more entry, which equals no other."""

    def __init__(self, words: np.ndarray, end: np.ndarray) -> None:
        """words: numbers from 0 without gaps, none in two documents; end: of each word's document."""
        counts = np.bincount(words) if len(words) else np.zeros(0, np.int64)
        first = np.cumsum(counts) - counts
        self.end, self.tables, self.base = end, [self._closed(first[words])], len(words) + 2
        self.open = np.flatnonzero(counts[words] > 1)

    @staticmethod
    def _closed(rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int64)

    def double(self) -> None:
        """Blocks twice as long; only those not yet told apart are compared."""
        last, at, step = self.tables[-1], self.open, 1 << (len(self.tables) - 1)
        after = np.where(at + step < self.end[at], last[np.minimum(at + step, len(last) - 1)] + 1, 0)
        order = np.argsort(last[at] * self.base + after, kind="stable")
        at, after = at[order], after[order]
        old = last[at]
        new_old = np.append(True, old[1:] != old[:-1]) if len(at) else np.zeros(0, bool)
        new = new_old | np.append(True, after[1:] != after[:-1]) if len(at) else new_old
        place = np.arange(len(at))
        # a class holds the ranks from its own on: a part's rank is the class's plus what stands before the part
        rank = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_old, place, 0))
        table = last.copy()
        table[at] = rank
        self.tables.append(table)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(at)))
        self.open = np.sort(at[np.repeat(size > 1, size)])

    def keep(self, which: np.ndarray) -> None:
        """Only the marked words (whole documents) stay."""
        moved = np.cumsum(which) - 1
        self.tables = [self._closed(t[:-1][which]) for t in self.tables]
        self.end = moved[self.end[which] - 1] + 1
        self.open = moved[self.open]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i < j, one document)."""
        n, last = np.zeros(len(i), np.int64), len(self.end)
        for k in range(len(self.tables) - 1, -1, -1):
            t = self.tables[k]
            n += (t[np.minimum(i + n, last)] == t[np.minimum(j + n, last)]).astype(np.int64) << k
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal (i < j, one document)."""
        n, last = np.zeros(len(i), np.int64), len(self.end)
        for k in range(len(self.tables) - 1, -1, -1):
            t, a = self.tables[k], i - n - (1 << k)
            n += ((a >= 0) & (t[np.where(a >= 0, a, last)] == t[np.maximum(j - n - (1 << k), 0)])).astype(np.int64) << k
        return n


def previous_factors(blocks: Blocks) -> tuple[list[int], list[int]]:
    """(length, place) of the longest factor at each word that also starts before it in its document."""
    n = len(blocks.end)
    array = np.empty(n, np.int64)
    array[blocks.tables[-1][:n]] = np.arange(n)
    low, high = np.minimum(array[1:], array[:-1]), np.maximum(array[1:], array[:-1])
    lcp = [0, *blocks.ahead(low, high).tolist(), 0]
    sa = [*array.tolist(), -1]
    length, place = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (place in the text, words in common with the entry below)
    for i, pos in enumerate(sa):
        common = lcp[i]
        while stack and stack[-1][0] > pos:
            top, below = stack.pop()
            if below > common or pos < 0:
                length[top], place[top] = below, stack[-1][0] if stack else -1
            else:
                length[top], place[top] = common, pos
            common = min(common, below)
        stack.append((pos, common))
    return length, place


def lz_blocks(length: list[int], end: np.ndarray) -> list[int]:
    """Starts of the blocks: the longest factor that stands before, or one new word."""
    out, i = [], 0
    while i < len(length):
        out.append(i)
        i += length[i] or 1
    return out


def _at_borders(blocks: Blocks, starts: np.ndarray) -> set[Run]:
    """Runs that touch a border of blocks (start, length, period), found from either side."""
    n = len(blocks.end)
    size = np.diff(np.append(starts, n))
    doc_end = blocks.end[starts]
    first_of_doc = np.append(True, doc_end[1:] != doc_end[:-1])
    # borders: before each block, and behind the last one of a document
    left = np.where(first_of_doc, 0, np.append(0, size[:-1]))
    last_of_doc = np.append(first_of_doc[1:], True)
    border = np.concatenate([starts, (starts + size)[last_of_doc]])
    reach = np.concatenate([left + size, size[last_of_doc]])
    low = np.concatenate([np.maximum.accumulate(np.where(first_of_doc, starts, 0)), np.maximum.accumulate(np.where(first_of_doc, starts, 0))[last_of_doc]])
    high = np.concatenate([doc_end, doc_end[last_of_doc]])
    # three periods: 3 p <= length < p + both blocks
    most = np.maximum(reach // (MIN_PERIODS - 1), 0)
    found: set[Run] = set()
    step = max(1, GROUP_WORDS * 4)
    cuts = np.searchsorted(np.cumsum(most), np.arange(step, most.sum() + step, step)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(most)), strict=True):
        times = most[a:b]
        p = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
        at, lo, hi = (np.repeat(x[a:b], times) for x in (border, low, high))
        for i, ok in ((at, at + p < hi), (at - p, at - p >= lo)):
            i, q, end, begin = i[ok], p[ok], hi[ok], lo[ok]
            on = blocks.ahead(i, i + q)
            back = blocks.behind(i, i + q)
            whole = on + back + q
            good = whole >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            assert ((i - back >= begin) & (i + on + q <= end)).all()
            found.update(zip((i - back)[good].tolist(), whole[good].tolist(), q[good].tolist()))
    return found


def all_runs(blocks: Blocks) -> list[Run]:
    """Every run of three periods and MIN_WORDS words: (start, length, period), by start and period."""
    length, place = previous_factors(blocks)
    starts = lz_blocks(length, blocks.end)
    smallest: dict[tuple[int, int], int] = {}
    for s, n, p in _at_borders(blocks, np.array(starts)):
        smallest[s, n] = min(p, smallest.get((s, n), p))
    runs = sorted((s, p, n) for (s, n), p in smallest.items())
    known = set(runs)
    for s in starts:
        size, source = length[s], place[s]
        if size < MIN_WORDS + 2:
            continue
        at = bisect_right(runs, (source + 1,))
        while at < len(runs) and runs[at][0] + MIN_WORDS < source + size:
            start, period, n = runs[at]
            copy = (start + s - source, period, n)
            if start + n < source + size and copy not in known:
                known.add(copy)
                insort(runs, copy)
            at += 1
    return [(s, n, p) for s, p, n in runs]


def _groups(texts: list[list[bytes]]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, words in enumerate(texts):
        if len(words) < MIN_WORDS:
            continue
        if held and size + len(words) > GROUP_WORDS:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(words)
    if held:
        yield held


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each list of words."""
    out: list[list[Run]] = [[] for _ in texts]
    for group in _groups(texts):
        words, lengths, base = [], [], 0
        for i in group:
            number: dict[bytes, int] = {}
            own = np.fromiter((number.setdefault(w, len(number)) for w in texts[i]), np.int64, len(texts[i]))
            words.append(own + base)
            base += len(number)
            lengths.append(len(own))
        end = np.cumsum(lengths)
        blocks = Blocks(np.concatenate(words), np.repeat(end, lengths))
        while len(blocks.open) and 1 << (len(blocks.tables) - 1) < TWICE:
            blocks.double()
        doc = np.repeat(np.arange(len(group)), lengths)
        live = np.zeros(len(group), bool)
        live[doc[blocks.open]] = True
        if not live.any():
            continue
        blocks.keep(live[doc])
        while len(blocks.open):
            blocks.double()
        # ranks of documents that went are gaps: close them
        order = np.argsort(blocks.tables[-1][:-1], kind="stable")
        blocks.tables[-1][order] = np.arange(len(order))
        begins = np.concatenate([[0], np.cumsum(np.array(lengths)[live])])
        owner = np.array(group)[live]
        for s, n, p in all_runs(blocks):
            k = int(np.searchsorted(begins, s, side="right")) - 1
            out[owner[k]].append((s - int(begins[k]), n, p))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, prepare=None) -> DataFrame:  # noqa: ANN001
    """docs(doc_id, text) -> doc_id, n_words, runs, collapsed. ``prepare(doc_id, words)`` may change the words first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]  # bytes split at \x20 and \x09-\x0D
            if prepare is not None:
                words = [prepare(i, w) for i, w in zip(batch.column(0).to_pylist(), words, strict=True)]
            runs = runs_of(words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], _RUNS),
                    pa.array([collapse(w, r).decode() for w, r in zip(words, runs, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lean(find), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own documents: of every tenth doc_id (by its crc32) the end becomes periodic. Null ids: unchanged."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
    # greatest length / period, exactly: fractions compared crosswise; earlier in (start, period) order wins a tie
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
