"""Packing: shortest-pack-first over the length histogram.

Documents become token ids (closing id included) and are cut only where they exceed the
sequence length. The histogram of piece lengths, at most ``SEQUENCE`` numbers, is all that
the driver sees: it places lengths longest first, always into the shortest open pack
(the one with most room), and keeps packing patterns with counts, not packs. Pieces get
a rank among those of their length, in salted slices so that a hot length isn't one task,
and patterns are joined back to pieces by (length, rank).

Defined results: null text counts as empty (one closing id); repeated rows and null ids are
packed like any other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.bytes_text import lean, mix, prefix_sums, span_hashes
from outlay.llm.workspace import materialise

SEQUENCE = 4096
CLOSING_ID = 2
#: Pieces of one length that are ranked in one sort, and such sorts beyond one a length, at most.
SLICE_ROWS = 1_000
SLICES = 1 << 16
#: Distinct words whose ids a task keeps; beyond, it starts afresh.
CACHE_WORDS = 200_000


#: Stands between words that are encoded in one go; no other byte of UTF-8 text has its token.
_BETWEEN = "\x01"

_ALL = np.arange(256)
_SPACE = (_ALL == 32) | (_ALL == 10)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_LETTER = ((_ALL >= 97) & (_ALL <= 122)) | ((_ALL >= 65) & (_ALL <= 90))
_POINT = (_ALL > 32) & (_ALL < 127) & ~_DIGIT & ~_LETTER
#: By the second byte: letters from À to ÿ, whose first byte is 0xC3.
_LATIN = (_ALL >= 0x80) & (_ALL != 0x97) & (_ALL != 0xB7)


def _prepared(text: str) -> bytes:
    """The text in lower case where the tokenizer would get the same letters, else as it is.

    The tokenizer composes first (NFC) and lower-cases letter by letter then; lower-casing first is the
    same where both forms are composed already and no letter depends on its neighbours.
    """
    if not text.isascii():
        low = text.lower()
        same = "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return (low if same else text).encode()
    return text.lower().encode()


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts: cut at spaces and newlines, and where a letter, a digit and a mark meet.

    The pre-tokeniser cuts at all these places, whatever stands around; a mark that is an
    apostrophe stays with what follows it.
    """
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    last, this = data[:-1], data[1:]
    letter = _LETTER[last]
    letter[1:] |= (data[:-2] == 0xC3) & _LATIN[last[1:]]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (letter & _POINT[this]) | (_POINT[last] & (last != 39) & _LETTER[this])
    cut[1:-1] |= (_DIGIT[last] & (this > 32) & (this < 127)) | (_DIGIT[this] & (last > 32) & (last < 127))
    start = ~space[1:] & (space[:-1] | cut)
    end = ~space[:-1] & (space[1:] | cut)
    return np.flatnonzero(start), np.flatnonzero(end)


class WordTokenizer:
    """Ids of whole texts, encoding each distinct word once.

    The tokenizer's pre-tokenisation never crosses a space or newline, so ids of a text are
    those of its parts in order; so it is where letters, digits and marks meet, and fewer
    distinct parts are left. Parts are known by 64-bit hashes and their length. Texts that
    may hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, closing: int = CLOSING_ID) -> None:
        self.closing = closing
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        alone = self.tok.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = alone[0] if len(alone) == 1 else None
        self._reset()

    def _reset(self) -> None:
        """Code 0 closes a document; known: sorted hashes, and their codes."""
        self.known, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length, self.ids = np.zeros(1, np.int64), np.array([1]), np.array([self.closing], dtype=np.uint32)

    def _add(self, length: np.ndarray, ids: list[int]) -> np.ndarray:
        first = len(self.start)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.asarray(ids, dtype=np.uint32)])
        return np.arange(first, first + len(length))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """How many ids each word has, and all of them: in one go, with a control character between words."""
        if self.between is not None and not any(_BETWEEN in w for w in words):
            ids = np.asarray(self.tok.encode_batch_fast([f"\n{_BETWEEN}\n".join([*words, ""])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.between)
            if len(ends) == len(words):
                return np.diff(ends, prepend=-1) - 1, ids[ids != self.between]
        e = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.asarray(e.word_ids, dtype=np.int64), minlength=len(words)), e.ids

    def _codes(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), dtype=bool)
        if new.any():
            where = np.flatnonzero(new)
            fresh, first = np.unique(h[where], return_index=True)
            words = [raw[start[i] : end[i]].decode() for i in where[first].tolist()]
            codes = self._add(*self._encode(words))
            to = np.searchsorted(self.known, fresh)
            self.known, self.code = np.insert(self.known, to, fresh), np.insert(self.code, to, codes)
            at = np.searchsorted(self.known, h)
        return self.code[at]

    def encode_closed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its closing id, in a row; and where each ends."""
        if len(self.known) > CACHE_WORDS:
            self._reset()
        whole = {i: self.tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if "<|" in t}
        parts = [b"" if i in whole else _prepared(t) for i, t in enumerate(texts)]
        raw = b"\n".join([*parts, b""])
        data = np.frombuffer(raw, np.uint8)
        start, end = _spans(data)
        h = mix(span_hashes(prefix_sums(data), start, end) + (end - start).astype(np.uint64))
        ends = np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts]))
        code = np.insert(self._codes(raw, start, end, h), ends, 0)
        length = self.length[code]
        stop = np.cumsum(length)
        ids = self.ids[np.repeat(self.start[code] - stop + length, length) + np.arange(stop[-1])]
        ends = stop[ends + np.arange(len(ends))]
        if whole:
            firsts = ends[list(whole)] - 1
            ids = np.insert(ids, np.repeat(firsts, [len(w) for w in whole.values()]), np.array([i for w in whole.values() for i in w], dtype=np.uint32))
            grown = np.zeros(len(ends), dtype=np.int64)
            grown[list(whole)] = [len(w) for w in whole.values()]
            ends = ends + np.cumsum(grown)
        return ids, ends


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker process, so that known words stay known."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for at in range(0, len(docs), 256):
                ids, ends = tok.encode_closed([t or "" for t in texts.slice(at, 256).to_pylist()])
                raw, first = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, end in zip(docs[at : at + 256], ends.tolist(), strict=True):
                    for s in range(first, end, sequence):
                        e = min(s + sequence, end)
                        rows.append((doc, s - first, e - s, zlib.crc32(raw[4 * s : 4 * e]), end - first))
                    first = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


Pattern = tuple[tuple[int, int], ...]


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[Pattern, int]]:
    """Counts by length -> packing patterns ((length, times), ...) with counts, shortest pack first.

    Each step uses up a pattern or a length, so there are at most three patterns a length.
    """
    open_packs: list[tuple[int, int, int]] = []  # (-room, tie, pattern number)
    patterns: list[tuple[Pattern, int]] = []
    done: list[tuple[Pattern, int]] = []

    def keep(lengths: Pattern, count: int) -> None:
        room = sequence - sum(n * times for n, times in lengths)
        if room == 0:
            done.append((lengths, count))
            return
        patterns.append((lengths, count))
        heapq.heappush(open_packs, (-room, len(patterns), len(patterns) - 1))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and open_packs and -open_packs[0][0] >= length:
            lengths, count = patterns[heapq.heappop(open_packs)[2]]
            used = min(count, left)
            if used < count:
                keep(lengths, count - used)
            more = (*lengths[:-1], (length, lengths[-1][1] + 1)) if lengths[-1][0] == length else (*lengths, (length, 1))
            keep(more, used)
            left -= used
        fit = sequence // length
        if left >= fit:
            keep(((length, fit),), left // fit)
        if left % fit:
            keep(((length, left % fit),), 1)
    return done + [patterns[i] for _, _, i in open_packs]


def place(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to the materialised pieces."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    segments, base = [], 0
    for lengths, count in pack_histogram(counts, sequence):
        offset = 0
        for length, times in lengths:
            segments.append((length, taken[length], base, offset, count))
            taken[length] += count * times
            offset += length * times
        base += count
    # at most three patterns a length, each of under 100 distinct lengths: bounded whatever the input
    seg_there = spark.sparkContext.broadcast(np.array(sorted(segments), dtype=np.int64).reshape(-1, 5))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = seg_there.value
        key = (seg[:, 0] << 48) + seg[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            time, pack = np.divmod(rank - seg[i, 1], seg[i, 4])
            yield pdf.drop(columns="rank").assign(sequence_id=seg[i, 2] + pack, offset=seg[i, 3] + time * length)

    rows = max(SLICE_ROWS, sum(counts.values()) // SLICES)
    slices = spark.createDataFrame([(n, -(-c // rows)) for n, c in counts.items()], "length long, slices long")  # a row a length
    salted = cut.join(F.broadcast(slices), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "slices").cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("r", F.row_number().over(inside))
        .join(F.broadcast(starts), ["length", "salt"])  # at most SEQUENCE + SLICES rows
        .select(F.col("doc_id").cast("string").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", (F.col("from") + F.col("r") - 1).cast("long").alias("rank"))
    )
    # as text: pandas would make floats of ids beside nulls
    placed = ranked.mapInPandas(assign, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    return place(materialise(pieces(docs, tokenizer_path, sequence)), sequence)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
