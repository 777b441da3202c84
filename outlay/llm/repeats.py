"""Suffix-array deduplication: every byte of a 200-byte string that also starts elsewhere goes.

A suffix array of all positions of a corpus is many times its size, so the array is a
sparse one: of each 200-byte window the 64-byte string with the smallest hash is its
anchor. Equal windows have equal anchors at equal places, so every repeat of 200
bytes is seen from an anchor it holds. Only anchors whose string stands elsewhere too (counted
by a pre-aggregated groupBy, over everything) send their surroundings: what lies before and
behind, as far as a window through the anchor reaches.

For each anchor string, its suffixes are sorted and their common prefixes stack-scanned: the
intervals are the nodes of the common-prefix interval tree. In each node the left
contexts are sorted and scanned in turn; a left interval is a maximal repeat when it is
diverse to the left (it ends where left extensions differ) and its suffixes come from more than
one child of the node. A maximal repeat covers all its occurrences.

Equal texts count as one during the search; a text with copies is removed whole if it has a
window. An anchor string in more than ``SPLIT`` places is split: its surroundings are dealt
by five longer strings around it, of which any two equal windows share one. Surroundings that are
equal travel and are compared once a task and bucket. The tree over two suffixes is one interval,
so those are settled for all anchors of two surroundings at once.

Texts travel once, to their hash: the search and the cut read the same exchange.

Defined results: null text is empty: nothing removed, hash of no bytes; texts under 200 bytes stay
whole; windows never cross texts; repeated rows each get the result of their text, which
counts as copied; an empty table gives no rows; extra columns are not read, whatever their names.
Texts are dealt by 64-bit hashes and told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.bytes_text import CHUNK_BYTES, distinct, give_back, lean, mix, prefix_sums, span_hashes
from outlay.llm.workspace import materialise

WINDOW = 200
ANCHOR = 64
BEFORE = WINDOW - ANCHOR
SPLIT = 4096
_STEP = 34
#: (bytes before the anchor, bytes from it) of the longer strings that split common anchors.
_AROUND = [(max(0, WINDOW - _STEP - y), y) for y in range(ANCHOR, WINDOW + 1, _STEP)]
#: Places that a bucket holds on average; places, and distinct surroundings of them, that a task packs before it sends them.
#: A pack goes to all buckets, so packets grow with the square of the input and shrink with both sizes.
BUCKET_ROWS = 40_000
FLUSH_ROWS = 500_000
FLUSH_DISTINCT = 60_000
MIN_BUCKETS = 256

_U = np.uint64
_SEGMENT = 1 << 24


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 64-bit hashes) of the anchors of all windows inside bounds[i]:bounds[i+1]."""
    found = [np.zeros(0, np.int64)]
    sums = prefix_sums(data)
    for at in range(0, max(1, len(data) - WINDOW + 1), _SEGMENT - WINDOW):
        part = min(len(data), at + _SEGMENT)
        starts = np.arange(at, part - ANCHOR + 1)
        n = len(starts) - BEFORE  # windows
        if n < 1:
            break
        ends_here = bounds[np.searchsorted(bounds, np.arange(at, at + n), side="right")]
        h = span_hashes(sums, starts, starts + ANCHOR) & ~_U(_SEGMENT - 1) | np.arange(len(starts)).astype(_U)
        least = _sliding_min(h, BEFORE + 1)[:n][np.arange(at, at + n) + WINDOW <= ends_here]
        found.append(distinct((least & _U(_SEGMENT - 1)).astype(np.int64)) + at)
    at = distinct(np.concatenate(found))
    return at, span_hashes(sums, at, at + ANCHOR)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of h[i : i + width] for each i, by running minima of blocks from either side."""
    blocks = np.pad(h, (0, -len(h) % width), constant_values=_U(0xFFFFFFFFFFFFFFFF)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _packs(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, their bytes in a row, bounds) for runs of about CHUNK_BYTES."""
    first, held, size = 0, [], 0
    for i, t in enumerate([*texts, None]):
        b = (t or "").encode()
        if held and (size + len(b) > CHUNK_BYTES or i == len(texts)):
            yield first, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])])
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)


def _places(docs: DataFrame) -> DataFrame:
    """docs(sig, text) -> (hash, sig, pos) of every text's anchors; copies met in one task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs = np.asarray(batch.column(0))
            texts = batch.column(1).to_pylist()
            for i, s in enumerate(sigs.tolist()):
                if s in seen:
                    texts[i] = None
                seen.add(s)
            if len(seen) > 1_000_000:
                seen.clear()
            for first, data, bounds in _packs(texts):
                at, h = anchors(data, bounds)
                own = np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sigs[own + first]), pa.array(at - bounds[own])], names=["hash", "sig", "pos"])

    return docs.mapInArrow(lean(run), "hash long, sig long, pos long")


_FACTORS = mix(np.arange(1, 2 * (BEFORE + WINDOW) // 8 + 1, dtype=np.uint64)) | _U(1)


def _known_by(key: np.ndarray, ctx: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each key with its surroundings."""
    words = mix(np.ascontiguousarray(ctx).view(np.uint64))
    of, n = mix(key) ^ mix((before.astype(np.uint64) << _U(16)) + behind.astype(np.uint64)), words.shape[1]
    return mix((words * _FACTORS[:n]).sum(axis=1) + of), mix((words * _FACTORS[n:]).sum(axis=1) ^ mix(of))


def _first_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each distinct (a, b); and for each row which it has."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    member = np.empty(len(by), dtype=np.int64)
    member[by] = np.cumsum(new) - 1
    return by[new], member


_SENT = "bucket int, hashes binary, before binary, behind binary, contexts binary, member binary, sigs binary, sigs2 binary, pos binary"


def _surroundings(joined: DataFrame, n_buckets: int, split: int) -> DataFrame:
    """joined(_sig, _sig2, text, doc_id or row, at array<struct<pos, n>>) -> packed surroundings by bucket of the anchor's key.

    Rows come sorted by _sig: a copy of the text before is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # distinct surroundings of a chunk
        found_at: list[tuple] = []  # and which of them its rows have
        rows = kept = 0

        def hold(key: np.ndarray, ctx: np.ndarray, before: np.ndarray, behind: np.ndarray, *where: np.ndarray) -> None:
            nonlocal rows, kept
            a, b = _known_by(key, ctx, before, behind)
            which, member = _first_of(a, b)
            held.append((key[which], ctx[which], before[which], behind[which], a[which], b[which]))
            found_at.append((member + kept, *where))
            rows, kept = rows + len(key), kept + len(which)

        def flush() -> pa.RecordBatch:
            key, ctx, before, behind, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            member, sig, sig2, pos = (np.concatenate(x) for x in zip(*found_at, strict=True))
            which, merged_ = _first_of(a, b)
            bucket = (mix(key[which]) % _U(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            which, bucket = which[by], bucket[by]
            place = np.empty(len(by), dtype=np.int64)
            place[by] = np.arange(len(by))
            member = place[merged_[member]]
            by = np.argsort(member, kind="stable")
            member, sig, sig2, pos = member[by].astype(np.int32), sig[by], sig2[by], pos[by].astype(np.int32)
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            of = np.searchsorted(member, edges)
            out = []
            for i, j, k, m in zip(edges[:-1].tolist(), edges[1:].tolist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                some = which[i:j]
                out.append((int(bucket[i]), key[some].tobytes(), before[some].tobytes(), behind[some].tobytes(), ctx[some].tobytes(), (member[k:m] - np.int32(i)).tobytes(), sig[k:m].tobytes(), sig2[k:m].tobytes(), pos[k:m].tobytes()))
            kinds = [pa.int32()] + [pa.binary()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])

        last = None
        for batch in batches:
            sigs, sigs2 = np.asarray(batch.column("_sig")), np.asarray(batch.column("_sig2"))
            new = []
            for i, s in enumerate(zip(sigs.tolist(), sigs2.tolist(), strict=True)):
                if s != last:
                    new.append(i)
                last = s
            batch = batch.take(pa.array(new, pa.int64()))
            sigs, sigs2 = sigs[new], sigs2[new]
            places = batch.column("at")
            counts = np.diff(np.asarray(places.offsets))
            flat = places.flatten()
            at_all, n_all = np.asarray(flat.field("pos")), np.asarray(flat.field("n"))
            begins = np.concatenate([[0], np.cumsum(counts)])
            for first, data, bounds in _packs(batch.column("text").to_pylist()):
                k = len(bounds) - 1
                lo, hi = begins[first], begins[first + k]
                if lo == hi:
                    continue
                own = np.repeat(np.arange(k), counts[first : first + k])
                pos, n = at_all[lo:hi], n_all[lo:hi]
                there = pos + ANCHOR <= np.diff(bounds)[own]  # a text that shares half a signature may be shorter
                own, pos, n = own[there], pos[there], n[there]
                at = pos + bounds[own]
                before = np.minimum(BEFORE, pos).astype(np.int16)
                behind = np.minimum(WINDOW, bounds[own + 1] - at).astype(np.int16)
                steps = np.arange(-BEFORE, WINDOW)
                inside = (steps >= -before[:, None]) & (steps < behind[:, None])
                ctx = np.where(inside, data[np.clip(at[:, None] + steps, 0, len(data) - 1)], 0).astype(np.uint8)
                sums = prefix_sums(data)
                usual = n <= split
                parts = [(usual, span_hashes(sums, at, at + ANCHOR))]
                if not usual.all():
                    for x, y in _AROUND:
                        fits = ~usual & (before >= x) & (behind >= y)
                        parts.append((fits, mix(span_hashes(sums, at - np.where(fits, x, 0), at + np.where(fits, y, 0)) + _U(y))))
                for mask, key in parts:
                    if mask.any():
                        hold(key[mask], ctx[mask], before[mask], behind[mask], sigs[own[mask] + first], sigs2[own[mask] + first], pos[mask])
                if rows >= FLUSH_ROWS or kept >= FLUSH_DISTINCT:
                    yield flush()
                    held, found_at, rows, kept = [], [], 0, 0
        if held:
            yield flush()

    return joined.mapInArrow(lean(run), _SENT)


def _distinct(key: np.ndarray, before: np.ndarray, behind: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of distinct surroundings, ordered by key and suffix; and for each row which it has."""
    raw = np.concatenate([key.astype(">u8")[:, None].view(np.uint8).reshape(len(key), 8), ctx[:, BEFORE:], ctx[:, :BEFORE][:, ::-1], before.astype(">i2")[:, None].view(np.uint8).reshape(len(key), 2), behind.astype(">i2")[:, None].view(np.uint8).reshape(len(key), 2)], axis=1)
    rows = np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel()
    _, which, member = np.unique(rows, return_index=True, return_inverse=True)
    return which, member


def common_prefix(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a with the same row of b."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(a_len, b_len))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of depth >= least; lcp[i] is between i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = int(lcp[i]) if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(left: np.ndarray, right: np.ndarray, before: np.ndarray, behind: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats through one anchor: (bytes before it, bytes from it, rows that have it).

    Rows are distinct surroundings sorted by `right`; `left` reads away from the anchor.
    """
    n = len(right)
    lcp = np.zeros(n, dtype=np.int64)
    lcp[1:] = common_prefix(right[1:], right[:-1], behind[1:], behind[:-1])
    rank = np.argsort(np.argsort(np.ascontiguousarray(left).view(f"V{left.shape[1]}").ravel(), kind="stable"), kind="stable")
    for depth, first, last in intervals(lcp, 1):
        rows = np.arange(first, last + 1)[np.argsort(rank[first : last + 1], kind="stable")]
        shared = np.zeros(len(rows), dtype=np.int64)
        shared[1:] = common_prefix(left[rows[1:]], left[rows[:-1]], before[rows[1:]], before[rows[:-1]])
        if shared.max() + depth < WINDOW:
            continue
        for extent, a, b in intervals(shared, max(0, WINDOW - depth)):
            own = rows[a : b + 1]
            if lcp[own.min() + 1 : own.max() + 1].min() == depth:  # from more than one child of the node
                yield extent, depth, own


def _covered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the stretch of its text that each anchor's repeats cover: (sig, sig2, first, last + 1)."""
    get = lambda c, t: [np.frombuffer(x, t) for x in pdf[c]]
    keys, contexts = get("hashes", np.uint64), get("contexts", np.uint8)
    shift = np.cumsum([0] + [len(k) for k in keys[:-1]])
    row = np.concatenate([m + s for m, s in zip(get("member", np.int32), shift, strict=True)])
    sig, sig2, pos = np.concatenate(get("sigs", np.int64)), np.concatenate(get("sigs2", np.int64)), np.concatenate(get("pos", np.int32))
    key, before, behind = np.concatenate(keys), np.concatenate(get("before", np.int16)), np.concatenate(get("behind", np.int16))
    ctx = np.concatenate(contexts).reshape(len(key), BEFORE + WINDOW)
    which, merged = _distinct(key, before, behind, ctx)
    row = merged[row]
    key, ctx, before, behind = key[which], ctx[which], before[which].astype(np.int64), behind[which].astype(np.int64)
    places = pd.DataFrame({"row": row, "sig": sig, "sig2": sig2, "pos": pos}).drop_duplicates()
    reach_left, reach_right = np.full(len(key), -1), np.full(len(key), -1)
    twice = (np.bincount(places["row"], minlength=len(key)) > 1) & (before + behind >= WINDOW)
    reach_left[twice], reach_right[twice] = before[twice], behind[twice]
    left, right = ctx[:, :BEFORE][:, ::-1], ctx[:, BEFORE:]
    bounds = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] + _U(1))), len(key))
    size = np.diff(bounds)
    two = bounds[:-1][size == 2]
    if len(two):
        l = common_prefix(left[two], left[two + 1], before[two], before[two + 1])
        r = common_prefix(right[two], right[two + 1], behind[two], behind[two + 1])
        ok = l + r >= WINDOW
        for rows in (two[ok], two[ok] + 1):
            reach_left[rows], reach_right[rows] = np.maximum(reach_left[rows], l[ok]), np.maximum(reach_right[rows], r[ok])
    for first, n in zip(bounds[:-1][size > 2], size[size > 2], strict=True):
        own = slice(first, first + n)
        for l, r, rows in maximal_repeats(left[own], right[own], before[own], behind[own]):
            rows = rows + first
            reach_left[rows], reach_right[rows] = np.maximum(reach_left[rows], l), np.maximum(reach_right[rows], r)
    del keys, contexts, ctx, left, right
    give_back()
    hit = places[reach_left[places["row"]] >= 0]
    at = hit["row"].to_numpy()
    return pd.DataFrame({"sig": hit["sig"], "sig2": hit["sig2"], "first": hit["pos"] - reach_left[at], "last": hit["pos"] + reach_right[at]})


def _dealt(docs: DataFrame, split: int) -> DataFrame:
    """docs(text, ...) without nulls in text -> the same rows with _sig, _sig2 and _found: array<struct<sig2, first, last>>.

    Stretches that repeat, unmerged; of a text with copies the whole (first = -1). Entries are for the rows with their sig2.
    """
    docs = docs.withColumn("_sig", F.xxhash64("text", F.octet_length("text"))).withColumn("_sig2", F.xxhash64(F.lit(WINDOW), F.octet_length("text"), "text"))
    long_ = docs.where(F.octet_length("text") >= WINDOW)
    copied = long_.groupBy(F.col("_sig").alias("sig"), F.col("_sig2").alias("sig2")).agg(F.count("*").alias("n")).where("n > 1").select("sig", "sig2", F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"))
    places = _places(long_.select(F.col("_sig").alias("sig"), "text"))
    common = materialise(places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.xxhash64("sig", "pos")).alias("a"), F.max(F.xxhash64("sig", "pos")).alias("b")).where("n > 1 and a != b").select("hash", "n"))
    wanted = materialise(places.join(common, "hash").groupBy("sig").agg(F.collect_set(F.struct("pos", "n")).alias("at")))
    n_rows = wanted.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    n_buckets = max(MIN_BUCKETS, n_rows // BUCKET_ROWS)
    # all columns of docs stay on the left of both joins, so that both read one exchange
    sent = _surroundings(docs.join(wanted.withColumnRenamed("sig", "_sig"), "_sig"), n_buckets, split)
    spans = sent.groupBy("bucket").applyInPandas(_covered, "sig long, sig2 long, first long, last long")
    found = spans.unionByName(copied).groupBy("sig").agg(F.collect_list(F.struct("sig2", "first", "last")).alias("_found"))
    return docs.join(found.withColumnRenamed("sig", "_sig"), "_sig", "left")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _gone(text: bytes, sig2: int, found: list[dict] | None) -> list[tuple[int, int]]:
    own = [(s["first"], s["last"]) for s in found or [] if s["sig2"] == sig2]
    return [(0, len(text))] if own and min(own)[0] < 0 else merged(own)


def _rest(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for first, last in gone:
        kept.append(text[at:first])
        at = last
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, sig2, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                b = text.encode()
                gone = _gone(b, sig2, found)
                kept = _rest(b, gone)
                rows.append((doc_id, len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=[c.split()[0] for c in _CUT.split(", ")])

    return _dealt(docs, split).select("doc_id", "text", "_sig2", "_found").mapInArrow(lean(cut), _CUT)


def without_repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs(text, ...) with the remaining text, and its length where there is a column n_chars; null text stays null.

    Bytes that the cuts leave of a split character go with it. Other columns pass unread, whatever their names.
    """
    schema = docs.schema
    others = [f"_{i}" for i in range(len(schema))]
    text_at = schema.names.index("text")
    chars_at = schema.names.index("n_chars") if "n_chars" in schema.names else None
    renamed = docs.toDF(*others).withColumn("text", F.coalesce(F.col(others[text_at]), F.lit(""))).withColumn("null", F.col(others[text_at]).isNull()).drop(others[text_at])
    held = [c for c in others if c != others[text_at]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, null, sig2, found in zip(*(batch.column(c).to_pylist() for c in ("text", "null", "_sig2", "_found")), strict=True):
                b = text.encode()
                texts.append(None if null else _rest(b, _gone(b, sig2, found)).decode("utf-8", "ignore"))
            columns = [batch.column(c) if c in held else pa.array(texts, pa.string()) for c in others]
            if chars_at is not None:
                was = columns[chars_at]
                columns[chars_at] = pa.array([c if t is None else len(t) for t, c in zip(texts, was.to_pylist(), strict=True)], was.type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _dealt(renamed, split).select(*held, "text", "null", "_sig2", "_found").mapInArrow(lean(cut), schema)


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
