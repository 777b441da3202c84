"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set is its distinct 5-word shingles. The join goes from all texts to few:

1. ``_survey``: shingles of all texts, dealt to buckets by hash, tell how many shingles of each
   set stand in another set too. A set with less than the share of the threshold links
   with nothing and goes no further. Shingles that a task meets in several sets are
   settled there, so a common passage sends two postings a task, not one a document.
2. ``_ordered_sets``: one text of each remaining set is read again, and the number of sets that
   hold each shingle is counted exactly. Single shingles match nothing and are left out.
3. Rounds (``_candidates``, ``_agreed``, ``_links``): an order sorts shingles rarest first and then
   by hash, or single ones first and then by another hash. Sets with Jaccard >= t share a
   token within their prefixes of |x| - ceil(t |x|) + 1 tokens under every order, and what stands
   behind the shared token must suffice for the overlap. Candidates are the pairs found under
   all orders; each is verified on the whole sets. The first rounds compare a group's members
   with a few leaders only, which joins most near copies; the last compares all pairs whose
   sets are still in different components.

Pairs travel packed, to the cell of one side; the sets they name travel once a cell, and a cell
returns a spanning forest of its links. A token of more than ``HOT`` sets is dealt to several
groups; sets outside the largest component visit all of them.

Results: every document gets n_shingles and component_id; copies are not expanded into
pairs. Null or wordless text has an empty set, linked with nothing; under five words the
whole sequence is one shingle; rows that share a doc_id count as one document
with the links of each of its texts; rows without a doc_id link nothing; an empty table
gives no rows; extra columns are not read. Shingles are compared as 64-bit hashes, sets told apart by
128-bit signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.bytes_text import NOT_SPACE, Words, chunks, distinct, give_back, lean, mix
from outlay.llm.components import components
from outlay.llm.workspace import materialise, slots

N = 5
#: Similarity at which documents link, as a fraction of whole numbers.
THRESHOLD = (75, 100)
ORDERS = 2
#: Sets of one token's group at most; tokens of more sets are dealt to several groups.
HOT = 1 << 14
#: Rounds that compare members of a group with so many leaders, before the one for all pairs.
LEADER_ROUNDS = 2
LEADERS = 8
#: Shingles that a bucket holds on average, and that a task packs before it sends them.
BUCKET_POSTINGS = 1 << 19
FLUSH_POSTINGS = 1 << 19
#: The same in the survey of all texts. A pack goes to all buckets, so packets grow with the square of the input and shrink with both sizes.
SURVEY_POSTINGS = 1 << 21
#: Bytes of sets that a cell holds on average, and sets of one component that share a cell.
CELL_BYTES = 4 << 20
CELL_SETS = 1 << 10
#: Bytes of ids up to which a side of a join is broadcast.
BROADCAST_BYTES = 16 << 20

_U = np.uint64
_STEPS = [_U(0x9FB21C651E98DF25), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)]
_SECOND = _U(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in chunks(texts):
        words = Words(part, NOT_SPACE)
        h = words.hash
        k = max(0, len(h) - N + 1)
        g = h[:k]
        for i in range(1, N):
            g = mix(g * _STEPS[i - 1] + h[i : i + k])
        for i in range(len(part)):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= N:
                yield distinct(g[a : b - N + 1])
            elif b > a:
                short = h[a : a + 1]
                for j in range(a + 1, b):
                    short = mix(short * _STEPS[0] + h[j : j + 1] + _U(b - a))
                yield short
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a, b = mix(shingles + _U(1)), mix(shingles ^ _U(0x5851F42D4C957F2D))
    return int(np.add.reduce(a).view(np.int64)), int(np.add.reduce(b).view(np.int64))


def _signatures(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """``signature`` of each set, all at once."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    full = np.flatnonzero(sizes)
    first, shingles = (np.cumsum(sizes) - sizes)[full], np.concatenate([*sets, np.zeros(0, np.uint64)])
    out = np.zeros((2, len(sets)), dtype=np.uint64)
    if len(full):
        out[0, full] = np.add.reduceat(mix(shingles + _U(1)), first)
        out[1, full] = np.add.reduceat(mix(shingles ^ _U(0x5851F42D4C957F2D)), first)
    return out[0].view(np.int64).tolist(), out[1].view(np.int64).tolist()


def _need(n, threshold: tuple[int, int]):  # noqa: ANN001, ANN202
    """Shingles that a set of n must share with any set it links with."""
    return -(-threshold[0] * n // threshold[1])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _join(parts, kind) -> np.ndarray:  # noqa: ANN001
    return np.concatenate([np.frombuffer(p, kind) for p in parts]) if len(parts) else np.zeros(0, kind)


def _few(df: DataFrame, n: int, bytes_each: int) -> DataFrame:
    return F.broadcast(df) if n * bytes_each <= BROADCAST_BYTES else df


# -- 1: which sets can link at all

_PACKED = "bucket int, ids binary, known binary, tokens binary, many binary, sigs binary, sigs2 binary"
_SURVEYED = "doc_id long, n long, sig long, sig2 long, home int, sigs binary, shared binary"


def _each(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[int | None, np.ndarray, int, int]]:
    """(doc_id, set, its signature) of a batch's rows; few texts at a time are Python strings."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        sets = list(shingle_sets(part.column(1).to_pylist()))
        yield from zip(part.column(0).to_pylist(), sets, *_signatures(sets), strict=True)


def _pack_all(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Packets of documents (a negative bucket) and of their sets' shingles by bucket.

    Within a bucket a shingle is 32 bits of its hash: a chance twin only keeps a set in.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs, sigs2, sizes, sets, seen, held, turn = [], [], [], [], [], {}, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            no = b""
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            plain = np.array([i or 0 for i in ids], dtype=np.int64)
            own = -1 - turn % n_buckets
            rows = [(own, plain.tobytes(), known.tobytes(), np.array(sizes, np.int64).tobytes(), no, np.array(sigs, np.int64).tobytes(), np.array(sigs2, np.int64).tobytes())]
            if sets:
                sig = np.array([s for s, _ in seen], dtype=np.int64)
                tokens = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                sets.clear()
                by = np.argsort(tokens)
                ordered = tokens[by]
                third = by[2:][(ordered[2:] == ordered[1:-1]) & (ordered[1:-1] == ordered[:-2])]
                del by, ordered
                settled = np.bincount(owner[third], minlength=len(sig)).astype(np.uint32)
                rows.append((own, no, no, no, settled.tobytes(), sig.tobytes(), no))
                sent = np.ones(len(tokens), dtype=bool)
                sent[third] = False
                spread, owner = mix(tokens[sent]), owner[sent]
                del tokens, third, sent
                bucket, short = (spread % _U(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64), (spread // _U(n_buckets)).astype(np.uint32)
                del spread
                by = np.argsort(bucket, kind="stable")  # owners stay in order
                bucket, short, owner = bucket[by], short[by], owner[by]
                first = np.flatnonzero(_runs(bucket, owner))
                used, many = sig[owner[first]], np.diff(first, append=len(owner)).astype(np.uint32)
                bounds = np.append(np.flatnonzero(_runs(bucket)), len(bucket))
                inner = np.searchsorted(first, bounds)
                for i, j, k, m in zip(bounds[:-1].tolist(), bounds[1:].tolist(), inner[:-1].tolist(), inner[1:].tolist(), strict=True):
                    rows.append((int(bucket[i]), no, no, short[i:j].tobytes(), many[k:m].tobytes(), used[k:m].tobytes(), no))
            kinds = [pa.int32()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "ids", "known", "tokens", "many", "sigs", "sigs2"])

        for batch in batches:
            for doc, s, *sig in _each(batch):
                ids.append(doc)
                sigs.append(sig[0])
                sigs2.append(sig[1])
                sizes.append(len(s))
                if len(s) and tuple(sig) not in seen:
                    seen[tuple(sig)] = True
                    sets.append(s)
                    held += len(s)
                if held >= SURVEY_POSTINGS or len(ids) >= FLUSH_POSTINGS:
                    yield flush()
                    ids, sigs, sigs2, sizes, sets, seen, held = [], [], [], [], [], {}, 0
        if ids:
            yield flush()

    return docs.mapInArrow(lean(pack), _PACKED)


def _survey(docs: DataFrame, n_buckets: int, n_homes: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, sig, sig2) of documents, (home, sigs, shared) of counts."""

    def homes(sigs: np.ndarray, shared: np.ndarray) -> pd.DataFrame:
        home = (mix(sigs.view(np.uint64)) % _U(n_homes)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        bounds = np.flatnonzero(_runs(home[by])) if len(by) else []
        rows = [(int(home[by[i]]), sigs[by[i:j]].tobytes(), shared[by[i:j]].astype(np.uint32).tobytes()) for i, j in zip(bounds, [*bounds[1:], len(by)], strict=False)]
        return pd.DataFrame(rows, columns=["home", "sigs", "shared"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["bucket"].iloc[0]) < 0:
            of_docs = pdf[pdf["ids"].str.len() > 0]
            known = _join(of_docs["known"], np.uint8).astype(bool)
            ids = pd.array(_join(of_docs["ids"], np.int64), "Int64")
            ids[~known] = pd.NA
            out = pd.DataFrame({"doc_id": ids, "n": _join(of_docs["tokens"], np.int64), "sig": _join(of_docs["sigs"], np.int64), "sig2": _join(of_docs["sigs2"], np.int64)}).astype("Int64")
            settled = pdf[pdf["ids"].str.len() == 0]
            sigs, shared = _join(settled["sigs"], np.int64), _join(settled["many"], np.uint32)
            out = pd.concat([out, homes(sigs[shared > 0], shared[shared > 0])])
        else:
            sig, owner = np.unique(_join(pdf["sigs"], np.int64), return_inverse=True)
            posted = np.repeat(owner, _join(pdf["many"], np.uint32)).astype(np.uint64)
            both = distinct(_join(pdf["tokens"], np.uint32).astype(np.uint64) << _U(32) | posted)
            same = (both[1:] >> _U(32)) == (both[:-1] >> _U(32))
            shared = np.zeros(len(both), dtype=bool)
            shared[1:] |= same
            shared[:-1] |= same
            counts = np.bincount((both[shared] & _U(0xFFFFFFFF)).astype(np.int64), minlength=len(sig))
            out = homes(sig[counts > 0], counts[counts > 0])
        give_back()
        for c in ("doc_id", "n", "sig", "sig2", "home"):
            out[c] = (out[c] if c in out else pd.Series([pd.NA] * len(out), index=out.index)).astype("Int64")
        for c in ("sigs", "shared"):
            out[c] = out[c].astype(object).where(out[c].notna(), None) if c in out else None
        return out[["doc_id", "n", "sig", "sig2", "home", "sigs", "shared"]]

    return _pack_all(docs, n_buckets).groupBy("bucket").applyInPandas(count, _SURVEYED)


def _hopeful(surveyed: DataFrame, reps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The representatives that share enough shingles with other sets, whichever they are.

    Counts go by half a signature: sets that share that half by chance only keep each other in.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, at = np.unique(_join(pdf["sigs"], np.int64), return_inverse=True)
        return pd.DataFrame({"sig": sig, "shared": np.bincount(at, weights=_join(pdf["shared"], np.uint32)).astype(np.int64)})

    shares = surveyed.where("home is not null").select("home", "sigs", "shared").groupBy("home").applyInPandas(add, "sig long, shared long")
    return reps.join(shares, "sig").where(F.col("shared") * threshold[1] >= F.col("n") * threshold[0]).select("sid", "uid", "sig", "sig2", "n")


# -- 2: the remaining sets, in the first order

_SETS = "sid long, n int, tokens binary, sets binary"


def _sets_of(docs: DataFrame, hopeful: DataFrame, count: int) -> DataFrame:
    """(sid, n, tokens) of the wanted sets, sid being their own uid; a text is known by its signature, not its doc_id alone."""
    wanted = _few(hopeful.select(F.col("sid").alias("doc_id"), "uid", "sig", "sig2"), count, 32)
    texts = docs.join(wanted, "doc_id").select("uid", "text", "sig", "sig2")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, s, a, b in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if signature(s) == (a, b):
                    rows.append((doc, len(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["sid", "n", "tokens"])

    return texts.mapInArrow(lean(build), "sid long, n int, tokens binary").dropDuplicates(["sid"])


def _flushes(sets: DataFrame) -> DataFrame:
    """Sets packed by some thousands, so that a shingle is counted once a pack."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, turn = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = (TaskContext.get().partitionId() << 32) + turn
            blobs = [np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.int64).tobytes(), b"".join(r[2] for r in rows)]
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=["flush", "sids", "ns", "tokens"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append(r)
                held += r[1]
                if held >= FLUSH_POSTINGS:
                    yield flush()
                    rows, held, turn = [], 0, turn + 1
        if rows:
            yield flush()

    return sets.mapInArrow(lean(pack), "flush long, sids binary, ns binary, tokens binary")


def _by_bucket(tokens: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pack's distinct tokens and their counts, dealt to buckets: (order, bucket, counts)."""
    distinct, counts = np.unique(tokens, return_counts=True)
    bucket = (mix(distinct) % _U(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return distinct[by], bucket[by], counts[by]


def _ordered_sets(flushes: DataFrame, n_buckets: int, threshold: tuple[int, int]) -> DataFrame:
    """(sid, n, tokens, sets): a set's shingles that other sets hold too, rarest first, and in how many sets each is."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct, bucket, counts = _by_bucket(np.frombuffer(blob, np.uint64), n_buckets)
                bounds = np.flatnonzero(_runs(bucket))
                rows = [(int(bucket[i]), flush, distinct[i:j].tobytes(), counts[i:j].astype(np.uint32).tobytes()) for i, j in zip(bounds, [*bounds[1:], len(bucket)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "flush", "tokens", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, at = np.unique(_join(pdf["tokens"], np.uint64), return_inverse=True)
        total = np.bincount(at, weights=_join(pdf["counts"], np.uint32), minlength=len(distinct))[at].astype(np.uint32)
        ends = np.cumsum(pdf["counts"].str.len().to_numpy() // 4)
        return pd.DataFrame({"flush": pdf["flush"], "bucket": pdf["bucket"], "totals": [t.tobytes() for t in np.split(total, ends[:-1])]})

    def order(key, packs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        rows = []
        for pack in packs.itertuples(index=False):
            tokens, sizes = np.frombuffer(pack.tokens, np.uint64), np.frombuffer(pack.ns, np.int64)
            distinct, _, _ = _by_bucket(tokens, n_buckets)
            held = _join(totals.sort_values("bucket")["totals"], np.uint32)
            by = np.argsort(distinct)
            sets = held[by[np.searchsorted(distinct, tokens, sorter=by)]]
            end = np.cumsum(sizes)
            for sid, n, j in zip(np.frombuffer(pack.sids, np.int64), sizes, end, strict=True):
                t, c = tokens[j - n : j], sets[j - n : j]
                t, c = t[c > 1], c[c > 1]
                if len(t) >= _need(int(n), threshold):
                    by_c = np.lexsort((t, c))
                    rows.append((int(sid), int(n), t[by_c].tobytes(), c[by_c].tobytes()))
        return pd.DataFrame(rows, columns=["sid", "n", "tokens", "sets"])

    totals = flushes.select("flush", "tokens").mapInArrow(lean(send), "bucket int, flush long, tokens binary, counts binary").groupBy("bucket").applyInPandas(add, "flush long, bucket int, totals binary")
    return flushes.groupBy("flush").cogroup(totals.groupBy("flush")).applyInPandas(order, _SETS)


# -- 3: candidates, their agreement, links

_POSTED = "bucket int, tokens binary, rest binary, many binary, sids binary, ns binary, comps binary, members binary"


def _postings(live: DataFrame, n_buckets: int, top: int | None, leaders: int | None, turn: int, hot: int, threshold: tuple[int, int]) -> DataFrame:
    """Packed prefix postings of live(sid, n, tokens, sets, comp, members) under all orders.

    rest: tokens of the set from this one on, in the order. A token of more than `hot` sets is
    dealt to several groups by sid; sets outside the largest component `top`, or in a round of
    leaders a few sets drawn by hash, visit all of them.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held = [], [[] for _ in range(ORDERS)], 0

        def flush() -> pa.RecordBatch:
            table = np.array(docs, dtype=np.int64)
            rows = []
            for order in range(ORDERS):
                tokens = np.concatenate([p[0] for p in parts[order]])
                rest = np.concatenate([p[1] for p in parts[order]])
                owner = np.repeat(np.arange(len(parts[order])), [len(p[0]) for p in parts[order]])
                spread = mix(tokens)
                bucket, short = order * n_buckets + (spread % _U(n_buckets)).astype(np.int64), (spread // _U(n_buckets)).astype(np.uint32)
                by = np.lexsort((owner, bucket))
                bounds = np.flatnonzero(_runs(bucket[by]))
                for i, j in zip(bounds, [*bounds[1:], len(by)], strict=True):
                    own = by[i:j]
                    of = owner[own]
                    first = np.flatnonzero(_runs(of))
                    used, many = of[first], np.diff(first, append=len(of))
                    sids, ns, comps, members = table[used].T
                    rows.append((int(bucket[own[0]]), short[own].tobytes(), rest[own].astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), sids.tobytes(), ns.tobytes(), comps.tobytes(), members.tobytes()))
            kinds = [pa.int32()] + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "tokens", "rest", "many", "sids", "ns", "comps", "members"])

        for batch in batches:
            for sid, n, blob, counts, comp, members in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                t, c = np.frombuffer(blob, np.uint64), np.frombuffer(counts, np.uint32)
                k = len(t) - _need(n, threshold) + 1
                docs.append((sid, n, comp, members))
                for order in range(ORDERS):
                    own = np.argsort(mix(t + _SECOND))[:k] if order else np.arange(k)
                    p, rest = t[own], len(t) - np.arange(k)
                    groups = -(-c[own].astype(np.int64) // hot)
                    if groups.max() > 1:
                        draw = _rank(np.array([sid]), turn)[0]
                        visits = comp != top if leaders is None else draw < _U(2**64 - 1) // c[own].astype(np.uint64) * _U(leaders)
                        home = (mix(np.array([sid]).view(np.uint64))[0] % groups.astype(np.uint64)).astype(np.int64)
                        many = np.where((groups > 1) & visits, groups, 1)
                        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        at = np.where(np.repeat(many, many) > 1, at, np.repeat(home, many))
                        p, rest = np.repeat(p, many), np.repeat(rest, many)
                        p = np.where(at > 0, mix(p + at.astype(np.uint64)), p)
                    parts[order].append((p, rest))
                    held += len(p)
                if held >= FLUSH_POSTINGS:
                    yield flush()
                    docs, parts, held = [], [[] for _ in range(ORDERS)], 0
        if docs:
            yield flush()

    return live.select("sid", "n", "tokens", "sets", "comp", "members").mapInArrow(lean(post), _POSTED)


def _rank(sids: np.ndarray, turn: int) -> np.ndarray:
    """Who leads: the same order in all groups, another one each round."""
    return mix(sids.view(np.uint64) + _U((turn + 1) * int(_SECOND) % (1 << 64)))


def _cells(comps: np.ndarray, sids: np.ndarray, members: np.ndarray, cells: int) -> np.ndarray:
    part = mix(sids.view(np.uint64)) % (-(-members // CELL_SETS)).astype(np.uint64)
    return (mix(comps.view(np.uint64) + part * _SECOND) % _U(cells)).astype(np.int64)


def _paired(of: np.ndarray, begin: np.ndarray, end: np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of `of` with each number from its begin to before its end, about so many pairs at once."""
    some = end > begin
    of, begin, many = of[some], begin[some], (end - begin)[some]
    before = np.cumsum(many) - many
    cuts = np.unique(np.append(np.searchsorted(before, np.arange(0, int(many.sum()), at_once)), len(of)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        inside = np.arange(many[i:j].sum()) - np.repeat(before[i:j] - before[i], many[i:j])
        yield np.repeat(of[i:j], many[i:j]), np.repeat(begin[i:j], many[i:j]) + inside


def _candidates(posted: DataFrame, n_buckets: int, cells: int, leaders: int | None, turn: int, threshold: tuple[int, int]) -> DataFrame:
    """Packed pairs (x, y) that one order allows, by the cell of y, the one in the larger component."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        order = int(pdf["bucket"].iloc[0]) // n_buckets
        many = _join(pdf["many"], np.uint32)
        token, rest = _join(pdf["tokens"], np.uint32), _join(pdf["rest"], np.uint32)
        sid, n, comp, members = (_join(pdf[c], np.int64) for c in ("sids", "ns", "comps", "members"))
        doc = np.repeat(np.arange(len(sid)), many)
        need = threshold[0] / (threshold[0] + threshold[1])
        _, group = np.unique(token, return_inverse=True)
        by = np.lexsort((comp[doc], group))
        group, doc, rest = group[by], doc[by], rest[by]
        first = np.flatnonzero(_runs(group, comp[doc]))
        size = np.diff(np.append(first, len(group)))
        of = group[first]
        largest = np.zeros(of[-1] + 1, dtype=np.int64)
        np.maximum.at(largest, of, size)
        best = np.full(of[-1] + 1, len(of), dtype=np.int64)
        hit = np.flatnonzero(size == largest[of])
        np.minimum.at(best, of[hit], hit)
        several = np.bincount(of, minlength=len(best)) > 1
        within = np.zeros(len(first), dtype=bool)
        within[best] = True
        within, live = np.repeat(within, size), np.repeat(several[of], size)
        group, doc, rest, within = group[live], doc[live], rest[live], within[live]
        if leaders is None:
            # sets outside a group's largest component, with all of about their size: those of it stand behind the others
            by = np.lexsort((n[doc], within, group))
            group, doc, rest, within = group[by], doc[by], rest[by], within[by]
            size, part = n[doc], 2 * group + within
            key = (part << 32) + size
            live = np.flatnonzero(~within)
            least, most = _need(size[live], threshold), size[live] * threshold[1] // threshold[0]
            begin = np.concatenate([live + 1, np.searchsorted(key, (part[live] + 1 << 32) + least)])
            end = np.concatenate([np.searchsorted(key, (part[live] << 32) + most, side="right"), np.searchsorted(key, (part[live] + 1 << 32) + most, side="right")])
            live = np.concatenate([live, live])
        else:
            by = np.lexsort((_rank(sid, turn)[doc], group))
            group, doc, rest = group[by], doc[by], rest[by]
            first = np.flatnonzero(_runs(group)) if len(group) else np.zeros(0, np.int64)
            length = np.diff(np.append(first, len(group)))
            live = np.flatnonzero(np.arange(len(group)) - np.repeat(first, length) < leaders)
            begin, end = live + 1, np.repeat(first + length, length)[live]
        keys, held, whole = [np.zeros(0, np.int64)], 0, 0
        for one, other in _paired(live, begin, end):
            x, y = doc[one], doc[other]
            a, b = n[x], n[y]
            ok = (comp[x] != comp[y]) & (np.minimum(a, b) * threshold[1] >= np.maximum(a, b) * threshold[0])
            ok &= np.minimum(rest[one], rest[other]) >= need * (a + b) - 1e-6
            x, y = x[ok], y[ok]
            keys.append(np.minimum(x, y) * len(sid) + np.maximum(x, y))
            held += len(x)
            if held > max(BUCKET_POSTINGS, whole):  # as many as are there: all compacting together takes a few sorts of the last
                keys, held = [distinct(np.concatenate(keys))], 0
                whole = len(keys[0])
        x, y = np.divmod(distinct(np.concatenate(keys)), max(1, len(sid)))
        larger = (members[x] > members[y]) | ((members[x] == members[y]) & (_rank(comp[x], turn) > _rank(comp[y], turn)))
        x, y = np.where(larger, y, x), np.where(larger, x, y)
        cell = _cells(comp[y], sid[y], members[y], cells)
        by = np.argsort(cell, kind="stable")
        bounds = np.flatnonzero(_runs(cell[by])) if len(by) else []
        rows = [(int(cell[by[i]]), order, sid[x[by[i:j]]].tobytes(), sid[y[by[i:j]]].tobytes()) for i, j in zip(bounds, [*bounds[1:], len(by)], strict=False)]
        return pd.DataFrame(rows, columns=["cell", "order", "xs", "ys"])

    return posted.groupBy("bucket").applyInPandas(find, "cell int, order int, xs binary, ys binary")


def _agreed(found: DataFrame) -> DataFrame:
    """The pairs of a cell that all orders name, packed, and a row for each set they need: (cell, sid)."""

    def agree(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _join(pdf["xs"], np.int64), _join(pdf["ys"], np.int64)
        order = np.repeat(pdf["order"].to_numpy(), pdf["xs"].str.len().to_numpy() // 8)
        by = np.lexsort((y, x))
        x, y, order = x[by], y[by], order[by]
        first = np.flatnonzero(_runs(x, y))
        all_ = np.bitwise_or.reduceat(1 << order, first) == (1 << ORDERS) - 1
        x, y = x[first[all_]], y[first[all_]]
        named = distinct(np.concatenate([x, y])).tolist()
        packed = [(None, x.tobytes(), y.tobytes())] if len(x) else []
        out = pd.DataFrame([*((s, None, None) for s in named), *packed], columns=["sid", "xs", "ys"], dtype=object)
        out["sid"] = pd.array([*named, *([pd.NA] * len(packed))], "Int64")
        return out.assign(cell=int(pdf["cell"].iloc[0]))[["cell", "sid", "xs", "ys"]]

    return found.groupBy("cell").applyInPandas(agree, "cell int, sid long, xs binary, ys binary")


def _links(agreed: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Verifies each cell's pairs on whole sets: (u, v), a spanning forest of the cell's links."""

    def verify(key, held: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        own = {r.sid: (r.n, np.sort(np.frombuffer(r.tokens, np.uint64))) for r in held.itertuples(index=False)}
        parent = {s: s for s in own}

        def root(s: int) -> int:
            while parent[s] != s:
                parent[s] = parent[parent[s]]
                s = parent[s]
            return s

        out = []
        for x, y in zip(_join(pairs["xs"], np.int64).tolist(), _join(pairs["ys"], np.int64).tolist(), strict=True):
            a, b = root(x), root(y)
            if a == b:
                continue
            (n, s), (m, t) = own[x], own[y]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            if threshold[1] * common >= threshold[0] * (n + m - common):
                parent[a] = b
                out.append((x, y))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    held = agreed.where("sid is not null").select("cell", "sid").join(sets.select("sid", "n", "tokens"), "sid")
    pairs = agreed.where("sid is null").select(F.col("cell").alias("own_cell"), "xs", "ys")
    return held.groupBy("cell").cogroup(pairs.groupBy("own_cell")).applyInPandas(verify, "u long, v long")


def _component_of(sets: DataFrame, links: DataFrame | None) -> DataFrame:
    """sid -> comp, members (sets in it), for every set."""
    own = sets.select("sid")
    if links is None:
        return own.withColumn("comp", F.col("sid")).withColumn("members", F.lit(1).cast("long"))
    linked = components(links).select(F.col("u").alias("sid"), F.col("component").alias("comp"))
    sizes = linked.groupBy("comp").agg(F.count("*").alias("members"))
    return own.join(linked.join(sizes, "comp"), "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"))


def set_links(sets: DataFrame, threshold: tuple[int, int], hot: int = HOT) -> DataFrame | None:
    """Links among ordered sets that join all that must be joined; None where there is no set."""
    held = sets.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0)), F.count("*")).first()
    if not held[1]:
        return None
    spark = sets.sparkSession
    n_buckets = max(slots(spark), int(held[0] // 8 // 4 // BUCKET_POSTINGS) + 1)
    cells = max(slots(spark), int(held[0] // CELL_BYTES) + 1)
    links = None
    for turn, leaders in enumerate([LEADERS] * LEADER_ROUNDS + [None]):
        comps = materialise(_component_of(sets, links))
        top = comps.orderBy(F.desc("members"), "comp").first()
        live = sets.join(comps, "sid")
        posted = _postings(live, n_buckets, top["comp"], leaders, turn, hot, threshold)
        agreed = materialise(_agreed(_candidates(posted, n_buckets, cells, leaders, turn, threshold)))
        new = _links(agreed, sets, threshold)
        links = materialise(new if links is None else links.unionByName(new))
    return links


def jaccard_components(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    n_buckets = max(slots(spark), int(words // BUCKET_POSTINGS) + 1)
    n_surveyed = max(slots(spark), int(words // SURVEY_POSTINGS) + 1)
    surveyed = materialise(_survey(docs, n_surveyed, max(slots(spark), n_surveyed // 4)))
    rows = surveyed.where("n is not null").select("doc_id", "n", "sig", "sig2")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("sid"))
    # a set's own id: its smallest doc_id, but for doc_ids of several sets a number beyond doc_ids
    again = F.row_number().over(Window.partitionBy("sid").orderBy("sig", "sig2", "n")) > 1
    reps = materialise(sets.withColumn("uid", F.when(again, F.lit(1 << 62) + F.pmod(F.xxhash64("sig", "sig2", "n"), F.lit(1 << 62))).otherwise(F.col("sid"))))
    hopeful = materialise(_hopeful(surveyed, reps, threshold))
    flushes = materialise(_flushes(_sets_of(docs, hopeful, hopeful.count())))
    sets = materialise(_ordered_sets(flushes, n_buckets, threshold))
    links = set_links(sets, threshold, hot)
    one = reps.where("uid != sid").select(F.col("uid").alias("u"), F.col("sid").alias("v"))  # one document
    linked = components(one if links is None else links.unionByName(one)).select(F.col("u").alias("uid"), "component")
    of = reps.join(linked, "uid", "left").select("sig", "sig2", "n", F.coalesce("component", "sid").alias("component"))
    return rows.join(of.select("sig", "sig2", "n", "component"), ["sig", "sig2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each component; all its columns.

    Rows without a doc_id stay; a doc_id that is repeated with several texts stays if one of them stays.
    """
    found = jaccard_components(docs, threshold).where("doc_id is not null")
    gone = materialise(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays").select(F.col("doc_id").alias("_gone")))
    gone = _few(gone, gone.count(), 8)
    return docs.join(gone, gone["_gone"] == docs["doc_id"], "left_anti")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sig AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, k) AS sid
  FROM (SELECT doc_id, count(*) AS n, bit_xor(hash(g)) AS k FROM s GROUP BY doc_id)
), r AS (
  SELECT s.doc_id, s.g, sig.n FROM s JOIN sig ON s.doc_id = sig.doc_id AND sig.sid = sig.doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), sym AS MATERIALIZED (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(u, c) AS (
  SELECT sid, sid FROM sig WHERE sid = doc_id
  UNION
  SELECT b.v, reach.c FROM reach JOIN sym b ON b.u = reach.u WHERE reach.c < b.v
), comp AS (
  SELECT u, min(c) AS c FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(sig.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM d LEFT JOIN sig USING (doc_id) LEFT JOIN comp ON comp.u = sig.sid
"""
