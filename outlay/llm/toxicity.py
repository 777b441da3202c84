"""Toxicity: a support vector machine on the gap-weighted subsequence string kernel.

Units are the words of a text (and runs of one- or two-byte words joined, which catches
spelled-out words), in overlapping pieces if they are long. The kernel counts common
subsequences, each weighted by a decay to the length it spans. Three are added (``KERNELS``):
three bytes with a steep decay tell near copies, four and five bytes with a gentle one tell a landmark
with foreign bytes between all its letters. They are computed against a few landmark strings
only (Nystrom): the features of a text are the landmarks' kernel values, the largest over its
units, times K_mm**-1/2.

Landmarks come from labelled training texts: a greedy cover of the toxic ones by strings that
clean ones hardly hold, each more telling than the luckiest chance string, and grown while nearly all their
occurrences agree. In fitting, clean training texts with a landmark put in stand in as further toxic examples:
virtual examples, which teach that inserted bytes don't change the label; they come from training rows alone.
Fitting uses at most ``SAMPLE`` labelled training texts of either class, chosen by a hash of
doc_id; that is its only bound. Scoring reads every whole text, in its own task, without a
shuffle. Units that share no subsequence as long as the kernel's with a landmark are passed over:
their value is zero. No other value is set to zero.

Learning uses rows with crc32(doc_id as text) mod 5 <> 0 only. Defined results: null and empty
texts have no units and get the score of that; null doc_ids count as not held out; without
labelled rows of both classes every score is 0; a doc_id labelled both ways is not learnt from,
of a doc_id's several texts the smallest is; repeated rows stay; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.bytes_text import NOT_SPACE, Words, chunks, give_back, lean, prefix_sums, span_hashes

SAMPLE = 1000
LANDMARKS = 64
#: (bytes of a subsequence, decay) of the kernels that are added.
KERNELS = ((3, 0.5), (4, 0.98), (5, 0.98))
POWER = 4
#: Clean texts that each landmark is put into as it is and with foreign bytes between its letters, in fitting.
SPACED = 16
#: How many chance strings may be expected among all landmarks.
CHANCE = 0.05
#: How often a toxic training text is covered before it asks for no more landmarks.
COVER = 3
#: Bytes of a unit; longer words and joined runs become overlapping units of this length.
UNIT = 24
_GRAMS = (4, 5, 6)
#: Grams of texts that are held before they are counted.
MERGED = 1 << 18
#: The landmark when none is found; no text holds it.
_NONE = b"\1\2\3\4"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@functools.lru_cache(maxsize=256)
def _decays(n: int, decay: float) -> np.ndarray:
    """decay ** (row - column), on and below the diagonal."""
    steps = np.arange(n)[:, None] - np.arange(n)[None, :]
    out = np.where(steps >= 0, np.float32(decay) ** np.maximum(steps, 0), 0).astype(np.float32)
    out.flags.writeable = False
    return out


def subsequence_kernel(landmark: np.ndarray, units: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The kernel of one landmark with many units (rows of bytes, zero-padded).

    The recurrences along either string are products with a triangle of decays.
    """
    n, width = units.shape
    m = len(landmark)
    same = np.ascontiguousarray(units.T)[None] == landmark[:, None, None]
    along_unit, along_landmark = _decays(width, decay), _decays(m, decay)
    before = np.ones((m, width, n), dtype=np.float32)
    for _ in range(order - 1):
        hits = same * before * np.float32(decay**2)
        ended = (along_landmark @ np.matmul(along_unit, hits).reshape(m, -1)).reshape(m, width, n)
        before[0], before[:, 0] = 0, 0
        before[1:, 1:] = ended[:-1, :-1]
    return (same * before).sum(axis=(0, 1), dtype=np.float64) * decay**2


def _row(s: bytes) -> np.ndarray:
    return np.frombuffer(s[:UNIT].ljust(UNIT, b"\0"), dtype=np.uint8)


def _common(places: np.ndarray, m: int, units: np.ndarray) -> np.ndarray:
    """The length of the longest subsequence that a landmark of m bytes and each unit share, by bits: places[byte] has the landmark's places of a byte."""
    left = np.full(len(units), (1 << m) - 1, dtype=np.uint32)
    for column in np.ascontiguousarray(units.T):
        met = left & places[column]
        left = (left + met) | (left - met)
    return m - np.bitwise_count(left & np.uint32((1 << m) - 1)).astype(np.int64)


class Kernels:
    """Kernel values of units with all landmarks, relative to the landmarks' own; known units are kept.

    One column for each kernel and landmark.
    """

    KEPT = 500_000
    KEPT_BYTES = 32 << 20

    def __init__(self, landmarks: list[bytes]) -> None:
        self.landmarks = [np.frombuffer(x, dtype=np.uint8) for x in landmarks]
        own = [np.array([subsequence_kernel(x, _row(s)[None, :], *kernel)[0] for x, s in zip(self.landmarks, landmarks, strict=True)]) for kernel in KERNELS]
        self.own = [np.where(v > 0, v, np.inf) for v in own]  # a landmark shorter than the kernel's subsequences shares none
        self.places = np.zeros((len(landmarks), 256), dtype=np.uint32)
        for held, landmark in zip(self.places, self.landmarks, strict=True):
            np.bitwise_or.at(held, landmark, np.uint32(1) << np.arange(len(landmark), dtype=np.uint32))
        self.width = len(landmarks) * len(KERNELS)
        self.dull, self.fresh = np.zeros(0, np.uint64), []
        self.known, self.known_values = np.zeros(0, np.uint64), np.zeros((0, self.width), np.float32)

    def values(self, units: np.ndarray) -> np.ndarray:
        out = np.zeros((len(units), self.width), dtype=np.float32)
        length = (units > 0).sum(axis=1)
        least = min(order for order, _ in KERNELS)
        for k, landmark in enumerate(self.landmarks):
            live = np.flatnonzero((self.places[k] > 0)[units].sum(axis=1) >= least)
            live = live[_common(self.places[k], len(landmark), units[live]) >= least]
            live = live[np.argsort(length[live], kind="stable")]
            for at in range(0, len(live), 512):
                part = live[at : at + 512]
                width = int(length[part].max())
                for j, kernel in enumerate(KERNELS):
                    v = subsequence_kernel(landmark, units[part, :width], *kernel) / self.own[j][k]
                    out[part, j * len(self.landmarks) + k] = np.minimum(v, 1.0)
        return out

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """For each text and column the largest value over the text's units."""
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for first, part in chunks(texts):
            words = Words(part, NOT_SPACE)
            data, start, end, owner = _units(words)
            key, at, which = np.unique(span_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
            row_of = np.full(len(key), -1)
            _, kept, here = np.intersect1d(self.known, key, assume_unique=True, return_indices=True)
            row_of[here] = np.arange(len(here))
            new = np.flatnonzero((row_of < 0) & ~np.isin(key, self.dull, assume_unique=True))
            v = self.values(_bytes_of(data, start[at[new]], end[at[new]]))
            some = v.any(axis=1)
            row_of[new[some]] = len(here) + np.arange(some.sum())
            v = np.concatenate([self.known_values[kept], v[some]])
            self._remember(key[new[~some]], key[new[some]], v[len(here) :])
            row = row_of[which]
            own = np.flatnonzero(row >= 0)
            if len(own):
                own = own[np.argsort(owner[own], kind="stable")]
                of = owner[own]
                begins = np.flatnonzero(np.diff(of, prepend=-1))
                out[of[begins] + first] = np.maximum.reduceat(v[row[own]], begins, axis=0)
        return out

    def _remember(self, dull: np.ndarray, live: np.ndarray, values: np.ndarray) -> None:
        self.fresh.append(dull)
        if sum(map(len, self.fresh)) > self.KEPT // 8:
            self.dull = np.unique(np.concatenate([*self.fresh, self.dull if len(self.dull) < self.KEPT else self.dull[:0]]))
            self.fresh = []
        if self.known_values.nbytes > self.KEPT_BYTES:
            self.known, self.known_values = self.known[:0], self.known_values[:0]
        self.known, self.known_values = np.concatenate([self.known, live]), np.concatenate([self.known_values, values])


def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer, spans of it and the text of each: words and runs of tiny ones, long ones in pieces.

    The letters of the runs, without the spaces between, follow the texts in the buffer.
    """
    start, end = words.start, words.end
    owner = np.searchsorted(words.first, np.arange(len(start)), side="right") - 1
    tiny = end - start <= 2
    begins = np.diff(owner, prepend=-1) > 0
    begins[1:] |= ~tiny[:-1]
    a = np.flatnonzero(tiny & begins)
    b = np.flatnonzero(tiny & np.append(begins | ~tiny, True)[1:])
    run = b - a >= 2
    a, b = a[run], b[run]
    inside = np.zeros(len(start) + 1, dtype=np.int8)
    inside[a] += 1
    inside[b + 1] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    one, two = start[inside], end[inside] - start[inside] == 2
    letters = words.data[np.repeat(one, 1 + two) + _second(two)]
    filled = len(words.data) + np.concatenate([[0], np.cumsum(np.where(inside, end - start, 0))])
    start, end, owner = np.concatenate([start, filled[a]]), np.concatenate([end, filled[b + 1]]), np.concatenate([owner, owner[a]])
    n = np.maximum(0, -(-(end - start - UNIT) // (UNIT // 2)))
    more = np.repeat(start, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1) * (UNIT // 2)
    return (
        np.concatenate([words.data, letters]),
        np.concatenate([start, more]),
        np.concatenate([np.minimum(end, start + UNIT), np.minimum(more + UNIT, np.repeat(end, n))]),
        np.concatenate([owner, np.repeat(owner, n)]),
    )


def _second(two: np.ndarray) -> np.ndarray:
    """0 for each word, followed by 1 for each that has two bytes."""
    out = np.zeros(len(two) + int(two.sum()), dtype=np.int64)
    out[np.cumsum(1 + two)[two] - 1] = 1
    return out


def _bytes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows of a unit's bytes, zero-padded to UNIT."""
    steps = np.arange(UNIT)
    return np.where(steps < (end - start)[:, None], data[np.minimum(start[:, None] + steps, len(data) - 1)], 0).astype(np.uint8)


def _gram_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct byte 4-, 5- and 6-grams inside the words of each text, packed into integers; those of one chunk at a time."""
    for _, part in chunks(texts):
        words = Words(part, NOT_SPACE)
        d = words.data.astype(np.uint64)
        space = ~NOT_SPACE[words.data]
        last_space = np.cumsum(space)
        sizes = np.cumsum([0] + [len(p) + 1 for p in part])
        found = []
        for n in _GRAMS:
            k = len(d) - n + 1
            if k < 1:
                continue
            v = np.zeros(k, dtype=np.uint64)
            for i in range(n):
                v = (v << np.uint64(8)) | d[i : i + k]
            ok = ~space[:k] & (last_space[n - 1 :] == last_space[:k])
            found.append((np.flatnonzero(ok), v[ok] | np.uint64(n) << np.uint64(56)))
        for i in range(len(part)):
            own = [v[np.searchsorted(p, sizes[i]) : np.searchsorted(p, sizes[i + 1])] for p, v in found]
            yield np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def _gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all texts, and how many texts hold each; the texts' sets are never there at once."""
    grams, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        new, more = np.unique(np.concatenate(held), return_counts=True)
        both = np.union1d(grams, new)
        total = np.zeros(len(both), np.int64)
        total[np.searchsorted(both, grams)] += n
        total[np.searchsorted(both, new)] += more
        return both, total

    for own in _gram_sets(texts):
        held.append(own)
        size += len(own)
        if size > max(MERGED, len(grams)):
            grams, n = added()
            held, size = [], 0
    return added() if held else (grams, n)


def _text_of(gram: int) -> bytes:
    n = gram >> 56
    return (gram & ((1 << 56) - 1)).to_bytes(8, "big")[8 - n :]


def _evidence(t: np.ndarray, c: np.ndarray, share: float) -> np.ndarray:
    """-log of a bound (Chernoff's) on the chance that t or more of t + c texts are toxic where `share` of all are."""
    n = np.maximum(t + c, 1)
    p = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = p * np.log(p / share) + np.where(c > 0, (1 - p) * np.log((1 - p) / (1 - share)), 0)
    return np.where(p > share, n * kl, 0)


def choose_landmarks(toxic: list[str], clean: list[str], limit: int = LANDMARKS) -> list[bytes]:
    """A greedy cover of the toxic training texts by strings that clean ones hardly hold.

    The next landmark is the string that stands in most toxic texts not yet covered, less its share of clean
    texts many times over. A text is covered by COVER landmarks (or all that it has), for one insult must not hide
    another beside it. A string counts only while the toxic texts that it adds are more than chance would give the luckiest
    of all strings of the sample; that is the one bar, whatever the sample's size.
    """
    grams, t = _gram_counts(toxic)
    c_all, c_n = _gram_counts(clean)
    at = np.minimum(np.searchsorted(c_all, grams), max(0, len(c_all) - 1))
    c = np.where(c_all[at] == grams, c_n[at], 0) if len(c_all) else np.zeros(len(grams), int)
    share, bar = len(toxic) / (len(toxic) + len(clean)), np.log(max(1, len(grams)) / CHANCE)
    price = 20 * c * len(toxic) / max(1, len(clean))
    telling = (t > price) & (_evidence(t, c, share) >= bar)
    grams, price, c = grams[telling], price[telling], c[telling]
    held = np.stack([np.isin(grams, s, assume_unique=True) for s in _gram_sets(toxic)], axis=1) if len(grams) else np.zeros((0, len(toxic)), dtype=bool)
    chosen: list[bytes] = []
    wanted = np.full(len(toxic), COVER)
    pool = [w for x in toxic for w in set(x.lower().encode().split())]
    while len(chosen) < limit and len(grams):
        adds = np.count_nonzero(held[:, wanted > 0], axis=1)
        k = int(np.lexsort((grams, price - adds))[0])
        if adds[k] <= price[k] or _evidence(adds[k], c[k], share) < bar:
            break
        own = held[k]
        same = (held & own).sum(axis=1) / np.maximum(1, (held | own).sum(axis=1)) > 0.7
        landmark = _grown(_text_of(int(grams[k])), pool)
        if not any(a in landmark or landmark in a for a in chosen):
            chosen.append(landmark)
            wanted = wanted - own
        grams, price, c, held = grams[~same], price[~same], c[~same], held[~same]
    return chosen


def _grown(gram: bytes, words: list[bytes]) -> bytes:
    """The gram, lengthened on either side while nine in ten of its occurrences agree."""
    own = [w for w in words if gram in w]
    while len(gram) < 12:
        sides: dict[bytes, int] = {}
        for w in own:
            i = w.find(gram)
            for longer in ((w[i - 1 : i + len(gram)] if i else b""), w[i : i + len(gram) + 1]):
                if len(longer) > len(gram):
                    sides[longer] = sides.get(longer, 0) + 1
        best = max(sides, key=lambda s: (sides[s], s), default=b"")
        if not best or sides[best] < 0.9 * len(own):
            return gram
        gram = best
        own = [w for w in own if gram in w]
    return gram


@dataclass
class Model:
    landmarks: list[bytes]
    roots: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        margin = features(pooled, self.roots) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def features(pooled: np.ndarray, roots: list[np.ndarray]) -> np.ndarray:
    """Nystrom features of the sum of the kernels and their POWER-th powers, which near copies alone reach."""
    parts = [(block, p) for block in np.split(pooled, len(KERNELS), axis=1) for p in (1, POWER)]
    return np.concatenate([(block**p) @ r for (block, p), r in zip(parts, roots, strict=True)], axis=1)


def fit(toxic: list[str], clean: list[str], prior: float = 0.5) -> Model | None:
    """Nystrom features and a squared-hinge SVM, with a sigmoid fitted to its margins.

    prior: the share of toxic texts among all labelled ones, which the sigmoid is fitted for.
    """
    if not toxic or not clean:
        return None
    landmarks = choose_landmarks(toxic, clean) or [_NONE]
    kernels = Kernels(landmarks)
    x = kernels.pooled([*toxic, *clean]).astype(np.float64)
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    rows = np.stack([_row(s) for s in landmarks])
    roots = []
    for kernel in KERNELS:
        gram = np.stack([subsequence_kernel(k, rows, *kernel) for k in kernels.landmarks])
        scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1))
        for power in (1, POWER):
            value, vector = np.linalg.eigh((gram / scale[:, None] / scale[None, :]) ** power)
            roots.append(vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T)
    gapped = _gapped(kernels, landmarks, x[y < 0])
    x, y = np.concatenate([x, gapped]), np.concatenate([y, np.ones(len(gapped))])
    z = np.column_stack([features(x, roots), np.ones(len(y))])
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * 1e-3 * len(y)
    ridge[-1, -1] *= 1e-3
    def loss(w: np.ndarray) -> float:
        return float(balance @ np.maximum(0, 1 - y * (z @ w)) ** 2 + w @ ridge @ w)

    for _ in range(100):  # Newton steps over the rows within the margin, halved until they help
        inside = y * (z @ w) < 1
        zi, bi = z[inside], balance[inside]
        step, size = np.linalg.solve(zi.T * bi @ zi + ridge, zi.T * bi @ y[inside]) - w, 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    margin, a, b = z @ w, 1.0, 0.0
    balance = len(y) * np.where(y > 0, prior / (y > 0).sum(), (1 - prior) / (y < 0).sum())
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = balance * ((y > 0) - p)
        h = balance * p * (1 - p) + 1e-9
        hess = np.array([[(h * margin**2).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + np.eye(2) * 1e-1
        step = np.linalg.solve(hess, [(g * margin).sum() - 0.1 * (a - 1), g.sum() - 0.1 * b])
        a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -0.5, 0.5)
        if np.abs(step).max() < 1e-8:
            break
    return Model(landmarks, roots, w[:-1], float(w[-1]), float(a), float(b))


def _gapped(kernels: Kernels, landmarks: list[bytes], clean: np.ndarray) -> np.ndarray:
    """Clean training texts, each with one landmark: toxic examples.

    As it is, with one foreign byte at each place, and with one after every or every other letter.
    """
    rows = []
    for s in landmarks:
        if s == _NONE:
            continue
        if len(s) >= 5:
            rows += [s[:i] + b"*" + s[i:] for i in range(2, len(s) - 1)]
        rows += [s, *(b"*".join(s[i : i + n] for i in range(0, len(s), n)) for n in (1, 2))] * SPACED
    if not rows or not len(clean):
        return np.zeros((0, clean.shape[1]))
    v = kernels.values(np.stack([_row(r) for r in rows]))
    return np.maximum(v, clean[np.arange(len(rows)) * 7919 % len(clean)])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on up to `sample` labelled texts of either class that are not held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in texts.toLocalIterator())
    model = fit([x for _, t, x in rows if t], [x for _, t, x in rows if not t], n.get(1, 0) / max(1, sum(n.values())))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds nothing but the verdict: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kernels = Kernels(m.landmarks) if m else None
        for batch in batches:
            texts = batch.column(1)
            s = np.concatenate([m.scores(kernels.pooled(texts.slice(i, 2000).to_pylist())) if m else np.zeros(min(2000, batch.num_rows - i)) for i in range(0, batch.num_rows, 2000)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below `cut`, with all their columns."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels = Kernels(shared.value.landmarks)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keep = shared.value.scores(kernels.pooled(part.column(at).to_pylist())) < cut
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
