"""Token counts by a whole-token shortcut: most pre-tokens are one vocabulary string, known beforehand to stay whole.

Offline, on the driver and from the vocabulary alone:

1. ``Rules`` asks which character classes ever stand side by side inside a vocabulary string. A merge only makes
   vocabulary strings, so none reaches over a border between other classes: a text may be cut there, and its count is the sum of its
   parts'. A space is always such a border, unless another space stands before it.
2. Each vocabulary string is encoded alone, and those that come out as one token are kept. (A vocabulary string
   needn't: its own merges may end elsewhere.)

In a task a text is cut at spaces, equal words are counted together, words and parts of words among the proven
strings count one, and only the rest is merged, by the library itself. No shuffle, no state between rows but a memo of
bounded size.

Texts of any length go through in windows that end at a space, so memory follows the longest run without
a space, not the text.

Defined results: a null text is empty (0 bytes, 0 tokens); null and repeated doc_ids are rows like any other and come
back as they are, at any size; an empty table gives no rows; extra columns are not read. Strings of special tokens
inside a text are ordinary text, as the library has it; no begin or end token is counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.bytes_text import lean

LIMIT = 4096
SPACE = "▁"
#: Characters of a text that are cut into words at a time, and different words whose counts are settled together.
WINDOW = 1 << 18
#: Words and characters that a task remembers, the last settled words aside.
MEMO_WORDS, MEMO_CHARS = 400_000, 1 << 24

#: Character classes between which a border may lie.
CLASSES = {"letter": "[^\\W\\d_¹²³]", "raised": "[¹²³]", "digit": r"\d", "other": r"[\W_]"}
#: A byte token, which takes part in no merge: what follows it is encoded as if it stood alone.
APART = "\n"


def _class(c: str) -> str:
    return next(name for name, pattern in CLASSES.items() if re.fullmatch(pattern, c))


class Rules:
    """What the vocabulary proves: the cut pattern of a word, and the strings that stay one token."""

    def __init__(self, model_path: str) -> None:
        sp = _library(model_path)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or sp.encode("a" + APART + "b", out_type=str)[1] != "<0x0A>":
            raise ValueError("this vocabulary has tokens over a space or has the line end, so words can't be counted apart")
        kind = {c: _class(c) for c in set("".join(pieces)) - {SPACE}}
        joined = {(kind[a], kind[b]) for p in pieces for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:])}
        #: classes that never meet inside a token are cut apart; those that do form one group
        group = {name: name for name in CLASSES}
        for a, b in joined:
            if group[a] != group[b]:
                old = group[b]
                group = {n: group[a] if g == old else g for n, g in group.items()}
        repeats = {g: "+" if any(group[a] == g for a, _ in joined) else "" for g in group.values()}
        self.cut = "|".join(f"(?:{'|'.join(CLASSES[n] for n in CLASSES if group[n] == g)}){more}" for g, more in repeats.items())
        alone = sp.encode([APART + p.replace(SPACE, " ") for p in pieces])
        base = len(sp.encode(APART))
        self.inner = frozenset(p for p, ids in zip(pieces, alone, strict=True) if not p.startswith(SPACE) and len(ids) == base + 1)
        opening = [p[1:] for p in pieces if p.startswith(SPACE)]
        whole = sp.encode([p.replace(SPACE, " ") for p in opening])
        #: without the one space before them; the empty string is the space itself
        self.words = frozenset(p for p, ids in zip(opening, whole, strict=True) if p and len(ids) == 1) | {""}


@lru_cache(maxsize=4)
def _library(model_path: str):  # noqa: ANN202
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model_path)


class Counting:
    """Counts of one task."""

    def __init__(self, rules: Rules, model_path: str) -> None:
        self.sp, self.size = _library(model_path), 0
        self.proven = dict.fromkeys(rules.words, 1) | {p + " ": 1 for p in rules.inner}
        self.known = dict(self.proven)
        self.parts = re.compile(rules.cut)
        self.runs = re.compile(" *[^ ]+| +")
        self.end = re.compile("(?<=[^ ]) ")

    def _windows(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = self.end.search(text, at + WINDOW)
            stop = cut.start() if cut else len(text)
            yield text[at:stop]
            at = stop

    def _words(self, text: str) -> Iterator[Counter[str]]:
        """Words of a text, each without the one space before it; the library, too, puts one space before a text."""
        for part in self._windows(" " + text.replace(SPACE, " ")):
            yield Counter([w[1:] for w in self.runs.findall(part)] if "  " in part else part[1:].split(" "))

    def _parts(self, word: str) -> list[str]:
        """What a word is cut into; all but the first part are marked by a space at their end, which no word has."""
        if word.isalpha() or word.startswith(" ") or len(parts := self.parts.findall(word)) < 2:
            return [word]
        return [parts[0], *(p + " " for p in parts[1:])]

    def _learn(self, words: set[str]) -> None:
        """Adds words that aren't known yet; only their unknown parts are merged."""
        known, parts = self.known, {w: self._parts(w) for w in words}
        rest = list({p for own in parts.values() for p in own if p not in known})
        inner = [p[-1] == " " != p[0] for p in rest]
        ids = self.sp.encode([APART + p[:-1] if within else p for p, within in zip(rest, inner, strict=True)], num_threads=1)
        known.update((p, len(own) - 2 * within) for p, own, within in zip(rest, ids, inner, strict=True))
        known.update((w, sum(map(known.__getitem__, own))) for w, own in parts.items() if len(own) > 1)

    def texts(self, texts: list[str | None]) -> list[int]:
        counts, held, size, group = [0] * len(texts), [], 0, WINDOW
        for i, t in enumerate(texts):
            for words in self._words(t) if t else ():
                held.append((i, words))
                size += len(words)
                if size > group:
                    self._settle(held, counts)
                    held, size = [], 0
        self._settle(held, counts)
        return counts

    def _settle(self, held: list[tuple[int, Counter[str]]], counts: list[int]) -> None:
        if len(self.known) > MEMO_WORDS or self.size > MEMO_CHARS:
            self.known, self.size = dict(self.proven), 0
        new = set().union(*(words.keys() for _, words in held)) - self.known.keys()
        self.size += sum(map(len, new))
        self._learn(new)
        for i, words in held:
            counts[i] += sum(map(mul, words.values(), map(self.known.__getitem__, words)))


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""
    shared = docs.sparkSession.sparkContext.broadcast(Rules(model_path))  # a vocabulary: bounded by its file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(shared.value, model_path)
        for batch in batches:
            tokens = pa.array(counting.texts(batch.column(2).to_pylist()), pa.int64())
            over = pc.greater(tokens, limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
