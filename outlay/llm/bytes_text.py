"""Words of whole texts as numpy arrays over UTF-8 bytes, for use inside tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step inside a task works on; a longer single text is taken whole.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_ALL = np.arange(256)
_LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased: digits, a-z and all beyond ASCII
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
#: [^\x20\x09-\x0D]
NOT_SPACE = (_ALL != 32) & ~((_ALL >= 9) & (_ALL <= 13))


def give_back() -> None:
    """Freed memory goes back to the system: Spark keeps Python workers, each stage's beside the others'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(step: Callable) -> Callable:
    """For mapInArrow and mapInPandas: the task's function, and what it freed given back at its end."""

    @functools.wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. By sorting: numpy's unique hashes them, which misses the cache at every step of a long array."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i below a power of two >= n."""
    size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        if len(_powers) > 2:
            _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = BASE**-i * (hash of data[i:j]), length len(data) + 1."""
    _, down = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * down[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end): equal bytes, equal hash."""
    up, _ = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * up[starts])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about CHUNK_BYTES: (index of the first, UTF-8 texts)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode() if t else b""
        if held and size + len(b) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


class Words:
    """The words of some texts: ``hash`` of each word, ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool = True) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.data = _LOWER[data] if lower else data
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = is_word[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, begins)
        self.hash = span_hashes(prefix_sums(self.data), self.start, self.end)
