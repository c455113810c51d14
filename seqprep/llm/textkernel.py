"""Vectorised text primitives on Arrow string columns: words, hashes, shingles. Bytes are UTF-8; a word is [^\\x20\\x09-\\x0D]+."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = [_U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(64)]
#: Ranges of this many bytes or more are hashed byte by byte: sums of powers modulo 2**64 can be made to agree from 1,024 bytes on.
_LONG = 512
_TABLES: list[np.ndarray] = [np.ones(0, _U), np.ones(0, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_TABLES[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, _U(b), _U)
            p[:1] = 1
            _TABLES[k] = np.multiply.accumulate(p)
    return _TABLES[0], _TABLES[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


class Ranges:
    """64-bit hashes of byte ranges: the same bytes, the same hash, wherever they stand."""

    def __init__(self, data: np.ndarray):
        self._data = data
        power, self._inverse = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts, ends = np.asarray(starts), np.asarray(ends)
        h = mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))
        for k in np.flatnonzero(ends - starts >= _LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(self._data[starts[k] : ends[k]].tobytes())
        return h


class Text:
    """The words of some rows: starts, ends (byte positions), row of each word, first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        n = len(data)
        word = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.word = word
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.n_words)
        self._sums: Ranges | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sums is None:
            self._sums = Ranges(self.data)
        return self._sums.hashes(starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of width words within a row."""
        h = self.word_hashes()
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        s = np.zeros(n, _U)
        for i in range(width):
            s += h[i : i + n] * _SHINGLE[i]
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return at, mix(s[at])

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the word shingles, repeats included; a row with 1 to width - 1 words has one, of all its words."""
        at, h = self.windows(width)
        row = self.row[at]
        few = np.flatnonzero((self.n_words > 0) & (self.n_words < width))
        if len(few):
            w = self.word_hashes()
            s = self.n_words[few].astype(_U) * _U(0x8CB92BA72F3D8DD7)
            for i in range(width - 1):
                has = self.n_words[few] > i
                s[has] += w[self.first[few[has]] + i] * _SHINGLE[i]
            row, h = np.concatenate([row, few]), np.concatenate([h, mix(s)])
        return row, h


def texts(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[tuple[int, int, Text]]:
    """The rows of a batch, in slices whose working memory is bounded by most or by the longest text."""
    data, offsets = flat(batch.column(name))
    for a, b in pieces(offsets, most):
        yield a, b, Text(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def give_back() -> None:
    """Freed memory that Arrow's pool and the C library keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # other C libraries than glibc have none
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives back freed memory when its task ends: Spark keeps a worker for the tasks of later stages, with all that it holds."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
