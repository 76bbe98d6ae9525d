"""Vectorised passes over the bytes of a batch of texts: word bounds and word hashes.

A scan works on the UTF-8 buffer of an Arrow column at once. It costs a few numpy
passes over the bytes, whatever the lengths of the texts, and holds about 25 bytes of
working memory for each byte of text in a chunk; chunks are cut between documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text in a chunk. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (in place)."""
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        found = np.ones(1, np.uint64)
        while len(found) < n:
            found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
        return found

    return table(_BASE), table(_INVERSE)

_SIZED = np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Hash of any range of bytes: prefix sums of code * base**position, mod 2**64,
    times the inverse power of the start, then mixed with the length."""

    def __init__(self, data: np.ndarray) -> None:
        size = 1 << max(12, int(len(data)).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_CODES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h += (end - start).astype(np.uint64) * _SIZED
        return mix(h)

    def every(self, width: int) -> np.ndarray:
        """of(i, i + width) for each i."""
        h = self.sums[width:] - self.sums[:-width]
        h *= self.down[: len(h)]
        h += np.uint64(width * int(_SIZED) % (1 << 64))
        return mix(h)


class Chunk:
    """Texts of one chunk as bytes.

    data: all bytes; bounds: where each text starts, and the end; start, end: of words;
    first: index of each text's first word, and the number of words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, *, lower: bool, words: bool = True) -> None:
        self.raw, self.bounds = data, bounds
        if not words:
            return
        self.data = LOWER[data] if lower else data
        word = ~SPACE[data]
        before = np.empty(len(word), bool)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
            before[bounds[:-1][bounds[:-1] < len(word)]] = False  # a text starts
            self.start = np.flatnonzero(word & ~before)
            after = np.empty(len(word), bool)
            after[-1] = False
            after[:-1] = word[1:]
            last = bounds[1:] - 1
            after[last[last >= 0]] = False
            self.end = np.flatnonzero(word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.word = word
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        return Rolling(self.data).of(self.start, self.end)

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def chunks(column: pa.Array, *, lower: bool = True, words: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """Cut a text column (nulls count as empty) in chunks: (from, to, chunk). Without
    ``words`` a chunk has raw and bounds only."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    buffer = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, Chunk(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=lower, words=words)
        lo = hi


def counts_in_groups(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values in groups first[i]:first[i+1]. Returns for each value how often it occurs
    in its group, and for each group its number of distinct values."""
    times = np.empty(len(values), np.int64)
    distinct = np.zeros(len(first) - 1, np.int64)
    for g in range(len(first) - 1):
        a, b = first[g], first[g + 1]
        if a == b:
            continue
        order = np.argsort(values[a:b])
        ranked = values[a:b][order]
        new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        distinct[g] = len(new)
        times[a:b][order] = np.repeat(np.diff(np.append(new, b - a)), np.diff(np.append(new, b - a)))
    return times, distinct
