"""Word and shingle kernels over Arrow string buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z
lower-cased.  All work is done on NumPy arrays over the UTF-8 bytes as Arrow
holds them; no Python object is made for a word.  Texts are worked on in
segments of about a quarter of a megabyte, so memory beyond the batch follows the segment,
or the words of the one longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LENGTH = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (Murmur3's finaliser)."""
    x = x ^ (x >> SHIFT)
    x *= MIX_1
    x ^= x >> SHIFT
    x *= MIX_2
    x ^= x >> SHIFT
    return x


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a function gathers for a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def groups(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a range of texts, in order: byte spans, hashes, owners."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: the bytes; offsets: of the texts, the first one 0."""
        pieces = [self._segment(data, offsets, a, b) for a, b in self._segments(data)]
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*pieces)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        #: index of each text's first word, and the number of words at the end
        self.first = np.searchsorted(self.start, offsets, "left")

    @staticmethod
    def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges of about SEGMENT, cut before white space."""
        a, n = 0, len(data)
        while a < n:
            b = min(a + SEGMENT, n)
            step = SEGMENT
            while b < n and not SPACE[data[b]]:
                found = np.flatnonzero(SPACE[data[b : b + step]])
                b = b + int(found[0]) if len(found) else min(b + step, n)
                step *= 2
            yield a, b
            a = b

    @staticmethod
    def _segment(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = data[a:b]
        n = len(part)
        space = SPACE[part]
        edge = np.zeros(n + 1, bool)  # a word may begin or end here
        edge[0] = edge[n] = True
        inner = offsets[(offsets >= a) & (offsets <= b)] - a
        edge[inner] = True
        opens = ~space
        opens[1:] &= space[:-1] | edge[1:n]
        closes = ~space
        closes[:-1] &= space[1:] | edge[1:n]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h += (end - start).astype(np.uint64) * LENGTH
        return start + a, end + a, mix(h)


def runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:start + size], order and length included."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[start + size] - total[start]) * down[start]
    return mix(h + size.astype(np.uint64) * LENGTH)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by its first word; there are at least that many."""
    last = len(h) - width + 1
    s = h[:last].copy()
    for i in range(1, width):
        s = mix(s) + h[i : last + i]
    return mix(s + np.uint64(width * int(LENGTH) % (1 << 64)))


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted, each value once; s is not kept."""
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def shingles(words: Words, first: int, last: int, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words[first:last].

    With fewer than ``width`` words the whole sequence is the one shingle; with
    none there is none.
    """
    n = int(last - first)
    return distinct(shingle_hashes(words.hash[first:last], min(n, width))) if n > 0 else np.zeros(0, np.uint64)
