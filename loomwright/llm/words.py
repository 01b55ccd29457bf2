"""Words and rolling hashes of whole texts, as numpy arrays over UTF-8 bytes.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which is what ``bytes.split`` cuts at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    def __init__(self, most: int = 1 << 18):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Rolling:
    """Hashes of all windows of ``width`` words in O(words), by prefix sums of a polynomial mod 2^64."""

    def __init__(self):
        self._up, self._down = _powers(1024, _BASE), _powers(1024, _BASE_INVERSE)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        while len(self._up) < n + 1:
            size = 2 * len(self._up)
            self._up, self._down = _powers(size, _BASE), _powers(size, _BASE_INVERSE)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self._up[:n], out=total[1:])
        return total

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((prefix[width:] - prefix[:n]) * self._down[:n])


def shingle_set(hashes: np.ndarray, width: int, rolling: Rolling) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    h = rolling.windows(rolling.prefix(hashes), min(width, n))
    if n < width:
        return mix(h + np.uint64(n))
    h.sort()
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few whole texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
