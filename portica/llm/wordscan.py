"""Vectorised scanning of UTF-8 text in numpy, for use inside Spark tasks.

A *word* is a run of bytes other than ASCII white space (space and 0x09-0x0D); lower-casing
touches A-Z only.  Words and shingles are identified by 64-bit polynomial hashes over a random
byte table, computed for a whole buffer at once with prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What stands between runs of ASCII letters, digits and non-ASCII bytes.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _TABLE[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_grown: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64; grown on demand and kept for the task."""
    have = _grown.get(base)
    if have is None or have.size < n:
        steps = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        _grown[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Prefix sums from which the hash of any byte range of a buffer follows in O(1)."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        n = buf.size
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER_TABLE if lower else _TABLE)[buf] * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def fixed(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width, by start."""
        n = self.sums.size - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


class Words:
    """The words of several texts: hash, text number, start and end, in order; `counts` by text."""

    def __init__(self, texts: list[bytes], lower: bool = True, breaks: np.ndarray = SPACE):
        joined = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.text_end = self.text_start + lengths
        inside = ~breaks[buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.prefix = Prefix(buf, lower)
        self.hash = self.prefix.ranges(self.start, self.end)
        self.inside = inside

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every run of k words inside one text."""
        n = self.hash.size - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h += self.hash[j : j + n] * np.uint64(_TABLE[j])
        same = self.doc[:n] == self.doc[k - 1 :]
        return mix(h[same]), self.doc[:n][same]


def sum_by_text(values: np.ndarray, words: Words) -> np.ndarray:
    """Sums of a per-byte array over each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[words.text_end] - total[words.text_start]


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def groups(batches, text: str, limit: int = CHUNK_BYTES):
    """(record batch slice, texts) with at most `limit` bytes of text, or one longer text alone."""
    for batch in batches:
        texts = as_bytes(batch.column(text))
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t) + 1
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
