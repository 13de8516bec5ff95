"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word's hash is a polynomial over its bytes mod 2**64.  One running sum of
``(byte + 1) * BASE**i`` gives all of them: the difference at a word's ends,
times ``BASE**-start``.  No Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Any odd base has an inverse mod 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers[key]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, most: int = CHUNK):
    """(first row, bytes, offsets) of consecutive rows; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


class Words:
    """The words of a chunk: ``doc`` (row in the chunk), ``start``, ``end`` (bytes), ``hash`` (lower-cased in ASCII)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.lower = LOWER[data]
        if len(data):
            after = np.empty(len(data), bool)
            after[0], after[1:] = False, word[:-1]
            start = word & (~after | edge[:-1])
            before = np.empty(len(data), bool)
            before[-1], before[:-1] = False, word[1:]
            end = word & (~before | edge[1:])
            self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.multiply(self.lower.astype(np.uint64) + np.uint64(1), _power(BASE, len(data))[:len(data)], out=total[1:])
        np.cumsum(total, out=total)
        h = (total[self.end] - total[self.start]) * _power(BASE_INVERSE, len(data) + 1)[self.start]
        self.hash = mixed(h)


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)
