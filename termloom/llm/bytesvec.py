"""Vectorised tokenising and hashing over the byte buffers of Arrow string columns.

No Python object is made for a word: whitespace, word bounds and 64-bit word hashes are numpy
operations over the concatenated UTF-8 bytes of many texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, so that equal-length words differ by random amounts.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _UNBASE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more entry than texts). Null counts as empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some texts: data (bytes), start, end (byte bounds), doc (index of the text), hash."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = raw(column)
        self.data = _LOWER[data] if lower else data
        self.n_docs = len(self.offsets) - 1
        n = len(self.data)
        solid = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        before |= edge[:n]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        up, down = _power(n)
        self._down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=self.sums[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes [start, end), the same wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def first_word(self) -> np.ndarray:
        """The index of each text's first word."""
        return np.cumsum(self.count) - self.count
