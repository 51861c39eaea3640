"""Words of a batch of texts as numpy arrays; used inside Arrow batch functions.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (those bytes
never occur inside a longer UTF-8 sequence).  Word hashes are 64-bit sums over
a random byte table times powers of an odd number, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _byte_table(lower: bool) -> np.ndarray:
    t = mix((np.arange(256, dtype=U) + U(1)) * U(_STEP))
    if lower:
        t[65:91] = t[97:123]
    return t


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.empty(n, U)
        p[0] = 1
        k, step = 1, base
        while k < n:  # doubling: p[k:2k] = p[:k] * base**k
            m = min(k, n - k)
            p[k : k + m] = p[:m] * U(step)
            k, step = k + m, (step * step) % (1 << 64)
        out.append(p)
    return out[0], out[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Texts:
    """Texts of an Arrow string array; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        n = len(column)
        self.offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo, hi = self.offsets[0], self.offsets[-1]
        self.data, self.offsets = self.data[lo:hi], self.offsets - lo
        blank = _SPACE[self.data]
        start, end = ~blank, ~blank
        start[1:] &= blank[:-1]
        end[:-1] &= blank[1:]
        full = self.offsets[:-1] < self.offsets[1:]
        a, b = self.offsets[:-1][full], self.offsets[1:][full] - 1
        start[a], end[b] = ~blank[a], ~blank[b]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` bytes."""
        table, out = _byte_table(lower), np.empty(len(self.starts), U)
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        i = 0
        while i < len(out):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + _BLOCK, "right")))
            n = int(ends[j - 1] - lo)
            power, inverse = _powers(_BLOCK if n <= _BLOCK else n)
            sums = np.zeros(n + 1, U)
            np.cumsum(table[self.data[lo : lo + n]] * power[:n], out=sums[1:])
            s, e = self.starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(_STEP)
            i = j
        return mix(out)

    def words(self, i: int) -> list[bytes]:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each position on (also across texts; the caller masks those)."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= U(_BASE)
        out += hashes[k : k + n]
    return mix(out)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of at most ``most`` rows with about ``limit`` bytes of text, to bound memory."""
    for batch in batches:
        column = batch.column(text).fill_null("").cast(pa.large_string())
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        i = 0
        while i < len(column):
            j = min(i + most, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def scatter(bucket: np.ndarray, n: int, **columns: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Order entries by bucket: the buckets that occur, the reordered columns, and entries per bucket."""
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n)
    used = np.flatnonzero(counts)
    return used, {k: v[order] for k, v in columns.items()}, counts[used]
