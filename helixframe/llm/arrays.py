"""Whole batches of texts as flat numpy arrays: words, line and shingle hashes without a Python loop over documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes at most that one step works on, unless a single document is longer.  A step takes about a hundred times as many.
STEP_BYTES = 1 << 20

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Two odd multipliers (fixed values; any odd numbers with mixed bits serve).
ODD_A, ODD_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of the public splitmix64 generator)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(ODD_A))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64; those that a step needs are kept, longer ones are not."""

    def __init__(self, odd: int):
        self.odd, self.inverse = odd, pow(odd, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        most = STEP_BYTES + 1
        m = n if n > most else min(most, max(n, 2 * len(self.up)))
        factors = np.full(m, self.odd, U)
        factors[0] = 1
        up = np.cumprod(factors, dtype=U)
        factors[1:] = self.inverse
        down = np.cumprod(factors, dtype=U, out=factors)
        if m <= most:
            self.up, self.down = up, down
        return up, down


_POWERS = {ODD_A: Powers(ODD_A), ODD_B: Powers(ODD_B)}


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit codes: equal stretches, equal hashes, wherever they stand."""

    def __init__(self, codes: np.ndarray, odd: int = ODD_A):
        n = len(codes)
        up, self.down = _POWERS[odd].to(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, n: int) -> np.ndarray:
        """Of every stretch of n codes, by its start."""
        m = max(0, len(self.sums) - n)
        return (self.sums[n:] - self.sums[:m]) * self.down[:m]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the offsets of the texts in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, most: int = STEP_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; every document stays whole."""
    _, at = flat(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    raw: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    """Index of each document's first word; one more than documents."""

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def hashes(self, lower: bool = False) -> np.ndarray:
        codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
        return mix(Rolling(codes[self.raw]).of(self.start, self.end) + (self.end - self.start).astype(U) * U(ODD_B))


def split_words(texts: pa.Array, sep: np.ndarray = _IS_SEP) -> Words:
    raw, at = flat(texts)
    inside = ~sep[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    before[at] = False  # no word runs on from the document before
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    after[at] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(raw, at, start, end, np.searchsorted(start, at))


def window_starts(at: np.ndarray, n: int) -> np.ndarray:
    """Of a flat sequence with documents at ``at``: which places start n items of one document."""
    ok = np.zeros(at[-1], bool)
    size = np.diff(at)
    many = size >= n
    edge = np.zeros(at[-1] + 1, np.int32)
    np.add.at(edge, at[:-1][many], 1)
    np.add.at(edge, at[1:][many] - n + 1, -1)
    np.cumsum(edge[:-1], out=edge[:-1])
    ok[:] = edge[:-1] > 0
    return ok


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n successive items, by doubling."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a stretch of ``length`` that begins at one of ``starts`` (distinct)."""
    edge = np.zeros(size + 1, np.int32)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge[:-1]) > 0
