"""Words of whole texts and rolling hashes of their runs, in numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return (UTF-8 keeps those bytes for themselves).
A run's hash is a polynomial in its bytes modulo 2**64, taken from one prefix
sum, so that all words of a block of texts cost a few passes over its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .blocks import SEPARATORS, byte_lengths

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A fixed 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of a window's first, second, ... word.
PLACE_VALUES = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept for the next block."""
    if _powers["n"] <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


class RunHasher:
    """Hashes of any runs of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h ^ (end - start).astype(np.uint64) * PLACE_VALUES[63])


@dataclass
class Words:
    """The words of a block of texts: rows are numbered from 0; ``first`` has each row's first word (one more entry at the end)."""

    data: np.ndarray
    row_start: np.ndarray
    row_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hasher: RunHasher
    hash: np.ndarray


def words_of(texts: pa.Array, lower: bool = False, separators: np.ndarray = SEPARATORS) -> Words:
    """Words of a block of rows; null is empty.  A space is put between rows, so no word spans two."""
    lengths = byte_lengths(texts)
    raw = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
    data = np.frombuffer(b" ".join(x or b"" for x in raw.to_pylist()) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    row_start = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1] + 1, out=row_start[1:])
    row_end = row_start + lengths
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(separators[data], out=inside[1:])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[0::2], change[1::2]
    first = np.searchsorted(start, np.append(row_start, len(data)))
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    hasher = RunHasher(data)
    return Words(data, row_start, row_end, start, end, row, first, hasher, hasher.of(start, end))


def windows(words: Words, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``n`` words that lies in one row, or of those that begin at ``at``."""
    total = len(words.hash) - n + 1
    if total <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if at is None:
        h = words.hash[:total] * PLACE_VALUES[0]
        for j in range(1, n):
            h += words.hash[j:j + total] * PLACE_VALUES[j]
        at = np.flatnonzero(words.row[:total] == words.row[n - 1:])
        return at, mix(h[at] + np.uint64(n))
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        h += words.hash[at + j] * PLACE_VALUES[j]
    return at, mix(h + np.uint64(n))
