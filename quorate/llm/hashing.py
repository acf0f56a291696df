"""Polynomial hashes of byte ranges, over whole batches of texts at once."""

from __future__ import annotations

import numpy as np

from .common import kept

M = 0x9E3779B97F4A7C15
M_INVERSE = pow(M, -1, 1 << 64)
_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept for the next batch."""
    have = _CACHE.get(base)
    if have is None or len(have) < n:
        if not _CACHE:
            kept(_CACHE.clear)
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _CACHE[base] = np.multiply.accumulate(out)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with hash(a, z) = (P[z] - P[a]) * M**-a for the bytes a .. z - 1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(M, len(data)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(M_INVERSE, len(prefix))[start])


def words(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """The hashes of many ranges in order, of which no two overlap: as ranges() has them, with prefix sums of about `most`
    bytes at a time (or of one range that is longer)."""
    if len(data) <= 2 * most:
        return ranges(prefix_sums(data), start, end)
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(end, start[a] + most, side="right")))
        low = start[a]
        out[a:z] = ranges(prefix_sums(data[low : end[z - 1]]), start[a:z] - low, end[a:z] - low)
        a = z
    return out


def slices(sizes: list[int], most: int):
    """Runs (a, z) of consecutive items of about `most` bytes, at least one item each."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
