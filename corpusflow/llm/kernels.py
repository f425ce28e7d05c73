"""Vectorised byte kernels: word spans, word hashes, shingles and rolling hashes.

A hash of a byte range is a polynomial over 64-bit random byte codes, read off
prefix sums, so that any range costs two look-ups; a finaliser spreads the bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    p = np.full(n + 1, _INVERSE if inverse else _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, False), _powers(size, True)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs without separators, and the row of each."""
    inside = ~separators[data]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of each row, in order, and where each row's words begin."""
    start, end, row = word_spans(data, offsets, separators)
    hashes = range_hash(prefix_hash(LOWER[data] if lower else data), start, end)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    return hashes, bounds


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word shingles.

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    n = len(words) - size + 1
    factor = [np.uint64(pow(0xA0761D6478BD642F | 1, k + 1, 1 << 64)) for k in range(size)]
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        grams += words[k : k + len(grams)] * factor[k]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = np.sum(words[a:b] * np.array(factor[: b - a]), dtype=np.uint64, keepdims=True)
            out.append(mix(whole ^ np.uint64(0x5851F42D4C957F2D + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
