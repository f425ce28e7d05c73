"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The first level has a small alphabet and is induced bucket by bucket: a bucket
is final once all buckets before it were scanned, so its suffixes place theirs
in one stable counting step of NumPy.  The reduced strings below have large
alphabets and are induced one suffix at a time.
"""

from __future__ import annotations

import numpy as np


def place_type(n: int) -> type:
    """The smaller integers that hold places (and sums of two) of ``n`` symbols: arrays of places are most of the memory."""
    return np.int32 if n < 1 << 30 else np.int64


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); ``s`` ends with its unique least symbol."""
    n = len(s)
    rising = np.zeros(n, bool)
    rising[:-1] = s[:-1] < s[1:]
    rising[-1] = True
    changes = np.flatnonzero(np.append(s[:-1] != s[1:], True))
    return np.repeat(rising[changes], np.diff(changes, prepend=-1))


def _deal(items: np.ndarray, symbols: np.ndarray, pending: list[list[np.ndarray]]) -> None:
    if not items.size:
        return
    order = np.argsort(symbols, kind="stable")
    symbols, items = symbols[order], items[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for at, part in zip(symbols[np.append(0, cuts)].tolist(), np.split(items, cuts), strict=True):
        pending[at].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce_buckets(s: np.ndarray, rising: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in an order right within each bucket."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _deal(leftmost, s[leftmost], seeds)
    pending: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    large: list[np.ndarray] = []
    for c in range(sigma):
        done, front = [], _joined(pending[c])
        while front.size:
            done.append(front)
            before = front[front > 0] - 1
            before = before[~rising[before]]
            symbols = s[before]
            _deal(before[symbols != c], symbols[symbols != c], pending)
            front = before[symbols == c]
        large.append(_joined(done))
        if seeds[c]:
            before = _joined(seeds[c])
            before = before[before > 0] - 1
            _deal(before, s[before], pending)
    pending = [[] for _ in range(sigma)]
    parts: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        done, front = [], _joined(pending[c])
        if c == 0:
            front = np.array([len(s) - 1], leftmost.dtype)
        while front.size:
            done.append(front)
            before = front[front > 0] - 1
            before = before[rising[before]]
            symbols = s[before]
            if c:
                _deal(before[symbols != c], symbols[symbols != c], pending)
            front = before[symbols == c] if c else before[:0]
        parts.append(_joined(done))
        back = large[c][::-1]
        parts.append(back)
        before = back[back > 0] - 1
        before = before[rising[before]]
        _deal(before, s[before], pending)
    return np.concatenate(parts)[::-1]


def _induce_singly(s: list[int], rising: list[bool], leftmost: list[int], sigma: int) -> list[int]:
    n = len(s)
    sizes = [0] * sigma
    for c in s:
        sizes[c] += 1
    ends, total = [], 0
    for c in range(sigma):
        total += sizes[c]
        ends.append(total)
    starts = [e - k for e, k in zip(ends, sizes, strict=True)]
    out = [-1] * n
    tail = ends[:]
    for i in reversed(leftmost):
        tail[s[i]] -= 1
        out[tail[s[i]]] = i
    head = starts[:]
    for i in out:
        if i > 0 and not rising[i - 1]:
            c = s[i - 1]
            out[head[c]] = i - 1
            head[c] += 1
    tail = ends[:]
    for k in range(n - 1, -1, -1):
        i = out[k]
        if i > 0 and rising[i - 1]:
            c = s[i - 1]
            tail[c] -= 1
            out[tail[c]] = i - 1
    return out


def _induce(s: np.ndarray, rising: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    if sigma * 64 <= len(s) or sigma <= 300 < len(s):
        return _induce_buckets(s, rising, leftmost, sigma)
    return np.array(_induce_singly(s.tolist(), rising.tolist(), leftmost.tolist(), sigma), leftmost.dtype)


def _names(s: np.ndarray, places: np.ndarray, by_order: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each leftmost-smaller substring, by rank; equal ones (neighbours in ``by_order``, compared symbol by symbol) share it."""
    sizes = np.zeros(len(s), places.dtype)
    sizes[places] = np.append(places[1:] + 1, len(s)) - places
    one, other = by_order[:-1], by_order[1:]
    differ = sizes[one] != sizes[other]
    alike = np.flatnonzero(~differ)
    lengths = sizes[one[alike]]
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0, dtype=places.dtype) - np.repeat((ends - lengths).astype(places.dtype), lengths)
    unequal = s[np.repeat(one[alike], lengths) + within] != s[np.repeat(other[alike], lengths) + within]
    if len(alike):
        differ[alike] = np.logical_or.reduceat(unequal, ends - lengths)
    rank = np.cumsum(np.append(False, differ))
    names = np.zeros(len(s), places.dtype)
    names[by_order] = rank
    return names[places], int(rank[-1]) + 1


def _sorted_suffixes(s: np.ndarray, sigma: int) -> np.ndarray:
    """``s`` ends with its unique least symbol 0."""
    rising = _types(s)
    is_leftmost = rising.copy()
    is_leftmost[0] = False
    is_leftmost[1:] &= ~rising[:-1]
    places = np.flatnonzero(is_leftmost).astype(place_type(len(s)))
    if len(places) > 1:
        order = _induce(s, rising, places, sigma)
        by_order = order[is_leftmost[order]]
        del order
        names, kinds = _names(s, places, by_order)
        if kinds < len(places):
            by_order = places[_sorted_suffixes(names, kinds)]
        places = by_order
    return _induce(s, rising, places, sigma)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (non-negative integers) in order; a shorter prefix comes first."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    sigma = int(symbols.max()) + 2
    s = np.zeros(len(symbols) + 1, np.uint16 if sigma < 1 << 16 else np.int64)
    s[:-1] = symbols
    s[:-1] += 1
    return _sorted_suffixes(s, sigma)[1:]


def common_prefixes(symbols: np.ndarray, order: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place the length of the common prefix with the suffix before it in ``order``.

    ``left`` holds the symbols that remain to the end of a place's piece, the
    separator (whose value is 0) excluded; prefixes end there.  Values are permuted
    (by place): only where the symbols before differ is a prefix compared, all
    others are one less than that of the place before.
    """
    n = len(symbols)
    kind = place_type(n)
    other = np.full(n, -1, kind)
    other[order[1:]] = order[:-1]
    reducible = np.zeros(n, bool)
    reducible[1:] = (other[1:] > 0) & (symbols[:-1] == symbols[other[1:] - 1]) & (symbols[:-1] != 0)
    out = np.zeros(n, kind)
    signed = np.result_type(symbols.dtype, np.int8)
    padded = np.concatenate([symbols.astype(signed), np.full(int(left.max(initial=0)) + 16, -1, signed)])
    live = np.flatnonzero(~reducible & (other >= 0)).astype(kind)
    most = left[live]
    length = np.zeros(len(live), kind)
    todo = np.arange(len(live), dtype=kind)
    while todo.size:
        same = padded[live[todo] + length[todo]] == padded[other[live[todo]] + length[todo]]
        todo = todo[same & (length[todo] < most[todo])]
        length[todo] += 1
    out[live] = np.minimum(length, most)
    own = np.arange(n, dtype=kind)
    source = np.maximum.accumulate(np.where(reducible, kind(0), own))
    return np.maximum(out[source] - (own - source), 0)
