"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

The scans of induced sorting go bucket by bucket in whole-array steps. Neighbouring buckets are taken together as
long as none of their suffixes is induced by another of them; a bucket that feeds itself is scanned in rounds.
"""

from __future__ import annotations

import numpy as np


def _reach(limits: np.ndarray, at: int, broken) -> int:
    """First index after ``at`` whose limit is broken, looked for in growing steps."""
    step = 16
    lo = at + 1
    while lo < len(limits):
        bad = broken(limits[lo : lo + step])
        if bad.any():
            return lo + int(np.argmax(bad))
        lo += step
        step *= 2
    return len(limits)


def _put(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, found: np.ndarray, ends: np.ndarray, sign: int) -> None:
    """Places the wanted predecessors of ``found``, in that order, at the moving ends of their buckets."""
    before = found[found > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    symbol = s[before]
    order = np.argsort(symbol, kind="stable")
    symbol, before = symbol[order], before[order]
    first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
    sizes = np.diff(np.r_[first, len(symbol)])
    nth = np.arange(len(symbol)) - np.repeat(first, sizes)
    at = ends[symbol] + nth if sign > 0 else ends[symbol] - 1 - nth
    sa[at] = before
    ends[symbol[first]] += sign * sizes


def _induce(s: np.ndarray, small: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    """The suffix order that follows from that of ``marks``, leftmost-smaller positions already in order within their buckets."""
    n = len(s)
    counts = np.bincount(s, minlength=k)
    stop = np.cumsum(counts)
    start = stop - counts
    sa = np.full(n, -1, np.int32)
    symbol = s[marks]
    order = np.argsort(symbol, kind="stable")
    own = np.bincount(symbol, minlength=k)
    sa[np.repeat(stop - own - (np.cumsum(own) - own), own) + np.arange(len(marks))] = marks[order]
    large = ~small
    # the largest symbol that a bucket's larger-type suffixes are induced by, the smallest of its smaller-type ones
    deepest, nearest = np.full(k, -1, np.int64), np.full(k, k, np.int64)
    i = np.flatnonzero(large[:-1])
    np.maximum.at(deepest, s[i], s[i + 1])
    i = np.flatnonzero(small[:-1])
    np.minimum.at(nearest, s[i], s[i + 1])

    heads = start.copy()
    c = 0
    while c < k:
        if deepest[c] >= c:  # only itself can be meant
            at = start[c]
            while at < heads[c]:
                to = heads[c]
                _put(sa, s, large, sa[at:to], heads, 1)
                at = to
            _put(sa, s, large, sa[stop[c] - own[c] : stop[c]], heads, 1)
            c += 1
            continue
        to = _reach(deepest, c, lambda x, c=c: x >= c)
        part = sa[start[c] : stop[to - 1]]
        _put(sa, s, large, part[part >= 0], heads, 1)
        c = to

    n_large = np.bincount(s[large], minlength=k)
    for_small = sa.copy()
    inside = np.repeat(start + n_large, counts) <= np.arange(n)
    for_small[inside] = -1  # smaller-type suffixes are placed anew
    for_small[0] = n - 1
    sa, tails = for_small, stop.copy()
    c = k - 1
    back = nearest[::-1]
    while c >= 0:
        if nearest[c] <= c:
            at = stop[c]
            while at > tails[c]:
                to = tails[c]
                _put(sa, s, small, sa[to:at][::-1], tails, -1)
                at = to
            _put(sa, s, small, sa[start[c] : start[c] + n_large[c]][::-1], tails, -1)
            c -= 1
            continue
        low = k - _reach(back, k - 1 - c, lambda x, c=c: x <= c)
        part = sa[start[low] : stop[c]][::-1]
        _put(sa, s, small, part[part >= 0], tails, -1)
        c = low - 1
    sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray, k: int | None = None) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is 0 and occurs nowhere else."""
    s = np.asarray(s, np.int32)
    n, k = len(s), int(s.max()) + 1 if k is None else k
    if n == 1:
        return np.zeros(1, np.int32)
    differ = np.flatnonzero(s[:-1] != s[1:])
    run = differ[np.searchsorted(differ, np.arange(n - 1))]
    small = np.r_[s[run] < s[run + 1], True]
    mark = small & np.r_[False, ~small[:-1]]
    at = np.flatnonzero(mark).astype(np.int32)
    first = _induce(s, small, at, k)
    ordered = first[mark[first]]
    # name the substrings between marks: equal ones are neighbours now
    size = np.zeros(n, np.int32)
    size[at[:-1]] = np.diff(at)
    a, b = ordered[:-1], ordered[1:]
    same = (size[a] == size[b]) & (size[a] > 0)
    live, off = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live], b[live]
        fine = s[x + off] == s[y + off]
        same[live[~fine]] = False
        live = live[fine & (size[x] > off)]
        off += 1
    names = np.cumsum(np.r_[0, ~same]).astype(np.int32)
    if int(names[-1]) + 1 < len(at):
        name_of = np.zeros(n, np.int32)
        name_of[ordered] = names
        ordered = at[suffix_array(name_of[at], int(names[-1]) + 1)]
    return _induce(s, small, ordered, k)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in suffix order (-1: none) and the prefix they share.

    Where the symbols before both agree, the prefix is one shorter than that of the position before; only the others are
    compared, a block of symbols at a time.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    free = (phi <= 0) | (here == 0)
    other = np.flatnonzero(~free)
    free[other] = s[other - 1] != s[phi[other] - 1]
    heads = np.flatnonzero(free)
    shared = np.zeros(len(heads), np.int64)
    padded = np.r_[s, np.full(block, -1, s.dtype)]
    steps = np.arange(block)
    live = np.flatnonzero(phi[heads] >= 0)
    while len(live):
        for some in np.array_split(live, max(1, len(live) // 65_536)):
            x, y = heads[some] + shared[some], phi[heads[some]] + shared[some]
            inside = (x < n) & (y < n)
            equal = (padded[np.minimum(x, n - 1)[:, None] + steps] == padded[np.minimum(y, n - 1)[:, None] + steps]) & inside[:, None]
            shared[some] += np.where(equal.all(1), block, np.argmin(equal, axis=1))
        live = live[shared[live] % block == 0]
        live = live[_went_on(padded, heads[live], phi[heads[live]], shared[live], block)]
    last = np.cumsum(free) - 1
    return phi, np.maximum(0, shared[last] + heads[last] - here)


def _went_on(padded: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray, block: int) -> np.ndarray:
    """Which of the comparisons ended in a whole block, and so go on."""
    n = len(padded) - block
    i, j = x + shared, y + shared
    fine = (shared > 0) & (i < n) & (j < n)
    return fine & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its positions start a string of ``length`` bytes that starts elsewhere too, in any of them."""
    sizes = np.array([len(t) for t in texts])
    # 0xFF is in no UTF-8 text, so no string of ``length`` bytes that crosses an end equals one inside a text
    flat = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8).astype(np.int32) + 1
    s = np.r_[flat, 0].astype(np.int32)
    phi, shared = permuted_lcp(s, suffix_array(s, 257))
    start = np.cumsum(np.r_[0, sizes[:-1] + 1])
    left = np.repeat(start + sizes, sizes + 1) - np.arange(len(flat))
    hit = np.flatnonzero((shared[: len(flat)] >= length) & (left >= length))
    found = np.zeros(len(flat), bool)
    found[hit] = True
    found[phi[hit]] = True
    return [found[i : i + max(0, z - length + 1)] for i, z in zip(start, sizes, strict=True)]
