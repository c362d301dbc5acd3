"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified (S: smaller than the next one, L: larger), the leftmost-S substrings (LMS) are sorted by one
induction and named, the string of names is sorted recursively, and a second induction orders all suffixes. Over a
small alphabet an induction handles a whole bucket at a time in numpy: what a bucket's suffixes induce is put into
other buckets at once, what they induce in their own bucket (runs of one symbol) is the next turn. In the string of
names buckets are about as many as suffixes, which numpy can't take in such bites; there the recursion names ever
longer LMS substrings, twice as many at a time, and goes on only with those whose names aren't unique yet.

Symbol 1, if `ends` is set, ends a string: each occurrence counts as a symbol of its own, so no comparison runs from
one string into the next.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to here are induced by buckets.
BUCKETS = 1024


def suffix_array(t: np.ndarray, sigma: int, ends: bool = False) -> np.ndarray:
    """t: symbols below sigma, at most BUCKETS; its last one is 0 and occurs only there."""
    if sigma > BUCKETS:
        raise ValueError(f"{sigma} symbols; {BUCKETS} is the bound")
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int64)
    s = classify(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _by_bucket(t, s, lms, sigma)
    by = sa[is_lms[sa]]
    new = _differs(t, lms, by)
    if ends:
        new |= t[by] == 1
    if not new.all():
        number = np.empty(n, np.int32 if n >> 31 == 0 else np.int64)
        number[lms] = np.arange(len(lms))
        by = lms[_by_name(number[by], new)]
    return _by_bucket(t, s, by, sigma)


def _words(t: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols from each place on as one word, the first of them lowest, and how many there are in a word."""
    width = 8 // t.itemsize
    padded = np.concatenate([t, np.zeros(width - 1, t.dtype)])
    return np.ndarray((len(t),), "<u8", padded, 0, (t.itemsize,)), width


def _by_name(by: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, whose last one occurs once and is the smallest. by: the places in order
    of their names, those of one name in any order; new: whether the name differs from the one before."""
    m = len(by)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, m))
    rank = np.empty(m, np.int64)
    rank[by] = np.repeat(first, size)
    open_ = by[np.repeat(size > 1, size)]
    k = 1
    while len(open_):
        old = rank[open_]
        key = old * m + rank[open_ + k]
        to = np.argsort(key)
        open_, key, old = open_[to], key[to], old[to]
        group = np.flatnonzero(np.concatenate(([True], np.diff(old) != 0)))
        start = np.repeat(group, np.diff(np.append(group, len(old))))
        first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        size = np.diff(np.append(first, len(key)))
        rank[open_] = np.repeat(old[first] + first - start[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        k *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes."""
    n = len(t)
    place = np.arange(n - 1)
    at = np.where(t[1:] != t[:-1], place, n - 2)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return np.append((t[1:] > t[:-1])[at], True)


def _differs(t: np.ndarray, lms: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether each LMS substring, in order, differs from the one before it."""
    length = np.ones(len(t), np.int32 if len(t) >> 31 == 0 else np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    words, width = _words(t)
    low = np.array([(1 << 64 // width * k) - 1 for k in range(width + 1)], np.uint64)
    out = np.ones(len(by), bool)
    long = length[by]
    i = np.flatnonzero(long[1:] == long[:-1])
    a, b, left = by[i], by[i + 1], long[i]
    while len(i):
        same = (words[a] ^ words[b]) & low[np.minimum(left, width)] == 0
        go = left > width
        out[i[same & ~go] + 1] = False
        go &= same
        i, a, b, left = i[go], a[go] + width, b[go] + width, left[go] - width
    return out


def _by_bucket(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    both = t.astype(np.uint8 if sigma <= 128 else np.uint16) * 2 + s  # symbol and class, read at once
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int64 if n >> 31 else np.int32)
    first = t[lms]
    many = np.bincount(first, minlength=sigma)
    by = np.argsort(first, kind="stable")
    sa[(end - many)[first[by]] + np.arange(len(by)) - (np.cumsum(many) - many)[first[by]]] = lms[by]
    head, tail = start.copy(), end.copy()
    symbols = np.flatnonzero(count).tolist()

    def put(q: np.ndarray, c: np.ndarray, up: bool) -> None:
        if len(q) <= 6:
            for x, c in zip(q.tolist(), c.tolist()):
                if up:
                    sa[head[c]] = x
                    head[c] += 1
                else:
                    tail[c] -= 1
                    sa[tail[c]] = x
            return
        by = np.argsort(c, kind="stable")
        n_of = np.bincount(c, minlength=sigma)
        before = np.cumsum(n_of) - n_of
        if up:
            sa[np.repeat(head - before, n_of) + np.arange(len(q))] = q[by]
            head[:] += n_of
        else:
            sa[np.repeat(tail - 1 + before, n_of) - np.arange(len(q))] = q[by]
            tail[:] -= n_of

    def before(p: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
        q = p[p > 0] - 1
        c = both[q]
        own = (c & 1) == small
        return q[own], c[own] >> 1

    for c in symbols:
        at = start[c]
        while head[c] > at:
            p = sa[at : head[c]]
            at = int(head[c])
            put(*before(p, False), True)
        if many[c]:
            put(*before(sa[end[c] - many[c] : end[c]], False), True)
    for c in reversed(symbols):
        at = end[c]
        while tail[c] < at:
            p = sa[tail[c] : at][::-1]
            at = int(tail[c])
            put(*before(p, True), False)
        if head[c] > start[c]:
            put(*before(sa[start[c] : head[c]][::-1], True), False)
    if sa[0] < 0:
        sa[0] = n - 1  # the end's own bucket
    return sa


def permuted_lcp(t: np.ndarray, sa: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each place p of t, how many symbols the suffix at p shares with its predecessor in the suffix array. It drops
    by one from p - 1 to p wherever both suffixes follow the same symbol; only the other places are compared. wanted: the
    places whose value counts, in stretches; what isn't wanted may be wrong, and a stretch follows no other's place."""
    n = len(t)
    previous = np.full(n, -1, sa.dtype)
    previous[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (previous[1:] <= 0) | (t[:-1] != t[previous[1:] - 1])
    shared = np.zeros(n, sa.dtype)
    if wanted is None:
        i = np.flatnonzero(own & (previous >= 0))
    else:
        own[1:] |= wanted[1:] & ~wanted[:-1]
        i = np.flatnonzero(own & wanted & (previous >= 0))
    words, width = _words(t)
    a, b, k = i, previous[i], 0
    while len(i):  # the last 0 occurs once, so it ends every comparison
        other = words[a] ^ words[b]
        go = other == 0
        bits = other[~go]
        shared[i[~go]] = k + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(sa.dtype) // (64 // width)
        i, a, b, k = i[go], a[go] + width, b[go] + width, k + width
    place = np.arange(n, dtype=sa.dtype)
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(shared[last] - (place - last), 0)
