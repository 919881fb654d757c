"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int], size: int) -> list[int]:
    """The suffix array of ``s``, symbols 1 to ``size`` - 1, by induced sorting; a sentinel is implied.

    Suffixes are classified as smaller (S) or larger (L) than the one after them. The leftmost S ones'
    substrings are sorted by two induction passes over the buckets and named; the names are sorted by
    recursion unless they are unique; two more passes induce the whole from the leftmost S ones in order.
    """
    out = _sais([*s, 0], size)
    return out[1:]


def _sais(s: list[int], size: int) -> list[int]:
    n = len(s)
    if n == 1:
        return [0]
    smaller = bytearray(n)  # 1: an S suffix
    smaller[n - 1] = 1
    after, kind = s[n - 1], 1
    for i in range(n - 2, -1, -1):
        c = s[i]
        if c < after or (c == after and kind):
            smaller[i] = kind = 1
        else:
            kind = 0
        after = c
    counts = np.bincount(np.asarray(s, np.int64), minlength=size)
    tails = np.cumsum(counts)
    heads0, tails0 = (tails - counts).tolist(), tails.tolist()
    flags = np.frombuffer(smaller, np.uint8)
    left = (np.flatnonzero((flags[1:] == 1) & (flags[:-1] == 0)) + 1).tolist()

    def induce(starts: list[int]) -> list[int]:
        sa = [-1] * n
        tail = tails0[:]
        for i in reversed(starts):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = heads0[:]
        for i in sa:
            if i > 0 and not smaller[i - 1]:
                c = s[i - 1]
                sa[head[c]] = i - 1
                head[c] += 1
        tail = tails0[:]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and smaller[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    sa = induce(left)
    ends = dict(zip(left, left[1:], strict=False))
    names, name, before = [0] * n, -1, None
    for i in sa:
        if i in ends or i == n - 1:
            piece = s[i : ends[i] + 1] if i in ends else None
            if piece is None or piece != before:
                name += 1
            names[i], before = name, piece
    reduced = [names[i] for i in left]
    if name + 1 == len(left):
        order = [0] * len(left)
        for k, x in enumerate(reduced):
            order[x] = k
    else:
        order = _sais(reduced, name + 1)
    return induce([left[k] for k in order])


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """At place k, how many symbols the suffixes sa[k - 1] and sa[k] share; found in text order, then permuted."""
    n = len(s)
    before = [-1] * n
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    shared, h = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and s[i + h] == s[j + h]:
            h += 1
        shared[i] = h
        if h:
            h -= 1
    return [shared[i] for i in sa]
