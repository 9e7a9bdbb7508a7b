"""Suffix arrays of symbol sequences by prefix doubling, in numpy.

Ranks of 2**k symbols are kept for each level k, so that the longest common
prefix of any two suffixes follows by descent over the levels.
"""

from __future__ import annotations

import numpy as np


def order_of(major: np.ndarray, minor: np.ndarray, top: int) -> np.ndarray:
    """Indices that sort by (major, minor), ties by index. Both are below ``top``."""
    n = len(major)
    bits, own = max(1, int(top).bit_length()), max(1, int(n).bit_length())
    if 2 * bits + own <= 63:  # one sort of packed keys is several times faster than a sort of indices
        key = (major << (bits + own)) | (minor << own) | np.arange(n)
        key.sort()
        return key & ((1 << own) - 1)
    return np.lexsort((minor, major))


class Suffixes:
    """Suffixes of many sequences, compared inside the sequence that ``end`` bounds.

    ``group`` and ``symbols``: of each position; positions of different groups
    never match. ``end``: of each position, where its sequence ends.
    ``depth``: suffixes that agree on so many symbols may stay in text order
    (0: compare them whole). ``ordered``: the order alone is wanted, ranks of
    lower levels are forgotten. The rank of a suffix is where its class begins in
    the order.
    """

    def __init__(self, group: np.ndarray, symbols: np.ndarray, end: np.ndarray, depth: int = 0, ordered: bool = False):
        n = self.n = len(symbols)
        self.end = end
        self.levels: list[np.ndarray] = []
        top = max(n + 1, int(group.max(initial=0)) + 1, int(symbols.max(initial=0)) + 1)
        self.order = order_of(group, symbols, top)
        new = np.ones(n, bool)
        g, s = group[self.order], symbols[self.order]
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels.append(rank)
        h = 1
        while n and (not depth or h < depth):
            tied = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(tied):
                break
            at = self.order[tied]
            far = at + h
            inside = far < end[at]
            minor = np.where(inside, rank[np.minimum(far, n - 1)] + 1, 0)
            major = rank[at]
            o = order_of(major, minor, n + 1)
            self.order[tied] = at[o]
            a, b = major[o], minor[o]
            fresh = np.ones(len(o), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[tied] = fresh
            rank = rank.copy()
            rank[self.order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
            self.levels = [rank] if ordered else [*self.levels, rank]
            h *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at a and b (a and b differ; depth 0 only).

        Suffixes of one sequence differ in length, so equal ranks at level k mean 2**k equal symbols.
        """
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y, r = a + out, b + out, self.levels[k]
            ok = np.flatnonzero((x < self.end[a]) & (y < self.end[b]))
            out[ok[r[x[ok]] == r[y[ok]]]] += 1 << k
        return out

    def lcp(self) -> np.ndarray:
        """Of each rank, the common prefix with the suffix before it; 0 for the first."""
        out = np.zeros(self.n, np.int64)
        if self.n > 1:
            a, b = self.order[:-1], self.order[1:]
            near = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
            out[1 + near] = self.common(a[near], b[near])
        return out

    def longest(self) -> np.ndarray:
        """Of each position, the longest prefix that occurs at another one as well."""
        lcp = self.lcp()
        best = np.maximum(lcp, np.append(lcp[1:], 0)) if self.n else lcp
        out = np.empty(self.n, np.int64)
        out[self.order] = best
        return out
