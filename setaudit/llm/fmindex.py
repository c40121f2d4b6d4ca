"""A compressed FM-index over sequences of integers, and matching statistics by backward search.

Everything is numpy: the suffix array by prefix doubling, the Burrows-Wheeler transform in a wavelet tree stored
level by level as packed bit vectors with a count for every 64 bits, and queries that advance in lock step.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector of n bits with rank in constant time: 1.5 bits for each bit."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((len(bits) // 64 + 1) * 64, bool)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(count) - count).astype(np.int32)
        self.zeros = int(len(bits) - count.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class Wavelet:
    """Symbols below 2**levels, one bit vector for each level, from the highest bit down."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.rows = []
        for k in range(self.levels - 1, -1, -1):
            bit = (symbols >> k) & 1 == 1
            self.rows.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i leads for symbol c; less where 0 leads, this is the rank of c before i."""
        for k, row in zip(range(self.levels - 1, -1, -1), self.rows):
            ones = row.rank(i)
            i = np.where((c >> k) & 1 == 1, row.zeros + ones, i - ones)
        return i


def suffixes(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... symbols). The last symbol must occur once."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    levels, h = [], 1
    sorted_key = s[order]
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        levels.append(rank.astype(np.int32))
        if rank[order[-1]] == n - 1:
            return order, levels
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        h *= 2


def _smaller_before(v: np.ndarray) -> np.ndarray:
    """For each i > 0 the last j < i with v[j] < v[i], or 0, by pointer jumping."""
    at = np.arange(-1, len(v) - 1)
    at[0] = 0
    todo = np.flatnonzero(v[at] >= v)
    todo = todo[at[todo] > 0]
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] > 0) & (v[at[todo]] >= v[todo])]
    return at


class FMIndex:
    """Pieces (concatenated in ``symbols``, cut at ``bounds``) of known owners; symbols are 0..sigma-1.

    least=False: a match counts where any piece of another owner than the query's holds it (owner -1 is always
    another one). least=True: where a piece of a smaller owner holds it.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, owner: np.ndarray, sigma: int, least: bool):
        pieces = len(bounds) - 1
        size = np.diff(bounds)
        n = len(symbols) + pieces
        piece = np.repeat(np.arange(pieces), size + 1)
        ends = np.cumsum(size + 1) - 1
        s = np.empty(n, np.int64)
        word = np.ones(n, bool)
        word[ends] = False
        s[word] = symbols + pieces
        s[ends] = np.arange(pieces)
        order, levels = suffixes(s)
        self.n, self.least = n, least
        self.lcp = np.zeros(n + 1, np.int32)
        a, b = order[:-1], order[1:]
        got = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = levels[k]
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += (rank[x] == rank[y]).astype(np.int64) << k
        self.lcp[1:n] = got
        self.lcp[0] = self.lcp[n] = -1
        del levels
        self.before = _smaller_before(self.lcp)
        self.after = n - _smaller_before(self.lcp[::-1])[::-1]
        last = s[order - 1]
        bwt = np.where((order == 0) | (last < pieces), 0, last - pieces + 1)
        self.tree = Wavelet(bwt, sigma)
        count = np.bincount(symbols, minlength=sigma)
        first = pieces + np.cumsum(count) - count
        self.jump = first - self.tree.descend(np.arange(1, sigma + 1), np.zeros(sigma, np.int64))
        holder = owner[piece[order]]
        if least:
            self.table = [holder]
            while 2 ** len(self.table) <= n:
                t, h = self.table[-1], 2 ** (len(self.table) - 1)
                self.table.append(np.minimum(t[:-h], t[h:]))
        else:
            change = np.flatnonzero(holder[1:] != holder[:-1]) + 1
            nxt = np.searchsorted(change, np.arange(n), "right")
            self.change = np.concatenate([change, [n]])[nxt]
            self.holder = holder

    def _alive(self, l: np.ndarray, r: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if not self.least:
            h = self.holder[l]
            return (h != owner) | (h < 0) | (self.change[l] < r)
        out = np.zeros(len(l), bool)
        level = np.log2(r - l).astype(np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[l[at]], t[r[at] - (1 << k)]) < owner[at]
        return out

    def statistics(self, symbols: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For every position of the queries, the length of the longest match that begins there. Unknown symbols are -1."""
        out = np.zeros(len(symbols), np.int32)
        pos, stop = bounds[1:] - 1, bounds[:-1]
        live = pos >= stop
        pos, stop, own = pos[live], stop[live], owner[live]
        l, r, m = np.zeros(len(pos), np.int64), np.full(len(pos), self.n), np.zeros(len(pos), np.int64)
        while len(pos):
            c = symbols[pos]
            known = np.maximum(c, 0)
            both = self.tree.descend(np.concatenate([known, known]) + 1, np.concatenate([l, r])).reshape(2, -1) + self.jump[known]
            l2, r2 = both
            good = (c >= 0) & (l2 < r2)
            at = np.flatnonzero(good)
            good[at] = self._alive(l2[at], r2[at], own[at])
            up = ~good & (m > 0)
            x, y = self.lcp[l], self.lcp[r]
            shorter = np.maximum(np.maximum(x, y), 0)
            l = np.where(good, l2, np.where(up & (x == shorter), self.before[l], l))
            r = np.where(good, r2, np.where(up & (y == shorter), self.after[np.minimum(r, self.n)], r))
            m = np.where(good, m + 1, np.where(up, shorter, 0))
            out[pos[good]] = m[good]
            pos = pos - ~up
            live = pos >= stop
            if not live.all():
                pos, stop, own, l, r, m = (v[live] for v in (pos, stop, own, l, r, m))
        return out
