"""An FM-index over sequences of word numbers: wavelet matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; each 0 is a separator that differs from all others, ordered by position.

    Prefix doubling: ranks by the first k symbols give ranks by the first 2k, until all ranks differ.
    """
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text.astype(np.int64) + int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        ordered = rank[order]
        fresh = np.empty(n, bool)
        fresh[:1] = True
        fresh[1:] = ordered[1:] != ordered[:-1]
        dense = np.cumsum(fresh) - 1
        if n == 0 or dense[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = dense
        tail = np.zeros(n, np.int64)
        tail[: n - k] = rank[k:] + 1
        # only suffixes that still tie with a neighbour are sorted again
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        some = order[places]
        key = rank[some] * (n + 1) + tail[some]
        order[places] = some[np.argsort(key, kind="stable")]
        rank = rank * (n + 1)
        rank[some] += tail[some]
        k *= 2


class Ranks:
    """A wavelet matrix: how often a symbol occurs before a position, one bit of the symbol a level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (symbols >> bit) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = before[start], before[at]
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start


class FMIndex:
    """Index of ``text`` (numbers from 1; 0 separates), which must end in 0.

    Positions are kept for every ``sample``-th suffix and for each one after a separator, so a walk to a kept
    position never has to step over a separator.
    """

    def __init__(self, text: np.ndarray, largest: int, sample: int = 16):
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.ranks = Ranks(self.bwt, largest)
        self.less = np.zeros(largest + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=largest + 1), out=self.less[1:])
        kept = (order % sample == 0) | (self.bwt == 0)
        self.kept_before = np.zeros(len(text) + 1, np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.kept, self.positions = kept, order[kept]

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns of one length, by backward search of all of them at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for symbol in patterns.T[::-1]:
            c = symbol[live]
            a, b = self.less[c] + self.ranks.rank(c, lo[live]), self.less[c] + self.ranks.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        hi[hi < lo] = lo[hi < lo]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking left to a kept one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        away = np.flatnonzero(~self.kept[rows])
        while len(away):
            c = self.bwt[rows[away]]
            rows[away] = self.less[c] + self.ranks.rank(c, rows[away])
            steps[away] += 1
            away = away[~self.kept[rows[away]]]
        return self.positions[self.kept_before[rows]] + steps
