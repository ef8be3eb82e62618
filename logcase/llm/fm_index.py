"""An FM-index over integer symbols, in numpy: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled places.

All queries are batches: arrays of patterns, rows or places at once.
"""
from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. ``text`` ends with a symbol that is smaller than all others and occurs once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Rank and access on a sequence of integers below 2**levels."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.levels - 1, -1, -1):
            high = (seq >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(high)]).astype(np.int32))
            self.zeros.append(int(len(seq) - high.sum()))
            seq = np.concatenate([seq[high == 0], seq[high == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        first, at = np.zeros_like(place), place
        for k, bit in enumerate(range(self.levels - 1, -1, -1)):
            high = (symbol >> bit) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            first = np.where(high, zeros + ones[first], first - ones[first])
            at = np.where(high, zeros + ones[at], at - ones[at])
        return at - first

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros_like(place), place
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            high = ones[at + 1] - ones[at]
            symbol = symbol * 2 + high
            at = np.where(high == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """``text``: symbols from 1 to ``sigma`` - 1. ``sample``: every so many places have their row marked."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16) -> None:
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.last = WaveletMatrix(text[order - 1], sigma)
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.places = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of each pattern (a matrix row); empty ranges where it does not occur."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.before[c] + self.last.rank(c, low[alive])
            high[alive] = self.before[c] + self.last.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: steps back until a marked row."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            at = rows[open_]
            hit = self.marks[at + 1] > self.marks[at]
            out[open_[hit]] = self.places[self.marks[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            c = self.last.access(at)
            rows[open_] = self.before[c] + self.last.rank(c, at)
            steps[open_] += 1
        return out

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, place) of every occurrence."""
        low, high = self.search(patterns)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(patterns)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return which, self.locate(rows)
