"""A run-length index of one bounded text: its Burrows-Wheeler transform kept as runs, with the suffix positions
at run ends sampled, and matching statistics of the text against the rest of itself.

A position's longest match with a neighbouring suffix falls by one as the position moves on, unless the
position is a run's sampled end; so the sampled ends and the matches computed at them give all statistics in
one stream over the text (the classic property of the permuted LCP array).
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling, with the ranks of each doubled length. symbols: int64, the last one unique; those below 2^15 start four at once."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64), []
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols + 1
    if int(symbols.max()) >= (1 << 15) - 1:
        rank, h = _dense_sort(s[:n]), 1
    else:
        rank, h = _dense_sort((s[:n] << 48) | (s[1 : n + 1] << 32) | (s[2 : n + 2] << 16) | s[3:]), 4
    ranks = [(h, rank)]
    if int(rank.max()) == n - 1:
        return np.argsort(rank), ranks
    while True:
        key = rank.astype(np.int64)
        key *= n + 1
        key[: max(0, n - h)] += rank[h:]
        key[: max(0, n - h)] += 1
        order = np.argsort(key)
        sorted_key = key[order]
        del key
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh) - 1
        h *= 2
        ranks.append((h, rank))
        if fresh.all():
            return order, ranks


def _dense_sort(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)  # equal keys share a rank, so their order is free
    k = key[order]
    fresh = np.ones(len(k), np.int32)
    fresh[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.int32)
    rank[order] = np.cumsum(fresh) - 1
    return rank


class RunLengthIndex:
    """heads/tails: suffix positions at the first and last row of each run; symbols: the runs' symbols; starts: their first rows."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        self._text = symbols
        order, self._ranks = suffix_order(symbols)
        bwt = symbols[order - 1]  # position 0 is preceded by the last symbol, which is unique
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.starts = np.concatenate([[0], change]) if n else np.zeros(0, np.int64)
        ends = np.append(change - 1, n - 1) if n else np.zeros(0, np.int64)
        self.symbols = bwt[self.starts]
        self.heads, self.tails = order[self.starts], order[ends]
        above = order[np.maximum(self.starts - 1, 0)]
        below = order[np.minimum(ends + 1, max(n - 1, 0))]
        self.head_match = np.where(self.starts > 0, self.common(self.heads, above), 0) if n else np.zeros(0, np.int64)
        self.tail_match = np.where(ends < n - 1, self.common(self.tails, below), 0) if n else np.zeros(0, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at a and b, by the ranks of halving lengths."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for h, rank in reversed(self._ranks):
            ok = (a < self.n) & (b < self.n) & (a != b)
            same = np.zeros(len(a), bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            # equal ranks of length h mean h equal symbols as the last symbol is unique
            a[same] += h
            b[same] += h
            out[same] += h
        for _ in range(3):  # what is left is shorter than the first packed length
            ok = (a < self.n) & (b < self.n) & (a != b)
            same = np.zeros(len(a), bool)
            same[ok] = self._text[a[ok]] == self._text[b[ok]]
            a[same] += 1
            b[same] += 1
            out[same] += 1
            if not same.any():
                break
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string starting there that starts anywhere else in the text too."""
        return np.maximum(self._stream(self.heads, self.head_match), self._stream(self.tails, self.tail_match))

    def _stream(self, at: np.ndarray, match: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        by = np.argsort(at)
        at, match = at[by], match[by]
        pos = np.arange(self.n)
        k = np.searchsorted(at, pos, side="right") - 1
        out = np.maximum(match[np.maximum(k, 0)] - (pos - at[np.maximum(k, 0)]), 0)
        return np.where(k >= 0, out, 0)
