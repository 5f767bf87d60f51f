"""Nearest neighbours of rectangles to the right and below, for all sheets of a batch at once.

Rectangles are ranked by the edge that comes nearer. A tree over the ranks keeps, for each node, the union of its rectangles' extents as
sorted intervals that don't overlap; a query climbs from the first rank beyond its own edge until a node's union meets its extent, and goes down
to the first rank that does. Every level is one pair of sorted arrays, and all queries take their steps together. Sheets are told apart by shifting
their extents, so rectangles of different sheets never meet.
"""

from __future__ import annotations

import numpy as np


class IntervalTree:
    """Unions of extents over runs of 2^k ranks, for each k."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.n = len(low)
        self.base = int(low.min(initial=0))
        self.span = int(high.max(initial=0)) - self.base + 1
        self.levels = []
        rank = np.arange(self.n)
        for k in range(max(1, self.n - 1).bit_length() + 1):
            shift = (rank >> k) * self.span - self.base
            start, end = low + shift, high + shift
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > end[:-1]])
            self.levels.append((start[new], end[np.append(np.flatnonzero(new)[1:] - 1, self.n - 1)]))

    def meets(self, level: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether some extent of a node reaches into [low, high)."""
        out = np.zeros(len(node), bool)
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            start, end = self.levels[k]
            shift = node[i] * self.span - self.base
            at = np.searchsorted(start, high[i] + shift, "left") - 1
            out[i] = (at >= 0) & (end[at] > low[i] + shift)
        return out

    def first(self, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first rank from begin on whose extent meets [low, high); n where there is none."""
        out = np.full(len(begin), self.n, np.int64)
        q = np.flatnonzero(begin < self.n)
        node, level, down = begin[q].copy(), np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        while len(q):
            hit = self.meets(level, node, low[q], high[q])
            done = hit & (level == 0)
            out[q[done]] = node[done]
            down |= hit
            node = np.where(hit, node * 2, node + 1)
            level = np.where(hit, level - 1, level)
            while (up := ~hit & ~down & (node % 2 == 0) & (level < len(self.levels) - 1) & (node > 0)).any():
                node, level = np.where(up, node >> 1, node), np.where(up, level + 1, level)
            go = ~done & ((node << np.maximum(level, 0)) < self.n)
            q, node, level, down = q[go], node[go], level[go], down[go]
        return out


def gaps_ahead(sheet: np.ndarray, at: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each rectangle the distance from its far edge to the nearest rectangle of its sheet that begins there or beyond and overlaps it sideways;
    -1 where there is none. sheet counts from 0."""
    if not len(at):
        return np.zeros(0, np.int64)
    width = int(high.max()) - int(low.min()) + 1
    shift = sheet * width - int(low.min())
    span = int((at + size).max()) - int(at.min()) + 1
    key = sheet * span + at - int(at.min())
    order = np.argsort(key, kind="stable")
    tree = IntervalTree((low + shift)[order], (high + shift)[order])
    begin = np.searchsorted(key[order], key + size, "left")
    found = tree.first(begin, low + shift, high + shift)
    return np.where(found < len(at), at[order][np.minimum(found, len(at) - 1)] - (at + size), -1)
