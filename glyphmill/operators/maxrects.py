"""Packing of rectangles into bins whose sides are powers of two.

Free space is kept as the set of maximal free rectangles; an item goes where the shorter of the two leftovers is least
(then the longer, then the topmost, then the leftmost place), and what it covers is cut out of every free rectangle it meets.
"""

from __future__ import annotations

import numpy as np


#: Free rectangles beyond which arrays are faster than loops.
LOOP = 40


def _strips(r: tuple[int, int, int, int], x: int, y: int, right: int, low: int) -> list[tuple[int, int, int, int]]:
    """What stays of a free rectangle on each side of one that is cut out of it."""
    x0, y0, x1, y1 = r
    out = []
    if x0 < x:
        out.append((x0, y0, x, y1))
    if right < x1:
        out.append((right, y0, x1, y1))
    if y0 < y:
        out.append((x0, y0, x1, y))
    if low < y1:
        out.append((x0, low, x1, y1))
    return out


class ManyFree:
    """The maximal free rectangles of a bin that has many, as columns of left, top, right and bottom."""

    def __init__(self, rects: list[tuple[int, int, int, int]]):
        self.rects = np.array(rects, np.int64).T.copy()

    def best(self, w: int, h: int, turn: bool) -> tuple[int, int, bool] | None:
        """The place for an item, and whether it lies turned there; the upright place wins among equals."""
        x0, y0, x1, y1 = self.rects
        width, height, found = x1 - x0, y1 - y0, None
        for turned in (False, True) if turn and w != h else (False,):
            iw, ih = (h, w) if turned else (w, h)
            ok = np.flatnonzero((width >= iw) & (height >= ih))
            if len(ok):
                dw, dh = width[ok] - iw, height[ok] - ih
                short = np.minimum(dw, dh)
                at = np.flatnonzero(short == short.min())
                key = min(zip(short[at].tolist(), np.maximum(dw, dh)[at].tolist(), y0[ok[at]].tolist(), x0[ok[at]].tolist(), strict=True))
                if found is None or key[:2] < found[0][:2]:
                    found = key, turned
        return (found[0][3], found[0][2], found[1]) if found else None

    def cover(self, x: int, y: int, w: int, h: int) -> None:
        """Cut a rectangle out; of the strips around it those that no other free rectangle holds stay. A free rectangle that holds a strip but wasn't cut
        spans the strip's side along the cut, so it ends there too; only such ones are looked at."""
        x0, y0, x1, y1 = self.rects
        right, low = x + w, y + h
        met = (x0 < right) & (x1 > x) & (y0 < low) & (y1 > y)
        rest = self.rects[:, ~met]
        strips = {s for r in self.rects[:, met].T.tolist() for s in _strips(r, x, y, right, low)}
        if not strips:
            self.rects = rest
            return
        s = np.array(list(strips), np.int64).T
        near = rest[:, (rest[2] == x) | (rest[0] == right) | (rest[3] == y) | (rest[1] == low)]
        a, b = s[:, :, None], np.concatenate([s, near], axis=1)[:, None, :]
        held = (a[:2] >= b[:2]).all(axis=0) & (a[2:] <= b[2:]).all(axis=0)  # each strip holds itself
        self.rects = np.concatenate([rest, s[:, held.sum(axis=1) == 1]], axis=1)


class FreeSpace:
    """The maximal free rectangles (left, top, right, bottom) of a bin. Most sheets are small, so few are gone through one by one."""

    def __init__(self, width: int, height: int):
        self.rects = [(0, 0, width, height)]
        self.many: ManyFree | None = None

    def best(self, w: int, h: int, turn: bool) -> tuple[int, int, bool] | None:
        """The place for an item, and whether it lies turned there; the upright place wins among equals."""
        if self.many is not None:
            return self.many.best(w, h, turn)
        found = None
        for turned in (False, True) if turn and w != h else (False,):
            iw, ih = (h, w) if turned else (w, h)
            key = None
            for x0, y0, x1, y1 in self.rects:
                dw, dh = x1 - x0 - iw, y1 - y0 - ih
                if dw >= 0 and dh >= 0:
                    k = (dw, dh, y0, x0) if dw < dh else (dh, dw, y0, x0)
                    if key is None or k < key:
                        key = k
            if key is not None and (found is None or key[:2] < found[0][:2]):
                found = key, turned
        return (found[0][3], found[0][2], found[1]) if found else None

    def cover(self, x: int, y: int, w: int, h: int) -> None:
        """Cut a rectangle out; of the strips around it those that no other free rectangle holds stay."""
        if self.many is not None:
            self.many.cover(x, y, w, h)
            return
        right, low = x + w, y + h
        kept, strips = [], set()
        for r in self.rects:
            x0, y0, x1, y1 = r
            if x0 >= right or x1 <= x or y0 >= low or y1 <= y:
                kept.append(r)
                continue
            strips.update(_strips(r, x, y, right, low))
        free = kept + list(strips)
        for a in strips:
            x0, y0, x1, y1 = a
            for b in free:
                if b[0] <= x0 and b[1] <= y0 and b[2] >= x1 and b[3] >= y1 and a != b:
                    break
            else:
                kept.append(a)
        self.rects = kept
        if len(kept) > LOOP:
            self.many = ManyFree(kept)


def fill(items: list[tuple[int, int]], width: int, height: int, turn: bool = False, all_or_none: bool = False) -> list[tuple[int, int, bool] | None]:
    """Places of items in a bin, in their order; None for what finds no room (all_or_none: stop at the first such)."""
    free, out = FreeSpace(width, height), []
    for w, h in items:
        at = free.best(w, h, turn)
        out.append(at)
        if at is None and all_or_none:
            break
        if at is not None:
            free.cover(at[0], at[1], *((h, w) if at[2] else (w, h)))
    return out


def _sizes(items: list[tuple[int, int]], extra: int) -> dict[int, tuple[int, int]]:
    """What items take, by item number, in the order in which they are placed: largest first."""
    return {i: (items[i][0] + extra, items[i][1] + extra) for i in sorted(range(len(items)), key=lambda i: (-items[i][0] * items[i][1], -max(items[i]), i))}


def pack_one(items: list[tuple[int, int]], most: int, padding: int = 0, gutter: int = 0, turn: bool = False, room: int | None = None) -> tuple[int, int, dict[int, tuple[int, int, bool]]] | None:
    """The smallest bin by area, then width, that holds everything, as `pack_items` gives it; None if there is none, or none of at most `room` pixels."""
    if not items:
        return None
    size = _sizes(items, padding + 2 * gutter)
    area, longest, shortest = sum(w * h for w, h in size.values()), max(max(s) for s in size.values()), max(min(s) for s in size.values())
    room = most * most if room is None else room
    sides = [1 << k for k in range(most.bit_length()) if 1 << k <= most]
    for w, h in sorted(((w, h) for w in sides for h in sides if area <= w * h <= room and max(w, h) >= longest and min(w, h) >= shortest), key=lambda b: (b[0] * b[1], b[0])):
        at = fill(list(size.values()), w, h, turn, all_or_none=True)
        if at[-1] is not None:
            return w, h, {i: (p[0] + gutter, p[1] + gutter, p[2]) for i, p in zip(size, at, strict=True)}
    return None


def pack_items(items: list[tuple[int, int]], most: int, padding: int = 0, gutter: int = 0, turn: bool = False) -> list[tuple[int, int, dict[int, tuple[int, int, bool]]]]:
    """Bins (width, height, places by item number). Items take their padding and a gutter on each side; places are of the items themselves.

    The smallest bin by area, then width, that holds everything; otherwise bins of the largest size are filled one after another. An
    item larger than that has one of them for itself.
    """
    if (one := pack_one(items, most, padding, gutter, turn)) is not None:
        return [one]
    size = _sizes(items, padding + 2 * gutter)
    order, bins = list(size), []
    while order:
        at = dict(zip(order, fill([size[i] for i in order], most, most, turn), strict=True))
        placed = {i: (p[0] + gutter, p[1] + gutter, p[2]) for i, p in at.items() if p is not None} or {order[0]: (0, 0, False)}
        bins.append((most, most, placed))
        order = [i for i in order if i not in placed]
    return bins
