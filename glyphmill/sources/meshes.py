"""Outlines of sprites: a polygon that holds every visible pixel, cut into triangles, and packing by outline.

All coordinates are whole numbers and all tests of geometry are exact. A sprite is one mask of cells; cells of large ones are
several pixels wide, and a cell with any visible pixel counts. Helpers work on one sprite; `sprite_meshes` and `nest_groups` run them in tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.operators.groups import over_groups
from glyphmill.operators.maxrects import pack_items
from glyphmill.sources.images import decode_png, image_info, visible_box

# fixed values: alpha from which a pixel is visible; most cells of a mask's edge; squared distance within which a vertex is dropped; most
# vertices; how much larger than the visible area an outline may be; pixels of a cell when nesting
VISIBLE, MOST_CELLS, TOLERANCE2, MOST_VERTICES, MOST_AREA, NEST_CELL = 1, 256, 1, 12, 2, 4
Point = tuple[int, int]


def mask_of(alpha: np.ndarray, cell: int) -> np.ndarray:
    """Cells with a visible pixel; cells at the far edges may be narrower."""
    if cell == 1:
        return alpha >= VISIBLE
    rows = np.maximum.reduceat(alpha >= VISIBLE, np.arange(0, alpha.shape[0], cell), axis=0)
    return np.maximum.reduceat(rows, np.arange(0, alpha.shape[1], cell), axis=1)


def island_count(mask: np.ndarray) -> int:
    """How many sets of cells that hang together by their sides: runs of cells joined with those of the row above."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for row in mask:
        turn = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).tolist()
        runs = []
        for a, b in zip(turn[::2], turn[1::2], strict=True):
            parent.append(len(parent))
            runs.append((a, b, len(parent) - 1))
            for c, d, i in above:
                if c < b and a < d:
                    parent[root(i)] = root(len(parent) - 1)
        above = runs
    return len({root(i) for i in range(len(parent))})


def outline(mask: np.ndarray) -> list[Point]:
    """The outer boundary of one island on the grid's corners, its cells on the right hand in reading order of corners, without straight vertices.

    Every side between a cell and none is an edge from corner to corner; where two edges leave a corner, the one that stays with its cell goes on.
    """
    p = np.pad(mask, 1)
    inner = p[1:-1, 1:-1]
    after: dict[Point, list[tuple[Point, Point]]] = {}
    for dy, dx, a, b in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (1, 1)), (1, 0, (1, 1), (0, 1)), (0, -1, (0, 1), (0, 0))):
        open_ = inner & ~p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
        for y, x in np.argwhere(open_).tolist():
            after.setdefault((x + a[0], y + a[1]), []).append(((x + b[0], y + b[1]), (x, y)))
    y, x = np.argwhere(mask)[0].tolist()  # the first cell in reading order: its upper side is on the outer boundary
    at, cell, loop = (x, y), (x, y), []
    while True:
        out = after[at]
        to, cell = out[0] if len(out) == 1 else next(e for e in out if e[1] == cell)
        loop.append(at)
        at = to
        if at == (x, y) and len(loop) > 2:
            break
    return _without_straight(loop)


def cross(a: Point, b: Point, c: Point) -> int:
    """Twice the signed area of a triangle."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def area2(loop: list[Point]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1], strict=True))


def _without_straight(loop: list[Point]) -> list[Point]:
    while True:
        keep = [b for a, b, c in zip(loop[-1:] + loop[:-1], loop, loop[1:] + loop[:1], strict=True) if cross(a, b, c) != 0]
        if len(keep) == len(loop) or len(keep) < 3:
            return keep
        loop = keep


def grown(loop: list[Point], tolerance2: int = TOLERANCE2, most: int = MOST_VERTICES) -> list[Point]:
    """A polygon around the given one (both with positive area) of at most so many vertices.

    Only dents are filled: a vertex where the boundary turns inward goes, the least area first, if the triangle it gives up holds no other vertex. Those
    within the tolerance go anyway, others while there are too many. If that isn't enough, the bounding box.
    """
    n = len(loop)
    xs, ys = np.array([p[0] for p in loop], np.int64), np.array([p[1] for p in loop], np.int64)
    alive = np.ones(n, bool)
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    left, heap, stamp = n, [], [0] * n

    def offer(i: int) -> None:
        a, b, c = loop[before[i]], loop[i], loop[after[i]]
        turn = cross(a, b, c)
        stamp[i] += 1
        if turn <= 0:
            far = turn * turn <= tolerance2 * ((c[0] - a[0]) ** 2 + (c[1] - a[1]) ** 2)
            heapq.heappush(heap, (0 if far else 1, -turn, i, stamp[i]))

    def clear(i: int) -> bool:
        a, b, c = loop[before[i]], loop[i], loop[after[i]]
        side = lambda p, q: (q[0] - p[0]) * (ys - p[1]) - (q[1] - p[1]) * (xs - p[0])
        inside = (side(a, b) <= 0) & (side(b, c) <= 0) & (side(c, a) <= 0) & alive
        inside[[before[i], i, after[i]]] = False
        return not inside.any()

    for i in range(n):
        offer(i)
    put_off: list[tuple] = []
    while heap and left > 3:
        kind, size, i, s = heapq.heappop(heap)
        if not alive[i] or s != stamp[i]:
            continue
        if kind == 1 and left <= most:
            break
        if size and not clear(i):
            put_off.append((kind, size, i, s))
            continue
        alive[i] = False
        left -= 1
        a, c = before[i], after[i]
        after[a], before[c] = c, a
        offer(a)
        offer(c)
        for entry in put_off:  # what stood in the way may be gone
            heapq.heappush(heap, entry)
        put_off = []
    out = _without_straight([loop[i] for i in np.flatnonzero(alive)])
    if len(out) > most:
        x0, x1, y0, y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return out


def triangles_of(loop: list[Point]) -> list[list[int]]:
    """Vertex numbers of triangles that fill a polygon of positive area: ears are cut off one after another. Empty if none is left to cut."""
    left, out = list(range(len(loop))), []
    while len(left) > 3:
        for k, i in enumerate(left):
            a, b, c = loop[left[k - 1]], loop[i], loop[left[(k + 1) % len(left)]]
            if cross(a, b, c) <= 0:
                continue
            others = (loop[j] for j in left if j not in (left[k - 1], i, left[(k + 1) % len(left)]))
            if any(cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 for p in others):
                continue
            out.append([left[k - 1], i, left[(k + 1) % len(left)]])
            del left[k]
            break
        else:
            return []
    return [*out, left] if cross(*(loop[i] for i in left)) > 0 else []


def mesh_of(alpha: np.ndarray) -> tuple[list[list[int]], list[list[int]]] | None:
    """Vertices (x, y) and triangles around a sprite's visible pixels; None where a rectangle does as well: nothing visible, several islands, an outline
    far larger than what is visible, or one that fills the frame."""
    h, w = alpha.shape
    cell = max(1, -(-max(h, w) // MOST_CELLS))
    mask = mask_of(alpha, cell) if alpha.size else np.zeros((0, 0), bool)
    box = visible_box(mask)
    if box is None:
        return None
    left, top, right, low = box
    mask = mask[top:low, left:right]
    if mask.all():  # one island, bounded by its box
        corners = [(left, top), (right, top), (right, low), (left, low)]
    elif island_count(mask) > 1:
        return None
    else:
        corners = [(x + left, y + top) for x, y in outline(mask)]
    loop = [(min(x * cell, w), min(y * cell, h)) for x, y in corners]  # far cells end with the frame
    if area2(loop) > MOST_AREA * 2 * int(mask.sum()) * cell * cell:
        return None
    loop = grown(loop)
    if len(loop) < 3 or area2(loop) >= 2 * w * h:
        return None
    parts = triangles_of(loop)
    return ([list(p) for p in loop], parts) if len(parts) == len(loop) - 2 else None


def sprite_meshes(files: DataFrame, sprites: DataFrame, most_pixels: int = 25_165_824) -> DataFrame:
    """files: path, content (PNG). sprites: path, sprite_idx, x, y, w, h. path, sprite_idx, vertices (x, y from the frame's corner), triangles (vertex numbers); both null for frames
    that a rectangle serves as well. Frames that reach over the image, and files that aren't decoded, have no row."""
    rects = sprites.groupBy("path").agg(F.collect_list(F.struct("sprite_idx", "x", "y", "w", "h")).alias("rects"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, found in zip(pdf["path"], pdf["content"], pdf["rects"], strict=True):
                info = image_info(data)
                px = decode_png(data) if info and info[0] == "image/png" and info[1] * info[2] <= most_pixels else None
                for r in found if px is not None else ():
                    x, y, w, h = r["x"], r["y"], r["w"], r["h"]
                    if min(x, y) >= 0 and min(w, h) > 0 and x + w <= px.shape[1] and y + h <= px.shape[0]:
                        rows.append((path, r["sprite_idx"], *(mesh_of(px[y : y + h, x : x + w, 3]) or (None, None))))
            yield pd.DataFrame(rows, columns=["path", "sprite_idx", "vertices", "triangles"])

    return files.select("path", "content").join(rects, "path").mapInPandas(run, "path string, sprite_idx long, vertices array<array<int>>, triangles array<array<int>>")


# ---------------------------------------------------------------- nesting


class Bits:
    """A mask as rows of bits, and what it would meet at every place of a row of bits at once."""

    def __init__(self, mask: np.ndarray, margin: int):
        grown_ = np.pad(mask, margin)
        for axis in (0, 1):
            grown_ = np.maximum.reduce([np.roll(grown_, k, axis) for k in range(-margin, margin + 1)])
        self.h, self.w = grown_.shape
        self.cells = int(grown_.sum())
        self.rows, self.runs = [], []
        for row in grown_:
            turn = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).tolist()
            self.runs.append(list(zip(turn[::2], turn[1::2], strict=True)))
            self.rows.append(sum((1 << b) - (1 << a) for a, b in self.runs[-1]))

    def blocked(self, taken: list[int], y: int) -> int:
        """Bits of the columns at which the mask, its top at row y, would meet what is taken."""
        out = 0
        for r, runs in enumerate(self.runs):
            row = taken[y + r]
            for a, b in runs if row else ():
                part, width = row >> a, 1
                while width * 2 <= b - a:  # the run as shifts that double
                    part |= part >> width
                    width *= 2
                out |= part | (part >> (b - a - width))
        return out


def nest(masks: list[Bits], width: int, height: int) -> list[Point | None]:
    """Places of masks in a grid, each at the first row and column where it meets nothing; None where there is none."""
    taken, out = [0] * height, []
    for m in masks:
        found = None
        room = width - m.w + 1
        for y in range(height - m.h + 1 if room > 0 else 0):
            free = ~m.blocked(taken, y) & ((1 << room) - 1)
            if free:
                found = ((free & -free).bit_length() - 1, y)
                break
        out.append(found)
        if found:
            for r, bits in enumerate(m.rows):
                taken[found[1] + r] |= bits << found[0]
    return out


def nest_items(masks: list[np.ndarray], most: int, padding: int = 2, cell: int = NEST_CELL) -> list[tuple[int, int, dict[int, Point]]]:
    """Bins (width, height, places in pixels) for masks of cells: the smallest that holds all, by area and then width, otherwise bins of the largest size one
    after another. Masks keep padding from each other, not from a bin's edge. What is larger than a bin has one for itself."""
    margin = -(-padding // cell)
    bits = [Bits(m, margin) for m in masks]
    order = sorted(range(len(masks)), key=lambda i: (-bits[i].cells, -max(bits[i].w, bits[i].h), i))
    sides = [1 << k for k in range(most.bit_length()) if cell <= 1 << k <= most]
    fits = lambda w, h: all(masks[i].shape[1] * cell <= w and masks[i].shape[0] * cell <= h for i in order)
    cells = sum(int(m.sum()) for m in masks) * cell * cell
    place = lambda at: (at[0] * cell, at[1] * cell)
    grid = lambda n: n // cell + 2 * margin  # noqa: E731  # margins may hang over the edges
    for w, h in sorted(((w, h) for w in sides for h in sides if w * h >= cells and fits(w, h)), key=lambda b: (b[0] * b[1], b[0])) if masks else ():
        at = nest([bits[i] for i in order], grid(w), grid(h))
        if None not in at:
            return [(w, h, {i: place(p) for i, p in zip(order, at, strict=True)})]
    bins = []
    while order:
        at = dict(zip(order, nest([bits[i] for i in order], grid(most), grid(most)), strict=True))
        placed = {i: place(p) for i, p in at.items() if p} or {order[0]: (0, 0)}
        bins.append((most, most, placed))
        order = [i for i in order if i not in placed]
    return bins


def nest_groups(masks: DataFrame, most: int = 4096, padding: int = 2, cell: int = NEST_CELL) -> DataFrame:
    """masks: group, item, w, h (pixels), rows (array of strings of 0 and 1, a row of cells each). group, bytes_rect, bytes_nested, wins: texture bytes of packing the
    rectangles and of nesting the masks. Nesting wins only by strictly fewer bytes."""

    def one(g: dict[str, list]) -> list[tuple]:
        rect = pack_items(list(zip(g["w"], g["h"], strict=True)), most, padding)
        shapes = [np.array([[c == "1" for c in row] for row in rows], bool) for rows in g["rows"]]
        nested = nest_items(shapes, most, padding, cell)
        a, b = (sum(w * h * 4 for w, h, _ in bins) for bins in (rect, nested))
        return [(g["group"][0], a, b, b < a)]

    schema = StructType().add("group", masks.schema["group"].dataType).add("bytes_rect", "long").add("bytes_nested", "long").add("wins", "boolean")
    return over_groups(masks.select("group", "item", "w", "h", "rows"), "group", ["item"], one, ["group", "bytes_rect", "bytes_nested", "wins"], schema)
