"""Operator 5: near-duplicate passages by compact windows.

A passage is at least WORDS words, told by its five-word shingles. For each of a few hash functions, the Cartesian
tree of a document's shingle hashes gives compact windows (l, c, r): every passage within l..r that holds c has its
min-hash at c. Windows wide enough for a passage are joined by min-hash over all documents; contexts around
equal min-hashes that are equal are one class at once, and the others are compared shingle by shingle, each with all
that no chain of alike ones joins to it yet. Very many all meet a few of them first, and what those don't reach meets what shares
a telling mark with it. Overlapping passages of a document merge, and classes that share them are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import _powers, Words, minimizers, mix, range_hash, release, shingle_hashes, slices, text_bytes, text_or_empty, written
from glyphmill.llm.components import connected_components
from glyphmill.llm.nn_descent import _grouped
from glyphmill.llm.repeat_removal import among

WORDS = 50
SHINGLE = 5
FUNCTIONS = 3
SIMILARITY = 0.8
#: Windows of one min-hash that are looked at together; more go through piece by piece.
RUN = 1 << 20
#: Beyond the end of any text, in shingles.
FAR = 1 << 30
#: Contexts of a block; those of one min-hash are compared at once up to this number, and by pairs of blocks beyond.
PIECE = 400
#: Contexts of a min-hash with more than a block that all others meet first.
PIVOTS = 16
#: Slots that tell cheaply that two contexts share too few marks to be compared.
SLOTS = 1 << 9
#: Pairs of contexts up to which all marks are compared at once.
FEW_ROWS = 8
#: Places by which marks are looked up where pairs are more; a power of two.
PLACES = 1 << 10


def compact_windows(h: np.ndarray, first: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the compact windows of at least `wide` positions; first: where each document's hashes begin (and the end).

    Nodes of the Cartesian tree with so wide a window are minima of some window of that width, and so are their
    ancestors; so the tree is built over those minima alone, by jumping pointers to the nearest smaller neighbour.
    """
    key = h & ~np.uint64((1 << 28) - 1)
    c = minimizers(h, wide)
    if not len(c):
        return c, c, c
    doc = np.searchsorted(first, c, side="right") - 1
    v = key[c]

    def nearest(step: int) -> np.ndarray:
        """Place, among the minima, of the nearest one on that side that is smaller (or equal, on the left); -1: none in the document."""
        n = len(c)
        p = np.arange(n) + step
        p[(p < 0) | (p >= n)] = -1
        p[(p >= 0) & (doc[p] != doc)] = -1
        todo = np.flatnonzero(p >= 0)
        while len(todo):
            q = p[todo]
            far = v[q] > v[todo] if step < 0 else v[q] >= v[todo]
            todo = todo[far]
            p[todo] = p[p[todo]]
            todo = todo[p[todo] >= 0]
        return p

    left, right = nearest(-1), nearest(1)
    l = np.where(left >= 0, c[left] + 1, first[doc])  # noqa: E741
    r = np.where(right >= 0, c[right] - 1, first[doc + 1] - 1)
    keep = (r - l + 1 >= wide) & (c < first[doc + 1])
    return l[keep], c[keep], r[keep]


def windows_of(texts: pa.Array, functions: int, words: int, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each function: row, position of the minimum (in shingles), min-hash, hash of the context."""
    wide = words - shingle + 1
    h, first = shingle_hashes(Words(texts), shingle)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h)), out=prefix[1:])
    for f in range(functions):
        hf = mix(h + np.uint64(f << 40))
        _, c, _ = compact_windows(hf, first, wide)
        row = np.searchsorted(first, c, side="right") - 1
        lo, hi = np.maximum(first[row], c - wide + 1), np.minimum(first[row + 1], c + wide)
        yield row, c - first[row], hf[c], mix(range_hash(prefix, lo, hi) + (c - lo).astype(np.uint64))


WINDOW = "t long, pos int, v long, e long"
DEALT = WINDOW + ", deal long, known int"
CLASSED = WINDOW + ", lead int, again boolean"


def dealt(t: np.ndarray, pos: np.ndarray, v: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """DEALT of windows at different places, sorted by t and pos: of each class the first goes to its min-hash (deal), and stands for several where known is 1.
    The others (2) are known to have their like, and are dealt by text, so that a class that very many share doesn't meet in one task."""
    by = np.lexsort((e, v))
    same = (v[by][1:] == v[by][:-1]) & (e[by][1:] == e[by][:-1])
    known = np.zeros(len(v), np.int32)
    known[by[1:][same]] = 2
    known[by[:-1][same & ~np.concatenate([[False], same])[: len(same)]]] = 1
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(pos.astype(np.int32)), pa.array(v), pa.array(e), pa.array(np.where(known == 2, t, v)), pa.array(known)], names=["t", "pos", "v", "e", "deal", "known"])


def classed(batches: Iterator[pa.RecordBatch], piece: int, at_least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """CLASSED of rows (WINDOW, and last known, as in `dealt`) that arrive sorted by v, e, t, pos, the greatest known first: the windows whose min-hash v occurs at several places, each place once.

    lead tells the first row of a class (v, e): 1 alone with its min-hash, 2 of up to `piece` classes of it, 3 of more (or of a run of
    over RUN rows, which isn't held whole); 0 for other rows. again: the class has several places. Rows with a negative pos stand for
    whole texts and count where they occur twice.
    """
    held: list[pa.RecordBatch] = []
    n, skip, long_, enough = 0, 0, None, at_least

    def told(part: pa.Table, last: bool) -> pa.RecordBatch:
        """Flags of the rows beyond `skip`, which are whole runs but for a first one that began before, and for the last one unless `last`."""
        t, pos, v, e, known = (part.column(i).to_numpy() for i in range(5))
        new_v = np.concatenate([[True], v[1:] != v[:-1], [True]])
        new_e = np.concatenate([[True], (v[1:] != v[:-1]) | (e[1:] != e[:-1]), [True]])
        run = np.cumsum(new_v[:-1]) - 1
        classes = np.bincount(run, weights=new_e[:-1])
        if long_ is not None and len(v) and v[0] == long_:
            classes[0] = piece + 1
        if not last:
            classes[-1] = piece + 1
        lead = np.where(new_e[:-1], np.where(classes == 1, 1, np.where(classes <= piece, 2, 3))[run], 0).astype(np.int32)
        again = ~new_e[:-1] | ~new_e[1:] | (known > 0)
        keep = np.flatnonzero(again | ~new_v[:-1] | ~new_v[1:])
        keep = keep[(keep >= skip) & (keep < len(v) - (not last))]
        part = part.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in part.columns[:4]), pa.array(lead[keep]), pa.array(again[keep])], names=["t", "pos", "v", "e", "lead", "again"])

    def once(part: pa.Table) -> pa.Table:
        """Without rows that repeat the row before; of a whole text that occurs more often, two rows stay."""
        x = [part.column(i).to_numpy() for i in range(4)]
        same = np.concatenate([[False], np.logical_and.reduce([c[1:] == c[:-1] for c in x])]) if part.num_rows else np.zeros(0, bool)
        more = np.concatenate([[False, False], same[2:] & same[1:-1]])[: len(same)]
        return part.filter(pa.array(np.where(x[1] < 0, ~more, ~same))) if same.any() else part

    for b in batches:
        other = b.column(4).to_numpy() == 2
        if other.any():
            yield pa.RecordBatch.from_arrays([*b.filter(pa.array(other)).columns[:4], pa.array(np.zeros(int(other.sum()), np.int32)), pa.array(np.ones(int(other.sum()), bool))], names=["t", "pos", "v", "e", "lead", "again"])
            b = b.filter(pa.array(~other))
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        part = once(pa.Table.from_batches(held).combine_chunks()).combine_chunks()
        v = part.column(2).to_numpy()
        cut = int(np.searchsorted(v, v[-1]))
        if cut > skip:
            yield told(part.slice(0, cut).combine_chunks(), True)
            part, skip, long_ = part.slice(cut).combine_chunks(), 0, None
        if part.num_rows > RUN:  # one min-hash: all but its last row can be told
            yield told(part, False)
            long_, skip = v[-1], 1
            part = part.slice(part.num_rows - 2).combine_chunks()
        held, n = part.to_batches(), part.num_rows
        enough = max(at_least, 2 * n)
    if n:
        yield told(once(pa.Table.from_batches(held).combine_chunks()).combine_chunks(), True)


def contexts_of(h: np.ndarray, first: np.ndarray, row: np.ndarray, pos: np.ndarray, wide: int, kind: type = np.uint16) -> np.ndarray:
    """16-bit or 32-bit marks of the 2 * wide - 1 shingles around each position. Places outside the text get 0, which is never a shingle's."""
    marks = np.concatenate([(h % np.uint64(np.iinfo(kind).max - 1)).astype(kind) + kind(1), np.zeros(1, kind)])
    at = first[row][:, None] + pos[:, None] + np.arange(-wide + 1, wide)
    ok = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    return np.where(ok, marks[np.where(ok, at, 0)], kind(0))


def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which marks of x the same row of y holds. A few rows are compared all at once; in many, each mark of x is looked up by its
    lower bits, and compared with all of y where those lead to another mark."""
    if len(x) <= FEW_ROWS:
        return (x[:, :, None] == y[:, None, :]).any(axis=2) & (x > 0)
    low, row = x.dtype.type(PLACES - 1), np.arange(len(x))[:, None] * PLACES
    held = np.zeros(len(x) * PLACES, y.dtype)
    held[row + (y & low)] = y
    place = x & low
    there = held[row + place]
    hit = (there == x) & (x > 0)
    i, at = np.nonzero(~hit & (x > 0) & ((there > 0) | (place == 0)))  # no mark (0) of y may stand in the first place
    for k in range(0, len(i), 20_000):
        z = slice(k, k + 20_000)
        hit[i[z], at[z]] = (y[i[z]] == x[i[z], at[z]][:, None]).any(axis=1)
    return hit


def alike(a: np.ndarray, b: np.ndarray, wide: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of contexts: whether some passages of `wide` shingles are that similar, and in either the first and the last
    place (n x 2) where a passage begins that holds enough of the other."""
    need = similarity / (1 + similarity) * 2 * wide  # common shingles of two passages of that size
    n = len(a)
    good, at_a, at_b = np.zeros(n, bool), np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)

    def best(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = np.concatenate([np.zeros((len(hit), 1), np.int16), np.cumsum(hit, axis=1, dtype=np.int16)], axis=1)
        sums = total[:, wide:] - total[:, :-wide]
        at, enough = sums.argmax(axis=1), sums >= need
        return sums[np.arange(len(hit)), at], at, np.stack([enough.argmax(axis=1), sums.shape[1] - 1 - enough[:, ::-1].argmax(axis=1)], axis=1)

    for i in range(0, n, 1000):
        x, y = a[i : i + 1000], b[i : i + 1000]
        most, at, ends = best(within(x, y))
        k = np.flatnonzero(most >= need)
        if not len(k):
            continue
        part = x[k][np.arange(len(k))[:, None], at[k][:, None] + np.arange(wide)]
        common, at_y, _ = best(within(y[k], part))
        other = y[k][np.arange(len(k))[:, None], at_y[:, None] + np.arange(wide)]
        ok = np.minimum(common, within(part, other).sum(axis=1)) >= need
        rest = k[~ok]  # those best windows aren't the only ones
        ok[~ok] = most_in_common(x[rest], y[rest], need, wide) >= need
        good[i + k[ok]] = True
        at_a[i + k[ok]] = ends[k[ok]]
        at_b[i + k[ok]] = best(within(y[k[ok]], x[k[ok]]))[2]
    return good, at_a, at_b


def most_in_common(a: np.ndarray, b: np.ndarray, need: float, wide: int) -> np.ndarray:
    """For each pair of contexts the most places of a passage of `wide` shingles whose marks, at their first places in the other
    context, lie in one passage of the other; passages with fewer than `need` marks of the other context aren't tried."""
    out, width = np.zeros(len(a), np.int64), a.shape[1]
    first = np.full(a.shape, -1, np.int8 if wide <= 64 else np.int32)
    for j in range(width - 1, -1, -1):
        np.copyto(first, j, where=a == b[:, j : j + 1])
    first[a == 0] = -1
    hit = first >= 0
    sums = np.concatenate([np.zeros((len(a), 1), np.int16), np.cumsum(hit, axis=1, dtype=np.int16)], axis=1)
    pair, start = np.nonzero(sums[:, wide:] - sums[:, :-wide] >= need)
    for i in range(0, len(pair), 2000):
        p, at = pair[i : i + 2000], start[i : i + 2000, None] + np.arange(wide)
        n, k = np.nonzero(hit[p[:, None], at])
        where = first[p[n], at[n, k]].astype(np.int64)
        total = np.zeros((len(p), width + 1), np.int16)
        total[:, 1:] = np.bincount(n * width + where, minlength=len(p) * width).reshape(len(p), width)
        np.cumsum(total, axis=1, out=total)
        np.maximum.at(out, p, (total[:, wide:] - total[:, :-wide]).max(axis=1))
    return out


def spanning(key: np.ndarray, side: np.ndarray, marks: np.ndarray, wide: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of alike rows (places) that connect, in each run of equal keys, whatever chains of alike rows connect, and where the
    alike passages begin in both. Where a key has rows of both sides, they meet those of the other side only.

    Every row, once reached, is compared with all that aren't reached yet; so only pairs that are connected already are spared.
    """
    run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    runs = int(run[-1]) + 1
    own = 2 * run + side
    there = np.bincount(own, minlength=2 * runs) > 0
    facing = np.where(there[own ^ 1], own ^ 1, own)
    slots, extra = slots_of(marks)
    need = similarity / (1 + similarity) * 2 * wide
    open_, todo = np.arange(len(key)), np.zeros(0, np.int64)  # not reached; reached, and not compared with the open ones
    reached, found = np.zeros(len(key), bool), []
    while True:
        left = np.bincount(own[open_], minlength=2 * runs)
        todo = todo[left[facing[todo]] > 0]
        pivot = np.full(runs, -1)
        fresh = open_[left[facing[open_]] > (facing[open_] == own[open_])]
        pivot[run[fresh[::-1]]] = fresh[::-1]
        pivot[run[todo[::-1]]] = todo[::-1]  # a run goes on from what it has reached before it starts anew
        todo = todo[pivot[run[todo]] != todo]
        at = pivot[run[open_]]
        open_, at = open_[(at >= 0) & (at != open_)], at[(at >= 0) & (at != open_)]
        if not len(open_):
            break
        meet = own[open_] == facing[at]
        i, of = open_[meet], at[meet]
        shared = np.bitwise_count(slots[i] & slots[of]).sum(axis=1, dtype=np.int32)
        near = np.flatnonzero(shared + extra[i] >= need)  # never fewer than the marks that both hold
        i, of = i[near], of[near]
        good, a, b = alike(marks[i], marks[of], wide, similarity)
        if good.any():
            i = i[good]
            found.append((i, of[good], a[good], b[good]))
            reached[i] = True
            open_ = open_[~reached[open_]]
            todo = np.concatenate([todo, i])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    i, of, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, of, a, b


def slots_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of slots as bits of 64-bit words, and how many of its marks are beyond one for each slot."""
    n = len(marks)
    bits, extra = np.zeros((n, SLOTS // 64), np.uint64), np.zeros(n, np.int32)
    for i in range(0, n, 2000):
        m = marks[i : i + 2000]
        row, at = np.nonzero(m)
        filled = np.zeros((len(m), SLOTS), bool)
        filled[row, m[row, at] % SLOTS] = True
        bits[i : i + 2000] = np.packbits(filled, axis=1).view(np.uint64)
        extra[i : i + 2000] = np.bincount(row, minlength=len(m)) - filled.sum(axis=1)
    return bits, extra


def telling(marks: np.ndarray, common: np.ndarray, wide: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, mark): the marks by which two alike contexts always meet. Of each passage the smallest marks that aren't common, one
    more than a passage may hold beyond those of an alike one; and 0 for a passage that holds fewer."""
    most = int(wide - similarity / (1 + similarity) * 2 * wide) + 1
    rows, out = [], []
    top = np.iinfo(marks.dtype).max  # no mark
    for i in range(0, len(marks), 500):
        m = marks[i : i + 500]
        x = np.where((m == 0) | np.isin(m, common), top, m)
        total = np.concatenate([np.zeros((len(m), 1), np.int16), np.cumsum(m > 0, axis=1, dtype=np.int16)], axis=1)
        inside = total[:, wide:] - total[:, :-wide] == wide
        limit = np.partition(np.lib.stride_tricks.sliding_window_view(x, wide, axis=1), most - 1, axis=2)[:, :, most - 1]
        few = (inside & (limit == top)).any(axis=1)
        limit = np.where(inside, limit, 0)
        edge = np.zeros((len(m), wide - 1), limit.dtype)
        reach = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, limit, edge], axis=1), wide, axis=1).max(axis=2)
        row, at = np.nonzero((x <= reach) & (x < top))
        rows += [i + row, i + np.flatnonzero(few)]
        out += [m[row, at].astype(np.int64), np.zeros(int(few.sum()), np.int64)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, mark = np.concatenate(rows), np.concatenate(out)
    by = np.lexsort((mark, row))
    row, mark = row[by], mark[by]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    return row[fresh], mark[fresh]


LINKS = "v long, e long, t long, pos int, s int, z int, lead_e long, lead_t long, lead_pos int, lead_s int, lead_z int"


def links_in(t: pa.Table, wide: int, similarity: float) -> pa.RecordBatch:
    """LINKS among rows (key, e, t, pos, marks, v, side) of equal keys, or between the sides of a key; rows of one key stand together.
    Place and ends of a lead are told with one of its links, and are null with the others."""
    i, of, own, other = spanning(t.column(0).to_numpy(), t.column(6).to_numpy(), marks_in(t, wide), wide, similarity)
    e, text, pos, v = (t.column(k).combine_chunks() for k in (1, 2, 3, 5))
    differ = np.flatnonzero(e.to_numpy()[i] != e.to_numpy()[of])
    row, to, own, other = pa.array(i[differ]), pa.array(of[differ]), own[differ], other[differ]
    # passages of a context all hold its middle, so those of all its links are one stretch
    by = np.argsort(of[differ], kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(of[differ][by]) != 0])) if len(by) else by
    told = np.ones(len(by), bool)
    told[by[at]] = False
    ends = np.zeros((len(by), 2), np.int32)
    if len(by):
        ends[by[at]] = np.stack([np.minimum.reduceat(other[by, 0], at), np.maximum.reduceat(other[by, 1], at)], axis=1)
    once = pa.array(to.to_numpy(), mask=told)
    columns = [v.take(row), e.take(row), text.take(row), pos.take(row), *[pa.array(own[:, k].astype(np.int32)) for k in (0, 1)], e.take(to), text.take(once), pos.take(once), *[pa.array(ends[:, k], mask=told) for k in (0, 1)]]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LINKS.split(", ")])


def marks_in(t: pa.Table, wide: int) -> np.ndarray:
    raw, _ = text_bytes(t.column(4).combine_chunks())
    return raw.view(np.uint32 if len(raw) == t.num_rows * (2 * wide - 1) * 4 else np.uint16).reshape(t.num_rows, -1)


def by_key(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "e", "t", "pos", "marks", "v", "side").repartition(parts, "key").sortWithinPartitions("key", "t", "pos")


def links_among(rows: DataFrame, wide: int, similarity: float) -> DataFrame:
    """LINKS among rows of equal keys, or between the sides of a key."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            yield links_in(t, wide, similarity)
        release()

    return by_key(rows).mapInArrow(connect, LINKS)


def links_of_many(contexts: DataFrame, wide: int, similarity: float, piece: int) -> DataFrame:
    """The links among contexts (v, e, n, ..) of min-hashes that have very many.

    First all meet the same few of them, about PIVOTS drawn by hash, block by block. The largest set that these links connect needn't
    meet among itself. All others, whether a drawn one reaches them or not, meet all with which they share a mark that tells: marks that several drawn ones hold are common, and tell little. Many that share one are compared by pairs of blocks.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            links = links_in(t, wide, similarity)
            yield pa.RecordBatch.from_arrays([*links.columns, pa.nulls(links.num_rows, pa.list_(pa.int64()))], names=[*links.schema.names, "telling"])
            key, e, v, side, marks = (t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(5).to_numpy(), t.column(6).to_numpy(), marks_in(t, wide))
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                first = lo + np.flatnonzero(side[lo:hi] == 1)
                row = lo + np.flatnonzero((side[lo:hi] == 0) & ~np.isin(e[lo:hi], e[first]))
                seen, times = np.unique(np.concatenate([np.unique(marks[i]) for i in first]) if len(first) else marks[:0], return_counts=True)
                at, mark = telling(marks[row], seen[times > 1], wide, similarity)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(row)))]).astype(np.int32)
                empty = [pa.nulls(len(row), f.type) for f in links.schema]
                yield pa.RecordBatch.from_arrays([pa.array(v[row]), pa.array(e[row]), *empty[2:], pa.ListArray.from_arrays(offsets, pa.array(mark))], names=[*links.schema.names, "telling"])
        release()

    blocks = F.ceil(F.col("n") / piece).cast("int")
    drawn = F.pmod(F.xxhash64(F.lit(1), "e"), F.col("n")) < PIVOTS
    own = contexts.withColumn("key", F.xxhash64("v", F.pmod(F.xxhash64("e"), blocks).cast("int"))).withColumn("side", F.lit(0))
    every = contexts.filter(drawn).withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("key", F.xxhash64("v", "to")).withColumn("side", F.lit(1)).drop("to")
    met = written(by_key(own.unionByName(every)).mapInArrow(meet, LINKS + ", telling array<long>"), "found-first")
    near = met.filter("telling is null").drop("telling")
    node = lambda e: F.xxhash64("v", e)
    joined = connected_components(near.select(node("e").alias("a"), node("lead_e").alias("b")))
    members = near.select("v", "e").unionByName(near.select("v", F.col("lead_e").alias("e"))).distinct().withColumn("node", node("e")).join(joined, "node").select("v", "e", "label")
    largest = members.groupBy("v", "label").count().groupBy("v").agg(F.max_by("label", F.struct("count", "label")).alias("label"))
    reached = members.join(largest, ["v", "label"]).select("v", "e", F.lit(1).alias("reached"))
    offers = met.filter("telling is not null").select("v", "e", F.explode("telling").alias("mark")).join(reached, ["v", "e"], "left")
    sizes = offers.groupBy("v", "mark").agg(F.count_if(F.col("reached").isNull()).alias("n_open"), F.count("reached").alias("n_reached")).filter("n_open > 0 and n_open + n_reached > 1")
    left = offers.join(sizes, ["v", "mark"]).withColumn("o", F.ceil(F.col("n_open") / piece).cast("int")).withColumn("r", F.ceil(F.col("n_reached") / piece).cast("int"))
    left = left.withColumn("block", F.pmod(F.xxhash64("e"), F.when(F.col("reached").isNull(), F.col("o")).otherwise(F.col("r"))).cast("int"))
    left = written(left.select("v", "e", "mark", "reached", "o", "r", "block", "n_open"), "offers")
    to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))
    open_, taken = left.filter("reached is null"), left.filter("reached is not null")
    same = open_.filter("n_open > 1").withColumn("to", F.explode(to("o"))).select("v", "e", F.xxhash64("v", "mark", F.least("block", "to"), F.greatest("block", "to")).alias("key"), (F.col("block") > F.col("to")).cast("int").alias("side"))
    one = open_.withColumn("to", F.explode(to("r"))).select("v", "e", F.xxhash64("v", "mark", "block", "to", F.lit(1)).alias("key"), F.lit(0).alias("side"))
    other = taken.withColumn("to", F.explode(to("o"))).select("v", "e", F.xxhash64("v", "mark", "to", "block", F.lit(1)).alias("key"), F.lit(1).alias("side"))
    rows = same.unionByName(one).unionByName(other).join(contexts, ["v", "e"])
    return near.unionByName(written(links_among(rows, wide, similarity), "found-last", replaces=[contexts, left]))


def near_duplicate_passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, functions: int = FUNCTIONS, shingle: int = SHINGLE, piece: int = PIECE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start_word, end_word (beyond the last), class_id: the passages that have a near duplicate in another document (doc_id).

    A passage has at least `words` words (between white space, A-Z lower-cased); two are near duplicates if passages of
    that size in them have shingle sets of at least the similarity (shingles compare by 16-bit hashes once a 64-bit one
    has met). class_id is the smallest doc_id that a class holds. A pair of exactly the similarity is met with
    probability 1 - (1 - similarity) ** functions; equal passages are always met. Documents without such passages, short, empty and
    null texts have no row; copies of a document have the same rows. Rows without a doc_id take part and keep it null.
    """
    wide = words - shingle + 1
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("t", F.xxhash64("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # copies have the same windows, and a row for the whole text (two at most in a batch) besides
            t, first, copies = np.unique(whole.column(0).to_numpy(), return_index=True, return_counts=True)
            for b in slices(iter([pa.RecordBatch.from_arrays([pa.array(t), whole.column(1).take(pa.array(first)), pa.array(np.minimum(copies, 2))], names=["t", "text", "copies"])]), "text"):
                t = b.column(0).to_numpy()
                for f, (row, pos, v, e) in enumerate(windows_of(b.column(1), functions, words, shingle)):
                    if not f:
                        some = np.unique(row)
                        some = np.repeat(t[some], b.column(2).to_numpy()[some])
                        some = pa.array(some)
                        yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), -1, np.int32)), some, some, some, pa.array(np.zeros(len(some), np.int32))], names=["t", "pos", "v", "e", "deal", "known"])
                    yield dealt(t[row], pos, v.view(np.int64), e.view(np.int64))
        release()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from classed(batches, piece)
        release()

    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    all_ = d.select("t", "text").mapInArrow(windows, DEALT).repartition(parts, "deal").sortWithinPartitions("v", "e", "t", "pos", F.desc("known")).drop("deal")
    met_ = written(all_.mapInArrow(met, CLASSED), "windows")
    whole = F.col("pos") < 0
    equal = met_.filter("again").select("t", F.when(whole, F.col("t")).otherwise(F.xxhash64("v", "e")).alias("k"), F.when(whole, 0).otherwise(F.col("pos") - (wide - 1)).alias("s"), F.when(whole, FAR).otherwise(F.col("pos") + wide).alias("e"))

    # of each class one context, fetched where the text is
    few, hot = (met_.filter(F.col("lead") == k).select("t", "pos", "v", "e") for k in (2, 3))

    def fetched(these: DataFrame, kind: type) -> DataFrame:
        """v, e, n, t, pos, marks: the contexts of rows of `chosen`, asked of one of the copies of a text."""

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1 << 20):
                h, first = shingle_hashes(Words(b.column(1)), shingle)
                w = b.column(2)
                row = np.repeat(np.arange(b.num_rows), np.diff(w.offsets.to_numpy()))
                pos, v, e, count = (w.flatten().field(i) for i in range(4))
                t = b.column(0).to_numpy()
                p = pos.to_numpy().astype(np.int64)
                for a in range(0, len(row), 20_000):
                    z = slice(a, a + 20_000)
                    c = contexts_of(h, first, row[z], p[z], wide, kind)
                    yield pa.RecordBatch.from_arrays([v[z], e[z], count[z], pa.array(t[row[z]]), pos[z], pa.FixedSizeBinaryArray.from_buffers(pa.binary(c[:1].nbytes), len(c), [None, pa.py_buffer(c.tobytes())]).cast(pa.binary())], names=["v", "e", "n", "t", "pos", "marks"])
            release()

        wanted = written(these.groupBy("t").agg(F.collect_list(F.struct("pos", "v", "e", "n")).alias("wanted")), "wanted")
        one = among(d.select("doc_id", "t"), wanted).groupBy("t").agg(F.min("doc_id").alias("keep"))
        rows = among(d, wanted).join(wanted.join(one, "t"), "t").filter(F.col("doc_id").eqNullSafe(F.col("keep")))
        return rows.select("t", "text", "wanted").mapInArrow(contexts, "v long, e long, n long, t long, pos int, marks binary")

    rows = fetched(few.withColumn("n", F.lit(0).cast("long")), np.uint16).withColumn("key", F.col("v")).withColumn("side", F.lit(0))
    found = written(links_among(rows, wide, similarity), "found")
    if not hot.isEmpty():
        sizes = hot.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
        found = found.unionByName(links_of_many(written(fetched(hot.join(sizes, "v"), np.uint32), "hot-contexts"), wide, similarity, piece))
    at = lambda pos, s: F.col(pos) - (wide - 1) + F.col(s)
    k = F.xxhash64("v", "lead_e")
    near = found.select("t", k.alias("k"), at("pos", "s").alias("s"), (at("pos", "z") + wide).alias("e"))
    near = near.unionByName(found.filter("lead_t is not null").select(F.col("lead_t").alias("t"), k.alias("k"), at("lead_pos", "lead_s").alias("s"), (at("lead_pos", "lead_z") + wide).alias("e")))
    passages = written(equal.unionByName(near).groupBy("t").agg(F.collect_list(F.struct("k", "s", "e")).alias("p")), "passages")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(1)
            t = np.repeat(b.column(0).to_numpy(), np.diff(p.offsets.to_numpy()))
            row = np.repeat(np.arange(b.num_rows), np.diff(p.offsets.to_numpy()))
            kk, s, e = (p.flatten().field(i).to_numpy() for i in range(3))
            by = np.lexsort((s, row))
            t, row, kk, s, e = t[by], row[by], kk[by], np.maximum(s[by], 0).astype(np.int64), e[by].astype(np.int64)
            far = row.astype(np.int64) << 33
            reach = np.maximum.accumulate(e + far)  # rows stand apart, so the running end never crosses them
            new = np.concatenate([[True], (s + far)[1:] >= reach[:-1]])
            node = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            once = np.unique(np.stack([node, kk]), axis=1, return_index=True)[1]
            kk, end, node, t = kk[once], (reach - far)[np.append(at[1:] - 1, len(t) - 1)][node[once]], node[once], t[once]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(kk), pa.array(s[at][node]), pa.array(end)], names=["t", "k", "s", "e"])

    # members of a class of equal contexts share what one of them was found to share: its stretch holds both
    nodes = written(passages.mapInArrow(merge, "t long, k long, s long, e long").withColumn("node", F.xxhash64("t", "s")), "nodes", replaces=[met_, passages])
    low = nodes.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("k", "low")
    label = connected_components(nodes.join(low, "k").select(F.col("node").alias("a"), F.col("low").alias("b")))
    spans = nodes.select("t", "s", "e", "node").distinct().join(label, "node", "left").select("t", "s", "e", F.coalesce("label", "node").alias("label"))
    spans = written(spans, "spans")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(Words(b.column(2), hashed=False).counts())], names=["doc_id", "t", "n"])

    sized = among(d, spans).select("doc_id", "t", "text").mapInArrow(lengths, "doc_id long, t long, n long")
    rows = written(sized.join(spans, "t").select("doc_id", F.col("s").alias("start_word"), F.least(F.col("e") + (shingle - 1), F.col("n")).alias("end_word"), "label"), "rows")
    lowest = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("other"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    lowest = lowest.filter("class_id <> other or unnamed > 0").select("label", "class_id")
    return rows.join(lowest, "label").select("doc_id", "start_word", "end_word", "class_id")
