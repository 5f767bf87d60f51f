"""Operator 9: a quality classifier of histogram gradient-boosted trees over document statistics.

The statistics come from one pass over a text's bytes in numpy. Trees are grown level by level from
histograms of binned statistics and then flattened into arrays, so a batch walks all trees at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import SPACE_WORDS, Words, id_fold, release, slices, text_bytes, text_or_empty

#: Labelled rows that the trees learn from at most: those first by a hash of their id.
MAX_TRAINING_ROWS = 15_000

_SIGNS = b"!?.,;:'\"-|#*$%&@/\\()[]{}<>=+_~^`"
_CLASSES = ("upper", "lower", "digit", "space", "newline", "wide", "control")


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    t[65:91], t[97:123], t[48:58], t[[9, 11, 12, 13, 32]], t[10], t[128:] = 0, 1, 2, 3, 4, 5
    for k, c in enumerate(_SIGNS):
        t[c] = 7 + k
    return t


_TABLE = _class_table()
_N = 7 + len(_SIGNS)

NAMES = (
    [f"share_{c}" for c in _CLASSES] + [f"share_{chr(c)}" for c in _SIGNS] + ["log_bytes", "log_words", "bytes_per_word", "upper_words", "sign_words", "word_variety", "long_words", "log_lines", "words_per_line", "line_variety", "word_length_spread", "signs_per_word", "top_sign_word_end", "one_byte_words"]
)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; null or empty texts get zeros."""
    raw, off = text_bytes(texts)
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    if not len(raw):
        return out
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    cls = _TABLE[raw]
    counts = np.bincount(row * _N + cls, minlength=n * _N).reshape(n, _N)
    out[:, :_N] = counts / np.maximum(size, 1)[:, None]
    words = Words(texts, SPACE_WORDS)
    nw = words.counts()
    wrow = np.repeat(np.arange(n), nw)
    length = (words.ends - words.starts).astype(np.float64)
    per = np.maximum(nw, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(wrow[mask], minlength=n) / per

    upper = np.concatenate([[0], np.cumsum(cls == 0)])
    signs = np.concatenate([[0], np.cumsum(cls >= 7)])
    in_word = lambda c: c[words.ends] - c[words.starts]
    word_signs = in_word(signs)
    last = np.zeros(0, np.uint8) if not len(words) else cls[words.ends - 1]
    ends = np.bincount(wrow[last >= 7] * _N + last[last >= 7], minlength=n * _N).reshape(n, _N)
    order = np.lexsort((words.hash, wrow)) if len(words) else np.zeros(0, np.int64)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])
    lines = Words(texts, _LINES)
    nl = lines.counts()
    lrow = np.repeat(np.arange(n), nl)
    both = np.unique(np.stack([lrow.astype(np.uint64), lines.hash]), axis=1)[0].astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    mean = np.bincount(wrow, length, n) / per
    extra = [
        np.log1p(size), np.log1p(nw), size / per, share(in_word(upper) >= 2), share(word_signs >= 2), np.bincount(wrow[order][fresh], minlength=n) / per, share(length >= 16), np.log1p(nl), nw / np.maximum(nl, 1),
        np.bincount(both, minlength=n) / np.maximum(nl, 1), np.sqrt(np.maximum(np.bincount(wrow, length**2, n) / per - mean**2, 0)), np.bincount(wrow, word_signs, n) / per, ends.max(axis=1) / per, share(length == 1),
    ]
    out[:, _N:] = np.stack(extra, axis=1)
    return out


_LINES = np.ones(256, bool)
_LINES[10] = False


@dataclass
class Forest:
    """Trees laid out in arrays: an inner node tests statistic[feature] <= limit and goes to left or left + 1; a leaf points to itself."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, walking all trees at once."""
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f < 0, at, self.left[at] + (part[rows, np.maximum(f, 0)] > self.limit[at]))
            out[a : a + 4096] = 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))
        return out

    def dump(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @staticmethod
    def load(text: str) -> Forest:
        d = json.loads(text)
        kinds = {"feature": np.int32, "limit": np.float32, "left": np.int32, "value": np.float64, "roots": np.int32}
        return Forest(**{k: np.array(v, kinds[k]) if k in kinds else v for k, v in d.items()})


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """Histogram gradient boosting with logistic loss. Rows in any order give the same trees up to rounding."""
    n, m = x.shape
    if not n:
        return Forest(0.0, np.array([-1], np.int32), np.zeros(1, np.float32), np.zeros(1, np.int32), np.zeros(1), np.zeros(1, np.int32), 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower").astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1) + np.arange(m) * bins
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, base)
    feature, limit, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (limit, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes = [node()]
        roots.append(nodes[0])
        slot = np.zeros(n, np.int64)  # which of this level's nodes a row is in; -1: in a leaf
        at = np.full(n, nodes[0])
        for _ in range(depth):
            live = np.flatnonzero(slot >= 0)
            k = len(nodes)
            key = (slot[live, None] * (m * bins) + binned[live]).ravel()
            shape = (k, m, bins)
            hg, hh, hc = (np.bincount(key, None if w is None else np.repeat(w[live], m), k * m * bins).reshape(shape).cumsum(axis=2) for w in (g, h, None))
            tg, th, tc = hg[:, :, -1:], hh[:, :, -1:], hc[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hc < least) | (tc - hc < least)] = -1
            best = gain.reshape(k, -1).argmax(axis=1)
            following = []
            to = np.full((k, 2), -1)
            for i, at_node in enumerate(nodes):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] <= 1e-6:
                    continue
                feature[at_node], limit[at_node] = j, float(edges[j][b])
                left[at_node] = node()
                node()
                to[i] = len(following), len(following) + 1
                following += [left[at_node], left[at_node] + 1]
            if not following:
                break
            s = slot[live]
            f = np.array([feature[a] for a in nodes])[s]
            split = f >= 0
            cut = best[s] % bins
            right = binned[live, np.maximum(f, 0)] - np.maximum(f, 0) * bins > cut
            new = np.where(split, to[s, right.astype(int)], -1)
            at[live[split]] = np.array(following)[new[split]]
            slot[live] = new
            nodes = following
        gs, hs = np.bincount(at, g, len(feature)), np.bincount(at, h, len(feature))
        for a in np.unique(at).tolist():
            value[a] = float(-rate * gs[a] / (hs[a] + l2))
        margin += np.array(value)[at]
    # leaves point to themselves through feature -1
    return Forest(base, np.array(feature, np.int32), np.array(limit, np.float32), np.array(left, np.int32), np.array(value), np.array(roots, np.int32), depth)


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and stats (array<float>), a narrow pass."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            x = statistics(b.column(1))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)], names=["doc_id", "stats"])
        release()

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return d.mapInArrow(measure, "doc_id long, stats array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_rows: int = MAX_TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id") -> str:
    """The trees, as JSON, learned in one task from at most max_rows labelled documents outside fold 0.

    Rows without an id or a label take no part; of several labels of one id the smallest holds, so order and
    repetition don't matter.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (id_fold(doc_id, folds) != 0)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    # the labelled ids first by hash, a bounded table, choose whose texts are measured
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(chosen.select("doc_id"), "doc_id", "left_semi")
    rows = with_statistics(d).join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(max_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.stack(b.column(1).to_numpy(zero_copy_only=False)), b.column(2).to_numpy()) for b in batches if b.num_rows]
        x = np.concatenate([g[0] for g in got]) if got else np.zeros((0, len(NAMES)), np.float32)
        y = np.concatenate([g[1] for g in got]) if got else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([grow(x, y.astype(float)).dump()])], names=["forest"])

    found = rows.select("doc_id", "stats", "y").coalesce(1).mapInArrow(fit, "forest string").collect()
    return found[0][0] if found else grow(np.zeros((0, len(NAMES))), np.zeros(0)).dump()


def score(docs: DataFrame, forest: str, folds: int = 5, limit: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted.

    Every text is measured whole; null and empty ones too. Rows are scored one by one, so repeated rows
    repeat and no row is lost.
    """
    trees = docs.sparkSession.sparkContext.broadcast(forest)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest.load(trees.value)
        for b in slices(batches, "text", 2 << 20):
            s = f.score(statistics(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release()

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), (id_fold(doc_id, folds) == 0).alias("held_out"))
    return d.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, forest: str, limit: float = 0.3, text: str = "text") -> DataFrame:
    """The documents, with their columns, that score at least limit."""
    trees = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest.load(trees.value)
        for b in slices(batches, text, 2 << 20):
            yield b.filter(pa.array(f.score(statistics(b.column(at))) >= limit))
        release()

    return docs.mapInArrow(choose, docs.schema)
