"""Operator 6: benchmark decontamination with a generalised suffix automaton.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The automaton holds the word
sequences of all test items; a document's words stream through it and each position gets the longest
match that ends there. A match of `window` words, or of a whole item that has fewer, marks its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import ALNUM_WORDS, Words, release, slices, text_or_empty

WINDOW = 10
#: Words of items that one automaton, and so one broadcast, holds at most (and one item more).
MAX_ITEM_WORDS = 200_000


class SuffixAutomaton:
    """Of word-id sequences, built one after another from the root, so no match runs across items."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.items: dict[int, set[int]] = defaultdict(set)  # by state: the items that hold its strings
        self.short: dict[int, list[int]] = defaultdict(list)  # by state: whole items that end any match in it

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def build(self, sequences: list[list[int]]) -> SuffixAutomaton:
        for seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        whole: dict[int, list[int]] = defaultdict(list)
        for k, seq in enumerate(sequences):
            state = 0
            for c in seq:
                state = up = self.next[state][c]
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if 0 < len(seq) < self.window:
                whole[state].append(k)
        if whole:
            for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                if found := whole.get(s, []) + self.short.get(self.link[s], []):
                    self.short[s] = found
        return self

    def stream(self, ids: list[int], lengths: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end position, matched words, items) of each match that counts; lengths: the items' words."""
        state = size = 0
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if c not in self.next[state]:
                continue
            state = self.next[state][c]
            size += 1
            if size >= self.window:
                up = state
                while self.len[self.link[up]] >= self.window:
                    up = self.link[up]
                yield i, self.window, self.items[up]
            for k in self.short.get(state, ()):
                if lengths[k] <= size:
                    yield i, lengths[k], {k}


class Matcher:
    """An automaton with the vectorised filter before it: only runs of words whose neighbours also
    stand side by side in some item can hold a match, and only those runs are streamed."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int = WINDOW):
        words = Words(pa.array(texts, pa.string()), ALNUM_WORDS)
        self.names = item_ids
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        first = words.first
        self.lengths = np.diff(first).tolist()
        self.least = min((min(n, window) for n in self.lengths if n), default=window)
        sequences = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        inside = np.ones(max(len(ids) - 1, 0), bool)
        inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(ids))] - 1] = False
        self.pairs = np.unique((ids[:-1] * len(self.vocabulary) + ids[1:])[inside]) if len(ids) > 1 else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.automaton = SuffixAutomaton(window).build(sequences)

    def find(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and by row the items with occurring windows."""
        n = len(words)
        hit = np.zeros(n, bool)
        found: dict[int, set[int]] = defaultdict(set)
        if not n or not len(self.vocabulary):
            return hit, found
        ids = np.full(n, -1, np.int64)
        may = np.flatnonzero(self.bits[(words.hash & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, words.hash[may]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == words.hash[may]
        ids[may[same]] = place[same]
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i stand side by side in some item
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        if len(self.pairs):
            key = ids[both - 1] * len(self.vocabulary) + ids[both]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[at] == key]] = True
        joined[words.first] = False
        if self.least > 1:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
            start, end = edge[::2] - 1, edge[1::2]
        else:
            start = np.flatnonzero((ids >= 0) & ~joined[:-1])
            end = np.flatnonzero((ids >= 0) & ~joined[1:]) + 1
        long = end - start >= self.least
        rows = np.searchsorted(words.first, start[long], side="right") - 1
        for a, b, row in zip(start[long].tolist(), end[long].tolist(), rows.tolist(), strict=True):
            for i, size, items in self.automaton.stream(ids[a:b].tolist(), self.lengths):
                hit[a + i - size + 1 : a + i + 1] = True
                found[row] |= items
        return hit, found


def matchers(bench: DataFrame, window: int, max_item_words: int, text: str = "text", item_id: str = "item_id") -> list[Matcher]:
    """Matchers over all items, each of a bounded number of words (a test set larger than the bound gets several)."""
    words = F.regexp_count(text_or_empty(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"), words.alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // max_item_words))
    return [Matcher([r[0] for r in rows], [r[1] for r in rows], window) for k in range(parts) for rows in [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).select("item", "text").collect()]]


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (distinct ids as strings, sorted), items_sha256
    (of the ids, comma-joined), contaminated, spans (byte ranges of maximal runs of hit words).

    Null and empty texts have no words and no hits; without items nothing is hit. Rows are judged one by one, so
    repeated rows repeat the result. A null item id is written "null"; items of one id count once.
    """
    auto = docs.sparkSession.sparkContext.broadcast(matchers(bench, window, max_item_words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words, hit, found = judged(b.column(1), auto.value)
            first = words.first
            total = np.concatenate([[0], np.cumsum(hit)])
            items = [sorted(found[i]) if i in found else [] for i in range(b.num_rows)]
            sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            n_hit = total[first[1:]] - total[first[:-1]]
            spans = [[{"start": s, "end": e} for s, e in byte_spans(words, hit, i)] if n_hit[i] else [] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(sums, pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"],
            )
        release()

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return d.mapInArrow(scan, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>")


def judged(texts: pa.Array, all_matchers: list[Matcher]) -> tuple[Words, np.ndarray, dict[int, set[str]]]:
    """Words, hit words and the ids of occurring items by row."""
    words = Words(texts, ALNUM_WORDS)
    hit = np.zeros(len(words), bool)
    names: dict[int, set[str]] = defaultdict(set)
    for m in all_matchers:
        h, found = m.find(words)
        hit |= h
        for row, items in found.items():
            names[row] |= {m.names[k] for k in items}
    return words, hit, names


def byte_spans(words: Words, hit: np.ndarray, row: int) -> list[tuple[int, int]]:
    """Byte ranges, within the row's text, of its maximal runs of hit words."""
    a, b = words.first[row], words.first[row + 1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
    base = words.off[row]
    return [(int(words.starts[a + s] - base), int(words.ends[a + e - 1] - base)) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def remove_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_item_words: int = MAX_ITEM_WORDS, text: str = "text") -> DataFrame:
    """The documents, with their columns, without contaminated words: hit runs go from the text, and a
    document of which more than max_coverage of the words are hit goes as a whole. Others stay as they are.
    A column n_chars, if there is one, follows the text.
    """
    auto = docs.sparkSession.sparkContext.broadcast(matchers(bench, window, max_item_words))
    at = docs.columns.index(text)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    chars_type = docs.schema["n_chars"].dataType if chars is not None else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            words, hit, found = judged(b.column(at), auto.value)
            if not found:
                yield b
                continue
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            sizes = b.column(chars).to_pylist() if chars is not None else []
            for i in found:
                n = words.first[i + 1] - words.first[i]
                spans = byte_spans(words, hit, i)
                keep[i] = hit[words.first[i] : words.first[i + 1]].sum() <= max_coverage * n
                raw, out, last = texts[i].encode(), [], 0
                for s, e in spans:
                    out.append(raw[last:s])
                    last = e
                texts[i] = b"".join([*out, raw[last:]]).decode()
                if sizes:
                    sizes[i] = len(texts[i])
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array(sizes, b.column(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep))
        release()

    if chars_type is not None and chars_type.typeName() not in ("long", "integer"):
        raise TypeError("n_chars must be a whole number")
    return docs.mapInArrow(clean, docs.schema)
