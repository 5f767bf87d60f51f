"""Operator 11: periodic runs of words in a document.

A run is a stretch of words with smallest period q, of at least max(6, 4 q) words, that no neighbouring word extends.
Its words recur q words on or before, so each lies in a k-gram that the document repeats, with k the least overlap
that a run has with its own shift. Words outside such k-grams are masked. Segments that survive are split in halves
again and again (Main and Lorentz): a run lies whole in one node and crosses its middle, and at least twice its period
of it stands on one side. So each node asks for squares that begin or end at its middle, and extends the shortest
of a kind to a run. Equality of stretches is told by names of all stretches of 1, 2, 4, ... words, which are exact.
All nodes of a depth, over all segments of a batch, are settled together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Words, byte_ranges, mix, release, slices, text_or_empty

LEAST, POWER = 6, 4


def least_overlap(least: int = LEAST, power: int = POWER) -> int:
    """The fewest words that a run shares with itself shifted by its period."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def repeated_grams(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram of their row that the row holds twice. Words are 64-bit hashes: equal grams are always found."""
    n = len(words)
    keep = np.zeros(n, bool)
    if n < k + 1:
        return keep
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + len(gram)]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[: len(gram)] == row[k - 1 :])
    gram = mix(gram[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(n + 1, np.int64)
    mark[at[twice]] += 1
    mark[at[twice] + k] -= 1
    return np.cumsum(mark[:-1]) > 0


class Stretches:
    """Names of all stretches of 2^j words: equal names, equal words. Stretches never reach over the array's end."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names = [codes.astype(np.int64)]
        while (1 << len(self.names)) <= longest:
            a, half = self.names[-1], 1 << (len(self.names) - 1)
            if len(a) <= half:
                break
            pair = a[:-half] * (int(a.max()) + 1) + a[half:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of some sizes (1 or more) at a and b are equal: by two names that overlap."""
        out = np.zeros(len(a), bool)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for j in np.unique(level).tolist():
            i = np.flatnonzero(level == j)
            name, back = self.names[j], size[i] - (1 << j)
            out[i] = (name[a[i]] == name[b[i]]) & (name[a[i] + back] == name[b[i] + back])
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words, at most so many, are equal from a and from b on."""
        n = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            i = np.flatnonzero(n + (1 << j) <= most)
            i = i[self.names[j][a[i] + n[i]] == self.names[j][b[i] + n[i]]]
            n[i] += 1 << j
        return n

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words, at most so many, are equal before a and before b."""
        n = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            i = np.flatnonzero(n + (1 << j) <= most)
            i = i[self.names[j][a[i] - n[i] - (1 << j)] == self.names[j][b[i] - n[i] - (1 << j)]]
            n[i] += 1 << j
        return n


def squares(s: Stretches, low: np.ndarray, mid: np.ndarray, high: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of the squares that begin (or end) at the nodes' middles, in order of node and period."""
    most = (high - mid if forward else mid - low) // 2
    node = np.repeat(np.arange(len(mid)), most)
    p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
    m = mid[node]
    hit = s.equal(m, m + p, p) if forward else s.equal(m - p, m - 2 * p, p)
    return node[hit], p[hit]


def segment_runs(codes: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, length, period) inside segments [start, end) of an array of codes, in order of start and period."""
    longest = int((end - start).max(initial=0))
    s = Stretches(codes, longest)
    found: list[np.ndarray] = []
    low, high = start, end
    first, last = start, end  # the segment of each node
    while True:
        use = high - low >= least
        low, high, first, last = low[use], high[use], first[use], last[use]
        if not len(low):
            break
        mid = (low + high) // 2
        for forward in (True, False):
            node, p = squares(s, low, mid, high, forward)
            while len(node):
                lead = np.concatenate([[True], node[1:] != node[:-1]])  # the shortest square that a node has left
                i, q = node[lead], p[lead]
                m = mid[i]
                a, b = (m, m + q) if forward else (m - q, m)
                back, on = s.behind(a, b, a - first[i]), s.ahead(a, b, last[i] - b)
                begin, stop = a - back, b + on
                found.append(np.stack([begin, stop - begin, q]))
                # longer squares inside this run have multiples of its period
                reach = np.zeros(len(mid), np.int64)
                reach[i] = stop - m if forward else m - begin
                rest = 2 * p > reach[node]
                node, p = node[rest], p[rest]
        low, high, first, last = np.concatenate([low, mid]), np.concatenate([mid, high]), np.tile(first, 2), np.tile(last, 2)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, n, q = np.concatenate(found, axis=1)
    long = n >= np.maximum(least, power * q)
    a, n, q = a[long], n[long], q[long]
    order = np.lexsort((q, n, a))
    a, n, q = a[order], n[order], q[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])  # of one stretch the smallest period counts
    a, n, q = a[new], n[new], q[new]
    order = np.lexsort((q, a))
    return a[order], n[order], q[order]


def runs_of(words: Words, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a batch's rows: (start, length, period), by start, as numbers of words of the batch."""
    keep = repeated_grams(words.hash, words.first, least_overlap(least, power))
    at = np.flatnonzero(keep)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    row = np.searchsorted(words.first, at, "right") - 1
    part = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)]))
    codes = byte_ranges(words.raw, words.starts[at], words.ends[at]).dictionary_encode().indices.to_numpy().astype(np.int64)
    a, n, q = segment_runs(codes, part, np.append(part[1:], len(at)), least, power)
    return at[a], n, q


def collapse_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, power: int = POWER) -> DataFrame:
    """Runs of each document's words, and its text with every run cut to its first period.

    Returns doc_id, n_words, runs (structs of start, length, period; by start, then period) and collapsed (the kept words, joined by a
    space). Words are [^\\x20\\x09-\\x0D]+ and equal if their bytes are. Null and empty texts have no words, no runs and "". Runs may
    overlap; a word goes if any run holds it after that run's first period. Each row is judged by itself, so repeated
    rows, ties and null ids need no rule; an empty table gives no rows; other columns are ignored. No shuffle; a long text is held whole by its
    task, and its memory follows the words that repeat.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = Words(b.column(1), lower=False)
            a, n, q = runs_of(words, least, power)
            row = np.searchsorted(words.first, a, "right") - 1
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, a + q, 1)
            np.add.at(gone, a + n, -1)
            stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            per_row = np.searchsorted(stay, words.first)
            joined = byte_ranges(words.raw, words.starts[stay], words.ends[stay])
            lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), joined)
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (a - words.first[row], n, q)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), runs)
            text_ = pc.binary_join(lists, b" ").cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts(), pa.int64()), runs, text_], names=["doc_id", "n_words", "runs", "collapsed"])
        release()

    return d.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the texts of a tenth of the documents go on periodically from some word, by a rule of the doc_id.

    With h the crc32 of the decimal doc_id and g = h div 10: where h mod 10 is 0 and there are n > 0 words, each word i >= a becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8); words are then joined by a space. Null ids: no change.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = d.where("h % 10 = 0").select("doc_id", "text", F.expr("h div 10").alias("g"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    placed = words.select("doc_id", "text", "g", "w", F.expr("int(g % greatest(size(w), 1))").alias("a"))
    placed = placed.select("doc_id", "text", "w", "a", F.expr("int(1 + (size(w) - a) div (3 + g % 8))").alias("p"))
    planted = placed.select("doc_id", F.expr("if(size(w) > 0, array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' '), text)").alias("text"))
    return d.where("h is null or h % 10 != 0").select("doc_id", "text").unionAll(planted)
