"""Operator 12: SentencePiece ids of merge-type vocabularies, and texts back from ids.

The library's normaliser writes a text's white space as U+2581. No piece of such a vocabulary holds U+2581 after
another character, so no merge crosses the place before it: texts part there into words, and each distinct word is
encoded once. In a word, two characters that stand beside each other in no piece part it further. What is left takes
merges from a score-ordered agenda of adjacent pairs: always the best score, of equal ones the leftmost. Segments of
one length share the rounds of one matrix; very long ones have a heap. Each new word's ids are compared with the
library's in the same Arrow batch, and a difference is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import release, slices, text_bytes, text_or_empty

SPACE = "▁"
#: Distinct words that a worker remembers, over all of its tasks; beyond, it forgets those that came up once.
WORDS = 600_000
#: Segments of more symbols take merges from a heap.
MATRIX = 32
_NONE = np.int32(1 << 30)
_ENCODERS: dict[str, MergeEncoder] = {}


class Vocabulary:
    """Symbols (pieces, and characters that only pieces hold), and for adjacent pairs the merged symbol and its rank by score."""

    def __init__(self, processor):
        sp = self.processor = processor
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces aren't supported")
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a vocabulary without all 256 byte pieces isn't supported")
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces that go on beyond white space aren't supported")
        chars = sorted({c for p in plain for c in p})
        names = chars + [p for p in plain if len(p) > 1]
        self.symbol = {s: k for k, s in enumerate(names)}
        self.size = len(names)
        self.span = np.array([len(s) for s in names], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[ord(c) for c in chars]] = np.arange(len(chars))
        self.id = np.array([plain.get(s, -1) for s in names], np.int64)  # -1: a character that is no piece
        score = np.array([sp.get_score(plain[s]) if s in plain else 0.0 for s in names], np.float32)
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        pairs = sorted((self.symbol[p[:i]] * self.size + self.symbol[p[i:]], self.symbol[p]) for p in plain for i in range(1, len(p)) if p[:i] in self.symbol and p[i:] in self.symbol)
        self.pair = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([m for _, m in pairs] + [0], np.int32)
        self.rank = np.append(rank[self.merged[:-1]], _NONE)
        self.lookup = dict(zip(self.pair[:-1].tolist(), zip(self.rank[:-1].tolist(), self.merged[:-1].tolist(), strict=True), strict=True))
        beside = np.zeros((len(chars), len(chars)), bool)
        for p in plain:
            for a, b in zip(p, p[1:], strict=False):
                beside[self.symbol[a], self.symbol[b]] = True
        self.beside = beside

    def pairs_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair, key)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.merged[at], 0)

    def merge_rows(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge rows of symbols, all of one length: (row numbers, their symbols) as rows run out of merges."""
        rows = np.arange(len(s))
        rank, merged = self.pairs_of(s[:, :-1], s[:, 1:])
        while len(rows):
            width = s.shape[1]
            j = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            done = np.ones(len(rows), bool) if width == 1 else rank[np.arange(len(rows)), j] == _NONE
            if done.any():
                yield rows[done], s[done]
                go = ~done
                rows, s, rank, merged, j = rows[go], s[go], rank[go], merged[go], j[go]
                if not len(rows):
                    return
            k = np.arange(len(rows))
            s[k, j] = merged[k, j]
            col = np.arange(width - 1)
            s = np.take_along_axis(s, col + (col > j[:, None]), axis=1)
            col = np.arange(width - 2)
            keep = col + (col >= j[:, None])
            rank, merged = np.take_along_axis(rank, keep, axis=1), np.take_along_axis(merged, keep, axis=1)
            for at, some in ((j - 1, j > 0), (j, j < width - 2)):
                r, c = k[some], at[some]
                rank[r, c], merged[r, c] = self.pairs_of(s[r, c], s[r, c + 1])

    def merge_long(self, s: list[int]) -> list[int]:
        """Merge one long row: a heap of (rank, place) with links between the symbols that are left."""
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            k = after[i]
            if k < n and (got := self.lookup.get(s[i] * self.size + s[k])):
                heapq.heappush(heap, (got[0], i, s[i] * self.size + s[k]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, key = heapq.heappop(heap)
            k = after[i]
            if s[i] < 0 or k >= n or s[i] * self.size + s[k] != key:
                continue  # a pair that is there no longer
            s[i] = self.lookup[key][1]
            s[k] = -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in s if x >= 0]


class MergeEncoder:
    """Ids of whole texts, word by word, each distinct word once."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = Vocabulary(self.processor)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int32)
        self.used = 0

    def forget(self) -> None:
        """Keep the words that came up in several slices since the last time; all go if these are too many as well."""
        n = len(self.known)
        stay = self.hits[:n] > 1
        if 2 * int(stay.sum()) > WORDS:
            return self.clear()
        at = np.flatnonzero(stay)
        size = self.size[at]
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.first[at] - np.cumsum(size) + size, size)]
        words = [w for w, k in zip(self.known, stay.tolist(), strict=True) if k]  # in order of their places
        self.clear()
        self._keep(words, ids, size)

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after another, and the number of ids of each."""
        v = self.vocabulary
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym = v.of_char[code]
        cut = np.ones(len(sym) + 1, bool)
        cut[1:-1] = (sym[:-1] < 0) | (sym[1:] < 0) | ~v.beside[sym[:-1], sym[1:]]
        cut[np.cumsum(length)] = True
        start = np.flatnonzero(cut)
        start, size = start[:-1], np.diff(start)
        # what stands at each character: a symbol that begins there after all merges, or nothing
        out = sym.copy()
        gone = np.zeros(len(sym), bool)
        for width in np.unique(size).tolist():
            if width == 1:
                continue
            here = start[size == width]
            if width > MATRIX:
                done = [(np.array([i]), np.array([v.merge_long(sym[b : b + width].tolist())])) for i, b in enumerate(here.tolist())]
            else:
                done = v.merge_rows(sym[here[:, None] + np.arange(width)].astype(np.int32))
            gone[(here[:, None] + np.arange(width)).ravel()] = True
            for rows, got in done:
                place = here[rows][:, None] + np.cumsum(v.span[got], axis=1) - v.span[got]
                out[place] = got
                gone[place] = False
        out, code, owner = out[~gone], code[~gone], np.repeat(np.arange(len(words)), length)[~gone]
        ids = np.where(out >= 0, v.id[out], -1)
        n = np.where(ids >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))  # characters that are no piece: their bytes
        flat = np.repeat(ids, n)
        if (bare := np.flatnonzero(ids < 0)).size:
            to = np.cumsum(n) - n
            for c in np.unique(code[bare]).tolist():
                spelled = [v.bytes[b] for b in chr(c).encode()]
                flat[to[bare[code[bare] == c]][:, None] + np.arange(len(spelled))] = spelled
        return flat.astype(np.int32), np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, size = self.words_ids(words)
        # every word starts with U+2581, which the library puts before a text itself, unless the text is empty
        sp = self.processor
        theirs = sp.encode([w[1:] for w in words], num_threads=1)
        if SPACE in words:
            theirs[words.index(SPACE)] = sp.encode("a ")[len(sp.encode("a")) :]
        want = np.fromiter(chain.from_iterable(theirs), np.int32)
        if not np.array_equal(want, ids) or list(map(len, theirs)) != size.tolist():
            raise ValueError("the library encodes these words otherwise: the model isn't of a supported kind")
        self._keep(words, ids, size)

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(size) > len(self.size):
            self.size, self.first, self.hits = (np.concatenate([a, np.zeros_like(a)]) for a in (self.size, self.first, self.hits))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(size)] = size
        self.first[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, without an end id, and the number of ids of each."""
        raw, off = text_bytes(pa.array(self.processor.normalize(texts), pa.string()))
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        mark = np.zeros(len(raw) + 1, bool)
        mark[: len(raw) - 2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        begins = mark.copy()
        begins[3:] &= ~mark[:-3]
        begins[off] = True
        at = np.flatnonzero(begins)
        coded = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > WORDS:
            self.forget()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if (fresh := np.flatnonzero(place < 0)).size:
            place[fresh] = len(self.known) + np.arange(len(fresh))
            self._learn([words[i] for i in fresh.tolist()])
        self.hits[place] += 1
        place = place[coded.indices.to_numpy()]
        size = self.size[place]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.first[place] - ends + size, size)]
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(at, off)])


def encoder(path: str) -> MergeEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = MergeEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's ids, with the end id alone added, and the text that the ids decode to: doc_id, ids, decoded.

    Null and empty texts have the end id alone and decode to "". Every row is encoded by itself, so ties, repeated rows
    and null ids need no rule; an empty table gives no rows; other columns are ignored. No shuffle. A long text is held whole by
    its task; texts of many rows come in slices of two megabytes.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        end = enc.processor.eos_id()
        for b in slices(batches, "text"):
            ids, size = enc.encode(b.column(1).to_pylist())
            off = np.concatenate([[0], np.cumsum(size + 1)])
            flat = np.full(off[-1], end, np.int32)
            keep = np.ones(len(flat), bool)
            keep[off[1:] - 1] = False
            flat[keep] = ids
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(enc.processor.decode(lists.to_pylist(), num_threads=1), pa.string())], names=["doc_id", "ids", "decoded"])
        release()

    return d.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
