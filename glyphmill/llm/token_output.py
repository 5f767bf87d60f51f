"""Operator 8: documents to token ids in entropy-coded files, and back."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import rans
from glyphmill.llm.common import open_store, prefix_hash, range_hash, release, shared_path, slices, text_bytes, text_or_empty, written

END_ID = 0
#: Distinct pieces that a worker remembers, over all of its tasks; beyond, it forgets those that came up once.
PIECES = 400_000
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Token ids of whole texts through the tokenizers library.

    A byte-level pre-tokenizer always cuts between a character and white space after it, between a lone line
    feed and a character after it, and between a letter and a sign after it. So the library encodes each
    distinct piece between such cuts once, and the ids of a text are those of its pieces in order. What spells an
    added token is a piece of its own, never cut; a row with an added token that looks at what stands beside it stays whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        spell = lambda some: re.compile(b"|".join(re.escape(c.encode()) for c in sorted((t.content for t in some), key=len, reverse=True))) if some else None
        beside = [t for t in added if t.lstrip or t.rstrip or t.single_word]
        self.added = {t.content for t in added}
        self.any_added, self.beside = spell(list(added)), spell(beside)
        self.clear()

    def clear(self) -> None:
        self.names = np.zeros(0, np.uint64)  # the pieces' 64-bit hashes, sorted, and the place of each
        self.at = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int32)
        self.used = 0

    def forget(self) -> None:
        """Keep the pieces that came up in several slices since the last time; all go if these are too many as well."""
        stay = self.hits[: len(self.names)] > 1
        if 2 * int(stay.sum()) > PIECES:
            return self.clear()
        at = np.flatnonzero(stay)
        size = self.size[at]
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.first[at] - np.cumsum(size) + size, size)]
        names = np.empty_like(self.names)
        names[self.at] = self.names
        names = names[at]
        self.clear()
        self._keep(names, ids, size)

    def _learn(self, names: np.ndarray, pieces: list[str]) -> None:
        got: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            word = p[1:] if p[:1] == " " else p
            if word.isascii() and word.isalpha() and word not in self.added:  # one word for the model; its alphabet writes a space as U+0120
                got[i] = [t.id for t in self.tokenizer.model.tokenize("\u0120" + word if len(word) < len(p) else word)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            got[i] = e.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        self._keep(names, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size)

    def _keep(self, names: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        n = len(self.names)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(size) > len(self.size):
            self.size, self.first, self.hits = (np.concatenate([a, np.zeros_like(a)]) for a in (self.size, self.first, self.hits))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(size)] = size
        self.first[n : n + len(size)] = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.used += len(flat)
        by = np.argsort(names)
        where = np.searchsorted(self.names, names[by])
        self.names, self.at = np.insert(self.names, where, names[by]), np.insert(self.at, where, (n + by).astype(np.int32))

    def _places(self, names: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it isn't known."""
        if not len(self.names):
            return np.full(len(names), -1, np.int64)
        i = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[i] == names, self.at[i].astype(np.int64), -1)

    def _part(self, raw: np.ndarray, off: np.ndarray, is_row: np.ndarray) -> None:
        """Cut around added tokens, and not inside them. Of those that begin at one place the longest counts."""
        buf = raw.tobytes()
        at = 0
        while self.any_added and (m := self.any_added.search(buf, at)):
            row = int(np.searchsorted(off, m.start(), "right")) - 1
            end = int(off[row + 1])
            if self.beside and self.beside.search(buf, int(off[row]), end):
                is_row[off[row] + 1 : end] = False
                at = end
            elif m.end() > end and (m := self.any_added.search(buf, m.start(), end)) is None:
                at = end  # it goes on in the next row
            else:
                is_row[m.start() + 1 : m.end()] = False
                is_row[[m.start(), m.end()]] = True
                at = m.end()

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and the number of ids of each row."""
        raw, off = text_bytes(arr)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        # a byte that surely ends or begins a sign other than white space: ASCII, or a two-byte Latin letter
        begins = ((raw > 0x20) & (raw < 0x7F)) | ((raw >= 0xC3) & (raw <= 0xC9))
        ends = (raw > 0x20) & (raw < 0x7F)
        ends[1:] |= begins[:-1] & (raw[:-1] >= 0xC3)
        letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
        sign = (raw > 0x20) & (raw < 0x7F) & ~letter & ~((raw >= 0x30) & (raw <= 0x39))
        is_row = np.zeros(len(raw) + 1, bool)
        alone = raw[:-1] == 0x0A  # a line feed with no white space before it; a longer run would part otherwise at its end
        alone[1:] &= ends[:-2]
        alone[:1] = False
        is_row[1:-1] = (ends[:-1] & ((raw[1:] == 0x20) | (raw[1:] == 0x0A))) | (alone & begins[1:]) | (letter[:-1] & sign[1:])
        is_row[off] = True
        self._part(raw, off, is_row)
        at = np.flatnonzero(is_row)
        pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        spelled, spans = text_bytes(coded.dictionary)
        names = range_hash(prefix_hash(spelled), spans[:-1], spans[1:])
        if len(self.names) > PIECES:
            self.forget()
        place = self._places(names)
        if (fresh := np.flatnonzero(place < 0)).size:
            place[fresh] = len(self.names) + np.arange(len(fresh))
            self._learn(names[fresh], coded.dictionary.take(pa.array(fresh)).to_numpy(zero_copy_only=False).tolist())
        self.hits[place] += 1
        place = place[coded.indices.to_numpy()]
        size = self.size[place]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.first[place] - ends + size, size)]
        token_at = np.concatenate([[0], ends])[np.searchsorted(at, off)]
        return ids, np.diff(token_at)


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, size: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each document."""
    out = np.full(len(ids) + len(size), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(size + 1) - 1] = False
    out[keep] = ids
    return out, size + 1


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", tokens_per_file: int = 2 << 20, block: int = 1 << 16) -> DataFrame:
    """Write every document's ids, end id appended, in ascending doc_id order (null ids first).

    Returns the manifest: one row per file (part, seq, path, n_docs, n_tokens, bytes). Documents are ranged by
    doc_id, a task sorts its range and writes files of about tokens_per_file ids, so memory is bounded however
    large a range is. Names are unique to each attempt; only files of the manifest, which is itself committed
    by Spark, count. Null or empty text: the end id alone. Rows that share a doc_id follow each other by text.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    d = d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(out)
        store.create_dir(base, recursive=True)
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        n = seq = 0
        rows = []

        def flush() -> None:
            nonlocal held, n, seq
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            data = rans.encode_file(ids, [x for h in held for x in h[2]], sizes, block)
            path = f"{base}/tokens-{part:05d}-{seq:05d}-{uuid.uuid4().hex[:12]}.rans"
            with store.open_output_stream(path, compression=None) as f:
                f.write(data)
            rows.append((part, seq, path, len(sizes), len(ids), len(data)))
            held, n, seq = [], 0, seq + 1

        for b in slices(batches, "text", 1 << 20):
            ids, sizes = with_end(*enc.encode(b.column(1)))
            held.append((ids, sizes, b.column(0).to_pylist()))
            n += len(ids)
            if n >= tokens_per_file:
                flush()
        if held:
            flush()
        release()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens", "bytes"])

    return written(d.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long, bytes long"), "token-manifest")


def read_tokens(manifest: DataFrame, out: str, ids: bool = False) -> DataFrame:
    """Decode the files of a manifest: doc_id, start (ids before it over all files), n_tokens, ids_crc32,
    and the ids themselves if asked for. One row of the manifest stands for one file, so the running sum of
    files is small; files decode in parallel, each with bounded memory."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("path", "before")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(out)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    got, doc_ids, sizes = rans.decode_file(f.read())
                ends = np.cumsum(sizes)
                view = memoryview(np.ascontiguousarray(got, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(got.astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
        release()

    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def encode_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write documents as token files in the shared folder and read them back (see write_tokens, read_tokens)."""
    out = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, out, tokenizer_path, **options), out)
