"""Shared helpers of the training-data operators: storage that every executor
sees, bounded batches, and numpy kernels over the UTF-8 bytes of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- storage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, as a URI without
    trailing slash. Where it is unset, a temporary folder is set on one machine (tests), and a cluster is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_glyphmill_shared", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="glyphmill-shared-")
        sc._glyphmill_shared = root
        sc.setCheckpointDir(root)
    return (root if "://" in root else f"file://{root}").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None, replaces: Iterable[DataFrame] = ()) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Spark drops the write's shuffle files as it ends; else they stay on disk until the driver collects garbage. replaces:
    tables written before that nothing reads any longer; they are deleted once this one stands.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for old in replaces:
        store, at = open_store(old.written_to)
        store.delete_dir(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path behind a URI (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_fold(name: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(n))


# ---------------------------------------------------------------- batches


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about max_bytes of one text column (a longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array laid end to end, and each row's offsets (n + 1); null counts as empty."""
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Hand freed memory back to the system: called as a task's kernel ends, since idle workers stay alive."""
    import ctypes

    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1, -(-n // (1 << 18))) << 18
        p = np.full(size, _INV if inverse else _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2^64 of the bytes: n + 1 values."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end); it depends on the bytes and their number alone."""
    h = (prefix[end] - prefix[start]) * _powers(len(prefix), inverse=True)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of words for the three word rules in use.
SPACE_WORDS = np.ones(256, bool)  # [^\x20\x09-\x0D]+
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)  # after lower-casing: digits, a-z, every byte beyond ASCII
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


class Words:
    """The words of a text column: hash, byte range, and per row the range of its words.

    starts/ends index the bytes in ``raw`` (lower-cased unless told otherwise); row i has words first[i]:first[i + 1].
    """

    def __init__(self, arr: pa.Array, kind: np.ndarray = SPACE_WORDS, hashed: bool = True, lower: bool = True):
        raw, self.off = text_bytes(arr)
        self.raw = lower_ascii(raw) if lower else raw
        n = len(self.raw)
        is_word = np.zeros(n + 1, bool)
        is_word[:n] = kind[self.raw]
        before = np.zeros(n + 1, bool)
        before[1:] = is_word[:-1]
        start = is_word & ~before
        end = before & ~is_word
        cut = self.off[1:-1][(self.off[1:-1] > 0) & (self.off[1:-1] < n)]  # a word never runs into the next row
        both = cut[is_word[cut] & before[cut]]
        start[both] = True
        end[both] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, self.off)
        if hashed:
            self.hash = range_hash(prefix_hash(self.raw), self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at the given positions as an Arrow string array."""
        s, e = self.starts[which], self.ends[which]
        return byte_ranges(self.raw, s, e).cast(pa.string())


def byte_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of a buffer gathered into a binary array."""
    size = (end - start).astype(np.int64)
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    take = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(raw[take].tobytes())])


def shingle_hashes(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words in each row, in order, and the n + 1 row offsets.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    n = words.counts()
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(words.first[:-1] - off[:-1], size)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    run = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        run = run * step + words.hash[k : k + len(run)] + np.uint64(k)
    h = np.zeros(len(at), np.uint64)
    few = np.repeat(n < width, size)
    h[~few] = run[at[~few]]
    if few.any():
        a, span, short = at[few], np.repeat(n, size)[few], np.zeros(int(few.sum()), np.uint64)
        padded = np.concatenate([words.hash, np.zeros(width, np.uint64)])
        for k in range(width):
            short = short * step + np.where(k < span, padded[a + k], np.uint64(0)) + np.uint64(k)
        h[few] = short
    return mix(h), off


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values: n - w + 1 results, by two running minima over blocks."""
    n = len(v)
    if w == 1 or n < w:
        return v[: max(0, n - w + 1)].copy()
    blocks = -(-n // w)
    p = np.full(blocks * w, np.iinfo(v.dtype).max, v.dtype)
    p[:n] = v
    p = p.reshape(blocks, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_AT = np.uint64((1 << 28) - 1)


def minimizer_windows(v: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted positions that hold the leftmost minimum of some window of w hashes (by their upper 36 bits), and the first and
    the last of those windows."""
    if len(v) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = [], []
    for i in range(0, len(v) - w + 1, 1 << 27):  # positions within a piece fit the lower bits
        part = v[i : i + (1 << 27) + w - 1]
        m = window_min((part & ~_AT) | np.arange(len(part), dtype=np.uint64), w)
        new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))  # the leftmost minimum only moves on
        at.append(i + (m[new] & _AT).astype(np.int64))
        first.append(i + new)
    at, first = np.concatenate(at), np.concatenate(first)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    at, first = at[new], first[new]
    return at, first, np.append(first[1:] - 1, len(v) - w)


def minimizers(v: np.ndarray, w: int) -> np.ndarray:
    """Sorted positions that hold the leftmost minimum of some window of w hashes (by their upper 36 bits)."""
    return minimizer_windows(v, w)[0]
