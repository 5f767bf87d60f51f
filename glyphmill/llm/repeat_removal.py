"""Operator 3: removal of long repeated byte strings, by run-length indexes over shards of a corpus.

Each window of `length` bytes has one anchor: the smallest-hashed GRAM-byte string in it. So equal windows
share an anchor at the same offset, and what repeats can be found among the contexts (all windows whose
anchor it is, which follow one another) of anchors with equal bytes:

1. anchors are counted by hash, and those met once are done with;
2. an anchor whose whole context occurs twice marks that context; no bytes move;
3. contexts that differ, but agree over one of four longer ranges, go, once for each distinct context, to
   shards by anchor; a shard's merged contexts form one text whose run-length index streams the matching
   statistics of every position, and matches of at least `length` are marked;
4. an anchor with very many distinct contexts doesn't go to one shard: its contexts go by the longer ranges, cut to the
   windows that span them; where still very many share a range, its windows part by offset, first as one range, then range by range, into those whose
   common bytes occur once, those whose bytes all agree, and the rest, which part again.

Marks name documents by a 64-bit hash of the text, so copies share them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_ranges, minimizer_windows, prefix_hash, range_hash, release, slices, text_bytes, text_or_empty, written
from glyphmill.llm.run_length_index import RunLengthIndex

LENGTH = 400
GRAM = 100
#: Bytes of context in a shard, on average.
SHARD = 1 << 20
#: Distinct contexts of one anchor, or of one longer range, that go to one shard.
HOT = 1000
#: Bits of the bounded set that spares documents without marks a shuffle.
BITS = 1 << 20


def anchors_of(texts: pa.Array, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """row, position, hash, hash of the context, four 16-bit hashes of longer ranges, and the context's start and end, of all anchors
    of texts of at least `length` bytes."""
    raw, off = text_bytes(texts)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = prefix_hash(raw)
    at = np.arange(n - gram + 1)
    g = range_hash(prefix, at, at + gram)
    for o in off[1:-1].tolist():
        g[max(0, o - gram + 1) : o] = np.uint64(0xFFFFFFFFFFFFFFFF)
    a, first, last = minimizer_windows(g, length - gram + 1)
    row = np.searchsorted(off, a, side="right") - 1
    first, last = np.maximum(first, off[row]), np.minimum(last, off[row + 1] - length)
    fine = first <= last
    a, row, first, last = a[fine], row[fine], first[fine], last[fine]
    context = range_hash(prefix, first, last + length) + (a - first).astype(np.uint64)
    edges = quarters_of(length, gram)
    quarters = np.zeros(len(a), np.int64)
    for i in range(4):
        ok = (a - last < edges[i + 1]) & (a - first >= edges[i])
        s, e = np.where(ok, a - edges[i], a), np.where(ok, a + length - edges[i + 1] + 1, a)
        h = (range_hash(prefix, s, e) % np.uint64(65535)).astype(np.int64) + 1
        quarters |= np.where(ok, h, 0) << (16 * i)
    begin = off[row]
    return row, a - begin, g[a], context, quarters, first - begin, last + length - begin


def quarters_of(length: int, gram: int) -> np.ndarray:
    """Offsets of windows before an anchor in four ranges: where each begins, and the end."""
    return np.linspace(0, length - gram + 1, 5).astype(np.int64)


def repeated_in(regions: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(region, start, end): maximal runs of bytes covered by strings of `length` that start twice among all regions."""
    size = np.array([len(r) for r in regions])
    ends = np.cumsum(size + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    is_byte = np.ones(len(text), bool)
    is_byte[ends - 1] = False
    text[is_byte] = np.frombuffer(b"".join(regions), np.uint8)
    text[ends - 1] = 256 + np.arange(len(regions))
    starts = RunLengthIndex(text).matching_statistics() >= length
    cover = np.zeros(len(text) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    s, e = edge[::2], edge[1::2]
    region = np.searchsorted(ends, s, side="right")
    base = ends[region] - size[region] - 1
    return list(zip(region.tolist(), (s - base).tolist(), (e - base).tolist(), strict=True))


def merged_regions(t: np.ndarray, start: np.ndarray, context: list[bytes]) -> tuple[list[int], list[int], list[bytes]]:
    """Contexts of one text that overlap become one region, so that a position stands in a shard once."""
    out_t, out_s, out = [], [], []
    for i in np.lexsort((start, t)).tolist():
        c, s = context[i], int(start[i])
        if out and out_t[-1] == t[i] and s <= out_s[-1] + len(out[-1]):
            out[-1] += c[max(0, out_s[-1] + len(out[-1]) - s) :]
        else:
            out_t.append(int(t[i]))
            out_s.append(s)
            out.append(c)
    return out_t, out_s, out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, t and marks: for each document, pairs (s, e) of bytes that repeat."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("t", F.xxhash64("text"))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, pos, g, c, q, s, e = anchors_of(b.column(1), length, gram)
            columns = [b.column(0).take(pa.array(row)), *[pa.array(x.view(np.int64)) for x in (g, c, q)], *[pa.array(x.astype(np.int32)) for x in (pos, s, e)]]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "g", "c", "q", "pos", "s", "e"])
        release()

    anchors = written(d.select("t", "text").mapInArrow(anchor_rows, "t long, g long, c long, q long, pos int, s int, e int"), "anchors")
    buckets = anchors.groupBy("g").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("several")).filter("n > 1").select("g", "several")
    met = written(anchors.join(buckets, "g"), "met")

    # whole contexts that occur twice
    same = met.filter("not several").select("t", "s", "e")
    classes = written(met.filter("several").groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("t", "pos", "q", "s", "e")).alias("first")), "classes")
    same = same.unionByName(met.filter("several").join(classes.filter("n > 1").select("g", "c"), ["g", "c"]).select("t", "s", "e"))
    whole = same.distinct()

    # contexts that differ but agree over one of the longer ranges
    each = classes.select("g", "c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("first.q", 16 * i).bitwiseAND(65535).alias("h")) for i in range(4)])).alias("r")).select("g", "c", "r.i", "r.h").filter("h > 0")
    agreed = each.groupBy("g", "i", "h").count().filter("count > 1")
    matched = written(each.join(agreed, ["g", "i", "h"]), "matched")
    chosen = written(matched.select("g", "c").distinct().join(classes.select("g", "c", "first.t", "first.pos", "first.s", "first.e"), ["g", "c"]), "chosen")
    sizes = chosen.groupBy("g").count()
    cold = chosen.join(sizes.filter(F.col("count") <= HOT), "g").select("t", "pos", "s", "e", F.lit(-1).alias("quarter"), F.xxhash64("g").alias("deal"))
    often = matched.join(sizes.filter(F.col("count") > HOT).select("g"), "g").join(chosen, ["g", "c"])
    often = often.select("t", "pos", "s", "e", F.col("i").alias("quarter"), F.when(F.col("count") <= HOT, F.xxhash64("g", "i", "h")).alias("deal"))
    asked = written(cold.unionByName(often), "asked")
    shards = max(1, asked.count() * (3 * length - gram) // (2 * SHARD))
    wanted = asked.select("t", F.struct("pos", "s", "e", F.pmod("deal", F.lit(shards)).cast("int").alias("shard"), "quarter").alias("w"))
    wanted = written(wanted.groupBy("t").agg(F.collect_list("w").alias("wanted")), "wanted")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            raw, off = text_bytes(b.column(1))
            w = b.column(2)
            count = np.diff(w.offsets.to_numpy())
            flat = w.flatten()
            pos, s, e = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            shard, quarter = flat.field(3), flat.field(4)
            row = np.repeat(np.arange(len(count)), count)
            edges, k = quarters_of(length, gram), quarter.to_numpy()
            part = k >= 0
            s = np.where(part, np.maximum(s, pos - edges[k + 1] + 1), s)
            e = np.where(part, np.minimum(e, pos + length - edges[np.maximum(k, 0)]), e)
            yield pa.RecordBatch.from_arrays(
                [shard, pa.array(b.column(0).to_numpy()[row]), pa.array(s.astype(np.int32)), pa.array((pos - s).astype(np.int32)), quarter, byte_ranges(raw, off[row] + s, off[row] + e)],
                names=["shard", "t", "start", "left", "quarter", "context"],
            )
        release()

    texts = among(d.select("t", "text"), wanted).join(wanted, "t")
    sent = texts.select("t", "text", "wanted").mapInArrow(contexts, "shard int, t long, start int, left int, quarter int, context binary")
    sent = written(sent, "contexts")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            shard = table.column(0).to_numpy()
            for k in np.unique(shard).tolist():
                part = table.filter(pa.array(shard == k)).combine_chunks()
                t, start, regions = merged_regions(part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).to_pylist())
                got = repeated_in(regions, length)
                yield pa.RecordBatch.from_arrays([pa.array([t[r] for r, _, _ in got], pa.int64()), pa.array([start[r] + s for r, s, _ in got], pa.int32()), pa.array([start[r] + e for r, _, e in got], pa.int32())], names=["t", "s", "e"])
        release()

    cold = sent.filter("shard is not null").groupBy("shard", "t", "start").agg(F.max("context").alias("context"))  # of contexts with one start the longest
    cold = cold.repartition(max(parts, min(shards, 20_000)), "shard").sortWithinPartitions("shard")
    indexed = cold.select("shard", "t", "start", "context").mapInArrow(index, "t long, s int, e int")
    hot = parted(sent.filter("shard is null").drop("shard").dropDuplicates(["t", "start", "left", "quarter"]), length, gram)

    marks = written(whole.unionByName(indexed).unionByName(hot).groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("marks")), "marks")
    marked = among(d, marks).join(marks, "t", "left")
    return marked.select("doc_id", "text", "marks").unionByName(among(d, marks, "left_anti").select("doc_id", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks")))


def parted(contexts: DataFrame, length: int, gram: int, parts: int = 5) -> DataFrame:
    """t, s, e of the bytes that repeat among contexts (t, start, left, quarter, context) of equal anchors, without bringing them together.

    The windows at offsets lo..hi before the anchor have some bytes in common and span some more. Where the common bytes occur once, no
    window repeats; contexts that agree in all they span repeat it, and one of them goes on with those that agree with none.
    """
    spark = contexts.sparkSession
    contexts = written(contexts, "hot-contexts")
    marks = spark.createDataFrame([], "t long, s int, e int")
    if contexts.isEmpty():
        return marks

    def into(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "context", 1 << 20):
                raw, off = text_bytes(b.column(3))
                prefix, size = prefix_hash(raw), np.diff(off)
                t, start, left = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
                quarter, open_ = b.column(5), b.column(4)
                row = np.repeat(np.arange(b.num_rows), np.diff(open_.offsets.to_numpy()))
                lo0, hi0 = (open_.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
                for k in range(parts):
                    n = hi0 - lo0 + 1
                    step = -(-n // parts)
                    lo, hi = lo0 + k * step, np.minimum(lo0 + (k + 1) * step - 1, hi0)
                    a = off[row] + left[row]
                    ok = (lo <= hi) & (lo <= left[row]) & (left[row] + length - hi <= size[row])
                    i = np.flatnonzero(ok)
                    if not len(i):
                        continue
                    r, a, lo, hi = row[i], a[i], lo[i], hi[i]
                    key = range_hash(prefix, a - lo, a + length - hi) + ((lo << 20) + hi).astype(np.uint64)
                    low, high = np.maximum(lo, left[r] + length - size[r]), np.minimum(hi, left[r])
                    full = range_hash(prefix, a - high, a + length - low) + low.astype(np.uint64)
                    at = start[r] + left[r]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), *[pa.array(x) for x in (t[r], start[r].astype(np.int32), left[r].astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), (at - high).astype(np.int32), (at + length - low).astype(np.int32))], quarter.take(pa.array(r))],
                        names=["key", "full", "t", "start", "left", "lo", "hi", "s", "e", "quarter"],
                    )
            release()

        return split

    edges = F.array(*[F.lit(int(c)) for c in quarters_of(length, gram)])
    open_ = contexts.withColumn("open", F.array(F.struct(F.get(edges, F.col("quarter")).alias("lo"), (F.get(edges, F.col("quarter") + 1) - 1).alias("hi"))))
    own = ["t", "start", "left", "quarter"]
    split = into(1)  # most contexts agree with another over all their windows: one range tells
    while True:
        rows = open_.select("t", "start", "left", "context", "open", "quarter").mapInArrow(split, "key long, full long, t long, start int, left int, lo int, hi int, s int, e int, quarter int")
        rows = written(rows, "ranges")
        full = written(rows.groupBy("key", "full").agg(F.count("*").alias("n"), F.min(F.struct(*own)).alias("first"), F.min("lo").alias("lo"), F.min("hi").alias("hi")), "range-classes")
        repeated = full.filter("n > 1").select("key", "full")
        marks = marks.unionByName(written(rows.join(repeated, ["key", "full"]).select("t", "s", "e"), "range-marks", replaces=[rows]))
        several = full.groupBy("key").count().filter("count > 1").select("key")
        mixed = full.filter("lo < hi").join(several, "key").select("first.*", "lo", "hi")
        if mixed.isEmpty():
            return marks
        split = into(parts)
        open_ = contexts.join(mixed.groupBy(*own).agg(F.collect_list(F.struct("lo", "hi")).alias("open")), own)


def among(docs: DataFrame, keyed: DataFrame, how: str = "left_semi") -> DataFrame:
    """Documents whose t may (left_semi) or can't (left_anti) be among those of a table: by at most BITS bits, a bounded
    broadcast. A full set lets everything through, and a join that follows decides."""
    bits = keyed.select(F.pmod("t", F.lit(BITS)).cast("int").alias("bit")).distinct()
    return docs.join(F.broadcast(bits), F.pmod("t", F.lit(BITS)).cast("int") == F.col("bit"), how)


def spans_of(marks: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of marked bytes."""
    if not marks:
        return []
    s = np.array([m["s"] for m in marks], np.int64)
    e = np.array([m["e"] for m in marks], np.int64)
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return list(zip(s[at].tolist(), e[np.append(at[1:] - 1, len(e) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes), kept_sha256.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the same document or another;
    strings never cross documents and are judged on the input. Null counts as empty text; shorter texts lose nothing.
    Equal rows repeat, and all of them lose what they repeat.
    """
    found = repeats(docs, length, gram, text, doc_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            raw, off = text_bytes(b.column(1))
            rows = []
            for i, marks in enumerate(b.column(2).to_pylist()):
                body = raw[off[i] : off[i + 1]].tobytes()
                spans = spans_of(marks)
                last, kept = 0, []
                for s, e in spans:
                    kept.append(body[last:s])
                    last = e
                kept = b"".join([*kept, body[last:]])
                rows.append((len(body), len(body) - len(kept), len(spans), [{"start": s, "end": e} for s, e in spans], kept, hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    return found.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
