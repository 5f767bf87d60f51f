"""Operator 2: n-gram Jaccard join along chosen paths.

Documents become sets of five-word shingles; equal sets are one class from the start. A set's tokens
are its min-hashes (coordinate, value). A bucket of sets splits on sampled coordinates: sets with the same
value there go on together, into 1/similarity children on average, so a similar pair's expected
number of shared paths stays at least one. Buckets of at most `limit` sets are compared in full; larger
ones split again, up to `depth`. Runs repeat until the target recall. The edges found join sets into
groups, and within a group all pairs are checked exactly, in blocks, counting links without listing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Words, mix, release, shingle_hashes, slices, text_or_empty, written
from glyphmill.llm.components import connected_components

COORDINATES = 64
LIMIT = 64
DEPTH = 5
BLOCK = 256
_A = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair of that similarity, whose bucket splits depth times, is met with the given probability.

    The pair's shared paths are a branching process: one child, or with probability `extra` two, each kept with
    probability `similarity`.
    """
    extra, alive = 1 / similarity - 1, 1.0
    for _ in range(depth):
        hit = similarity * alive
        alive = (1 - extra) * hit + extra * (1 - (1 - hit) ** 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def sets_of(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: a 64-bit name of its shingle set, the number of distinct shingles, and its min-hashes."""
    h, off = shingle_hashes(Words(texts), width)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    size = np.bincount(row, minlength=n)
    some = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[some]
    name, mins = np.zeros(n, np.uint64), np.zeros((n, COORDINATES), np.uint32)
    if len(some):
        name[some] = mix(np.add.reduceat(mix(h), first) + size[some].astype(np.uint64))
        for k in range(COORDINATES):
            mins[some, k] = (np.minimum.reduceat(h * _A[k], first) >> np.uint64(16)).astype(np.uint32)
    return name, size, mins


def children(path: np.ndarray, mins: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, new path) of the children of each set's path: the coordinates come from the path alone."""
    every = np.arange(len(path))
    more = (mix(path + np.uint64(2)) >> np.uint64(11)).astype(np.float64) / (1 << 53) < 1 / similarity - 1
    rows, out = [], []
    for k, which in ((1, every), (3, every[more])):
        i = (mix(path[which] + np.uint64(k)) % np.uint64(COORDINATES)).astype(np.int64)
        rows.append(which)
        out.append(mix(path[which] * np.uint64(0x9E3779B97F4A7C15) + (i.astype(np.uint64) << np.uint64(32)) + mins[which, i].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(out)


def _mins(col: pa.Array) -> np.ndarray:
    raw = col.buffers()[2]
    if raw is None or not len(col):
        return np.zeros((0, COORDINATES), np.uint32)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    return np.frombuffer(raw, np.uint8)[off : off + len(col) * COORDINATES * 4].copy().view("<u4").reshape(-1, COORDINATES)


def similar_in_buckets(key: np.ndarray, sid: np.ndarray, mins: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that join, within each bucket (equal keys stand together), the sets with at least that share of equal min-hashes."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    edges = []
    for gap in range(1, int(size.max())):
        i = np.flatnonzero(np.repeat(size - gap, size) > np.arange(len(key)) - np.repeat(start, size))
        same = sid[i] != sid[i + gap]
        i = i[same]
        for a in range(0, len(i), 50_000):
            j = i[a : a + 50_000]
            hit = (mins[j] == mins[j + gap]).mean(axis=1) >= least
            edges += list(zip(j[hit].tolist(), (j[hit] + gap).tolist(), strict=True))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((int(sid[a]), int(sid[b])))
    return out


def exact_links(sets: list[np.ndarray], block: np.ndarray, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one block, or of two different blocks: the weight that each set is linked to, and its root in the graph of links."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(col, kind="stable")
    owner, col = owner[by], col[by]
    common = np.zeros((n, n), np.float32)
    at, width = 0, max(1024, (8 << 20) // (4 * n))
    while at < len(col):
        to = int(np.searchsorted(col, col[at] + width))
        m = np.zeros((n, min(width, int(col[to - 1] - col[at]) + 1)), np.float32)
        m[owner[at:to], col[at:to] - col[at]] = 1
        common += m @ m.T
        at = to
    pair = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(pair, False)
    if len(np.unique(block)) > 1:
        pair &= block[:, None] != block[None, :]
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(pair, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return pair @ weight, label
        label = low


def jaccard_join(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, width: int = 5, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_shingles, n_copies, n_links.

    Two documents are linked if their sets of `width`-word shingles (words between white space, A-Z lower-cased; fewer
    words than `width`, but not none, are one shingle) have Jaccard similarity of at least `similarity`. class_id: the
    smallest doc_id among all documents that links connect; set_id: the same among equal sets; n_copies: documents of
    an equal set; n_links: other documents linked. Null and empty texts, and texts of white space, have no shingles:
    they link to nothing and are classes of their own. A null doc_id counts as larger than any other; a class of such alone has class_id null.
    """
    measured, s = _classes(docs, similarity, recall, width, text, doc_id, limit, depth)
    some = measured.filter("n > 0").select("doc_id", "sid", "n").join(s, "sid")
    none = measured.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return some.select("doc_id", "class_id", "set_id", F.col("n").alias("n_shingles"), F.col("m").alias("n_copies"), (F.col("m") - 1 + F.col("links")).cast("long").alias("n_links")).unionByName(none)


def _row(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The name of a row: a hash of its doc_id, null or not, and its text."""
    return F.xxhash64(F.col(doc_id).cast("long"), text_or_empty(text))


def _classes(docs: DataFrame, similarity: float, recall: float = 0.999, width: int = 5, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sid, n, mins, row), and shingle sets (sid, set_id, class_id, label, m, links, first: its first row by doc_id, nulls last)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            name, size, mins = sets_of(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name.view(np.int64)), pa.array(size), pa.array([m.tobytes() for m in mins], pa.binary()), b.column(2)], names=["doc_id", "sid", "n", "mins", "row"])
        release()

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), _row(doc_id, text).alias("row"))
    measured = written(d.mapInArrow(measure, "doc_id long, sid long, n long, mins binary, row long"), "measured")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    sets = written(measured.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("set_id"), first, F.count("*").alias("m"), F.min("mins").alias("mins")), "sets")

    edges = chosen_path_edges(sets, similarity, recall, limit, depth)
    groups = written(connected_components(edges), "groups")
    links = written(verified_links(d, sets, groups, similarity, width), "links")
    by_set = links.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = connected_components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")).filter("a <> b"))

    s = sets.select("sid", "set_id", "first", "m").join(by_set, "sid", "left").join(classes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    lowest = s.groupBy("label").agg(F.min("set_id").alias("class_id"))
    return measured, s.join(lowest, "label").select("sid", "set_id", "class_id", "label", "m", F.coalesce("links", F.lit(0)).alias("links"), "first")


def chosen_path_edges(sets: DataFrame, similarity: float, recall: float, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """a, b: edges that connect the sets (sid, mins) met in a common bucket with min-hashes that agree closely."""
    runs = runs_for(recall, similarity, depth)
    least = similarity - 3 * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    seeds = mix(np.arange(1000, 1000 + runs, dtype=np.uint64))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mins, sid = _mins(b.column(1)), b.column(0).to_numpy()
            for s in seeds:
                rows, path = children(np.full(len(sid), s), mins, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(sid[rows])], names=["path", "sid"])
        release()

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, path = children(b.column(0).to_numpy().view(np.uint64), _mins(b.column(2)), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(1).take(pa.array(rows))], names=["path", "sid"])
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
            if cut:
                yield edges_of(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield edges_of(rest)
        release()

    def edges_of(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        got = similar_in_buckets(t.column(0).to_numpy(), t.column(1).to_numpy(), _mins(t.column(2).chunk(0)), least)
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

    rows = written(sets.select("sid", "mins").mapInArrow(begin, "path long, sid long"), "paths")
    found = None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").count().filter("count > 1")
        met = written(rows.join(sizes, "path"), "buckets")
        small = met.filter(F.col("count") <= limit).join(sets.select("sid", "mins"), "sid").select("path", "sid", "mins")
        n = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = small.repartition(n, "path").sortWithinPartitions("path").mapInArrow(compare, "a long, b long")
        found = part if found is None else found.unionByName(part)
        large = met.filter(F.col("count") > limit)
        if large.isEmpty():
            break
        if level == depth:  # sets that agree along every sampled path: each is joined to the bucket's first
            first = large.groupBy("path").agg(F.min("sid").alias("a"))
            found = found.unionByName(large.join(first, "path").select("a", F.col("sid").alias("b")))
        else:
            rows = written(large.join(sets.select("sid", "mins"), "sid").select("path", "sid", "mins").mapInArrow(go_on, "path long, sid long"), "paths")
    return found


def verified_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float, width: int = 5, block: int = BLOCK) -> DataFrame:
    """sid, links, root: for each set of a group, by pair of blocks, the documents of other sets at the similarity and the
    smallest set it is connected to. A group of g sets has g / block blocks; each set goes to as many pairs of blocks."""
    size = groups.groupBy("label").count()
    members = groups.join(size, "label").select(F.col("node").alias("sid"), "label", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    members = members.join(sets.select("sid", F.col("first.row").alias("row"), "m"), "sid")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, off = shingle_hashes(Words(b.column(1)), width)
            h = [np.unique(h[a:z]) for a, z in zip(off[:-1], off[1:], strict=True)]
            name = [int(mix(np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64)).view(np.int64)[0]) for x in h]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.int64()), pa.array([x.tobytes() for x in h], pa.binary())], names=["row", "sid", "shingles"])
        release()

    # each set is asked of one row, whether that has a doc_id or not
    wanted = members.select("row").distinct()
    full = docs.join(wanted, "row", "left_semi").select("row", "text").mapInArrow(shingles, "row long, sid long, shingles binary").dropDuplicates(["sid"])
    full = members.join(full.drop("row"), "sid").select("sid", "label", "blocks", "m", "shingles")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = full.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "m", "shingles")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid", kind="stable")
        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        links, label = exact_links(sets_, pdf["block"].to_numpy(), pdf["m"].to_numpy(), similarity)
        sid = pdf["sid"].to_numpy()
        return pd.DataFrame({"sid": sid, "links": links.astype(np.int64), "root": sid[label]})

    return dealt.groupBy("label", "low", "high").applyInPandas(check, "sid long, links long, root long")


def one_of_each(docs: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents, with their columns, one of each class of near duplicates: that with the smallest doc_id, a null one
    counting as larger than any other. Texts without words stay; of rows with equal ids and such texts, one of each text."""
    _, sets = _classes(docs, similarity, text=text, doc_id=doc_id, **options)
    keep = sets.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    d = docs.withColumn("_row", _row(doc_id, text))
    words = text_or_empty(text).rlike(r"[^\x20\x09-\x0D]")
    some = d.filter(words).join(keep, "_row", "left_semi").dropDuplicates(["_row"])
    none = d.filter(~words & F.col(doc_id).isNotNull()).dropDuplicates(["_row"])
    unnamed = d.filter(~words & F.col(doc_id).isNull())
    return some.unionByName(none).unionByName(unnamed).drop("_row").select(*docs.columns)
