"""Operator 1: approximate nearest neighbours by inner product over an NN-descent graph.

The graph starts from the leaves of a few random-projection trees. Then, round by round, Spark joins the
neighbours (forward and backward) of every node with their vectors, compares them with one another, and keeps
each node's best; rounds end as few lists change. Queries walk the graph: each keeps a beam of its best nodes and opens
the best unopened ones until none is left.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import written

log = logging.getLogger(__name__)

#: Length of a node's list; as many backward neighbours at most take part in a round.
DEGREE = 32
LEAF = 256
TREES = 5
ROUNDS = 6
BEAM = 140
OPEN = 35


def quantised(x: np.ndarray, width: np.ndarray) -> pa.Array:
    """Vectors laid end to end as bytes: a float32 scale, then a signed byte for each component."""
    off = np.concatenate([[0], np.cumsum(width)])
    most = np.maximum.reduceat(np.abs(x), off[:-1]) if len(width) else np.zeros(0)
    scale = (most / 127).astype(np.float32)
    out = np.zeros(int(off[-1]) + 4 * len(width), np.uint8)
    at = off[:-1] + 4 * np.arange(len(width))
    for k in range(4):
        out[at + k] = scale.view(np.uint8).reshape(-1, 4)[:, k]
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.nan_to_num(np.rint(x / np.repeat(scale, width))).astype(np.int8)
    out[np.arange(off[-1]) + 4 * np.repeat(np.arange(1, len(width) + 1), width)] = steps.view(np.uint8)
    ends = np.concatenate([[0], off[1:] + 4 * np.arange(1, len(width) + 1)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def _matrix(col: pa.Array) -> np.ndarray:
    """Quantised vectors of one length as a float32 matrix."""
    if not len(col):
        return np.zeros((0, 0), np.float32)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(col), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def usable_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): rows whose vector is neither null, zero nor holds null or non-finite components.
    Of rows that share an id the smallest vector stays; rows without an id go."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_nodes(vectors: DataFrame) -> DataFrame:
    """node (its smallest vec_id), v, f (quantised): equal vectors are one node."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), v, quantised(v.flatten().to_numpy(), np.diff(v.offsets.to_numpy()))], names=["node", "v", "f"])

    nodes = vectors.groupBy("v").agg(F.min("vec_id").alias("node"))
    return nodes.select("node", "v").mapInArrow(pack, "node long, v array<double>, f binary")


def leaves(nodes: DataFrame, dim: int, n: int, trees: int, leaf: int) -> DataFrame:
    """tree, leaf, node, f: a node's leaf in each random-projection tree (signs of seeded projections about their medians' estimate, 0)."""
    bits = max(0, math.ceil(math.log2(max(1, n / leaf))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(11).standard_normal((trees, max(bits, 1), dim)).astype(np.float32)
        for b in batches:
            x = _matrix(b.column(1))
            for t in range(trees):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1]))) if bits else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), b.column(0), b.column(1)], names=["tree", "leaf", "node", "f"])

    return nodes.select("node", "f").mapInArrow(place, "tree int, leaf long, node long, f binary")


def best_pairs(node: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each node's k best distinct others, best first, ties to the smaller."""
    by = np.lexsort((other, -score, node))
    n, o = node[by], other[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (n[1:] != n[:-1]) | (o[1:] != o[:-1])  # equal pairs have equal scores, so they stand together
    by = by[fresh]
    n = node[by]
    start = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, int)
    rank = np.arange(len(n)) - np.repeat(start, np.diff(np.append(start, len(n))))
    return by[rank < k]


def _edges(node: list, other: list, score: list, k: int) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((node, np.int64), (other, np.int64), (score, np.float32)))
    keep = best_pairs(a, b, s, k)
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep])], names=["node", "other", "score"])


def _grouped(batches: Iterator[pa.RecordBatch], at_least: int = 20_000) -> Iterator[pa.Table]:
    """Rows that arrive sorted by their first column, in pieces that never cut a run of equal values."""
    rest: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        rest.append(b)
        n += b.num_rows
        if n >= at_least:
            t = pa.Table.from_batches(rest).combine_chunks()
            key = t.column(0).chunk(0)
            cut = t.num_rows
            last = key[-1].as_py()
            values = key.to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(values, last))
            if cut:
                yield t.slice(0, cut).combine_chunks()
            t = t.slice(cut)
            rest, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(rest).combine_chunks()


EDGE = "node long, other long, score float"


def first_graph(nodes: DataFrame, dim: int, n: int, k: int = DEGREE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Each node's best others among those of its leaves. A leaf that holds more than its share is cut into random
    pieces of at most 4 leaves' size, so no task compares an unbounded group."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = leaves(nodes, dim, n, trees, leaf)
    size = placed.groupBy("tree", "leaf").count()
    placed = placed.join(size, ["tree", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / (4 * leaf))))
    placed = placed.select(F.xxhash64("tree", "leaf", "piece").alias("key"), "node", "f").repartition(parts, "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 5_000):
            key, node, x = t.column(0).to_numpy(), t.column(1).to_numpy(), _matrix(t.column(2).chunk(0))
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            a, b, s = [], [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo > 1:
                    m = x[lo:hi] @ x[lo:hi].T
                    np.fill_diagonal(m, -np.inf)
                    top = np.argpartition(-m, min(k, hi - lo - 1) - 1, axis=1)[:, : min(k, hi - lo - 1)]
                    a.append(np.repeat(node[lo:hi], top.shape[1]))
                    b.append(node[lo:hi][top].ravel())
                    s.append(np.take_along_axis(m, top, 1).ravel())
            yield _edges(a, b, s, k)

    return merged(placed.mapInArrow(compare, EDGE), k)


def merged(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k best others. Lists are dealt by node, and a node gets a bounded number of candidates from each task."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            yield _edges([t.column(0).to_numpy()], [t.column(1).to_numpy()], [t.column(2).to_numpy()], k)

    return edges.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(best, EDGE)


def descend(graph: DataFrame, nodes: DataFrame, k: int = DEGREE) -> DataFrame:
    """One round: every node's forward and (at most k) backward neighbours meet, with their vectors and the scores
    that a newcomer must beat; what beats them joins the lists."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bar = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).cast("float").alias("bar"))
    known = nodes.select("node", "f").join(bar, "node", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))).cast("float"))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            yield _edges([t.column(0).to_numpy()], [t.column(1).to_numpy()], [t.column(2).to_numpy()], k)

    # backward neighbours: those that rank the node highest; tasks first cut what they hold, as hubs have many
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score").sortWithinPartitions("node").mapInArrow(closest, EDGE)
    back = back.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(closest, EDGE)
    met = graph.select("node", "other").unionByName(back.select("node", "other")).distinct().unionByName(nodes.select("node", F.col("node").alias("other")))
    local = met.join(known.withColumnRenamed("node", "other"), "other").select("node", "other", "f", "bar").repartition(parts, "node").sortWithinPartitions("node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 60_000):
            key, member, x, bar_ = t.column(0).to_numpy(), t.column(1).to_numpy(), _matrix(t.column(2).chunk(0)), t.column(3).to_numpy()
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            a, b, s = [], [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                m = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(m, -np.inf)
                i, j = np.nonzero(m > bar_[lo:hi, None])
                a.append(member[lo + i])
                b.append(member[lo + j])
                s.append(m[i, j])
            yield _edges(a, b, s, k)

    return merged(graph.unionByName(local.mapInArrow(compare, EDGE)), k)


def neighbour_graph(nodes: DataFrame, k: int = DEGREE, rounds: int = ROUNDS, settled: float = 0.03) -> DataFrame:
    """node, other, score: NN-descent until less than `settled` of the edges are new, `rounds` rounds at most."""
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    graph = written(first_graph(nodes, dim or 1, n, k), "graph")
    for _ in range(rounds):
        new = written(descend(graph, nodes, k), "graph")
        total = new.count()
        changed = new.join(graph, ["node", "other"], "left_anti").count()
        log.info("NN-descent: %d of %d edges are new", changed, total)
        graph = new
        if changed <= settled * total:
            break
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, open_: int = OPEN) -> DataFrame:
    """Greedy graph search. queries: q, start (a node), f. Returns q, other, score: the beam's nodes, the start among them.

    A hop joins the nodes that queries open with those nodes' neighbours and their vectors; each query then keeps its
    `beam` best. It ends as every query has opened all of its beam; a node is opened once for a query, since a beam only gets
    better and what left it doesn't come back.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = graph.select("node", "other").unionByName(_backward(graph, DEGREE)).distinct()
    lists = both.join(nodes.select(F.col("node").alias("other"), "f"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "f")).alias("near"))
    lists = written(lists, "adjacency")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, x, near = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2)
            size = np.diff(near.offsets.to_numpy())
            flat = near.flatten()
            y = _matrix(flat.field(1))
            row = np.repeat(np.arange(len(q)), size)
            yield _edges([q[row]], [flat.field(0).to_numpy()], [np.einsum("ij,ij->i", x[row], y).astype(np.float32)], beam)

    hop_rows = queries.select("q", "f", F.col("start").alias("node"))
    state = None  # q, other, score, opened
    while True:
        got = hop_rows.join(lists, "node").select("q", "f", "near").mapInArrow(score, "node long, other long, score float").select(F.col("node").alias("q"), "other", "score", F.lit(False).alias("opened"))
        if state is None:
            own = queries.select("q", F.col("start").alias("other"), F.lit(float("inf")).cast("float").alias("score"), F.lit(True).alias("opened"))
            got = got.unionByName(own)
        else:
            got = got.unionByName(state)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _grouped(batches):
                q, other, s, opened = (t.column(i).to_numpy() for i in range(4))
                by = np.lexsort((~opened, other, -s, q))  # of equal nodes the opened one first
                q, other, s, opened = q[by], other[by], s[by], opened[by]
                fresh = np.ones(len(q), bool)
                fresh[1:] = (q[1:] != q[:-1]) | (other[1:] != other[:-1])
                q, other, s, opened = q[fresh], other[fresh], s[fresh], opened[fresh]
                start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
                q, other, s, opened = (x[rank < beam] for x in (q, other, s, opened))
                start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                waiting = np.cumsum(~opened)
                base = np.repeat((waiting - ~opened)[start], np.diff(np.append(start, len(q))))
                next_ = ~opened & (waiting - base <= open_)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(other), pa.array(s), pa.array(opened | next_), pa.array(next_)], names=["q", "other", "score", "opened", "next"])

        state = written(got.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(keep, "q long, other long, score float, opened boolean, next boolean"), "beam")
        going = state.filter("next").select("q", F.col("other").alias("node"))
        if going.isEmpty():
            break
        hop_rows = going.join(queries.select("q", "f"), "q")
        state = state.drop("next")
    return state.select("q", "other", "score")


def _backward(graph: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("other").orderBy(F.desc("score"), "node")
    return graph.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select(F.col("other").alias("node"), F.col("node").alias("other"))


def nearest(table: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found, by inner product in double precision, of each row
    that is_query (a condition on vec_id) picks, itself excepted; ties to the smaller vec_id; fewer if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Equal
    vectors are one node of the graph; of each node the k + 1 smallest ids can be among the k nearest, and do expand.
    Vectors of several lengths: only those of the most common length (the longest among ties) take part.
    """
    vectors = usable_vectors(table, vec_id, embedding)
    length = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not length:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    vectors = written(vectors.filter(F.size("v") == length[0][0]), "vectors")
    nodes = written(distinct_nodes(vectors), "nodes")
    graph = neighbour_graph(nodes, degree)
    of_node = vectors.join(nodes.select("node", "v"), "v").select("vec_id", "node")
    first = written(members(of_node, k + 1), "members")
    queries = of_node.filter(is_query(F.col("vec_id"))).join(nodes, "node").select(F.col("vec_id").alias("q"), F.col("node").alias("start"), "f", F.col("v").alias("qv"))
    queries = written(queries, "queries")
    found = search(queries.select("q", "start", "f"), nodes, graph, max(beam, k + 1))
    # exact scores, in double precision, of the nodes met; then their members
    exact = found.join(queries.select("q", "qv"), "q").join(nodes.select(F.col("node").alias("other"), "v"), "other")
    scored = exact.select("q", "other", F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("score"))
    rows = scored.join(first.withColumnRenamed("node", "other"), "other").select("q", "score", F.explode("ids").alias("vec_id")).filter("q <> vec_id")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")


def members(of_node: DataFrame, k: int) -> DataFrame:
    """node, ids: the k smallest vec_ids of each node (each task keeps k of a node before the shuffle)."""
    w = Window.partitionBy("node").orderBy("vec_id")
    few = of_node.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
    return few.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
