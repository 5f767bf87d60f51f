"""Operator 13: rounds of integer centroid clustering, screened by segment norms.

A vector of 64 integers is kept with a compressed form z: for each segment of eight components its sum over sqrt(8) and
the norm of what is left of the segment without its mean. By Cauchy-Schwarz, segment for segment, the squared distance
of two compressed forms is at most the squared distance of the vectors. A vector first meets the centroid whose
compressed form is nearest; only centroids whose bound doesn't exceed that exact distance get an exact integer one.

The driver holds the centroids alone (k times 64 integers). A round is one pass over the vectors: each task adds up
its vectors by cluster, and Spark adds the tasks' k sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import release, written

DIM, SEGMENT = 64, 8
#: Integers up to this magnitude have distances and sums that 64 bits hold; vectors beyond it take Python's integers.
NARROW = 1 << 27
#: Larger components count as this much, so that sums stay within 38 digits.
WIDE = 1 << 90
LONG = (1 << 63) - 1
#: Relative error that a bound may have, from single precision and from sums of squares.
SLACK = 1e-5


def compressed(v: np.ndarray) -> np.ndarray:
    """The compressed forms of integer vectors: per segment its scaled sum, and the norm of its deviations."""
    s = v.astype(np.float64).reshape(len(v), -1, SEGMENT)
    total = s.sum(axis=2)
    rest = np.sqrt(((s - total[..., None] / SEGMENT) ** 2).sum(axis=2))
    return np.concatenate([total / np.sqrt(SEGMENT), rest], axis=1)


def exact_distance(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, in integers (of 64 bits, or of Python for arrays of objects)."""
    d = v - c
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def nearest_centroid(v: np.ndarray, z: np.ndarray, c: np.ndarray, cz: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many exact distances it took."""
    norm = np.sqrt((z * z).sum(axis=1))[:, None] + np.sqrt((cz * cz).sum(axis=1))[None]
    bound = np.stack([np.sqrt(((z - one) ** 2).sum(axis=1)) for one in cz], axis=1)
    bound = np.maximum(bound - SLACK * norm, 0.0) ** 2
    first = bound.argmin(axis=1)
    best = exact_distance(v, c[first])
    left = bound <= best.astype(np.float64)[:, None] * (1 + SLACK)
    left[np.arange(len(v)), first] = False
    cluster, taken = first.copy(), len(v)
    for j in range(len(c)):
        at = np.flatnonzero(left[:, j])
        if not len(at):
            continue
        taken += len(at)
        d = exact_distance(v[at], c[j][None])
        won = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        best[at[won]] = d[won]
        cluster[at[won]] = j
    return cluster, best, taken


def prepared(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """Vectors that take part, as integers, each with its compressed form, written as a table."""
    x = F.col(embedding)
    kept = vectors.where((F.size(x) == DIM) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    whole = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("x"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.floor(scale * pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False).reshape(-1, DIM))
            v = np.clip(x, -NARROW, NARROW).astype(np.int64)
            far = np.flatnonzero((np.abs(x) > NARROW).any(axis=1))
            digits: list = [None] * len(x)
            for i in far.tolist():
                digits[i] = [str(int(min(max(e, -float(WIDE)), float(WIDE)))) for e in x[i].tolist()]
            flat = lambda a, t: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), t), a.shape[1]).cast(pa.list_(t))
            yield pa.RecordBatch.from_arrays([b.column(0), flat(v, pa.int32()), flat(compressed(v), pa.float32()), pa.array(digits, pa.list_(pa.string()))], names=["vec_id", "v", "z", "digits"])
        release()

    return written(whole.mapInArrow(compress, "vec_id long, v array<int>, z array<float>, digits array<string>"), "centroid-vectors")


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, integers and compressed forms; vectors beyond the narrow range come apart, as Python's integers."""
    for b in batches:
        far = np.asarray(pc.is_valid(b.column(3)))
        for some, wide in ((~far, False), (far, True)):
            if not some.any():
                continue
            part = b if some.all() else b.filter(pa.array(some))
            if wide:
                v = np.array([[int(e) for e in row] for row in part.column(3).to_pylist()], dtype=object)
                yield part.column(0), v, compressed(v)
            else:
                v = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIM)
                yield part.column(0), v, pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


class Centroids:
    """Centroids as integers of 64 bits where they fit and of Python, with their compressed forms."""

    def __init__(self, rows: list[list[int]]):
        self.wide = np.array(rows, dtype=object).reshape(len(rows), DIM)
        self.fits = all(abs(e) <= NARROW for row in rows for e in row)
        self.narrow = self.wide.astype(np.int64) if self.fits else None
        self.z = compressed(self.wide)

    def assign(self, v: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        if self.fits and v.dtype != object:
            return nearest_centroid(v, z, self.narrow, self.z)
        return nearest_centroid(v.astype(object), z, self.wide, self.z)


def next_centroids(data: DataFrame, centroids: Centroids) -> list[list[int]]:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids.wide), DIM), dtype=object)
        n = np.zeros(len(centroids.wide), np.int64)
        for _, v, z in batches_of(batches):
            cluster, _, _ = centroids.assign(v, z)
            n += np.bincount(cluster, minlength=len(n))
            for j in np.unique(cluster).tolist():
                total[j] += v[cluster == j].sum(axis=0)
        held = np.flatnonzero(n).tolist()
        sums = [[str(int(e)) for e in total[j]] for j in held]
        release()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), pa.array(sums, pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    parts = data.mapInArrow(add, "cluster int, n long, sums array<string>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM)]
    rows = [[int(e) for e in r] for r in centroids.wide]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid
        rows[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIM)]
    return rows


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Cluster vectors of 64 components, as integers floor(scale * x), around k centroids in a fixed number of rounds.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components). Centroids start
    as the k vectors with smallest sha256 of `1:<vec_id>`; ties (repeated ids) go by the components. Ties between
    centroids go to the smaller number, so equal vectors may leave later centroids empty: these stay as they are.
    Null vectors and vectors of another length, or with a null or non-finite component, take no part and have no row.
    A null vec_id counts as empty text. Fewer than k vectors: as many centroids. No vectors: no rows. Repeated rows
    each count. Other columns are ignored. Distances and sums are exact; those beyond 2^63 - 1 are given as that, and components
    beyond 2^90 count as 2^90.
    """
    data = prepared(vectors, vec_id, embedding, scale)
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = data.orderBy(name, "v", "digits").limit(k).select("v", "digits").collect()
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>"
    if not first:
        return vectors.sparkSession.createDataFrame([], shape)
    centroids = Centroids([[int(e) for e in (r["digits"] or r["v"])] for r in first])
    for _ in range(rounds):
        centroids = Centroids(next_centroids(data, centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, z in batches_of(batches):
            cluster, d, _ = centroids.assign(v, z)
            d = np.minimum(d, LONG).astype(np.int64) if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])
        release()

    final = written(data.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroid-clusters", replaces=[data])
    inertia = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(j, min(d, LONG), min(sum(inertia.values()), LONG), [str(e) for e in centroids.wide[j]]) for j, d in inertia.items()]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return final.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # at most k rows are sent
