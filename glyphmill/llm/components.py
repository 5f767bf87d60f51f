"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: the smallest node of each node's component.

    Each round is two group-bys over edges that shrink towards stars; every round is written to the shared folder,
    so a lost executor costs no more than the round. Rounds go on until the edges are stars. Null ends and loops are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v and a is not null and b is not null").distinct()
    e = written(e, "edges")
    before = None
    while True:
        # large-star: every larger neighbour of u points to u's smallest neighbour (u included)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: u and its smaller neighbours point to the smallest of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
        e = written(small, "edges", replaces=[e])
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
