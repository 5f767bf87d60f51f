"""Images that look alike: difference hashes within a few bits, and greedy groups of them.

Candidates come from a multi-index: a hash is cut into more blocks than two near ones may differ in, so some set of blocks is equal in both, and
hashes meet by each set of so many blocks. The more hashes there are, the more blocks a set has, so that few meet by chance. Groups are those of a greedy loop in input order, found in rounds: all
images that come first among their neighbours' neighbours take their groups at once, since nothing before them can claim what they claim.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.config import DEFAULT, Thresholds
from glyphmill.plans.storage import written

#: Hashes up to which sets of two blocks are compared; each further block in a set lets in MORE times as many.
FEW = 1 << 19
MORE = 1 << 5


def block_masks(size: int, most: int) -> list[int]:
    """The bits of each of size + most blocks of a 64-bit hash, as signed numbers."""
    cuts = [64 * i // (size + most) for i in range(size + most + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def meetings(values: DataFrame, n: int, most: int) -> tuple[DataFrame, list[int]]:
    """values: value, n distinct 64-bit numbers. set, part, value, near: each smaller number beside those that agree with it over a set of blocks, once for each
    set; and the blocks."""
    size = 2
    while n > FEW * MORE ** (size - 2) and size < 4:
        size += 1
    masks = block_masks(size, most)
    sets = F.array(*[F.struct(F.lit(sum(1 << i for i in some)).alias("set"), F.lit(sum(masks[i] for i in some)).cast("long").alias("mask")) for some in combinations(range(len(masks)), size)])
    # dealt by number and joined by sorting: the optimiser takes the size of few numbers for that of their many keys
    dealt = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
    met = dealt.select("value", F.inline(sets)).select("set", F.col("value").bitwiseAND(F.col("mask")).alias("part"), "value").hint("merge")
    a, b = met.alias("a"), met.alias("b")
    pair = a.join(b, (F.col("a.set") == F.col("b.set")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.value") < F.col("b.value")))
    return pair.select("a.set", "a.part", "a.value", F.col("b.value").alias("near")), masks


def similar_candidates(features: DataFrame, most: int = 6) -> DataFrame:
    """d_hash, other, distance: pairs of distinct difference hashes within `most` bits, the smaller first. None is missed. Hashes have 16 hexadecimal digits."""
    half = lambda at: F.conv(F.substring("d_hash", at, 8), 16, 10).cast("long")
    h = features.filter(F.col("d_hash").rlike("^[0-9A-Fa-f]{16}$")).select("d_hash").distinct().withColumn("value", F.shiftleft(half(1), 32).bitwiseOR(half(9)))
    met, masks = meetings(h.select("value").distinct(), h.count(), most)
    x = F.col("value").bitwiseXOR(F.col("near"))
    pair = met.withColumn("distance", F.bit_count(x)).filter(F.col("distance") <= most)
    # a pair meets by each set of its equal blocks, and is taken by the first of them: no block before its last one is equal besides
    others = [F.when((F.col("set").bitwiseAND(1 << i) == 0) & (F.col("set") > 1 << i) & (x.bitwiseAND(F.lit(m)) == 0), 1).otherwise(0) for i, m in enumerate(masks)]
    pair = pair.filter(sum(others, F.lit(0)) == 0).select("value", "near", "distance")
    same = h.groupBy("value").count().filter("count > 1").select("value", F.col("value").alias("near"), F.lit(0).alias("distance"))  # spelled in two ways
    spelled = h.select(F.col("value").alias("near"), F.col("d_hash").alias("with"))
    out = pair.unionByName(same).join(h, "value").join(spelled, "near").filter((F.col("value") < F.col("near")) | (F.col("d_hash") < F.col("with")))
    return out.select(F.least("d_hash", "with").alias("d_hash"), F.greatest("d_hash", "with").alias("other"), "distance")


def _near_color(t: Thresholds, a: str, b: str):
    """Whether two mean colours are no further apart than allowed in any channel; unknown ones never part."""
    far = F.greatest(*[F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in ("mean_r", "mean_g", "mean_b")])
    unknown = F.col(f"{a}.mean_r").isNull() | F.col(f"{b}.mean_r").isNull() | F.col(f"{a}.mean_g").isNull() | F.col(f"{b}.mean_g").isNull() | F.col(f"{a}.mean_b").isNull() | F.col(f"{b}.mean_b").isNull()
    return unknown | (far <= t.color)


def duplicate_similar(features: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """group (its first ref), asset_ref: greedy complete linkage in input order (ord, then asset_ref) over hashes and mean colours. Groups of one content are left
    out, and their members stay used.

    Images of one hash and colour move together and are one node. Rounds end when no near pair is left; a round settles at least each
    component's first node. Near pairs of one hash with very many colours are listed.
    """
    color = ("mean_r", "mean_g", "mean_b")
    f = features.filter("d_hash is not null").select("asset_ref", "ord", "content_hash", "d_hash", *[F.col(c).cast("double").alias(c) for c in color])
    f = f.withColumn("key", F.concat_ws("|", "d_hash", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in color]))
    node = written(f.groupBy("key").agg(F.min(F.struct("ord", "asset_ref")).alias("id"), F.first("d_hash").alias("d_hash"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in color]), "similar-nodes")
    packed = lambda name: node.select("d_hash", F.struct("id", "d_hash", *color).alias(name))
    pairs = similar_candidates(node, t.hamming).select("d_hash", "other").unionByName(node.groupBy("d_hash").count().filter("count > 1").select("d_hash", F.col("d_hash").alias("other")))
    e = packed("x").join(pairs, "d_hash").select("x", F.col("other").alias("d_hash")).join(packed("y"), "d_hash").filter(_near_color(t, "x", "y"))
    swap = F.col("x.id") > F.col("y.id")
    e = e.filter("x.id <> y.id").select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b")).distinct()
    edges, found = written(e, "similar-edges"), None

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def near(p, q) -> bool:
            known = all(p[c] is not None and q[c] is not None for c in color)
            return (int(p["d_hash"], 16) ^ int(q["d_hash"], 16)).bit_count() <= t.hamming and not (known and max(abs(p[c] - q[c]) for c in color) > t.color)

        for pdf in batches:
            rows = []
            for seed, around in zip(pdf["seed"], pdf["around"], strict=True):
                group: list = []
                for q in around:
                    if all(near(p, q) for p in group):
                        group.append(q)
                rows += [(seed, q["id"]) for q in group]
            yield pd.DataFrame(rows, columns=["seed", "id"])

    kind = f"struct<ord:{features.schema['ord'].dataType.simpleString()},asset_ref:{features.schema['asset_ref'].dataType.simpleString()}>"
    while not edges.isEmpty():
        both = edges.select(F.col("a.id").alias("v"), F.col("b.id").alias("u")).unionAll(edges.select(F.col("b.id").alias("v"), F.col("a.id").alias("u")))
        low = written(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("low")), "similar-low")
        around = both.join(low.select(F.col("v").alias("u"), "low"), "u").groupBy("v").agg(F.min("low").alias("low2"))
        seeds = low.filter("low = v").join(around.filter("low2 = v").select("v"), "v", "left_semi").select(F.col("v").alias("seed"))
        lists = edges.withColumn("seed", F.col("a.id")).join(seeds, "seed", "left_semi").groupBy("seed").agg(F.array_sort(F.collect_list("b")).alias("around"))
        won = written(lists.mapInPandas(link, f"seed {kind}, id {kind}"), "similar-won")
        found = won if found is None else found.unionByName(won)
        used = won.select("id").unionAll(won.select(F.col("seed").alias("id"))).distinct()
        left = edges.join(used, edges["a.id"] == used["id"], "left_anti").join(used, F.col("b.id") == used["id"], "left_anti")
        edges = written(left, "similar-edges")
    groups = node.filter("n > 1").select(F.col("id").alias("seed"), "id")
    if found is not None:
        taken = written(found.unionByName(found.select("seed", F.col("seed").alias("id")).distinct()), "similar-found")
        groups = taken.unionByName(groups.join(taken.select("id"), "id", "left_anti").select("seed", "id"))
    m = f.join(node.select("key", "id"), "key").join(groups, "id").select(F.col("seed.asset_ref").alias("group"), "asset_ref", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    several = m.groupBy("group").agg(F.min("content_hash").alias("lo"), F.max("content_hash").alias("hi")).filter("lo <> hi").select("group")
    return m.join(several, "group").select("group", "asset_ref")
