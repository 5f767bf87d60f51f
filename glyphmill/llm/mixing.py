"""Operator 7: mix overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they count for). On that small network
each pattern offers its words once per copy, at a cost that rises with every repetition, each source asks
for its target, and a minimum-cost flow routes words from patterns to sources. A pattern's flow then is
whole copies of all of its documents plus one more copy of those first in a seeded order.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_COPIES = 3
#: Membership patterns (and sources) that the network may have; the plan, broadcast, has a row for each.
MAX_PATTERNS = 20_000
_SEP, _NONE = ",", "~"


def water_fill(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> dict[str | None, float]:
    """Targets that share the sum of sizes by weight; none above max_copies times its size, the excess reshared.

    Sources take the weights in turn in code-point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: max_copies * n for s, n in order}
    left, open_, out = sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = float(cap[s])
            left -= cap[s]
            open_.remove(s)
    return out


def min_cost_flow(patterns: dict[str, tuple[int, tuple]], quotas: dict, max_copies: int = MAX_COPIES) -> dict[str, int]:
    """Words taken of each pattern. patterns: words and sources of each; quotas: words asked for by each source.

    The r-th copy of a word costs r - 1, so repeats spread before they pile up (convex). Successive shortest paths.
    """
    p_at = {p: i + 2 for i, p in enumerate(patterns)}
    s_at = {s: i + 2 + len(patterns) for i, s in enumerate(quotas)}
    graph: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(quotas))]
    to, room, cost = [], [], []

    def arc(a: int, b: int, n: int, c: int) -> None:
        for x, y, m, k in ((a, b, n, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(m)
            cost.append(k)

    for p, (words, sources) in patterns.items():
        for r in range(max_copies):
            arc(0, p_at[p], words, r)
        for s in sources:
            if s in s_at:
                arc(p_at[p], s_at[s], max_copies * words, 0)
    for s, quota in quotas.items():
        arc(s_at[s], 1, quota, 0)
    while True:
        far, by = [math.inf] * len(graph), [-1] * len(graph)
        far[0], queue, queued = 0, deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if room[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if by[1] < 0:
            break
        path, b = [], 1
        while b:
            path.append(by[b])
            b = to[by[b] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {p: sum(room[e] for e in graph[p_at[p]] if to[e] == 0) for p in patterns}


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pattern_of(sources: Column) -> Column:
    """A text that names a set of sources, given as an array, in code point order (a null element counts as a source, the last one; so
    does an empty array)."""
    names = F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), F.hex(s.cast("string").cast("binary"))), F.lit(_NONE)))
    return F.when(F.size(sources) > 0, F.array_join(F.array_sort(F.array_distinct(names)), _SEP)).otherwise(_NONE)


def place_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in the seeded order: by its id and its text, so rows that share an id spread."""
    words = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), words))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """sized: pattern, place, size. The plan: pattern, pattern_size, source_size, target (both of the pattern's first source), copies, cut, ties.

    A document is taken `copies` times, and once more if its place is below `cut`, or is the cut and the row is one of the first `ties` there:
    only rows that are the same in id and text share a place. Patterns are summed by
    Spark; their small table is solved on the driver. The cut comes from sums over 4096 ranges of places and
    a running sum within one range, so no task sorts a whole source.
    """
    spark = sized.sparkSession
    ranges = sized.groupBy("pattern", F.substring("place", 1, 3).alias("range")).agg(F.sum("size").alias("size"))
    sums = [(r[0], r[1]) for r in ranges.groupBy("pattern").agg(F.sum("size")).limit(MAX_PATTERNS + 1).collect()]
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    members = {p: tuple(None if s == _NONE else bytes.fromhex(s[1:]).decode() for s in p.split(_SEP)) for p, _ in sums}
    by_source: dict[str | None, int] = {}
    for p, n in sums:
        for s in members[p]:
            by_source[s] = by_source.get(s, 0) + n
    targets = water_fill(list(by_source.items()), weights, max_copies)
    flow = min_cost_flow({p: (n, members[p]) for p, n in sums}, {s: math.floor(t + 0.5) for s, t in targets.items()}, max_copies)
    rows = [(p, n, by_source[members[p][0]], float(targets[members[p][0]]), flow[p] // n if n else 0, flow[p] % n if n else 0) for p, n in sums]
    solved = F.broadcast(spark.createDataFrame(rows, "pattern string, pattern_size long, source_size long, target double, copies long, rest long"))
    w = Window.partitionBy("pattern").orderBy("range")
    before = ranges.withColumn("before", F.sum("size").over(w) - F.col("size")).join(solved, "pattern").filter("before <= rest")
    edge = before.groupBy("pattern").agg(F.max(F.struct("range", "before")).alias("e")).select("pattern", "e.range", "e.before")
    inside = sized.withColumn("range", F.substring("place", 1, 3)).join(F.broadcast(edge), ["pattern", "range"]).join(solved.select("pattern", "rest"), "pattern")
    inside = inside.groupBy("pattern", "range", "place").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    room = F.col("rest") - F.col("before") - F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("pattern", "range").orderBy("place")) + F.col("n") * F.col("size")
    fits = F.when((F.col("size") > 0) & (2 * F.col("room") + F.col("size") >= 0), F.least(F.col("n"), F.expr("(2 * room + size) div (2 * greatest(size, 1))"))).when((F.col("size") == 0) & (F.col("room") >= 0), F.col("n")).otherwise(0)
    cut = inside.withColumn("room", room).withColumn("ties", fits.cast("long")).filter("ties > 0").groupBy("pattern").agg(F.max(F.struct("place", "ties")).alias("c"))
    plan = solved.join(edge.select("pattern", "range"), "pattern", "left").join(cut, "pattern", "left")
    return plan.select("pattern", "pattern_size", "source_size", "target", "copies", F.coalesce("c.place", "range", F.lit("")).alias("cut"), F.coalesce("c.ties", F.lit(0).cast("long")).alias("ties"))


def with_extra(placed: DataFrame, keep: list[str]) -> DataFrame:
    """placed: columns to keep, and pattern, place, cut, ties under `_mix_`. Adds _mix_extra: 1 for rows that are taken once more.

    Rows at the cut are alike but for columns that no choice looks at; they are numbered over salts, so very many repeats of a row spread.
    """
    from glyphmill.llm.common import written

    rest = placed.filter("_mix_place <> _mix_cut").select(*keep, F.when(F.col("_mix_place") < F.col("_mix_cut"), 1).otherwise(0).alias("_mix_extra"))
    ties = written(placed.filter("_mix_place = _mix_cut").withColumn("_mix_salt", F.monotonically_increasing_id() % 1024), "mix-ties")
    w = Window.partitionBy("_mix_pattern").orderBy("_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = ties.groupBy("_mix_pattern", "_mix_salt").agg(F.count("*").alias("n")).select("_mix_pattern", "_mix_salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_mix_before"))
    nth = F.row_number().over(Window.partitionBy("_mix_pattern", "_mix_salt").orderBy("_mix_place"))
    ties = ties.join(before, ["_mix_pattern", "_mix_salt"]).withColumn("_mix_nth", nth)
    return rest.unionByName(ties.select(*keep, F.when(F.col("_mix_before") + F.col("_mix_nth") <= F.col("_mix_ties"), 1).otherwise(0).alias("_mix_extra")))


def sized_documents(docs: DataFrame, sources: Column, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), pattern_of(sources).alias("pattern"), place_of(F.col(doc_id), F.col(text), seed).alias("place"), word_count(F.col(text)).alias("size"))


def mix(docs: DataFrame, sources: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (of its source; of the first for several), taken.

    sources: an array column of the sources a document counts for; by default the column `source` alone. A null
    source is a source of its own. Null or empty texts have size 0 and nothing is taken of them. Rows that share a
    doc_id spread by their texts, and repeated rows are taken one by one. An empty table gives no rows.
    """
    from glyphmill.llm.common import written

    sized = written(sized_documents(docs, F.array("source") if sources is None else sources, text, doc_id, seed), "sizes")
    plan = mixing_plan(sized, weights).withColumnsRenamed({c: f"_mix_{c}" for c in ("pattern", "copies", "cut", "ties")})
    placed = sized.withColumnsRenamed({"pattern": "_mix_pattern", "place": "_mix_place"}).join(F.broadcast(plan), "_mix_pattern")
    keep = ["doc_id", "size", "source_size", "target", "_mix_copies"]
    return with_extra(placed, keep).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("_mix_copies") + F.col("_mix_extra"))).alias("taken"))


def take_mix(docs: DataFrame, sources: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that the mix takes, with their columns, each as often as it is taken (see mix). Texts without words go."""
    from glyphmill.llm.common import written

    sources = F.array("source") if sources is None else sources
    plan = mixing_plan(written(sized_documents(docs, sources, text, doc_id, seed), "sizes"), weights)
    plan = F.broadcast(plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("pattern", "copies", "cut", "ties")]))
    d = docs.withColumns({"_mix_pattern": pattern_of(sources), "_mix_place": place_of(F.col(doc_id), F.col(text), seed)}).join(plan, "_mix_pattern")
    d = with_extra(d, [*docs.columns, "_mix_copies"])
    n = F.col("_mix_copies") + F.col("_mix_extra")
    n = F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), n).otherwise(0)
    return d.withColumn("_mix_n", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[F.col(c) for c in docs.columns])
