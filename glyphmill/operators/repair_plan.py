"""The repair plan: operations over findings, some of which claim several refs at once, settled in a fixed order of passes.

findings: report, ord, rule, folder (a finding of the whole folder), ref, w, h, best_mime, content_class. related: report, ord, place, ref: the members of
findings about several refs, in order. owners: report, grp, owner, consumer (null for an owner alone). packs: report, pack, ref.
Everything is by report, so many folders are planned together.

A pass leaves alone what earlier ones have claimed. All but one are joins against flags of refs; findings that merge sheets may
compete for members, and are settled in rounds of those that come first for all of their members.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.storage import written

MIMES = ("image/png", "image/webp", "image/jpeg", "image/avif")
REF = ["report", "ref"]


@dataclass(frozen=True)
class PlanOptions:
    target_mime: str = "image/webp"
    lossless: bool = False
    max_edge: int = 2048
    aggressive: bool = False  # merge sheets and drop duplicates: references change
    opaque: bool = False
    strip: bool = False
    best_format: bool = False
    frame_redundancy: bool = True
    trim_margin: bool = True
    tiers: bool = False
    extrude: int = 0


def merges(claims: DataFrame) -> DataFrame:
    """claims: report, ord, ref: members that findings may merge. Those of each finding that it gets: the earliest finding has all its members that
    are left, if they are two at least.

    Each round settles the findings that come first for every member they have left, so no two of a round share one.
    """
    left = written(claims.select("report", "ord", "ref").distinct(), "merge-claims")
    out = None
    while not left.isEmpty():
        first = left.groupBy(REF).agg(F.min("ord").alias("first"))
        c = left.join(first, REF).groupBy("report", "ord").agg(F.bool_and(F.col("ord") == F.col("first")).alias("ready"), F.count("*").alias("n")).filter("ready")
        c = written(c, "merge-ready")
        won = written(left.join(c.filter("n >= 2").select("report", "ord"), ["report", "ord"], "left_semi"), "merge-won")
        out = won if out is None else out.unionByName(won)
        left = written(left.join(c.select("report", "ord"), ["report", "ord"], "left_anti").join(won.select(REF), REF, "left_anti"), "merge-claims")
    return claims.select("report", "ord", "ref").limit(0) if out is None else out


def plan(findings: DataFrame, related: DataFrame, owners: DataFrame | None = None, packs: DataFrame | None = None, atlases: DataFrame | None = None, tierable: DataFrame | None = None, o: PlanOptions = PlanOptions()) -> DataFrame:
    """report, pass, ord, op, ref, owner, to_w, to_h, target_mime, lossless, opaque, repoint, keep_consumer, extrude: a row for each ref of each operation, which
    report, pass and ord name (a group to pack by its place among the report's groups).

    Passes: 1 drop of duplicates with an owner, 2 pack, 3 merge of sheets (op repack over several refs), 4 repack, resize and drop in the order of findings, 5 transcode, 6
    opaque transcode, 7 strip. An owner is never dropped, merged, repacked or resized. In pass 4 findings
    settle in their order: a repack keeps later operations on its ref away but not earlier ones, and a copy may be dropped though it was to be scaled. Passes 5 to 7
    claim each ref once, and none that a pass before them re-encodes. atlases: report, ref, the refs that are sheets with
    manifests. tierable: report, ref, what the ladder of tiers may take, if tiers are on; null: everything.
    """
    none = lambda name: findings.select(*REF).limit(0).withColumn(name, F.lit(None).cast("string"))
    flag = lambda df, name: df.select(REF).distinct().withColumn(name, F.lit(True))
    owned = owners if o.aggressive and owners is not None else None
    own = flag(owned.select("report", F.col("owner").alias("ref")), "owns") if owned is not None else none("owns").withColumn("owns", F.lit(True))
    drops = None
    if owned is not None:
        first = owned.filter("consumer is not null").groupBy("report", F.col("consumer").alias("ref")).agg(F.min(F.struct("grp", "owner")).alias("g"))
        sheet = flag(atlases, "sheet") if atlases is not None else none("sheet").withColumn("sheet", F.lit(True))
        drops = written(first.join(own, REF, "left_anti").join(sheet, REF, "left").select(*REF, F.col("g.grp").alias("grp"), F.col("g.owner").alias("owner"), (F.coalesce("sheet", F.lit(False)) & F.lit(not o.tiers)).alias("repoint")), "plan-drops")
    dropped = flag(drops, "dropped") if drops is not None else none("dropped").withColumn("dropped", F.lit(True))
    packed = written(packs.join(dropped, REF, "left_anti").select("report", "pack", "ref").distinct(), "plan-packs") if packs is not None else None
    in_pack = flag(packed, "packed") if packed is not None else none("packed").withColumn("packed", F.lit(True))
    merged = None
    if o.aggressive:
        m = related.join(findings.filter("rule = 'atlas-merge'").select("report", "ord"), ["report", "ord"], "left_semi")
        merged = merges(m.join(own, REF, "left_anti").join(dropped, REF, "left_anti"))
    in_merge = flag(merged, "merged") if merged is not None else none("merged").withColumn("merged", F.lit(True))

    # pass 4: what each ref's findings ask for, with flags of what has claimed it
    repacks = ["occupancy", "wasted-regions", *(["frame-redundancy"] if o.frame_redundancy else []), *(["trim-margin"] if o.trim_margin else [])]
    mine = findings.filter(F.col("rule").isin("occupancy", "wasted-regions") | ~F.col("folder"))
    at = lambda *when: F.min(F.when(F.lit(True) if not when else when[0], F.col("ord")))
    rule = lambda *names: F.col("rule").isin(*names)
    longest = F.greatest("w", "h")
    asked = mine.groupBy(REF).agg(
        at(rule(*repacks)).alias("repack_at"), F.min(F.when(rule("dimensions-oversize") & (F.col("w") > 0) & (F.col("h") > 0) & (longest > o.max_edge), F.struct("ord", "w", "h"))).alias("big"),
        F.min(F.when(rule("format") & ~F.col("folder"), F.struct("ord", "best_mime", "content_class"))).alias("format"), at(rule("wasted-alpha") & ~F.col("folder")).alias("opaque_at"), at(rule("strippable-metadata") & ~F.col("folder")).alias("strip_at"),
        F.bool_or(~F.col("folder")).alias("single"),
    )
    copies = None
    if o.aggressive:
        rules = ("duplicate-similar",) if owned is not None else ("duplicate-exact", "duplicate-similar")
        d = related.filter("place > 0").join(findings.filter(rule(*rules)).select("report", "ord", "rule"), ["report", "ord"])
        copies = d.groupBy(REF).agg(F.min(F.struct("ord", "rule")).alias("copy"))
        asked = asked.join(copies, REF, "full_outer")
    else:
        asked = asked.withColumn("copy", F.lit(None).cast("struct<ord:bigint,rule:string>"))
    for df in (own, dropped, in_pack, in_merge):
        asked = asked.join(df, REF, "left")
    if o.tiers and tierable is not None:
        asked = asked.join(flag(tierable, "tierable"), REF, "left")
    else:
        asked = asked.withColumn("tierable", F.lit(o.tiers))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    free = ~yes("owns") & ~yes("merged")
    late = lambda c: F.col("repack_at").isNull() | (c < F.col("repack_at"))
    a = asked.withColumn("repack_at", F.when(free, F.col("repack_at")))
    a = a.withColumn("tiered", yes("tierable") & yes("single") & ~yes("dropped") & ~yes("packed") & free & F.col("repack_at").isNull())
    a = a.withColumn("resized", F.coalesce(F.col("big").isNotNull() & free & ~F.col("tiered") & late(F.col("big.ord")), F.lit(False)))
    a = a.withColumn("copy_dropped", F.coalesce(F.col("copy").isNotNull() & free & ~yes("dropped") & late(F.col("copy.ord")), F.lit(False)))
    gone = yes("dropped") | F.col("copy_dropped")
    taken = F.col("resized") | gone | yes("packed") | F.col("tiered")
    is_repacked = F.col("repack_at").isNotNull() | yes("merged")
    a = a.withColumn("transcoded", F.coalesce(F.col("format").isNotNull() & ~is_repacked & ~taken, F.lit(False)))
    want_opaque = F.lit(o.opaque) & F.col("opaque_at").isNotNull()
    a = a.withColumns({"opaqued": want_opaque & ~F.col("transcoded") & ~taken, "wants_opaque": want_opaque})
    a = a.withColumn("stripped", F.lit(o.strip) & F.col("strip_at").isNotNull() & ~F.col("transcoded") & ~F.col("opaqued") & ~taken & ~is_repacked & ~yes("owns"))
    a = written(a.select(*REF, "repack_at", "big", "format", "copy", "opaque_at", "strip_at", "resized", "copy_dropped", "transcoded", "opaqued", "stripped", "wants_opaque"), "plan-refs")

    null = lambda kind: F.lit(None).cast(kind)
    bleed = F.lit(max(0, o.extrude)).cast("long") if o.extrude > 0 else null("long")
    target = F.lit(o.target_mime)

    def rows(df: DataFrame, pass_: int, op: str, ord_: Column, **cols: Column) -> DataFrame:
        base = {"owner": null("string"), "to_w": null("long"), "to_h": null("long"), "target_mime": null("string"), "lossless": null("boolean"), "opaque": null("boolean"), "repoint": null("boolean"), "keep_consumer": null("boolean"), "extrude": null("long"), **cols}
        return df.select("report", F.lit(pass_).alias("pass"), ord_.cast("long").alias("ord"), F.lit(op).alias("op"), "ref", *[c.alias(k) for k, c in base.items()])

    s = F.lit(float(o.max_edge)) / F.greatest("big.w", "big.h")
    scaled = lambda c: F.floor(F.col(c) * s + 0.5).cast("long")
    plain = F.coalesce(F.col("format.content_class").isin("flat", "alpha-art"), F.lit(False)) | F.lit(o.lossless)
    mime = F.when(F.lit(o.best_format) & F.col("format.best_mime").isin(*MIMES), F.col("format.best_mime")).otherwise(target)
    parts = [
        rows(a.filter("repack_at is not null"), 4, "repack", F.col("repack_at"), target_mime=target, extrude=bleed), rows(a.filter("resized"), 4, "resize", F.col("big.ord"), to_w=scaled("big.w"), to_h=scaled("big.h"), target_mime=target),
        rows(a.filter("copy_dropped"), 4, "drop", F.col("copy.ord")), rows(a.filter("transcoded"), 5, "transcode", F.col("format.ord"), target_mime=mime, lossless=plain, opaque=F.col("wants_opaque")),
        rows(a.filter("opaqued"), 6, "transcode", F.col("opaque_at"), target_mime=target, lossless=F.lit(o.lossless), opaque=F.lit(True)), rows(a.filter("stripped"), 7, "strip", F.col("strip_at")),
    ]
    if drops is not None:
        parts.append(rows(drops, 1, "drop", F.col("grp"), owner=F.col("owner"), repoint=F.col("repoint"), keep_consumer=F.lit(o.tiers)))
    if packed is not None:
        parts.append(rows(packed, 2, "pack", F.col("pack"), target_mime=target, extrude=bleed))
    if merged is not None:
        parts.append(rows(merged, 3, "repack", F.col("ord"), target_mime=target, extrude=bleed))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
