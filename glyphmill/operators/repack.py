"""Sheets packed anew: equal frames once, transparent margins trimmed, quarter turns where they pay.

sprites: asset_ref, sprite_idx, x, y, w, h (as placed), rotated, trimmed, frame_hash, src_w, src_h, off_x, off_y (of frames trimmed already), and
trim_x, trim_y, trim_w, trim_h, the opaque box of untrimmed frames (null: not measured). groups: group, asset_ref, ord: sheets that become
one. Grouping, aliases, trims and the rows that come out are joins and aggregates; only the packing of a group is sequential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.operators.groups import over_groups
from glyphmill.operators.maxrects import pack_items

MOST = 4096


def repack_items(sprites: DataFrame, groups: DataFrame, least: int = 2, alone: bool = False) -> DataFrame:
    """Every frame with the frame that stands for it (rep_ref, rep_idx) and what that one packs at: pack_w, pack_h, tight, turnable.

    Frames of one hash in a group share the first of them if they lie in `least` distinct places. A representative is trimmed to its opaque box
    if that is smaller than the frame, unless the frame is trimmed or turned already, or one that it stands for is: that one's source size and
    anchor wouldn't survive. A group may be turned if none of its frames is turned and none is trimmed anew. alone: groups are single sheets under
    their own refs, by which the join has dealt them.
    """
    # rows are dealt by group once, and every step looks at frames beside each other: a group is packed in one task anyway
    s = sprites.join(groups.select("asset_ref", "ord"), "asset_ref").withColumn("group", F.col("asset_ref")) if alone else sprites.join(groups, "asset_ref").repartition("group")
    s = s.withColumn("at", F.struct("ord", "asset_ref", "sprite_idx"))
    key = "asset_ref" if alone else "group"
    hashed = Window.partitionBy(key, "frame_hash")
    s = s.withColumns({"nth_place": F.dense_rank().over(hashed.orderBy("asset_ref", "x", "y", "w", "h")), "first": F.min("at").over(hashed)})
    s = s.withColumn("places", F.max("nth_place").over(hashed))
    shared = F.col("frame_hash").isNotNull() & (F.col("places") >= least)
    s = s.withColumns({"rep": F.when(shared, F.col("first")).otherwise(F.col("at")), "places": F.when(shared, F.col("places").cast("long")).otherwise(F.lit(1).cast("long"))})
    other, block = F.col("rep") != F.col("at"), Window.partitionBy(key, "rep")
    s = s.withColumns({"blocked": F.bool_or(other & (F.col("trimmed") | F.col("rotated"))).over(block), "r": F.max(F.when(~other, F.struct("w", "h", "trimmed", "rotated", "src_w", "src_h", "trim_x", "trim_y", "trim_w", "trim_h"))).over(block)})
    inside = (F.col("r.trim_w") > 0) & (F.col("r.trim_h") > 0) & ((F.col("r.trim_x") > 0) | (F.col("r.trim_y") > 0) | (F.col("r.trim_w") < F.col("r.w")) | (F.col("r.trim_h") < F.col("r.h")))
    s = s.withColumn("tight", F.coalesce(inside & ~F.col("blocked") & ~F.col("r.trimmed") & ~F.col("r.rotated"), F.lit(False)))
    s = s.withColumns({"pack_w": F.when(F.col("tight"), F.col("r.trim_w")).otherwise(F.col("r.w")), "pack_h": F.when(F.col("tight"), F.col("r.trim_h")).otherwise(F.col("r.h"))})
    s = s.withColumn("turnable", ~F.bool_or(F.col("rotated") | F.col("tight")).over(Window.partitionBy(key)))
    return s.select(
        "group", "asset_ref", "sprite_idx", F.col("rep.asset_ref").alias("rep_ref"), F.col("rep.sprite_idx").alias("rep_idx"), "x", "y", "w", "h", "rotated", "trimmed", "src_w", "src_h", "off_x", "off_y", "pack_w", "pack_h", "tight", "turnable",
        F.col("r.trim_x").alias("rep_trim_x"), F.col("r.trim_y").alias("rep_trim_y"), F.col("r.src_w").alias("rep_src_w"), F.col("r.src_h").alias("rep_src_h"), "places", "ord",
    )


def _own(items: DataFrame) -> DataFrame:
    return items.filter("asset_ref = rep_ref and sprite_idx = rep_idx")


def place_items(items: DataFrame, padding: int = 2, gutter: int = 0, most: int = MOST, rotation: bool = True) -> DataFrame:
    """group, rep_ref, rep_idx, bin, bin_w, bin_h, px, py, turned: the representatives of each group packed. Turnable groups are packed a second time
    with quarter turns, which count only if they take strictly fewer bytes."""

    def one(g: dict[str, list]) -> list[tuple]:
        sizes = list(zip(g["pack_w"], g["pack_h"], strict=True))
        bins = pack_items(sizes, most, padding, gutter)
        if rotation and g["turnable"][0]:
            turned = pack_items(sizes, most, padding, gutter, turn=True)
            if sum(w * h for w, h, _ in turned) < sum(w * h for w, h, _ in bins):
                bins = turned
        return [(g["group"][i], g["rep_ref"][i], g["rep_idx"][i], k, w, h, *p) for k, (w, h, places) in enumerate(bins) for i, p in places.items()]

    kinds = {f.name: f.dataType for f in items.schema.fields}
    schema = StructType().add("group", kinds["group"]).add("rep_ref", kinds["rep_ref"]).add("rep_idx", kinds["rep_idx"])
    for c in ("bin", "bin_w", "bin_h", "px", "py"):
        schema = schema.add(c, "long")
    own = _own(items).select("group", "ord", "rep_ref", "rep_idx", "pack_w", "pack_h", "turnable")
    return over_groups(own, "group", ["ord", "rep_ref", "rep_idx"], one, ["group", "rep_ref", "rep_idx", "bin", "bin_w", "bin_h", "px", "py", "turned"], schema.add("turned", "boolean"))


def repacked_frames(items: DataFrame, placed: DataFrame, bottom_left: bool = False) -> DataFrame:
    """Every frame as its new sheet describes it: group, bin, asset_ref, sprite_idx, x, y, w, h, rotated, trimmed, src_w, src_h, off_x, off_y, copied.

    Frames with one representative share its place. They have its trim too, if it is trimmed anew, and otherwise keep their own source
    size and offset. Offsets count from the top, or from the bottom for skeletons. copied: the pixels are written from this frame.
    """
    f = items.join(placed, ["group", "rep_ref", "rep_idx"])
    turn = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    new = lambda rep, own: F.when(F.col("tight"), rep).otherwise(own)
    down = F.col("rep_src_h") - F.col("rep_trim_y") - F.col("pack_h") if bottom_left else F.col("rep_trim_y")
    return f.select(
        "group", "bin", "asset_ref", "sprite_idx", F.col("px").alias("x"), F.col("py").alias("y"), turn("pack_w", "pack_h").alias("w"), turn("pack_h", "pack_w").alias("h"), (F.col("rotated") | F.col("turned")).alias("rotated"), (F.col("trimmed") | F.col("tight")).alias("trimmed"),
        new(F.col("rep_src_w"), F.col("src_w")).alias("src_w"), new(F.col("rep_src_h"), F.col("src_h")).alias("src_h"), new(F.col("rep_trim_x"), F.col("off_x")).alias("off_x"), new(down, F.col("off_y")).alias("off_y"),
        ((F.col("asset_ref") == F.col("rep_ref")) & (F.col("sprite_idx") == F.col("rep_idx"))).alias("copied"),
    )


def repack_totals(items: DataFrame, placed: DataFrame, atlases: DataFrame, groups: DataFrame) -> DataFrame:
    """Before and after of each group: sheets, texture bytes, occupancy (before: all frames; after: what is packed), aliased frames (distinct places beyond
    the first of a hash), trimmed frames and the pixels that frees, turned frames."""
    area = lambda w, h: F.col(w).cast("long") * F.col(h)
    before = groups.join(atlases.select("asset_ref", area("decl_w", "decl_h").alias("area")), "asset_ref").groupBy("group").agg(F.count("*").alias("sheets"), F.sum("area").alias("area_before"))
    own = (F.col("asset_ref") == F.col("rep_ref")) & (F.col("sprite_idx") == F.col("rep_idx"))
    of_own = lambda c: F.coalesce(F.sum(F.when(own, c)), F.lit(0))
    sums = items.groupBy("group").agg(
        F.sum(area("w", "h")).alias("covered"), F.sum(F.when(own, area("pack_w", "pack_h"))).alias("packed"), F.sum(F.when(own, F.col("places") - 1)).alias("aliased"), F.count_if(own & F.col("tight")).alias("trimmed"),
        of_own(F.when(F.col("tight"), area("w", "h") - area("pack_w", "pack_h"))).alias("reclaimed"),
    )
    bins = placed.groupBy("group", "bin").agg(F.first("bin_w").alias("w"), F.first("bin_h").alias("h"), F.count_if("turned").alias("turned"))
    after = bins.groupBy("group").agg(F.count("*").alias("bins"), F.sum(area("w", "h")).alias("area_after"), F.sum("turned").alias("turned"))
    t = before.join(sums, "group").join(after, "group")
    return t.select("group", "sheets", "bins", (F.col("area_before") * 4).alias("vram_before"), (F.col("area_after") * 4).alias("vram_after"), F.try_divide("covered", "area_before").alias("occupancy_before"), F.try_divide("packed", "area_after").alias("occupancy_after"), "aliased", "trimmed", "reclaimed", "turned")


def repack(sprites: DataFrame, atlases: DataFrame, groups: DataFrame | None = None, least: int = 2, **options) -> DataFrame:
    """Totals of repacking each sheet by itself, or groups of them as one (see place_items for options)."""
    from glyphmill.plans.storage import written

    alone = groups is None
    if alone:
        groups = atlases.select(F.col("asset_ref").alias("group"), "asset_ref", F.lit(0).cast("long").alias("ord"))
    used = ("group", "ord", "asset_ref", "sprite_idx", "rep_ref", "rep_idx", "w", "h", "pack_w", "pack_h", "tight", "turnable", "places")
    items = written(repack_items(sprites, groups, least, alone).select(*used), "repack-items")
    return repack_totals(items, place_items(items, **options), atlases, groups)


def merge_gain(sprites: DataFrame, groups: DataFrame, least: int = 2, **options) -> DataFrame:
    """group, vram_after, vram_plain, vram_reclaimed: what sharing frames over a group's sheets frees, against a pack of every frame at the same trims."""
    from glyphmill.plans.storage import written

    items = written(repack_items(sprites, groups, least), "items")
    alone = items.withColumns({"rep_ref": F.col("asset_ref"), "rep_idx": F.col("sprite_idx")})
    size = lambda df, name: df.groupBy("group", "bin").agg((F.first("bin_w") * F.first("bin_h") * 4).alias("v")).groupBy("group").agg(F.sum("v").alias(name))
    both = size(place_items(items, **options), "vram_after").join(size(place_items(alone, **options), "vram_plain"), "group")
    return both.select("group", "vram_after", "vram_plain", F.greatest(F.lit(0).cast("long"), F.col("vram_plain") - F.col("vram_after")).alias("vram_reclaimed"))


def names_after(frames: DataFrame, names: DataFrame) -> DataFrame:
    """Frames with their names, in name order within a sheet: what a manifest lists."""
    w = Window.partitionBy("group", "bin").orderBy("name", "asset_ref", "sprite_idx")
    return frames.join(names.select("asset_ref", "sprite_idx", "name"), ["asset_ref", "sprite_idx"]).withColumn("nth", F.row_number().over(w))
