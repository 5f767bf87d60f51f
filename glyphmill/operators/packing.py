"""Trial packing and repair planning.

Packing is sequential within a sheet, however large, and parallel over sheets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.operators.groups import over_groups
from glyphmill.operators.maxrects import pack_items, pack_one

#: A bound for callers of `pack` who want one, as the reference has it for its trial; no query uses it.
MAX_SPRITES = 2000


def pack(sprites: DataFrame, most: int = 4096, most_sprites: int | None = None) -> DataFrame:
    """asset_ref, sprite_idx, bin, bin_w, bin_h, x, y: each sheet's sprites, largest first, in the smallest bin that holds them all, otherwise in bins
    of the largest size. Sheets of over most_sprites, if given, are left out."""

    def one(g: dict[str, list]) -> list[tuple]:
        bins = pack_items(list(zip(g["w"], g["h"], strict=True)), most)
        return [(g["asset_ref"][i], g["sprite_idx"][i], k, w, h, x, y) for k, (w, h, places) in enumerate(bins) for i, (x, y, _) in places.items()]

    s = sprites
    if most_sprites is not None:
        s = s.join(s.groupBy("asset_ref").count().filter(F.col("count") <= most_sprites).select("asset_ref"), "asset_ref", "left_semi")
    schema = StructType().add("asset_ref", sprites.schema["asset_ref"].dataType)
    for c in ("sprite_idx", "bin", "bin_w", "bin_h", "x", "y"):
        schema = schema.add(c, "long")
    s = s.filter("w > 0 and h > 0").select("asset_ref", "sprite_idx", "w", "h")
    return over_groups(s, "asset_ref", ["sprite_idx"], one, ["asset_ref", "sprite_idx", "bin", "bin_w", "bin_h", "x", "y"], schema)


def packed_sizes(packed: DataFrame) -> DataFrame:
    """asset_ref, bins, n, bin_w, bin_h (of the largest bin)."""
    return packed.groupBy("asset_ref").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("n"), F.max("bin_w").alias("bin_w"), F.max("bin_h").alias("bin_h"))


def trial_sizes(sprites: DataFrame, room: DataFrame, most: int = 4096) -> DataFrame:
    """room: asset_ref, room, the pixels that a bin may have. The `packed_sizes` of `pack` for the sheets, of any number of sprites, that fit one bin
    within their room: as a bin is no smaller than what it holds, sheets of a larger area fit none, and only the others are packed."""

    def one(g: dict[str, list]) -> list[tuple]:
        fit = pack_one(list(zip(g["w"], g["h"], strict=True)), most, room=g["room"][0])
        return [(g["asset_ref"][0], 1, len(g["w"]), fit[0], fit[1])] if fit else []

    s = sprites.filter("w > 0 and h > 0").select("asset_ref", "sprite_idx", "w", "h")
    r = room.groupBy("asset_ref").agg(F.least(F.max("room"), F.lit(most * most)).alias("room"))
    area = s.groupBy("asset_ref").agg(F.sum(F.col("w").cast("double") * F.col("h")).alias("area"))  # exact below 2^53, and no room is as large
    schema = StructType().add("asset_ref", sprites.schema["asset_ref"].dataType)
    for c in ("bins", "n", "bin_w", "bin_h"):
        schema = schema.add(c, "long")
    s = s.join(area.join(r, "asset_ref").filter("area <= room").select("asset_ref", "room"), "asset_ref")
    return over_groups(s, "asset_ref", ["sprite_idx"], one, ["asset_ref", "bins", "n", "bin_w", "bin_h"], schema, spread=True)


def scale_atlas(sprites: DataFrame, atlases: DataFrame, scale: float) -> DataFrame:
    """Sheets and their rectangles at another scale. Sizes and places round by themselves, so frames are held inside the new sheet; nothing is
    smaller than 1. Adds the sheet's new size as sheet_w, sheet_h."""
    near = lambda c: F.floor(F.col(c) * scale + 0.5).cast("long")
    size = lambda c: F.greatest(F.lit(1).cast("long"), near(c))
    a = atlases.select("asset_ref", size("decl_w").alias("sheet_w"), size("decl_h").alias("sheet_h"))
    s = sprites.join(a, "asset_ref").withColumns({"nx": F.least(near("x"), F.col("sheet_w") - 1), "ny": F.least(near("y"), F.col("sheet_h") - 1)})
    return s.select("asset_ref", "sprite_idx", "sheet_w", "sheet_h", F.col("nx").alias("x"), F.col("ny").alias("y"), F.least(size("w"), F.col("sheet_w") - F.col("nx")).alias("w"), F.least(size("h"), F.col("sheet_h") - F.col("ny")).alias("h"))


def alias_map(sprites: DataFrame, least: int = 2) -> DataFrame:
    """asset_ref, sprite_idx, alias_of: frames that may use an equal one; the lowest place of the first of at least `least` distinct rectangles represents a hash."""
    g = sprites.filter("frame_hash is not null").groupBy("asset_ref", "frame_hash").agg(F.count_distinct("x", "y", "w", "h").alias("places"), F.min("sprite_idx").alias("alias_of")).filter(F.col("places") >= least)
    return sprites.join(g, ["asset_ref", "frame_hash"]).filter("sprite_idx <> alias_of").select("asset_ref", "sprite_idx", "alias_of")


def source_rects(trims: DataFrame) -> DataFrame:
    """Offsets of trimmed frames, from the top and, for skeletons, from the bottom."""
    return trims.select("asset_ref", "sprite_idx", "trim_x", "trim_y", (F.col("src_h") - F.col("trim_y") - F.col("trim_h")).alias("bottom_y"))


#: Operations that change how much memory textures take; those that only change files have disk figures alone, and a pack has none before it is done.
_TEXTURE_OPS = ("repack", "resize", "drop")


def plan_footprint(plan: DataFrame, figures: DataFrame) -> DataFrame:
    """plan: as `repair_plan.plan` gives it. figures: report, ref, disk_saved, vram_saved (null: not measured). By report and operation: operations, refs, what is
    predicted for disk and for textures, and refs without any figure, which are counted, not guessed."""
    p = plan.join(figures, ["report", "ref"], "left")
    disk = F.when(F.col("op") != "pack", F.col("disk_saved"))
    vram = F.when(F.col("op").isin(*_TEXTURE_OPS), F.col("vram_saved"))
    return p.groupBy("report", "op").agg(F.count_distinct("pass", "ord").alias("ops"), F.count("*").alias("refs"), F.sum(disk).alias("disk_saved"), F.sum(vram).alias("vram_saved"), F.count_if(disk.isNull() & vram.isNull()).alias("deferred"))


# fixed values: kinds of operations in the order of the receipt
OP_KINDS = ("repack", "merge", "resize", "transcode", "strip", "drop", "pack", "dedup", "tier")


def op_counts(ops: DataFrame) -> DataFrame:
    """ops: kind, n_atlases, owner_ref. kind, place, n: a repack of several sheets is a merge, a drop with an owner a dedup; unknown kinds come last."""
    kind = F.when((F.col("kind") == "repack") & (F.col("n_atlases") > 1), "merge").when((F.col("kind") == "drop") & F.col("owner_ref").isNotNull(), "dedup").otherwise(F.col("kind"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OP_KINDS)), F.col("kind")), F.lit(0)), F.lit(len(OP_KINDS) + 1))
    return ops.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select("kind", place.cast("long").alias("place"), "n")
