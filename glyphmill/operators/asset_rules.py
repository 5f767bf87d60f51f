"""Rules over single assets. Each takes relations and thresholds and returns a row for each firing.

A null means "not measured", and a rule is silent where an input is null; it never counts as zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.config import DEFAULT, Thresholds
from glyphmill.functions import scalars as S
from glyphmill.operators.groups import over_chunks
from glyphmill.operators.sweep import gaps_ahead


def severity(crit: Column | None, warn: Column | None, otherwise: str | None = None) -> Column:
    c = None
    for name, when in (("crit", crit), ("warn", warn)):
        if when is not None:
            c = F.when(when, name) if c is None else c.when(when, name)
    return c.otherwise(otherwise) if otherwise else c


def atlas_occupancy(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """asset_ref, used, area, occ of each sheet; frames with the same place count once each, as placed."""
    used = sprites.groupBy("asset_ref").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("used"), F.count("*").alias("n"))
    a = atlases.join(used, "asset_ref")
    return a.select("asset_ref", "decl_w", "decl_h", "source_kind", "scale", "used", "n", (F.col("decl_w").cast("long") * F.col("decl_h")).alias("area"), S.occupancy(F.col("used"), F.col("decl_w"), F.col("decl_h")).alias("occ"))


def occupancy(sprites: DataFrame, atlases: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Sheets whose frames cover too little; where less than a floor of bytes is wasted it is a note."""
    o = atlas_occupancy(sprites, atlases).filter(F.col("occ") < t.occupancy_warn)
    wasted = F.greatest(F.col("area") - F.col("used"), F.lit(0)) * 4
    return o.select("asset_ref", "occ", wasted.alias("wasted_bytes"), F.when(wasted < t.occupancy_floor_bytes, "info").when(F.col("occ") < t.occupancy_crit, "crit").otherwise("warn").alias("severity"))


def oversize(images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    longest = F.greatest("w", "h")
    return images.filter(longest > t.longest_warn).select("asset_ref", longest.alias("longest"), severity(longest > t.longest_crit, None, "warn").alias("severity"))


def npot(images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Images that padding to powers of two would waste much of."""
    pw, ph = S.next_power_of_two(F.col("w")), S.next_power_of_two(F.col("h"))
    waste = 1 - (F.col("w").cast("long") * F.col("h")).cast("double") / (pw * ph).cast("double")
    odd = ~(S.is_power_of_two(F.col("w")) & S.is_power_of_two(F.col("h")))
    return images.filter("w > 0 and h > 0").filter(odd & (waste > t.npot_waste)).select("asset_ref", waste.alias("waste"), (S.vram_bytes(pw, ph) - S.vram_bytes(F.col("w"), F.col("h"))).alias("vram_saved"), F.lit("info").alias("severity"))


def solid_fill(images: DataFrame, features: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    i = images.join(features.filter("solid"), "asset_ref").filter(F.least("w", "h") >= t.solid_shorter)
    return i.select("asset_ref", (S.vram_bytes(F.col("w"), F.col("h")) - 4).alias("vram_saved"), F.when(F.greatest("w", "h") >= t.solid_longest_warn, "warn").otherwise("info").alias("severity"))


def upscaled_source(images: DataFrame, features: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Images whose pixels repeat in blocks; the solid ones, which always do, excepted."""
    i = images.join(features.filter("upscale_depth >= 1 and not coalesce(solid, false)"), "asset_ref").filter(F.greatest("w", "h") >= t.upscaled_longest)
    small = lambda c: F.call_function("shiftright", F.col(c), F.col("upscale_depth"))
    return i.select("asset_ref", "upscale_depth", (S.vram_bytes(F.col("w"), F.col("h")) - S.vram_bytes(small("w"), small("h"))).alias("vram_saved"), F.lit("warn").alias("severity"))


def frame_redundancy(sprites: DataFrame, images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Equal frames at several places of one sheet: area, texture bytes and a share of the file that one copy would free."""
    rect = F.struct("x", "y", "w", "h")
    clusters = sprites.filter("frame_hash is not null").groupBy("asset_ref", "frame_hash").agg(F.count_distinct(rect).alias("places"), F.min_by(F.col("w").cast("long") * F.col("h"), "sprite_idx").alias("area"), F.min("sprite_idx").alias("first"))
    clusters = clusters.filter(F.col("places") >= t.redundant_frames).groupBy("asset_ref").agg(F.count("*").alias("clusters"), F.sum(F.col("area") * (F.col("places") - 1)).alias("area"))
    total = sprites.groupBy("asset_ref").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("total"))
    c = clusters.join(total, "asset_ref").join(images.select("asset_ref", "byte_size"), "asset_ref", "left")
    return c.select("asset_ref", "clusters", "area", (F.col("area") * 4).alias("vram_saved"), F.floor(F.col("byte_size") * F.col("area") / F.col("total") + 0.5).alias("disk_saved"), F.lit("warn").alias("severity"))


def trim_margin(sprites: DataFrame, atlases: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Untrimmed frames with wide transparent margins; of frames at one place the first that qualifies counts. A frame without any opaque pixel can go as a whole."""
    none = F.col("trim_w").isNull()
    area, kept = F.col("w").cast("long") * F.col("h"), F.when(none, F.lit(0).cast("long")).otherwise(F.col("trim_w").cast("long") * F.col("trim_h"))
    margin = F.when(none, F.greatest("w", "h")).otherwise(F.greatest("trim_x", "trim_y", F.col("w") - F.col("trim_x") - F.col("trim_w"), F.col("h") - F.col("trim_y") - F.col("trim_h")))
    s = sprites.filter("not trimmed").withColumns({"margin": margin, "freed": area - kept}).filter(F.col("margin") >= t.trim_margin)
    w = Window.partitionBy("asset_ref", "x", "y", "w", "h").orderBy("sprite_idx")
    s = s.withColumn("nth", F.row_number().over(w)).filter("nth = 1").groupBy("asset_ref").agg(F.count("*").alias("frames"), F.sum("freed").alias("freed"))
    share = F.col("freed") / (F.col("decl_w").cast("long") * F.col("decl_h"))
    return s.join(atlases, "asset_ref").filter(share >= t.trim_share).select("asset_ref", "frames", "freed", share.alias("share"), F.lit("info").alias("severity"))


def wasted_alpha(images: DataFrame, features: DataFrame, encode_sizes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Opaque images in a format with alpha whose opaque encoding is smaller by a share."""
    i = images.filter(F.col("mime").isin("image/png", "image/webp")).join(features.filter("opaque").select("asset_ref"), "asset_ref").filter(F.least("w", "h") >= t.alpha_shorter)
    e = encode_sizes.filter("opaque").groupBy("asset_ref", F.col("target_mime").alias("mime")).agg(F.min("bytes").alias("bytes"))
    saved = F.col("byte_size") - F.col("bytes")
    return i.join(e, ["asset_ref", "mime"]).filter((saved > 0) & (saved / F.col("byte_size") >= t.alpha_share)).select("asset_ref", saved.alias("disk_saved"), F.lit("info").alias("severity"))


def strippable_metadata(images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    n = F.col("strippable_bytes")
    return images.filter(n >= t.strip_info).select("asset_ref", n.alias("disk_saved"), F.when(n >= t.strip_warn, "warn").otherwise("info").alias("severity"))


def icc_non_srgb(images: DataFrame) -> DataFrame:
    return images.filter("icc_bytes is not null and not coalesce(icc_srgb, false)").select("asset_ref", "icc_bytes", F.lit("info").alias("severity"))


def interior_transparency(images: DataFrame, features: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Images with a large opaque box that is mostly transparent inside."""
    box = F.col("bbox_w").cast("long") * F.col("bbox_h")
    share = F.col("interior_transparent") / box
    return images.join(features, "asset_ref").filter((box >= t.interior_pixels) & (share >= t.interior_share)).select("asset_ref", box.alias("box"), share.alias("share"), F.lit("info").alias("severity"))


def binary_alpha(images: DataFrame, features: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    f = features.filter("binary_alpha and not coalesce(opaque, false)")
    return images.join(f, "asset_ref").filter(F.greatest("w", "h") >= t.binary_longest).select("asset_ref", F.lit("info").alias("severity"))


def _places(sprites: DataFrame) -> DataFrame:
    """Distinct places of frames that aren't rotated; p is the place's first sprite."""
    return sprites.filter("not rotated").groupBy("asset_ref", "x", "y", "w", "h").agg(F.min("sprite_idx").alias("p"))


def touching_pairs(sprites: DataFrame) -> DataFrame:
    """Pairs of places that share an edge: equal edge coordinates join, strict overlap along the edge filters. A pair that touches twice counts once."""
    a = _places(sprites)
    b = a.select(*[F.col(c).alias(f"b{c}") for c in ("asset_ref", "x", "y", "w", "h", "p")])
    same = F.col("asset_ref") == F.col("basset_ref")
    right = a.join(b, same & (F.col("bx") + F.col("bw") == F.col("x")) & (F.col("by") < F.col("y") + F.col("h")) & (F.col("y") < F.col("by") + F.col("bh")))
    below = a.join(b, same & (F.col("by") + F.col("bh") == F.col("y")) & (F.col("bx") < F.col("x") + F.col("w")) & (F.col("x") < F.col("bx") + F.col("bw")))
    both = right.select("asset_ref", "p", "bp").union(below.select("asset_ref", "p", "bp"))
    return both.filter("p <> bp").select("asset_ref", F.least("p", "bp").alias("a"), F.greatest("p", "bp").alias("b")).distinct()


def bleeding(sprites: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    n = touching_pairs(sprites).groupBy("asset_ref").agg(F.count("*").alias("pairs"))
    return n.filter(F.col("pairs") >= t.bleed_info).select("asset_ref", "pairs", F.when(F.col("pairs") >= t.bleed_warn, "warn").otherwise("info").alias("severity"))


def neighbour_gaps(sprites: DataFrame) -> DataFrame:
    """asset_ref, p, gap: the smaller distance of a place to its nearest neighbour to the right and below, among those that overlap it sideways. Places are
    distinct rectangles as they lie on the sheet, rotated ones too; p is the first sprite there. By `sweep`, in time near-linear in a sheet's places."""
    places = sprites.filter("w > 0 and h > 0").groupBy("asset_ref", "x", "y", "w", "h").agg(F.min("sprite_idx").alias("p"))
    places = places.select("asset_ref", *[F.col(c).cast("long").alias(c) for c in ("p", "x", "y", "w", "h")])

    def gaps(pdf: pd.DataFrame) -> pd.DataFrame:
        sheet = (pdf["asset_ref"] != pdf["asset_ref"].shift()).cumsum().to_numpy() - 1
        x, y, w, h = (pdf[c].to_numpy() for c in ("x", "y", "w", "h"))
        right, below = gaps_ahead(sheet, x, w, y, y + h), gaps_ahead(sheet, y, h, x, x + w)
        gap = np.where(right < 0, below, np.where(below < 0, right, np.minimum(right, below)))
        return pd.DataFrame({"asset_ref": pdf["asset_ref"], "p": pdf["p"], "gap": gap})[gap >= 0]

    schema = StructType().add("asset_ref", sprites.schema["asset_ref"].dataType).add("p", "long").add("gap", "long")
    return over_chunks(places, "asset_ref", ["p"], gaps, schema)


def excessive_gutter(sprites: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Sheets whose lower median gap is wide."""
    g = neighbour_gaps(sprites).groupBy("asset_ref").agg(F.count("*").alias("gaps"), F.expr("percentile_disc(0.5) within group (order by gap)").cast("long").alias("median"))
    return g.filter((F.col("gaps") >= t.gutter_gaps) & (F.col("median") >= t.gutter)).select("asset_ref", "gaps", "median", F.lit("info").alias("severity"))


def _repackable(atlases: DataFrame, images: DataFrame) -> DataFrame:
    return atlases.filter("source_kind <> 'bmfont'").join(images.select("asset_ref", "w", "h"), "asset_ref").filter("w = decl_w and h = decl_h")


def repack_room(atlases: DataFrame, images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """asset_ref, room: the pixels that a bin may have for a sheet to be a repack opportunity; sheets that can't be one are left out."""
    room = F.shiftright(S.vram_bytes(F.col("decl_w"), F.col("decl_h")) - t.repack_saved, 2)
    return _repackable(atlases, images).select("asset_ref", room.alias("room")).filter("room > 0")


def repack_opportunity(atlases: DataFrame, packed: DataFrame, images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """packed: asset_ref, bins, n, bin_w, bin_h of a trial pack, of sheets within `repack_room` at least. Sheets that fit one smaller bin."""
    before, after = S.vram_bytes(F.col("decl_w"), F.col("decl_h")), S.vram_bytes(F.col("bin_w"), F.col("bin_h"))
    p = _repackable(atlases, images).join(packed.filter("bins = 1 and n >= 2"), "asset_ref")
    return p.filter(before - after >= t.repack_saved).select("asset_ref", (before - after).alias("vram_saved"), F.when(after * 2 <= before, "warn").otherwise("info").alias("severity"))


def unreferenced_regions(sprites: DataFrame, pages: DataFrame, refs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """pages: file, asset_ref, the sheets of a skeleton's atlas file. refs: file, kind (name or prefix), value. For each sheet the regions
    that no name and no prefix with digits behind it stands for: distinct names, and the area of their distinct rectangles; where at
    least a share of the distinct names of the whole file is matched."""
    names = sprites.join(pages, "asset_ref").select("file", "name").distinct()
    exact = names.join(refs.filter("kind = 'name'").select("file", F.col("value").alias("name")), ["file", "name"], "left_semi")
    digits = F.length(F.regexp_extract("name", "[0-9]+$", 0))
    cut = names.withColumn("digits", digits).filter("digits > 0").withColumn("drop", F.explode(F.sequence(F.lit(1), F.col("digits"))))
    cut = cut.withColumn("value", F.expr("left(name, length(name) - drop)"))
    behind = cut.join(refs.filter("kind = 'prefix'").select("file", "value"), ["file", "value"], "left_semi").select("file", "name")
    matched = exact.unionByName(behind).distinct()
    trusted = names.join(matched.withColumn("hit", F.lit(1)), ["file", "name"], "left").groupBy("file").agg((F.count("hit") / F.count("*")).alias("share")).filter(F.col("share") >= t.matched_share).select("file")
    dead = sprites.join(pages, "asset_ref").join(trusted, "file", "left_semi").join(matched, ["file", "name"], "left_anti")
    counts = dead.groupBy("file", "asset_ref").agg(F.count_distinct("name").alias("dead"))
    rects = dead.filter("w > 0 and h > 0").select("file", "asset_ref", "x", "y", "w", "h").distinct()
    area = rects.groupBy("file", "asset_ref").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("area"))
    return counts.join(area, ["file", "asset_ref"], "left").select("asset_ref", "dead", F.coalesce("area", F.lit(0)).alias("area"), F.lit("info").alias("severity"))


def dimension_mismatch(atlases: DataFrame, images: DataFrame, sprites: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Sheets whose image isn't as large as declared; frames off a smaller image are critical."""
    a = atlases.join(images.select("asset_ref", "w", "h"), "asset_ref").filter((F.abs(F.col("w") - F.col("decl_w")) > t.mismatch) | (F.abs(F.col("h") - F.col("decl_h")) > t.mismatch))
    shrunk = (F.col("w") < F.col("decl_w")) | (F.col("h") < F.col("decl_h"))
    s = sprites.select("asset_ref", (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"))
    off = a.join(s, "asset_ref").groupBy("asset_ref").agg(F.count_if((F.col("right") > F.col("w")) | (F.col("bottom") > F.col("h"))).alias("off_edge"))
    a = a.join(off, "asset_ref", "left").withColumn("off_edge", F.coalesce("off_edge", F.lit(0).cast("long")))
    return a.select("asset_ref", "off_edge", F.when(shrunk & (F.col("off_edge") > 0), "crit").when(shrunk, "warn").otherwise("info").alias("severity"))


def format_candidates(images: DataFrame, features: DataFrame, encode_sizes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The smallest encoding in a better format, AVIF before WebP among equals, where it saves enough. Flat and alpha art asks for lossless."""
    order = F.when(F.col("target_mime") == "image/avif", 0).otherwise(1)
    best = encode_sizes.filter(F.col("target_mime").isin("image/avif", "image/webp") & ~F.col("opaque")).groupBy("asset_ref").agg(F.min(F.struct("bytes", order.alias("o"), "target_mime")).alias("b")).select("asset_ref", "b.bytes", "b.target_mime")
    i = images.join(best, "asset_ref").filter(F.col("mime") != F.col("target_mime")).join(features.select("asset_ref", "content_class"), "asset_ref", "left")
    saved = F.col("byte_size") - F.col("bytes")
    lossless = F.coalesce(F.col("content_class").isin("flat", "alpha-art"), F.lit(False))
    return i.filter((saved >= t.format_saved) & (saved / F.col("byte_size") >= t.format_share)).select("asset_ref", "target_mime", saved.alias("disk_saved"), F.when(lossless, "format-lossless").otherwise("format").alias("rule"), F.lit("warn").alias("severity"))


def font_glyph_page(sprites: DataFrame, atlases: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    o = atlas_occupancy(sprites, atlases).filter((F.col("source_kind") == "bmfont") & (F.col("n") >= t.glyphs))
    return o.select("asset_ref", F.col("n").alias("glyphs"), "occ", F.when(F.col("occ") <= t.glyph_occupancy, "warn").otherwise("info").alias("severity"))
