"""Rules over all assets of a folder: grouping, joins and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.config import DEFAULT, Thresholds
from glyphmill.functions import scalars as S
from glyphmill.operators.asset_rules import atlas_occupancy


def duplicate_exact(images: DataFrame, features: DataFrame) -> DataFrame:
    """Groups of equal content: the refs in order, copies, and bytes that all but one copy take."""
    i = images.join(features.filter("content_hash is not null").select("asset_ref", "content_hash"), "asset_ref")
    g = i.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("asset_ref").alias("first"), F.min_by("byte_size", "asset_ref").alias("each"))
    return g.filter("n > 1").select("content_hash", "n", "first", (F.col("each") * (F.col("n") - 1)).alias("disk_saved"))


def should_atlas(images: DataFrame, features: DataFrame | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """One row if the folder has many small loose images, files and logical images alike."""
    small = images.filter(F.greatest("w", "h") <= t.small)
    n = small.agg(F.count("*").alias("files")).crossJoin(variant_groups(small).agg(F.count("*").alias("logical")))
    return n.filter((F.col("files") >= t.small_count) & (F.col("logical") >= t.small_count))


def atlas_merge(sprites: DataFrame, atlases: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Sparse sheets of one scale (the largest group, the first among equals) that fit fewer sheets as large as the largest edge of them."""
    o = atlas_occupancy(sprites, atlases).filter(F.col("source_kind").isin("texturepacker-hash", "texturepacker-array", "pixi") & (F.col("occ") < t.merge_occupancy))
    g = o.groupBy("scale").agg(F.count("*").alias("n"), F.sum("used").alias("used"), F.sum("area").alias("area"), F.min("asset_ref").alias("first"), F.max(F.greatest("decl_w", "decl_h")).cast("long").alias("side"))
    best = g.orderBy(F.desc("n"), "first").limit(1).filter("n >= 2")
    merged = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("used") / (F.col("side") * F.col("side") * t.merge_fill)))
    saved = F.col("area") * 4 - merged * F.col("side") * F.col("side") * 4
    return best.withColumn("merged", merged).filter("merged < n").select("scale", "n", "merged", F.when(saved > 0, saved).alias("vram_saved"))


def missing_images(missing: DataFrame) -> DataFrame:
    return missing.select("manifest", "image", F.lit("crit").alias("severity"))


def aggregate_saving(rows: DataFrame, least: int = 2) -> DataFrame:
    """A folder row for at least that many firings whose bytes sum above 0 (formats; metadata)."""
    return rows.agg(F.count("*").alias("n"), F.sum("disk_saved").alias("disk_saved")).filter(F.col("n") >= least).filter("disk_saved > 0")


def premultiplied_alpha(features: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    dark = features.filter((F.col("pma_edge_pixels") >= t.fringe_pixels) & (F.col("pma_fringe_frac") >= t.fringe_share))
    return dark.agg(F.count("*").alias("n")).filter("n >= 2").withColumn("severity", F.lit("info"))


def variant_groups(images: DataFrame) -> DataFrame:
    """Resolution variants of one image by name stem, else by stem and aspect: textures, and sum, least and most of their bytes."""
    key = F.when(S.has_resolution_token(F.col("path")), S.stem_of(F.col("path"))).otherwise(F.concat(S.stem_of(F.col("path")), F.lit("|"), S.aspect_bucket(F.col("w"), F.col("h")).cast("string")))
    v = S.vram_bytes(F.col("w"), F.col("h"))
    return images.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(v).alias("vram"), F.min(v).alias("least"), F.max(v).alias("most"))


def variant_totals(images: DataFrame) -> DataFrame:
    """All textures against those loaded, one for each group."""
    g = variant_groups(images)
    return g.agg(F.sum("vram").alias("vram"), F.sum("least").alias("least"), F.sum("most").alias("loaded"), F.count("*").alias("logical"))


def variants(images: DataFrame) -> DataFrame:
    return variant_totals(images).select((F.col("vram") - F.col("loaded")).alias("vram_saved"), "logical").filter("vram_saved > 0")


def format_siblings(images: DataFrame) -> DataFrame:
    """stem, w, h, refs, mimes: images of one stem and size in several formats, without resolution tokens."""
    s = images.filter(~S.has_resolution_token(F.col("path"))).withColumn("stem", S.stem_of(F.col("path")))
    return s.groupBy("stem", "w", "h").agg(F.count_distinct("mime").alias("mimes"), F.count("*").alias("n")).filter("mimes > 1")


def redundant_formats(images: DataFrame, formats: DataFrame) -> DataFrame:
    """formats: asset_ref, target_mime, the format findings. Those whose target a sibling of one stem and size has already."""
    s = images.filter(~S.has_resolution_token(F.col("path"))).select("asset_ref", S.stem_of(F.col("path")).alias("stem"), "w", "h", "mime")
    clusters = s.select("stem", "w", "h", "mime").distinct()
    several = clusters.groupBy("stem", "w", "h").count().filter("count > 1").select("stem", "w", "h")
    asked = formats.select("asset_ref", "target_mime").join(s.drop("mime"), "asset_ref").join(several, ["stem", "w", "h"], "left_semi")
    return asked.join(clusters.withColumnRenamed("mime", "target_mime"), ["stem", "w", "h", "target_mime"], "left_semi").select("asset_ref", "target_mime")


def loose_in_atlas(features: DataFrame, sprites: DataFrame) -> DataFrame:
    """Loose images that equal a frame of a sheet; the first such frame by sheet and place."""
    w = Window.partitionBy("frame_hash").orderBy("asset_ref", "sprite_idx")
    frames = sprites.filter("frame_hash is not null").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select(F.col("frame_hash").alias("pixel_hash"), F.col("asset_ref").alias("atlas_ref"), "sprite_idx")
    return features.filter("pixel_hash is not null").join(frames, "pixel_hash").select("asset_ref", "atlas_ref", "sprite_idx")


def gpu_alignment(images: DataFrame) -> DataFrame:
    n = images.filter("w % 4 <> 0 or h % 4 <> 0").agg(F.count("*").alias("n"))
    return n.filter("n >= 2").withColumn("severity", F.lit("info"))


def mipmap_cost(images: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    extra = F.sum(S.vram_bytes_mipmapped(F.col("w"), F.col("h")) - S.vram_bytes(F.col("w"), F.col("h")))
    return images.agg(extra.alias("extra")).filter(F.col("extra") > t.mipmap_bytes)


def cross_atlas_units(sprites: DataFrame) -> DataFrame:
    """The first frame of each hash on each sheet, for hashes on several sheets; `kept` marks the lowest sheet's."""
    w = Window.partitionBy("frame_hash", "asset_ref").orderBy("sprite_idx")
    unit = sprites.filter("frame_hash is not null").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("frame_hash", "asset_ref", "sprite_idx", (F.col("w").cast("long") * F.col("h")).alias("area"))
    g = unit.groupBy("frame_hash").agg(F.count("*").alias("sheets"), F.min("asset_ref").alias("owner")).filter("sheets > 1")
    return unit.join(g, "frame_hash").withColumn("kept", F.col("asset_ref") == F.col("owner"))


def cross_atlas_redundancy(sprites: DataFrame, images: DataFrame) -> DataFrame:
    """Per sheet that could drop frames another sheet has: frames, area, texture bytes, and its file's share."""
    freed = cross_atlas_units(sprites).filter("not kept").groupBy("asset_ref").agg(F.count("*").alias("dupes"), F.sum("area").alias("area"))
    total = sprites.groupBy("asset_ref").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("total"))
    f = freed.join(total, "asset_ref").join(images.select("asset_ref", "byte_size"), "asset_ref", "left")
    return f.select("asset_ref", "dupes", "area", (F.col("area") * 4).alias("vram_saved"), F.floor(F.col("byte_size") * F.col("area") / F.col("total") + 0.5).alias("disk_saved"))


def merge_shared_atlases(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """Sheets over one image become one: of frames with one name the first, by sheet order and place, stays."""
    s = sprites.join(atlases.select("asset_ref", "image_ref", "ord"), "asset_ref")
    w = Window.partitionBy("image_ref", "name").orderBy("ord", "sprite_idx")
    return s.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("image_ref", "name", "asset_ref", "sprite_idx")


def totals(images: DataFrame) -> DataFrame:
    """Disk and texture bytes, never one number; what is loaded counts one texture for each group of variants."""
    i = images.agg(F.sum("byte_size").alias("disk"), F.sum(S.vram_bytes(F.col("w"), F.col("h"))).alias("vram"), F.sum(S.vram_bytes_mipmapped(F.col("w"), F.col("h"))).alias("vram_mipmapped"), F.count("*").alias("textures"))
    loaded = variant_totals(images).select("loaded", F.ceil(F.col("loaded") * 4 / 3.0).cast("long").alias("loaded_mipmapped"), F.col("logical").alias("loaded_textures"))
    return i.crossJoin(loaded)


def potential_disk_saved(per_ref: DataFrame, images: DataFrame, features: DataFrame) -> DataFrame:
    """per_ref: asset_ref, disk_saved of formats, alpha and metadata. Of each ref the best counts, not the sum; copies that
    duplicate removal drops count their bytes instead of their best."""
    best = per_ref.groupBy("asset_ref").agg(F.max("disk_saved").alias("best"))
    i = images.join(features.filter("content_hash is not null").select("asset_ref", "content_hash"), "asset_ref")
    dup = duplicate_exact(images, features)
    dropped = i.join(dup.select("content_hash", "first"), "content_hash").filter("asset_ref <> first").select("asset_ref")
    kept = best.join(dropped, "asset_ref", "left_anti").agg(F.coalesce(F.sum("best"), F.lit(0)).alias("best"))
    return kept.crossJoin(dup.agg(F.coalesce(F.sum("disk_saved"), F.lit(0)).alias("copies"))).select("best", "copies", (F.col("best") + F.col("copies")).alias("potential"))


def dedup_edges(features: DataFrame, marking: DataFrame, skin_guard: DataFrame) -> DataFrame:
    """features: asset_ref (a path), content_hash, pool. marking: bundle, availability (eager, lazy, isolated; absent: isolated).
    skin_guard: key, value. Each asset of a group of equal content (two at least, within pool and skin class): its owner and
    why it may use it; owners have no reason.

    With an eager member the first eager one owns and all others use it; otherwise each bundle's first owns within the bundle.
    """
    base = S.base_without_extension(F.col("asset_ref"))
    keys, values = skin_guard.select(F.col("key").alias("base")).distinct(), skin_guard.select(F.col("value").alias("base")).distinct()
    f = features.select("asset_ref", "content_hash", "pool", S.bundle_of(F.col("asset_ref")).alias("bundle"), base.alias("base"))
    f = f.join(keys.withColumn("is_key", F.lit(True)), "base", "left").join(values.withColumn("is_value", F.lit(True)), "base", "left")
    f = f.withColumn("skin", F.when(F.col("is_key"), "key").when(F.col("is_value"), "value").otherwise("general"))
    f = f.join(marking, "bundle", "left").withColumn("availability", F.coalesce("availability", F.lit("isolated")))
    group = ["content_hash", "pool", "skin"]
    g = f.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.when(F.col("availability") == "eager", F.col("asset_ref"))).alias("eager")).filter("n > 1")
    per = f.groupBy(*group, "bundle").agg(F.min("asset_ref").alias("local"))
    f = f.join(g, group).join(per, [*group, "bundle"])
    owner = F.coalesce("eager", "local")
    reason = F.when(F.col("asset_ref") == owner, None).when(F.col("eager").isNull(), F.concat(F.lit("same-"), "availability", F.lit("-bundle"))).when(F.col("bundle") == S.bundle_of(F.col("eager")), "same-eager-bundle").otherwise("eager-owner-cross-bundle")
    return f.select(*group, "asset_ref", owner.alias("owner"), reason.alias("reason"))


def owner_final_names(owners: DataFrame, plan: DataFrame) -> DataFrame:
    """owners: owner. plan: ref, image_path, manifest_path, target_mime (null: not transcoded). The image and manifest that each owner will
    have after the repair; owners without a known image are left out."""
    j = owners.select(F.col("owner").alias("ref")).distinct().join(plan, "ref").filter("image_path is not null")
    image = F.when(F.col("target_mime").isNull(), F.col("image_path")).otherwise(S.renamed_to(F.col("image_path"), F.col("target_mime")))
    return j.select(F.col("ref").alias("owner"), image.alias("image"), F.col("manifest_path").alias("manifest"))
