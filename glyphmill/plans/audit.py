"""The whole chain: files of a folder, parsed manifests, image features, relations, rules, findings with texts, totals.

files: path, content, as `files.scan_folder` reads them or any table of that shape. Parsed manifests and features are written once, since
many rules read them. Sheets over one image are one sheet, known by its image; loose images are those that no manifest names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.config import DEFAULT, Thresholds
from glyphmill.functions import scalars as S
from glyphmill.operators import asset_rules as R
from glyphmill.operators import folder_rules as A
from glyphmill.operators import geometry as G
from glyphmill.operators import messages as M
from glyphmill.operators import near_duplicates as ND
from glyphmill.plans.storage import written
from glyphmill.sources import files as FS
from glyphmill.sources import images as I
from glyphmill.sources import manifests as P

IMAGE = r"(?i)\.(png|webp|jpe?g|avif)$"


@dataclass(frozen=True)
class Inputs:
    """The audit's relations. Null columns are what wasn't measured; unparsed says why of manifests and frames that were left out."""

    sprites: DataFrame
    atlases: DataFrame
    images: DataFrame
    features: DataFrame
    missing: DataFrame
    unparsed: DataFrame


def inputs(files: DataFrame) -> Inputs:
    text = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "content")
    sheets = P.sheets(text.filter(F.col("path").rlike(r"(?i)\.json$")).filter(FS.manifest_kind("text") == "sheet"))
    parsed = sheets.unionByName(P.atlas_texts(text.filter(F.col("path").rlike(r"(?i)\.atlas$")))).unionByName(P.fonts(text.filter(F.col("path").rlike(r"(?i)\.fnt$"))))
    parsed = written(parsed, "audit-parsed")
    unparsed = parsed.filter("error is not null").select(F.col("asset_ref").alias("path"), "name", "error")
    good = parsed.filter("error is null and page is not null")
    found = written(I.image_features(files.filter(F.col("path").rlike(IMAGE))), "audit-features")
    readable = found.filter("mime is not null")
    unparsed = unparsed.unionByName(found.filter("mime is null").select("path", F.lit(None).cast("string").alias("name"), F.lit("unknown image").alias("error")))
    pages = good.groupBy(F.col("asset_ref").alias("path"), F.col("page").alias("image")).agg(F.first("page_w").alias("decl_w"), F.first("page_h").alias("decl_h"), F.first("kind").alias("source_kind"))
    resolved = FS.resolve_images(pages.select("path", "image"), readable.select("path"))
    sheet = pages.join(resolved, ["path", "image"]).filter("image_ref is not null")
    # sheets over one image become one: the first manifest's declaration, and of frames with one name the first
    first = sheet.groupBy(F.col("image_ref").alias("asset_ref")).agg(F.min(F.struct("path", "decl_w", "decl_h", "source_kind")).alias("m"))
    real = readable.select(F.col("path").alias("asset_ref"), "w", "h", "byte_size")
    size = lambda c, own: F.coalesce(F.col(f"m.{c}"), F.col(own))
    atlases = first.join(real, "asset_ref").select("asset_ref", size("decl_w", "w").alias("decl_w"), size("decl_h", "h").alias("decl_h"), "m.source_kind", F.lit(None).cast("double").alias("scale"), F.col("asset_ref").alias("image_ref"), F.col("m.path").alias("ord"))
    s = good.withColumnsRenamed({"asset_ref": "path", "page": "image"}).join(sheet.select("path", "image", F.col("image_ref").alias("asset_ref")), ["path", "image"])
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("asset_ref", "name").orderBy("path", "sprite_idx"))).filter("nth = 1")
    s = s.withColumn("sprite_idx", (F.row_number().over(Window.partitionBy("asset_ref").orderBy("path", "sprite_idx", "name")) - 1).cast("long"))
    s = written(s.select("asset_ref", "sprite_idx", "name", "x", "y", "w", "h", "rotated", "trimmed", "src_w", "src_h"), "audit-sprites")
    unparsed = unparsed.unionByName(I.skipped_sheets(files, s.select(F.col("asset_ref").alias("path"))))
    hashes = I.frame_hashes(files, s.select(F.col("asset_ref").alias("path"), "sprite_idx", "x", "y", "w", "h")).withColumnRenamed("path", "asset_ref")
    none = F.lit(None).cast("int")
    sprites = written(s.join(hashes, ["asset_ref", "sprite_idx"], "left").withColumns({"trim_x": none, "trim_y": none, "trim_w": none, "trim_h": none}), "audit-frames")
    loose = readable.join(atlases.select(F.col("asset_ref").alias("path")), "path", "left_anti").select("path", F.lit(True).alias("loose"))
    images = readable.join(loose, "path", "left").select(F.col("path").alias("asset_ref"), "path", "w", "h", "mime", "byte_size", "strippable_bytes", "icc_bytes", "icc_srgb", F.coalesce("loose", F.lit(False)).alias("loose"))
    features = readable.select(F.col("path").alias("asset_ref"), F.col("path").alias("ord"), *[c for c in readable.columns if c not in ("path", "mime", "w", "h", "byte_size", "strippable_bytes", "icc_bytes", "icc_srgb", "icc_label")])
    return Inputs(sprites, atlases, images, features, FS.missing(resolved), unparsed)


def findings(i: Inputs, encode_sizes: DataFrame | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Firings of all rules in one shape, with texts. Rules that need trial encodings are silent without them; folder rows have the rule as their ref."""
    sheet_images = i.images.join(i.atlases.select("asset_ref"), "asset_ref", "left_semi")
    loose = i.images.filter("loose")
    declared = loose.select("asset_ref", "w", "h").unionByName(i.atlases.select("asset_ref", F.col("decl_w").alias("w"), F.col("decl_h").alias("h")))
    per_asset = {
        "occupancy": R.occupancy(i.sprites, i.atlases, t), "dimensions-oversize": R.oversize(declared, t), "dimensions-npot": R.npot(declared, t), "solid-fill": R.solid_fill(i.images, i.features, t), "upscaled-source": R.upscaled_source(i.images, i.features, t),
        "frame-redundancy": R.frame_redundancy(i.sprites, sheet_images, t), "strippable-metadata": R.strippable_metadata(i.images, t), "icc-non-srgb": R.icc_non_srgb(i.images), "interior-transparency": R.interior_transparency(loose, i.features, t),
        "binary-alpha": R.binary_alpha(loose, i.features, t), "bleeding": R.bleeding(i.sprites, t), "excessive-gutter": R.excessive_gutter(i.sprites, t), "dimension-mismatch": R.dimension_mismatch(i.atlases, sheet_images, i.sprites, t),
        "wasted-regions": G.wasted_regions(i.sprites, i.atlases), "font-glyph-page": R.font_glyph_page(i.sprites, i.atlases, t),
    }
    if encode_sizes is not None:
        per_asset |= {"wasted-alpha": R.wasted_alpha(i.images, i.features, encode_sizes, t), "format": R.format_candidates(i.images, i.features, encode_sizes, t)}
    folder = {
        "duplicate-exact": (A.duplicate_exact(i.images, i.features), "first"), "duplicate-similar": (ND.duplicate_similar(i.features, t).groupBy("group").agg(F.count("*").alias("n")), "group"), "missing-image": (A.missing_images(i.missing), "manifest"),
        "loose-in-atlas": (A.loose_in_atlas(i.features.join(loose.select("asset_ref"), "asset_ref", "left_semi"), i.sprites), "asset_ref"), "cross-atlas-redundancy": (A.cross_atlas_redundancy(i.sprites, sheet_images), "asset_ref"),
    }
    whole = {"should-atlas": A.should_atlas(loose, None, t), "premultiplied-alpha": A.premultiplied_alpha(i.features.join(loose.select("asset_ref"), "asset_ref", "left_semi"), t), "variants": A.variants(i.images), "gpu-compression-alignment": A.gpu_alignment(i.images), "mipmap-cost": A.mipmap_cost(i.images, t)}
    rows = [(rule, df, "asset_ref") for rule, df in per_asset.items()] + [(rule, df, ref) for rule, (df, ref) in folder.items()] + [(rule, df.withColumn("folder", F.lit(".")), "folder") for rule, df in whole.items()]
    return M.all_findings(rows)


def audit(files: DataFrame, encode_sizes: DataFrame | None = None, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame, Inputs]:
    """(findings, totals, relations) of a table of files."""
    i = inputs(files)
    return written(findings(i, encode_sizes, t), "audit-findings"), A.totals(i.images), i


def audit_folder(spark: SparkSession, root: str, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame, Inputs]:
    return audit(FS.scan_folder(spark, root).select("path", "content"), None, t)


def sheet_texts(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """Relations as manifests: path, content of a JSON text for each sheet, in the form that `manifests.parse_sheet` reads."""
    side = lambda a, b: F.when(F.col("rotated"), F.col(b)).otherwise(F.col(a))
    body = F.to_json(F.struct(F.col("name").alias("filename"), F.struct("x", "y", side("w", "h").alias("w"), side("h", "w").alias("h")).alias("frame"), "rotated", "trimmed", F.struct(F.col("src_w").alias("w"), F.col("src_h").alias("h")).alias("sourceSize")))
    frames = sprites.groupBy("asset_ref").agg(F.array_sort(F.collect_list(F.struct("sprite_idx", body.alias("body")))).alias("f"))
    j = frames.join(atlases, "asset_ref")
    meta = F.to_json(F.struct(F.concat(F.lit("made by "), "source_kind").alias("app"), F.concat("image_ref", F.lit(".png")).alias("image"), F.struct(F.col("decl_w").alias("w"), F.col("decl_h").alias("h")).alias("size")))
    text = F.concat(F.lit('{"frames":['), F.array_join(F.transform("f", lambda e: e["body"]), ","), F.lit('],"meta":'), meta, F.lit("}"))
    return j.select(F.concat(F.lit("sheets/"), F.col("asset_ref").cast("string"), F.lit(".json")).alias("path"), text.cast("binary").alias("content"))
