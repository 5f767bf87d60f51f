"""What goes out with a sheet: loose images packed to new ones, strips that extend frames into their gutters, and which format a page gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.functions.scalars import EXTENSION
from glyphmill.operators.groups import over_groups
from glyphmill.operators.maxrects import pack_items


def loose_items(regions: DataFrame, trim: bool = True) -> DataFrame:
    """regions: group, skeleton (whether a skeleton's), name, ref, src_w, src_h, trim_x, trim_y, trim_w, trim_h (null: not measured). What each packs at, and what its
    manifest says: pack_w, pack_h, trimmed, off_x, off_y (of trimmed ones; from the bottom for skeletons)."""
    cut = F.lit(trim) & F.col("trim_w").isNotNull() & F.col("trim_h").isNotNull()
    trimmed = cut & ((F.col("trim_w") != F.col("src_w")) | (F.col("trim_h") != F.col("src_h")))
    down = F.when(F.col("skeleton"), F.col("src_h") - F.col("trim_y") - F.col("trim_h")).otherwise(F.col("trim_y"))
    size = lambda c: F.when(cut, F.col(f"trim_{c}")).otherwise(F.col(f"src_{c}")).cast("long")
    return regions.select("group", "skeleton", "name", "ref", "src_w", "src_h", size("w").alias("pack_w"), size("h").alias("pack_h"), trimmed.alias("trimmed"), F.when(trimmed, F.col("trim_x")).alias("off_x"), F.when(trimmed, down).alias("off_y"))


def pack_loose(regions: DataFrame, mime: str = "image/webp", trim: bool = True, padding: int = 2, gutter: int = 0, most: int = 4096) -> DataFrame:
    """New sheets of loose images, one group to a sheet and more where it doesn't fit, never turned: the columns of loose_items and page, page_name, page_w, page_h, x, y."""
    items = loose_items(regions, trim)

    def one(g: dict[str, list]) -> list[tuple]:
        bins = pack_items(list(zip(g["pack_w"], g["pack_h"], strict=True)), most, padding, gutter)
        return [(g["group"][i], g["name"][i], k, w, h, x, y) for k, (w, h, places) in enumerate(bins) for i, (x, y, _) in places.items()]

    kind = {f.name: f.dataType for f in items.schema.fields}
    schema = StructType().add("group", kind["group"]).add("name", kind["name"])
    for c in ("page", "page_w", "page_h", "x", "y"):
        schema = schema.add(c, "long")
    at = over_groups(items.select("group", "name", "pack_w", "pack_h"), "group", ["name"], one, ["group", "name", "page", "page_w", "page_h", "x", "y"], schema)
    stem = F.coalesce(F.nullif(F.regexp_extract("group", r"[^/:]*$", 0), F.lit("")), F.lit("sheet"))
    name = F.concat(stem, F.when(F.col("page") > 0, F.concat(F.lit("_"), F.col("page").cast("string"))).otherwise(""), F.lit(EXTENSION.get(mime, ".png")))
    return items.join(at, ["group", "name"]).withColumn("page_name", name)


def extrusions(blits: DataFrame, extrude: int) -> DataFrame:
    """blits: id, from_x, from_y, from_w, from_h, x, y, w, h, page_w, page_h, turned (either side), clipped. Strips and corners that repeat a frame's border `extrude` pixels outwards, cut
    to the page: id, kind, src_x, src_y, src_w, src_h, dst_x, dst_y, dst_w, dst_h. Turned frames and those with outlines of their own have none."""
    e, c = F.lit(int(extrude)).cast("long"), F.col
    sx, sy, sw, sh, x, y, w, h = (c(k).cast("long") for k in ("from_x", "from_y", "from_w", "from_h", "x", "y", "w", "h"))
    one = F.lit(1).cast("long")
    right, low = sx + sw - 1, sy + sh - 1
    parts = [
        ("top", sx, sy, sw, one, x, y - e, w, e), ("bottom", sx, low, sw, one, x, y + h, w, e), ("left", sx, sy, one, sh, x - e, y, e, h), ("right", right, sy, one, sh, x + w, y, e, h),
        ("tl", sx, sy, one, one, x - e, y - e, e, e), ("tr", right, sy, one, one, x + w, y - e, e, e), ("bl", sx, low, one, one, x - e, y + h, e, e), ("br", right, low, one, one, x + w, y + h, e, e),
    ]
    names = ("kind", "sx", "sy", "sw", "sh", "dx", "dy", "dw", "dh")
    rows = blits.filter(~c("turned") & ~c("clipped") & (e > 0)).select("id", "page_w", "page_h", F.inline(F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, p, strict=True)]) for p in parts])))
    zero = F.lit(0).cast("long")
    x0, y0, x1, y1 = F.greatest(zero, c("dx")), F.greatest(zero, c("dy")), F.least(c("page_w").cast("long"), c("dx") + c("dw")), F.least(c("page_h").cast("long"), c("dy") + c("dh"))
    rows = rows.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1}).filter("x1 > x0 and y1 > y0")
    # what the page cuts off goes from the source in proportion
    share = lambda of, size: F.floor(c(of) * size + 0.5).cast("long")
    left, top = (c("x0") - c("dx")) / c("dw"), (c("y0") - c("dy")) / c("dh")
    across, down = left + (c("dx") + c("dw") - c("x1")) / c("dw"), top + (c("dy") + c("dh") - c("y1")) / c("dh")
    return rows.select(
        "id", "kind", (c("sx") + share("sw", left)).alias("src_x"), (c("sy") + share("sh", top)).alias("src_y"), F.greatest(one, c("sw") - share("sw", across)).alias("src_w"), F.greatest(one, c("sh") - share("sh", down)).alias("src_h"),
        c("x0").alias("dst_x"), c("y0").alias("dst_y"), (c("x1") - c("x0")).alias("dst_w"), (c("y1") - c("y0")).alias("dst_h"),
    )


def forced_format(claimed: Column, sidecar: Column, several_pages: Column, several_formats: Column, source: Column, target: Column) -> Column:
    """Whether a page is encoded anew for an export profile, as a struct of force and why not (null where nothing needs saying)."""
    why = F.when(claimed, "another operation has the sheet").when(~sidecar, "its manifest isn't there").when(several_pages, "a skeleton's atlas of several pages").when(several_formats, "pages stay of one format")
    return F.struct((why.isNull() & (source != target)).alias("force"), why.alias("reason"))


def page_target(skeleton: Column, skeleton_by_profile: Column, profile: Column, repacked: Column, legacy: Column) -> Column:
    """What a new page is encoded as, as a struct of kind (profile, png, webp-lossless, legacy), mime and whether the profile's further formats (profile: array of mimes) go unused. Pages of skeletons
    stay PNG unless the profile may decide; without a profile a repack is WebP without loss, and others keep the format that was chosen for all."""
    by_profile = F.size(profile) > 0
    first = F.when(by_profile, F.element_at(profile, 1))
    kind = F.when(skeleton & ~skeleton_by_profile, "png").when(by_profile, "profile").when(repacked & ~skeleton, "webp-lossless").otherwise("legacy")
    mime = F.when(kind == "png", "image/png").when(kind == "profile", first).when(kind == "webp-lossless", "image/webp").otherwise(legacy)
    return F.struct(kind.alias("kind"), mime.alias("mime"), ((kind == "profile") & (F.size(profile) > 1)).alias("more"))
