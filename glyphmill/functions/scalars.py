"""Scalar functions of the audit, as Column expressions that stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[_-](?:\d+p|\d+x|hd|sd|png|webp|avif|jpe?g)"
RESOLUTION = r"[_-](?:\d+p|\d+x|hd|sd)"


def vram_bytes(w: Column, h: Column) -> Column:
    """Bytes of an uncompressed texture: four for each pixel."""
    return w.cast("long") * h.cast("long") * 4


def vram_bytes_mipmapped(w: Column, h: Column) -> Column:
    """With mipmaps: a third more, rounded up, in floating point."""
    return F.ceil(vram_bytes(w, h).cast("double") * F.lit(4.0) / 3).cast("long")


def is_power_of_two(n: Column) -> Column:
    n = n.cast("long")
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is at least n, without floating-point logarithms."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long") - 1))))


def round_half_up(v: Column, digits: int = 0) -> Column:
    """floor(v * 10^digits + 0.5) / 10^digits: halves go up, for negatives too."""
    k = 10**digits
    return F.floor(v * k + 0.5) / k if digits else F.floor(v + 0.5)


def percent1(v: Column) -> Column:
    return F.floor(v * 1000 + 0.5) / 10


def format_bytes(n: Column) -> Column:
    """B, KB or MB, with one digit beyond bytes."""
    n = n.cast("double")
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))


def occupancy(used: Column, w: Column, h: Column) -> Column:
    """Share of a sheet that its frames cover, at most 1; 0 for a sheet without area."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(used.cast("double"), (w.cast("long") * h).cast("double"))), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes, in two halves (64 bits don't fit a signed conversion)."""

    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 8), 16, 10).cast("long")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def normalize_path(p: Column) -> Column:
    """Drop empty parts and `.`; `..` takes back the part before it."""
    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))), "/")


def dir_of(p: Column) -> Column:
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def base_name(p: Column) -> Column:
    return F.regexp_extract(p, r"[^/]*$", 0)


def base_without_extension(p: Column) -> Column:
    return F.regexp_replace(base_name(p), r"\.[^.]*$", "")


def bundle_of(p: Column) -> Column:
    """The first part of a path, or the whole of one without parts."""
    return F.regexp_extract(p, r"^[^/]*", 0)


def stem_of(p: Column) -> Column:
    """Directory and lower-case name without extension and trailing resolution or format tokens."""
    name = F.regexp_replace(F.lower(base_without_extension(p)), f"(?:{TOKEN})+$", "")
    d = dir_of(p)
    return F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))


def has_resolution_token(p: Column) -> Column:
    return F.lower(base_without_extension(p)).rlike(f"{RESOLUTION}(?:{TOKEN})*$")


def aspect_bucket(w: Column, h: Column) -> Column:
    return F.when(h == 0, F.lit(0).cast("long")).otherwise(F.floor(w.cast("double") / h * 50 + 0.5))


def refs_preview(refs: Column, most: int = 10) -> Column:
    """The first refs, and how many more there are."""
    more = F.size(refs) - most
    return F.concat(F.array_join(F.slice(refs, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" … (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def default_cell(w: Column, h: Column) -> Column:
    """Side of a coverage cell: a 64th of the longest edge, 8 at least."""
    return F.greatest(F.lit(8).cast("long"), F.floor(F.greatest(w, h) / 64.0 + 0.5))


def glob_to_regex(glob: str) -> str:
    """`**` any parts, `*` within a part, `?` one sign; anchored."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def scaled_size(n: Column, scale: float) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(scale) + 0.5))


def scale_aware_quality(quality: Column, scale: Column) -> Column:
    return F.greatest(F.lit(50), F.least(F.lit(100), (quality - F.floor((1 - scale) * 50 + 0.5)).cast("int")))


def vram_ceiling(w: Column, h: Column, compressed: Column, mipmaps: Column) -> Column:
    """Bytes a page may take: four or, compressed, one for each pixel; a third more with mipmaps, rounded up."""
    n = w.cast("long") * h * F.when(compressed, 1).otherwise(4)
    return F.when(mipmaps, F.ceil(n.cast("double") * 4 / 3).cast("long")).otherwise(n)


def exceeds_scan_budget(w: Column, h: Column) -> Column:
    return w.cast("long") * h > 25_165_824


def effective_extrude(extrude: Column, gutter: Column) -> Column:
    return F.greatest(F.lit(0), F.least(extrude, gutter))


def blend_label(straight: Column, premultiplied: Column, upload: Column) -> Column:
    return F.when(straight & premultiplied, "mixed").when(straight, "straight").when(premultiplied, "premultiplied").when(upload, "upload")


def transcode_is_loss(before: Column, after: Column, opaque: Column) -> Column:
    """A transcode that isn't smaller is dropped unless it removes an alpha channel."""
    return (after >= before) & ~opaque


def signed_area2(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle, exact in whole numbers."""
    ax, ay, bx, by, cx, cy = (c.cast("long") for c in (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def _plain(n: Column) -> Column:
    """A number as text, without a fraction of nothing."""
    return F.regexp_replace(n.cast("double").cast("string"), r"\.0$", "")


def format_value(unit: str, n: Column) -> Column:
    """A metric's value as reports print it: bytes, ratio (as a percentage with one digit at most), px or count."""
    if unit == "bytes":
        return format_bytes(n)
    if unit == "ratio":
        return F.concat(_plain(F.floor(n * 100 * 10 + 0.5) / 10), F.lit("%"))
    if unit not in ("px", "count"):
        raise ValueError(f"unknown unit: {unit}")
    return F.concat(_plain(n), F.lit("px")) if unit == "px" else _plain(n)


def saved_percent(saved: Column, disk: Column) -> Column:
    """Whole per cent of the disk bytes that can go; 0 of nothing."""
    return F.when(disk > 0, F.floor(saved.cast("double") / disk * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def dominates(owner_bundle: Column, bundle: Column, owner_availability: Column) -> Column:
    """Whether a bundle may use what another owns: its own, and whatever an eager bundle has."""
    return (owner_bundle == bundle) | F.coalesce(owner_availability == "eager", F.lit(False))


# fixed values: file extensions of image formats
EXTENSION = {"image/webp": ".webp", "image/avif": ".avif", "image/png": ".png", "image/jpeg": ".jpg"}


def renamed_to(path: Column, mime: Column) -> Column:
    """The path with the extension of a format (of WebP for unknown ones); a name without extension stays."""
    ext = F.lit(".webp")
    for name, e in EXTENSION.items():
        ext = F.when(mime == name, e).otherwise(ext)
    name = base_name(path)
    bare = F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", "")
    return F.when(name == bare, path).otherwise(F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(name)), bare, ext))


def convention_root(directory: Column, prefixes: list[str]) -> Column:
    """The deepest folder right under one of the named folders (`animations/hero`); null if there is none."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    at = F.array_max(F.filter(F.transform(parts, lambda s, i: F.when(s.isin(*prefixes) & (i < F.size(parts) - 1), i)), lambda i: i.isNotNull()))
    return F.when(at.isNotNull(), F.array_join(F.slice(parts, F.lit(1), at + 2), "/"))


def pack_bucket(path: Column, granularity: str) -> Column:
    """Which sheet a loose image goes to: one-sheet-for-all, per-top-level-bundle (images in the root share one) or per-leaf-folder."""
    if granularity == "one-sheet-for-all":
        return F.lit("")
    if granularity == "per-top-level-bundle":
        return F.when(F.instr(path, "/") > 0, bundle_of(path)).otherwise(F.lit(""))
    if granularity != "per-leaf-folder":
        raise ValueError(f"unknown granularity: {granularity}")
    return dir_of(path)


def key_of(path: Column, name: Column) -> Column:
    """What a file is known by: its path, or its bare name where it has none."""
    return normalize_path(F.coalesce(path, name))
