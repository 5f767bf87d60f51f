"""Reports as tables and files: findings in a fixed order, audits read back, manifests and export settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators.gate import SEVERITY_RANK

AUDIT = "findings array<struct<id:string,rule:string,severity:string,asset_ref:string,disk_saved:bigint,vram_saved:bigint>>, totals struct<disk:bigint,vram:bigint,loaded:bigint>"
SESSION = "session string, frames bigint, duration double, avg_draws double, p95 double, redundant bigint"


def _ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.expr(SEVERITY_RANK), "asset_ref", "rule", "id")


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding, worst first; nulls are left out, so unmeasured never reads as zero."""
    return _ordered(findings).select(F.to_json(F.struct(*findings.columns)).alias("value"))


def write_csv(findings: DataFrame, path: str) -> None:
    """Quotes doubled, and an empty field for null: blank isn't 0."""
    _ordered(findings).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def sarif_results(breaches: DataFrame) -> DataFrame:
    """Breaches in the shape of static-analysis results."""
    message = F.format_string("%s is %.4g, the budget is %.4g", "metric", "value", "budget")
    return breaches.filter("breach").select(F.concat(F.lit("budget/"), "metric").alias("ruleId"), F.when(F.col("level") == "error", "error").otherwise("warning").alias("level"), F.struct(message.alias("text")).alias("message"), F.coalesce("ref", F.lit(".")).alias("uri"))


def read_audits(spark: SparkSession, path: str) -> DataFrame:
    """Findings of saved audits, with the file of each; files of another shape fail."""
    a = spark.read.schema(AUDIT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return a.select(F.input_file_name().alias("file"), F.posexplode("findings").alias("ord", "f")).select("file", "ord", "f.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Runtime reports, bare or in an envelope; those without frames are refused as a whole."""
    s = spark.read.schema(f"{SESSION}, runtime struct<{SESSION.replace(' ', ':').replace(',:', ',')}>").option("multiLine", True).json(path)
    s = s.select(*[F.coalesce(F.col(f"runtime.{c}"), F.col(c)).alias(c) for c in (x.split()[0] for x in SESSION.split(", "))])
    return s.withColumn("frames", F.when(F.col("frames").isNull(), F.raise_error(F.lit("a session has no frames"))).otherwise(F.col("frames")))


def _frames(placed: DataFrame) -> DataFrame:
    """placed with all columns that emitters read; frames are as placed, so a turned one's own sides are swapped back."""
    has = set(placed.columns)
    col = lambda name, other: F.col(name) if name in has else other
    turned = F.coalesce(col("rotated", F.lit(False)), F.lit(False))
    own_w, own_h = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    trimmed = F.coalesce(col("trimmed", F.lit(False)), F.lit(False))
    return placed.select("asset_ref", "page", "page_w", "page_h", "name", "x", "y", own_w.alias("own_w"), own_h.alias("own_h"), turned.alias("turned"), trimmed.alias("cut"), F.coalesce(col("src_w", own_w), own_w).alias("from_w"), F.coalesce(col("src_h", own_h), own_h).alias("from_h"), F.coalesce(col("off_x", F.lit(0)), F.lit(0)).alias("at_x"), F.coalesce(col("off_y", F.lit(0)), F.lit(0)).alias("at_y"))


def sheet_manifests(placed: DataFrame) -> DataFrame:
    """placed: asset_ref, name, x, y, w, h, page, page_w, page_h, and where there are such rotated, trimmed, src_w, src_h, off_x, off_y. A manifest for each sheet as
    JSON, frames in name order; a trimmed frame says where in its source it lies."""
    box = lambda x, y, w, h: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).alias("w"), F.col(h).alias("h"))
    body = F.struct(box("x", "y", "own_w", "own_h").alias("frame"), F.col("turned").alias("rotated"), F.col("cut").alias("trimmed"), F.when(F.col("cut"), box("at_x", "at_y", "own_w", "own_h")).alias("spriteSourceSize"), F.struct(F.col("from_w").alias("w"), F.col("from_h").alias("h")).alias("sourceSize"))
    g = _frames(placed).groupBy("asset_ref", "page", "page_w", "page_h").agg(F.array_sort(F.collect_list(F.struct("name", body.alias("body")))).alias("e"))
    doc = F.struct(F.map_from_entries("e").alias("frames"), F.struct(F.col("page").alias("image"), F.struct(F.col("page_w").alias("w"), F.col("page_h").alias("h")).alias("size")).alias("meta"))
    return g.select("asset_ref", F.to_json(doc).alias("manifest"))


def atlas_texts(placed: DataFrame) -> DataFrame:
    """placed: as for sheet_manifests, offsets from the bottom. asset_ref, text: a page of an .atlas text for each sheet, regions in name order."""
    num = lambda *names: F.concat_ws(", ", *[F.col(n).cast("string") for n in names])
    line = F.concat_ws("\n", "name", F.concat(F.lit("  rotate: "), F.when(F.col("turned"), "90").otherwise("0")), F.concat(F.lit("  xy: "), num("x", "y")), F.concat(F.lit("  size: "), num("own_w", "own_h")), F.concat(F.lit("  orig: "), num("from_w", "from_h")), F.concat(F.lit("  offset: "), num("at_x", "at_y")), F.lit("  index: -1"))
    g = _frames(placed).groupBy("asset_ref", "page", "page_w", "page_h").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("e"))
    head = F.concat("page", F.lit("\nsize: "), F.col("page_w").cast("string"), F.lit(","), F.col("page_h").cast("string"), F.lit("\nformat: RGBA8888\nfilter: Linear,Linear\nrepeat: none\n"))
    return g.select("asset_ref", F.concat(head, F.array_join(F.transform("e", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def resolved_profiles(refs: DataFrame, overrides: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """refs: ref. overrides: ord, match (regex), and fields. Of the overrides that match a ref the last that sets a field decides it."""
    j = refs.join(F.broadcast(overrides), F.regexp_like("ref", F.col("match")), "left")
    return j.groupBy("ref").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields])


def skeleton_gaps(refs: DataFrame, regions: DataFrame) -> DataFrame:
    """refs: path, kind, value. regions: name. What a skeleton asks for and no region has; a prefix needs one region with digits behind it."""
    names = refs.filter("kind = 'name'").join(regions.select(F.col("name").alias("value")), "value", "left_anti")
    have = regions.select(F.regexp_replace("name", r"\d+$", "").alias("value")).filter("value <> ''").distinct()
    prefixes = refs.filter("kind = 'prefix'").join(have, "value", "left_anti")
    return names.select("path", "kind", "value").unionByName(prefixes.select("path", "kind", "value"))


def hashed_name(path: Column, content: Column) -> Column:
    """A file name with a short content hash before its extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8), F.regexp_extract(path, r"(\.[^./]*)$", 1))


def bundle_manifest(files: DataFrame) -> DataFrame:
    """files: bundle, path, suffix. Entries by bundle and suffix; of equal base names in a bundle the first path counts."""
    w = Window.partitionBy("bundle", "suffix", F.regexp_extract("path", r"[^/]*$", 0)).orderBy("path")
    f = files.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return f.groupBy("bundle", "suffix").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
