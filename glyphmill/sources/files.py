"""Folder scans: manifests, images, and how they belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import scalars as S

EXTENSIONS = r"(?i)\.(png|webp|jpe?g|avif|json|atlas|fnt|skel)$"


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root, normalised), content, length of the files that the audit reads. Content is read only where a consumer selects it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), f"^.*?{base.split('://')[-1].lstrip('/')}/", "")
    return f.filter(F.col("path").rlike(EXTENSIONS)).select(S.normalize_path(rel).alias("path"), "content", "length")


def manifest_kind(text: str = "text") -> F.Column:
    """sheet, skeleton or null of a JSON text, by its shape."""
    get = lambda p: F.get_json_object(F.col(text), p)
    sheet = F.coalesce(get("$.frames").rlike(r"^\s*[\[{]"), F.lit(False))
    skeleton = get("$.skeleton").isNotNull() & get("$.bones").isNotNull() & get("$.slots").isNotNull()
    return F.when(sheet, "sheet").when(skeleton & get("$.frames").isNull() & get("$.meta").isNull(), "skeleton")


def resolve_images(manifests: DataFrame, images: DataFrame) -> DataFrame:
    """manifests: path, image (as named in it). images: path. The image of each manifest: in its own folder, else, for a manifest
    in the root alone, the first of that base name anywhere. image_ref is null where it is missing."""
    near = F.when(S.dir_of(F.col("path")) == "", F.col("image")).otherwise(F.concat(S.dir_of(F.col("path")), F.lit("/"), F.col("image")))
    m = manifests.withColumns({"near": S.normalize_path(near), "base": S.base_name(F.col("image"))})
    i = images.select(F.col("path").alias("hit")).distinct()
    w = Window.partitionBy("base").orderBy("far")
    by_name = images.select(F.col("path").alias("far"), S.base_name(F.col("path")).alias("base")).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    j = m.join(i, m["near"] == i["hit"], "left").join(by_name, "base", "left")
    return j.select("path", "image", F.coalesce("hit", F.when(F.instr("path", "/") == 0, F.col("far"))).alias("image_ref"))


def missing(resolved: DataFrame) -> DataFrame:
    return resolved.filter("image_ref is null").select(F.col("path").alias("manifest"), "image")


def loose(images: DataFrame, resolved: DataFrame) -> DataFrame:
    """Images that no manifest names."""
    return images.join(resolved.select(F.col("image_ref").alias("path")), "path", "left_anti")


def ancestors(folder: F.Column) -> F.Column:
    """A folder and all above it, the deepest first; the root is empty text."""
    parts = F.filter(F.split(folder, "/"), lambda s: s != "")
    return F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def nearest_above(items: DataFrame, key: str, folder: F.Column, places: DataFrame) -> DataFrame:
    """items: with a unique key. places: folder, rank and other columns. Each item with the place of the nearest folder above it, of several in one folder the least
    by rank and then by their columns; an equi-join by exploded folders. Items without a place are left out."""
    names = [c for c in places.columns if c != "folder"]
    up = items.select(key, F.posexplode(ancestors(folder)).alias("up", "folder"))
    best = up.join(places, "folder").groupBy(key).agg(F.min(F.struct("up", *names, "folder")).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in names if c != "rank"], F.col("b.folder").alias("above"))


def discover_configs(folders: DataFrame, configs: DataFrame) -> DataFrame:
    """folders: folder. configs: path, kind (file, or package for one with a field that holds a configuration; other packages aren't rows). folder, path, kind: the
    configuration that holds for each folder: the nearest above, a file before a package. null where there is none."""
    rank = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "package", 1)
    c = configs.select(S.dir_of(F.col("path")).alias("folder"), rank.alias("rank"), "path", "kind").filter("rank is not null")
    f = folders.select("folder").distinct()
    return f.join(nearest_above(f.withColumnRenamed("folder", "of"), "of", F.col("of"), c).withColumnRenamed("of", "folder").drop("above"), "folder", "left")


def pack_groups(images: DataFrame, roots: DataFrame, small: int = 512, least: int = 2, granularity: str = "per-leaf-folder") -> DataFrame:
    """Loose images by group for packing: under a skeleton's folder, the deepest that holds them, whatever their size and number; others,
    if small, by bucket (see `scalars.pack_bucket`), which needs `least` of them."""
    r = roots.select(F.col("root").alias("folder")).distinct().withColumn("rank", F.lit(0))
    i = images.select("path", "w", "h").distinct()
    under = i.join(nearest_above(i, "path", S.dir_of(F.col("path")), r), "path", "left")
    key = F.when(F.col("above").isNotNull(), F.concat(F.lit("skeleton:"), "above")).when(F.greatest("w", "h") <= small, F.concat(F.lit("folder:"), S.pack_bucket(F.col("path"), granularity)))
    g = under.withColumn("group", key).filter("group is not null")
    enough = g.groupBy("group").count().filter((F.col("count") >= least) | F.col("group").startswith("skeleton:"))
    return g.join(enough.select("group"), "group").select("group", "path", "w", "h")


def regions(images: DataFrame) -> DataFrame:
    """images: group, name, path. Every path with whether it keeps the region of its name in its group (the first by binary order
    does) and whether several distinct paths claim that name."""
    r = images.select("group", "name", "path").distinct()
    claims = r.groupBy("group", "name").agg(F.min("path").alias("first"), F.count("*").alias("n"))
    return r.join(claims, ["group", "name"]).select("group", "name", "path", (F.col("path") == F.col("first")).alias("kept"), (F.col("n") > 1).alias("collides"))


def common_folders(images: DataFrame) -> DataFrame:
    """images: group, path. The deepest folder that holds all of a group (empty: the root): what the first and the last of its
    folders, part by part, have in common."""
    parts = F.filter(F.split(S.dir_of(F.col("path")), "/"), lambda s: s != "")
    g = images.groupBy("group").agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    k = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i)))
    return g.select("group", F.array_join(F.slice("lo", F.lit(1), k), "/").alias("folder"))


def folder_label(paths: DataFrame, by: str) -> DataFrame:
    """by, label: the first folder that all paths share; null where they don't, or where one lies in the root."""
    first = F.when(F.instr("path", "/") > 1, S.bundle_of(F.col("path")))
    g = paths.groupBy(by).agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.count(first).alias("n"), F.count("*").alias("all"))
    return g.select(by, F.when((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("all")), F.col("lo")).alias("label"))


def skeleton_pairs(atlases: DataFrame, skeletons: DataFrame, binaries: DataFrame) -> DataFrame:
    """atlas, skeleton: atlases and skeleton texts (all by path) of one folder; a binary skeleton in it leaves the folder out."""
    folder = lambda df, name: df.select(S.dir_of(F.col("path")).alias("folder"), F.col("path").alias(name))
    a = folder(atlases, "atlas").join(folder(binaries, "binary"), "folder", "left_anti")
    return a.join(folder(skeletons, "skeleton"), "folder").select("atlas", "skeleton")
