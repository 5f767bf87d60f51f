"""The driver's tables seen as the audit's relations.

Each adapter is one SQL text of whole-number arithmetic that both engines read alike; the rules over it are
DataFrame code here and SQL of their own for the comparison.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "sprites": """SELECT l_orderkey AS asset_ref, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS sprite_idx,
  concat('s', CAST(l_partkey % 40 AS STRING)) AS name, (l_partkey * 7 + l_linenumber * 61) % 300 AS x, (l_suppkey * 11 + l_linenumber * 37) % 300 AS y,
  8 + l_partkey % 180 AS w, 8 + (l_suppkey * 7 + l_linenumber * 13) % 180 AS h, l_returnflag = 'R' AS rotated, l_linestatus = 'F' AS trimmed,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('h', CAST(l_partkey % 97 AS STRING)) END AS frame_hash,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 4 END AS trim_x, l_suppkey % 5 AS trim_y,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 1 + (8 + l_partkey % 180) * 3 // 5 END AS trim_w, 1 + (8 + (l_suppkey * 7 + l_linenumber * 13) % 180) * 3 // 5 AS trim_h,
  8 + l_partkey % 180 + 10 AS src_w, 8 + (l_suppkey * 7 + l_linenumber * 13) % 180 + 10 AS src_h FROM lineitem""",
    "grid_sprites": """SELECT l_orderkey AS asset_ref, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS sprite_idx,
  (l_partkey % 6) * 40 + (l_suppkey % 3) * 4 AS x, (l_suppkey % 6) * 40 AS y, 28 + (l_linenumber % 3) * 6 AS w, 28 + (l_partkey % 3) * 6 AS h, l_returnflag = 'R' AS rotated FROM lineitem""",
    "atlases": """SELECT o_orderkey AS asset_ref, 256 * (1 + o_orderkey % 3) AS decl_w, 256 * (1 + o_custkey % 3) AS decl_h,
  CASE o_orderkey % 5 WHEN 0 THEN 'texturepacker-hash' WHEN 1 THEN 'texturepacker-array' WHEN 2 THEN 'pixi' WHEN 3 THEN 'spine' ELSE 'bmfont' END AS source_kind,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS DOUBLE) / 2 END AS scale, concat('img', CAST(o_custkey % 500 AS STRING)) AS image_ref, o_orderkey AS ord FROM orders""",
    "atlas_images": """SELECT o_orderkey AS asset_ref, 256 * (1 + o_orderkey % 3) + CASE WHEN o_custkey % 7 = 0 THEN -100 WHEN o_custkey % 7 = 1 THEN 64 WHEN o_custkey % 7 = 2 THEN 2 ELSE 0 END AS w,
  256 * (1 + o_custkey % 3) AS h, 1000 + o_custkey * 37 % 90000 AS byte_size FROM orders""",
    "images": """SELECT p_partkey AS asset_ref, concat('dir', CAST(p_partkey // 6 % 5 AS STRING), '/Pic', CAST(p_partkey // 6 AS STRING),
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '@' WHEN 2 THEN '_2x' WHEN 3 THEN '-hd_png' WHEN 4 THEN '_webp' ELSE '_720p' END, CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' WHEN 2 THEN '.jpg' ELSE '.png' END) AS path,
  16 + p_partkey * 37 % 3200 AS w, CASE WHEN p_size % 3 = 0 THEN 16 + p_partkey * 37 % 3200 ELSE 16 + p_partkey * 53 % 2900 END AS h,
  CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/jpeg' ELSE 'image/png' END AS mime, 500 + p_partkey * 7919 % 400000 AS byte_size,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey * 31 % 80000 END AS strippable_bytes, CASE WHEN p_size % 5 = 0 THEN 3144 + p_partkey % 7 END AS icc_bytes, CASE WHEN p_partkey % 3 = 0 THEN TRUE WHEN p_partkey % 3 = 1 THEN FALSE END AS icc_srgb,
  p_size % 2 = 0 AS loose FROM part""",
    "features": """SELECT p_partkey AS asset_ref, p_partkey AS ord, CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat('c', CAST(p_partkey % 600 AS STRING)) END AS content_hash, CASE WHEN p_partkey % 13 = 0 THEN TRUE WHEN p_partkey % 13 < 9 THEN FALSE END AS solid, p_partkey % 3 = 0 AS opaque,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size % 3 AS INT) END AS upscale_depth, 50 + p_partkey * 13 % 1500 AS bbox_w, 50 + p_partkey * 17 % 900 AS bbox_h, p_partkey * 7907 % 900000 AS interior_transparent, p_partkey % 6 = 1 AS binary_alpha,
  CASE p_partkey % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'alpha-art' WHEN 2 THEN 'photographic' END AS content_class, p_partkey % 100 AS pma_edge_pixels, CAST(p_partkey % 100 AS DOUBLE) / 100 AS pma_fringe_frac, concat('h', CAST(p_partkey % 300 AS STRING)) AS pixel_hash FROM part""",
    "encode_sizes": """SELECT p_partkey AS asset_ref, m AS target_mime, p_partkey % 2 = 0 AND m = 'image/png' AS opaque, (500 + p_partkey * 7919 % 400000) * (30 + (p_partkey * 3 + length(m)) % 75) // 100 AS bytes
  FROM part CROSS JOIN (SELECT 'image/avif' AS m UNION ALL SELECT 'image/webp' UNION ALL SELECT 'image/png') t WHERE p_partkey % 5 <> 0""",
    "hashes": """SELECT doc_id AS asset_ref, doc_id AS ord, md5(text) AS content_hash, concat(substr(md5(concat('g', CAST(doc_id // 4 AS STRING))), 1, 15), substr('0123456789abcdef', CAST(1 + doc_id % 4 * 3 AS INT), 1)) AS d_hash,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(doc_id * 7 % 40 AS DOUBLE) END AS mean_r, CAST(100 AS DOUBLE) AS mean_g, CAST(doc_id % 30 AS DOUBLE) AS mean_b, n_chars AS byte_size FROM documents""",
    "assets": """SELECT concat(source, '/', lang, '/a', CAST(doc_id % 50 AS STRING), '.png') AS asset_ref, md5(concat('x', CAST(doc_id % 90 AS STRING))) AS content_hash, CASE WHEN doc_id % 8 = 0 THEN 'spine' ELSE 'raw' END AS pool FROM documents""",
    "marking": """SELECT DISTINCT source AS bundle, CASE WHEN length(source) = 4 THEN 'eager' ELSE 'lazy' END AS availability FROM documents WHERE source <> 'src12'""",
    "frames": """SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(8 + event_id * 31 % 17 + CASE WHEN event_id % 41 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS dt,
  event_id * 7 % 90 AS draws, event_id % 30 AS binds, event_id % 13 AS redundant, CASE WHEN event_id % 82 = 0 THEN 1 ELSE 0 END AS uploads, CASE WHEN event_id % 123 = 0 THEN 1 ELSE 0 END AS compiles FROM events""",
    "siblings": """SELECT p_partkey AS asset_ref, concat('dir/pic', CAST(p_partkey // 4 AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' WHEN 2 THEN '.avif' ELSE '_hd.png' END) AS path,
  64 + p_partkey // 8 % 3 AS w, CASE WHEN p_partkey % 7 = 0 THEN 32 ELSE 64 END AS h, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/avif' ELSE 'image/png' END AS mime FROM part""",
    "blends": """SELECT DISTINCT user_id AS session, user_id % 3 = 0 AS straight, user_id % 4 = 0 AS premultiplied, user_id % 5 = 0 AS unpacked FROM events""",
    "calls": """SELECT user_id AS session, event_type AS target, event_id AS seq, concat('t', CAST(event_id % 3 AS STRING)) AS texture FROM events""",
    "gl_calls": """SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  split_part('bindTexture,bindTexture,bindTexture,bindTexture,bindTexture,createTexture,createTexture,createTexture,deleteTexture,texImage2D,texImage2D,texImage2D,compressedTexImage2D,compressedTexImage2D,compressedTexImage2D,generateMipmap,texSubImage2D,compressedTexSubImage2D,useProgram,useProgram,drawElements,drawArraysInstanced,compileShader,linkProgram,blendFunc,pixelStorei,frame', ',', CAST(1 + event_id * 7919 % 10007 % 27 AS INT)) AS call,
  concat('u', CAST(event_id % 2 AS STRING)) AS target, CASE WHEN event_id * 31 % 101 % 9 = 0 THEN NULL ELSE concat('t', CAST(event_id * 31 % 101 % 3 AS STRING)) END AS object, CASE WHEN event_id * 13 % 103 % 3 = 0 THEN 1 ELSE 0 END AS level,
  event_id * 17 % 300 AS w, event_id * 19 % 200 AS h, event_id * 23 % 5000 AS bytes, CASE event_id * 11 % 107 % 4 WHEN 0 THEN 1 WHEN 1 THEN 770 WHEN 2 THEN 37441 ELSE 0 END AS value FROM events""",
    "ruled": """SELECT o_orderkey AS id, split_part('integrity-missing-image,dimension-mismatch,bleeding,icc-non-srgb,premultiplied-alpha,dimensions-npot,dimensions-oversize,format,strippable-metadata,solid-fill,upscaled-source,wasted-alpha,binary-alpha,duplicate-exact,duplicate-similar,frame-redundancy,cross-atlas-redundancy,loose-in-atlas,occupancy,wasted-regions,trim-margin,excessive-gutter,spine-unreferenced-regions,interior-transparency,should-atlas,atlas-merge,repack-opportunity,variants,gpu-compression-alignment,mipmap-cost,font-glyph-page,own-rule', ',', CAST(1 + o_orderkey * 37 % 32 AS INT)) AS rule,
  CASE o_custkey % 3 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' ELSE 'info' END AS severity FROM orders""",
    "plan_findings": """SELECT o_custkey AS report, o_orderkey AS ord, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'atlas-merge' ELSE split_part('occupancy,dimensions-oversize,format,format,wasted-alpha,strippable-metadata,strippable-metadata,frame-redundancy,trim-margin,duplicate-similar,duplicate-exact,wasted-regions,dimensions-oversize,bleeding', ',', CAST(1 + o_orderkey * 37 % 101 % 14 AS INT)) END AS rule,
  o_orderkey % 19 = 0 AS folder, concat('a', CAST(o_orderkey * 7 % 103 % 12 AS STRING)) AS ref, 100 + o_orderkey * 31 % 5000 AS w, 100 + o_orderkey * 17 % 3000 AS h, CASE o_orderkey % 4 WHEN 0 THEN 'image/avif' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/none' END AS best_mime,
  CASE o_orderkey % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'photographic' END AS content_class FROM orders""",
    "plan_related": """SELECT o_custkey AS report, o_orderkey AS ord, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, concat('a', CAST(l_partkey % 12 AS STRING)) AS ref FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "plan_owners": """SELECT o_custkey AS report, o_orderkey AS grp, concat('a', CAST(o_orderkey * 13 % 107 % 12 AS STRING)) AS owner, CASE WHEN o_orderkey % 2 = 0 THEN concat('a', CAST(o_orderkey * 5 % 109 % 12 AS STRING)) END AS consumer FROM orders WHERE o_orderkey % 7 = 3""",
    "plan_figures": """SELECT DISTINCT o_custkey AS report, concat('a', CAST(o_orderkey * 7 % 103 % 12 AS STRING)) AS ref, CASE WHEN o_orderkey * 7 % 103 % 12 % 3 > 0 THEN o_custkey * 3 + o_orderkey * 7 % 103 % 12 END AS disk_saved, CASE WHEN o_orderkey * 7 % 103 % 12 % 4 > 1 THEN o_custkey * 5 END AS vram_saved FROM orders""",
    "plan_packs": """SELECT DISTINCT o_custkey AS report, o_orderkey % 2 AS pack, concat('a', CAST(o_orderkey % 2 + 2 * (o_orderkey * 3 % 113 % 6) AS STRING)) AS ref FROM orders WHERE o_orderkey % 5 = 1""",
    "attachments": """SELECT path, skin, slot, attachment, type, region_path, parent, parent_skin FROM (SELECT concat('k', CAST(l_orderkey AS STRING), '.json') AS path, concat('skin', CAST(l_suppkey % 3 AS STRING)) AS skin, concat('s', CAST(l_linenumber % 3 AS STRING)) AS slot, concat('n', CAST(l_partkey % 4 AS STRING)) AS attachment,
  split_part('region,mesh,linkedmesh,linkedmesh,clipping,point,weightedlinkedmesh', ',', CAST(1 + l_partkey * 7 % 101 % 7 AS INT)) AS type, CASE WHEN l_partkey % 5 = 0 THEN concat('dir/p', CAST(l_partkey % 6 AS STRING)) END AS region_path, CASE WHEN l_partkey % 11 > 0 THEN concat('n', CAST(l_partkey * 3 % 7 % 4 AS STRING)) END AS parent,
  CASE WHEN l_partkey % 3 = 0 THEN concat('skin', CAST(l_suppkey % 4 AS STRING)) END AS parent_skin, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3, l_linenumber % 3, l_partkey % 4 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) t WHERE nth = 1""",
    "packed_names": """SELECT DISTINCT concat('k', CAST(l_orderkey AS STRING), '.json') AS path, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'dir/p' ELSE 'n' END, CAST(l_partkey % 4 AS STRING)) AS name FROM lineitem WHERE l_partkey % 3 > 0""",
    "audits": """SELECT concat('folder', CAST(o_custkey % 40 AS STRING)) AS label, CAST(o_custkey AS BIGINT) * 86400000 AS at_ms, o_orderpriority AS metric, CAST(floor(sum(o_totalprice)) AS DOUBLE) AS value FROM orders GROUP BY o_custkey, o_orderpriority""",
    "configs": """SELECT concat(source, CASE WHEN length(source) = 4 THEN '' ELSE '/en' END, CASE WHEN doc_id % 2 = 0 THEN '/budget.json' ELSE '/package.json' END) AS path, CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'package' END AS kind FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 'package.json', 'package'""",
    "pictures": """SELECT concat('pics/p', CAST(p_partkey AS STRING), '.png') AS path, 20 + p_partkey * 7 % 61 AS w, 16 + p_partkey * 11 % 53 AS h, p_partkey * 13 % 256 AS red, p_partkey * 17 % 256 AS green, p_partkey * 19 % 256 AS blue, CASE WHEN p_partkey % 5 = 0 THEN 255 WHEN p_partkey % 7 = 0 THEN 40 ELSE 0 END AS ground,
  CASE WHEN p_partkey % 5 = 0 THEN 255 WHEN p_partkey % 3 = 0 THEN 128 ELSE 255 END AS alpha, p_partkey % 9 AS from_x, p_partkey % 8 AS from_y, 4 + p_partkey % 7 AS box_w, 3 + p_partkey % 5 AS box_h FROM part""",
    "before": """SELECT concat('f', CAST(o_custkey % 700 AS STRING)) AS id, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' ELSE 'info' END AS severity FROM orders WHERE o_orderkey % 2 = 0""",
    "after": """SELECT concat('f', CAST(o_custkey % 900 AS STRING)) AS id, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' ELSE 'info' END AS severity FROM orders WHERE o_orderkey % 2 = 1""",
    "found": """SELECT concat('f', CAST(o_orderkey AS STRING)) AS id, CAST(o_custkey % 400 AS BIGINT) AS asset_ref, CASE o_orderkey % 4 WHEN 0 THEN 'occupancy' WHEN 1 THEN 'dimensions-npot' WHEN 2 THEN 'format' ELSE 'duplicate-exact' END AS rule,
  CASE o_custkey % 4 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' WHEN 2 THEN 'info' ELSE 'ok' END AS severity, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 31 % 9973 END AS disk_saved, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey * 17 % 8887 END AS vram_saved FROM orders""",
}
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def duck(name: str) -> str:
    """The adapter as the second engine reads it."""
    return SQL[name]


def spark_sql(name: str) -> str:
    """`//` is the whole-number division of the second engine; here it is `div`."""
    return re.sub(r"//", "div", SQL[name])


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = spark_sql(name)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def with_relations(sql: str) -> str:
    """Prefix a comparison query with the adapters that it names."""
    names = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    return "WITH " + ", ".join(f"{n} AS ({duck(n)})" for n in names) + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else " " + sql.strip())
