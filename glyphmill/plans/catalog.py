"""Every query over the driver's tables, with SQL that a second engine runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import scalars as S
from glyphmill.operators import asset_rules as R
from glyphmill.operators import folder_rules as A
from glyphmill.operators import gate as B
from glyphmill.operators import geometry as G
from glyphmill.operators import gl_calls as GL
from glyphmill.operators import history as H
from glyphmill.operators import messages as M
from glyphmill.operators import near_duplicates as ND
from glyphmill.operators import packing as X
from glyphmill.operators import repack as RP
from glyphmill.operators import repair_plan as PL
from glyphmill.operators import runtime as T
from glyphmill.operators import sheet_output as SO
from glyphmill.plans import audit as AU
from glyphmill.plans import pictures as PX
from glyphmill.plans import reports as RE
from glyphmill.plans.adapters import relation, with_relations
from glyphmill.plans.storage import written
from glyphmill.sources import files
from glyphmill.sources import manifests as P
from glyphmill.sources import meshes as MS
from glyphmill.sources import skeletons as SK

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, build: Callable[..., DataFrame], relations: str, sql: str | None = None) -> None:
    """Register a query that builds on relations, in order, and its comparison."""
    names = relations.split()
    _QUERIES[name] = lambda spark, sf_dir: build(*[relation(spark, sf_dir, n) for n in names])
    if sql:
        _SQL[name] = with_relations(sql)


OCC = "occ AS (SELECT a.asset_ref, decl_w, decl_h, source_kind, scale, used, n, decl_w * decl_h AS area, least(1.0::DOUBLE, used::DOUBLE / (decl_w * decl_h)) AS occ FROM atlases a JOIN (SELECT asset_ref, sum(w * h)::BIGINT AS used, count(*) AS n FROM sprites GROUP BY 1) s USING (asset_ref))"
_add("r01_occupancy", R.occupancy, "sprites atlases", f"WITH {OCC} SELECT asset_ref, occ, greatest(area - used, 0) * 4 AS wasted_bytes, CASE WHEN greatest(area - used, 0) * 4 < 262144 THEN 'info' WHEN occ < 0.6 THEN 'crit' ELSE 'warn' END AS severity FROM occ WHERE occ < 0.8")
_add("r02_oversize", R.oversize, "images", "SELECT asset_ref, greatest(w, h) AS longest, CASE WHEN greatest(w, h) > 2730 THEN 'crit' ELSE 'warn' END AS severity FROM images WHERE greatest(w, h) > 2048")
POT = "i AS (SELECT *, CAST(pow(2, ceil(log2(w))) AS BIGINT) AS pw, CAST(pow(2, ceil(log2(h))) AS BIGINT) AS ph FROM images)"
_add("r03_npot", R.npot, "images", f"WITH {POT} SELECT asset_ref, 1 - (w * h)::DOUBLE / (pw * ph)::DOUBLE AS waste, pw * ph * 4 - w * h * 4 AS vram_saved, 'info' AS severity FROM i WHERE NOT (w = pw AND h = ph) AND 1 - (w * h)::DOUBLE / (pw * ph)::DOUBLE > 0.25")
_add("r04_solid_fill", R.solid_fill, "images features", "SELECT asset_ref, w * h * 4 - 4 AS vram_saved, CASE WHEN greatest(w, h) >= 1024 THEN 'warn' ELSE 'info' END AS severity FROM images JOIN features USING (asset_ref) WHERE solid AND least(w, h) >= 256")
_add("r05_upscaled_source", R.upscaled_source, "images features", "SELECT asset_ref, upscale_depth, w * h * 4 - (w >> upscale_depth) * (h >> upscale_depth) * 4 AS vram_saved, 'warn' AS severity FROM images JOIN features USING (asset_ref) WHERE upscale_depth >= 1 AND NOT coalesce(solid, false) AND greatest(w, h) >= 256")
_add("r06_frame_redundancy", R.frame_redundancy, "sprites atlas_images", """WITH c AS (SELECT asset_ref, frame_hash, count(DISTINCT (x, y, w, h)) AS n, arg_min(w * h, sprite_idx) AS area FROM sprites WHERE frame_hash IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT (x, y, w, h)) >= 3),
g AS (SELECT asset_ref, count(*) AS clusters, sum(area * (n - 1))::BIGINT AS area FROM c GROUP BY 1), t AS (SELECT asset_ref, sum(w * h)::BIGINT AS total FROM sprites GROUP BY 1)
SELECT asset_ref, clusters, area, area * 4 AS vram_saved, floor((byte_size * area)::DOUBLE / total + 0.5)::BIGINT AS disk_saved, 'warn' AS severity FROM g JOIN t USING (asset_ref) LEFT JOIN atlas_images USING (asset_ref)""")
_add("r07_trim_margin", R.trim_margin, "sprites atlases", """WITH m AS (SELECT *, CASE WHEN trim_w IS NULL THEN greatest(w, h) ELSE greatest(trim_x, trim_y, w - trim_x - trim_w, h - trim_y - trim_h) END AS margin, w * h - CASE WHEN trim_w IS NULL THEN 0 ELSE trim_w * trim_h END AS freed FROM sprites WHERE NOT trimmed),
f AS (SELECT *, row_number() OVER (PARTITION BY asset_ref, x, y, w, h ORDER BY sprite_idx) AS k FROM m WHERE margin >= 4), g AS (SELECT asset_ref, count(*) AS frames, sum(freed)::BIGINT AS freed FROM f WHERE k = 1 GROUP BY 1)
SELECT asset_ref, frames, freed, freed::DOUBLE / (decl_w * decl_h) AS share, 'info' AS severity FROM g JOIN atlases USING (asset_ref) WHERE freed::DOUBLE / (decl_w * decl_h) >= 0.05""")
_add("r08_wasted_alpha", R.wasted_alpha, "images features encode_sizes", "SELECT i.asset_ref, byte_size - bytes AS disk_saved, 'info' AS severity FROM images i JOIN features USING (asset_ref) JOIN encode_sizes e ON e.asset_ref = i.asset_ref AND e.target_mime = i.mime AND e.opaque WHERE features.opaque AND i.mime IN ('image/png', 'image/webp') AND least(w, h) >= 64 AND byte_size - bytes > 0 AND (byte_size - bytes)::DOUBLE / byte_size >= 0.05")
_add("r09_strippable_metadata", R.strippable_metadata, "images", "SELECT asset_ref, strippable_bytes AS disk_saved, CASE WHEN strippable_bytes >= 65536 THEN 'warn' ELSE 'info' END AS severity FROM images WHERE strippable_bytes >= 4096")
_add("r10_icc_non_srgb", R.icc_non_srgb, "images", "SELECT asset_ref, icc_bytes, 'info' AS severity FROM images WHERE icc_bytes IS NOT NULL AND icc_srgb IS NOT TRUE")
_add("r11_interior_transparency", R.interior_transparency, "images features", "SELECT asset_ref, bbox_w * bbox_h AS box, interior_transparent::DOUBLE / (bbox_w * bbox_h) AS share, 'info' AS severity FROM features WHERE bbox_w * bbox_h >= 16384 AND interior_transparent::DOUBLE / (bbox_w * bbox_h) >= 0.6")
_add("r12_binary_alpha", R.binary_alpha, "images features", "SELECT asset_ref, 'info' AS severity FROM images JOIN features USING (asset_ref) WHERE binary_alpha AND opaque IS NOT TRUE AND greatest(w, h) >= 128")
PLACES = "p AS (SELECT asset_ref, x, y, w, h, min(sprite_idx) AS p FROM grid_sprites WHERE NOT rotated GROUP BY ALL)"
TOUCH = f"{PLACES}, t AS (SELECT DISTINCT a.asset_ref, least(a.p, b.p) AS a, greatest(a.p, b.p) AS b FROM p a JOIN p b ON a.asset_ref = b.asset_ref AND a.p <> b.p AND ((b.x + b.w = a.x AND b.y < a.y + a.h AND a.y < b.y + b.h) OR (b.y + b.h = a.y AND b.x < a.x + a.w AND a.x < b.x + b.w)))"
_add("r13_touching_pairs", R.touching_pairs, "grid_sprites", f"WITH {TOUCH} SELECT * FROM t")
_add("r13_bleeding", lambda s: R.bleeding(s, R.DEFAULT.replace(bleed_info=1, bleed_warn=2)), "grid_sprites", f"WITH {TOUCH} SELECT asset_ref, count(*) AS pairs, CASE WHEN count(*) >= 2 THEN 'warn' ELSE 'info' END AS severity FROM t GROUP BY 1")
GAPS = f"""{PLACES.replace('WHERE NOT rotated', 'WHERE w > 0 AND h > 0')}, g AS (SELECT a.asset_ref, a.p, min(least(CASE WHEN b.y < a.y + a.h AND a.y < b.y + b.h AND b.x - a.x - a.w >= 0 THEN b.x - a.x - a.w END, CASE WHEN b.x < a.x + a.w AND a.x < b.x + b.w AND b.y - a.y - a.h >= 0 THEN b.y - a.y - a.h END)) AS gap
FROM p a JOIN p b ON a.asset_ref = b.asset_ref AND a.p <> b.p GROUP BY 1, 2)"""
_add("r14_neighbour_gaps", R.neighbour_gaps, "grid_sprites", f"WITH {GAPS} SELECT asset_ref, p, gap FROM g WHERE gap IS NOT NULL")
_add("r14_excessive_gutter", lambda s: R.excessive_gutter(s, R.DEFAULT.replace(gutter_gaps=2)), "grid_sprites", f"WITH {GAPS} SELECT asset_ref, count(*) AS gaps, quantile_disc(gap, 0.5)::BIGINT AS median, 'info' AS severity FROM g WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND quantile_disc(gap, 0.5) >= 8")
_add("r15_repack_opportunity", lambda s, a, i: R.repack_opportunity(a, X.trial_sizes(s, R.repack_room(a, i)), i), "sprites atlases atlas_images")


def _pages(sprites: DataFrame) -> DataFrame:
    return sprites.filter("asset_ref % 4 < 2").select(F.expr("asset_ref div 4").alias("file"), "asset_ref").distinct()


def _refs(sprites: DataFrame) -> DataFrame:
    r = sprites.filter("asset_ref % 4 < 2 and cast(substr(name, 2) as int) % 3 <> 0").select(F.expr("asset_ref div 4").alias("file"), "asset_ref", "name")
    return r.select("file", F.lit("name").alias("kind"), F.col("name").alias("value")).unionByName(r.filter("asset_ref % 8 = 0").select("file", F.lit("prefix").alias("kind"), F.substring("name", 1, 2).alias("value")))


_add("r16_unreferenced_regions", lambda s: R.unreferenced_regions(s, _pages(s), _refs(s)), "sprites", """WITH p AS (SELECT *, asset_ref // 4 AS file FROM sprites WHERE asset_ref % 4 < 2), r AS (SELECT * FROM p WHERE CAST(substr(name, 2) AS INT) % 3 <> 0),
n AS (SELECT DISTINCT file, name FROM p), m AS (SELECT file, name, (EXISTS (SELECT 1 FROM r WHERE r.file = n.file AND r.name = n.name) OR EXISTS (SELECT 1 FROM r WHERE r.file = n.file AND r.asset_ref % 8 = 0 AND regexp_matches(n.name, concat('^', substr(r.name, 1, 2), '[0-9]+$')))) AS hit FROM n),
ok AS (SELECT file FROM m GROUP BY 1 HAVING sum(hit::INT)::DOUBLE / count(*) >= 0.5), d AS (SELECT p.* FROM p JOIN m USING (file, name) WHERE NOT hit AND file IN (SELECT file FROM ok)),
a AS (SELECT asset_ref, sum(w * h)::BIGINT AS area FROM (SELECT DISTINCT asset_ref, x, y, w, h FROM d WHERE w > 0 AND h > 0) GROUP BY 1)
SELECT asset_ref, count(DISTINCT name) AS dead, coalesce(any_value(area), 0)::BIGINT AS area, 'info' AS severity FROM d LEFT JOIN a USING (asset_ref) GROUP BY 1""")
_add("r17_dimension_mismatch", R.dimension_mismatch, "atlases atlas_images sprites", """SELECT a.asset_ref, count(s.asset_ref) FILTER (WHERE s.x + s.w > i.w OR s.y + s.h > i.h) AS off_edge,
CASE WHEN (any_value(i.w) < any_value(decl_w) OR any_value(i.h) < any_value(decl_h)) AND count(s.asset_ref) FILTER (WHERE s.x + s.w > i.w OR s.y + s.h > i.h) > 0 THEN 'crit' WHEN any_value(i.w) < any_value(decl_w) OR any_value(i.h) < any_value(decl_h) THEN 'warn' ELSE 'info' END AS severity
FROM atlases a JOIN atlas_images i USING (asset_ref) LEFT JOIN sprites s ON s.asset_ref = a.asset_ref WHERE abs(i.w - decl_w) > 2 OR abs(i.h - decl_h) > 2 GROUP BY 1""")
GRID = """g AS (SELECT asset_ref, decl_w, decl_h, cell, ceil(decl_w / cell)::BIGINT AS cols, ceil(decl_h / cell)::BIGINT AS rows FROM (SELECT *, greatest(8, floor(greatest(decl_w, decl_h) / 64.0 + 0.5))::BIGINT AS cell FROM atlases)),
cov AS (SELECT DISTINCT asset_ref, r, c FROM g JOIN sprites s USING (asset_ref), unnest(generate_series(greatest(0, y // cell), least(rows - 1, (y + h - 1) // cell))) AS a(r), unnest(generate_series(greatest(0, x // cell), least(cols - 1, (x + w - 1) // cell))) AS b(c)),
e AS (SELECT g.asset_ref, r, c FROM (SELECT asset_ref, r, c FROM g, unnest(generate_series(0, rows - 1)) AS a(r), unnest(generate_series(0, cols - 1)) AS b(c)) AS g ANTI JOIN cov USING (asset_ref, r, c)),
run AS (SELECT asset_ref, r, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY asset_ref, r ORDER BY c) AS i FROM e) GROUP BY asset_ref, r, i),
blk AS (SELECT asset_ref, c0, c1, min(r) AS r0, max(r) AS r1 FROM (SELECT *, r - row_number() OVER (PARTITION BY asset_ref, c0, c1 ORDER BY r) AS j FROM run) GROUP BY asset_ref, c0, c1, j),
rect AS (SELECT asset_ref, c0 * cell AS x, r0 * cell AS y, least(decl_w, (c1 + 1) * cell) - c0 * cell AS w, least(decl_h, (r1 + 1) * cell) - r0 * cell AS h FROM blk JOIN g USING (asset_ref))"""
_add("g02_empty_rectangles", G.empty_rectangles, "sprites atlases", f"WITH {GRID} SELECT * FROM rect")
_add("g03_empty_summary", G.empty_summary, "sprites atlases", f"WITH {GRID} SELECT asset_ref, count(*) AS n, sum(w * h)::BIGINT AS area, max(w * h)::BIGINT AS largest, max(w * h)::DOUBLE / sum(w * h)::DOUBLE AS share FROM rect GROUP BY 1")
_add("r18_wasted_regions", G.wasted_regions, "sprites atlases", f"WITH {GRID}, {OCC} SELECT asset_ref, count(*) AS n, sum(w * h)::BIGINT AS area, max(w * h)::BIGINT AS largest, max(w * h)::DOUBLE / sum(w * h)::DOUBLE AS share, 'info' AS severity FROM rect JOIN occ USING (asset_ref) WHERE occ < 0.8 GROUP BY 1")
_add("a16_dispersion", G.dispersion, "sprites atlases", f"WITH {GRID} SELECT g.asset_ref, count(rect.asset_ref) AS n, 1 - coalesce(max(w * h)::DOUBLE / sum(w * h)::DOUBLE, 1.0) AS fragmentation FROM g LEFT JOIN rect USING (asset_ref) GROUP BY 1")
_FORMAT = "fb AS (SELECT asset_ref, arg_min(target_mime, (bytes, target_mime)) AS target_mime, min(bytes) AS bytes FROM encode_sizes WHERE target_mime IN ('image/avif', 'image/webp') AND NOT opaque GROUP BY 1), fm AS (SELECT i.asset_ref, target_mime, byte_size - bytes AS disk_saved, CASE WHEN content_class IN ('flat', 'alpha-art') THEN 'format-lossless' ELSE 'format' END AS rule, 'warn' AS severity FROM images i JOIN fb USING (asset_ref) LEFT JOIN features f ON f.asset_ref = i.asset_ref WHERE i.mime <> target_mime AND byte_size - bytes >= 4096 AND (byte_size - bytes)::DOUBLE / byte_size >= 0.25)"
_add("r19_format", R.format_candidates, "images features encode_sizes", f"WITH {_FORMAT} SELECT * FROM fm")
_add("r20_font_glyph_page", lambda s, a: R.font_glyph_page(s, a, R.DEFAULT.replace(glyphs=4)), "sprites atlases", f"WITH {OCC} SELECT asset_ref, n AS glyphs, occ, CASE WHEN occ <= 0.5 THEN 'warn' ELSE 'info' END AS severity FROM occ WHERE source_kind = 'bmfont' AND n >= 4")

_DUP = "dup AS (SELECT content_hash, count(*) AS n, min(asset_ref) AS first, arg_min(byte_size, asset_ref) * (count(*) - 1) AS disk_saved FROM images JOIN features USING (asset_ref) WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
_add("a01_duplicate_exact", A.duplicate_exact, "images features", f"WITH {_DUP} SELECT * FROM dup")
_add("a01_duplicate_documents", lambda h: A.duplicate_exact(h.select("asset_ref", "byte_size"), h), "hashes", "SELECT content_hash, count(*) AS n, min(asset_ref) AS first, arg_min(byte_size, asset_ref) * (count(*) - 1) AS disk_saved FROM hashes GROUP BY 1 HAVING count(*) > 1")
_XOR = "bit_count(xor(CAST(('0x' || substr(a.d_hash, 1, 8)) AS BIGINT), CAST(('0x' || substr(b.d_hash, 1, 8)) AS BIGINT))) + bit_count(xor(CAST(('0x' || substr(a.d_hash, 9, 8)) AS BIGINT), CAST(('0x' || substr(b.d_hash, 9, 8)) AS BIGINT)))"
_add("a02_similar_candidates", ND.similar_candidates, "hashes", f"SELECT a.d_hash, b.d_hash AS other, ({_XOR})::INT AS distance FROM (SELECT DISTINCT d_hash FROM hashes) a JOIN (SELECT DISTINCT d_hash FROM hashes) b ON a.d_hash < b.d_hash AND {_XOR} <= 6")
_add("a02_duplicate_similar", ND.duplicate_similar, "hashes")
_STEM = r"concat(regexp_extract(path, '^(.*/)?', 0), regexp_replace(regexp_replace(lower(regexp_extract(path, '[^/]*$', 0)), '\.[^.]*$', ''), '(?:[_-](?:\d+p|\d+x|hd|sd|png|webp|avif|jpe?g))+$', ''))"
_RES = r"regexp_matches(regexp_replace(lower(regexp_extract(path, '[^/]*$', 0)), '\.[^.]*$', ''), '[_-](?:\d+p|\d+x|hd|sd)(?:[_-](?:\d+p|\d+x|hd|sd|png|webp|avif|jpe?g))*$')"
_V = f"v AS (SELECT CASE WHEN {_RES} THEN {_STEM} ELSE concat({_STEM}, '|', CAST(floor(w::DOUBLE / h * 50 + 0.5) AS BIGINT)) END AS key, count(*) AS n, sum(w * h * 4)::BIGINT AS vram, min(w * h * 4) AS least, max(w * h * 4) AS most FROM images GROUP BY 1)"
_add("a03_should_atlas", A.should_atlas, "images", f"WITH small AS (SELECT * FROM images WHERE greatest(w, h) <= 512), {_V.replace('FROM images', 'FROM small')}, n AS (SELECT (SELECT count(*) FROM small) AS files, (SELECT count(*) FROM v) AS logical) SELECT * FROM n WHERE files >= 8 AND logical >= 8")
_add("a04_atlas_merge", A.atlas_merge, "sprites atlases", f"WITH {OCC}, m AS (SELECT scale, count(*) AS n, sum(used) AS used, sum(area) AS area, min(asset_ref) AS first, max(greatest(decl_w, decl_h))::BIGINT AS side FROM occ WHERE source_kind IN ('texturepacker-hash', 'texturepacker-array', 'pixi') AND occ < 0.5 GROUP BY 1 ORDER BY n DESC, first LIMIT 1), k AS (SELECT *, greatest(1, ceil(used / (side * side * 0.8::DOUBLE)))::BIGINT AS merged FROM m WHERE n >= 2) SELECT scale, n, merged, CASE WHEN area * 4 - merged * side * side * 4 > 0 THEN (area * 4 - merged * side * side * 4)::BIGINT END AS vram_saved FROM k WHERE merged < n")
_add("a05_missing_images", lambda a, i: A.missing_images(a.join(i.filter("asset_ref % 6 <> 1"), "asset_ref", "left_anti").select(F.col("asset_ref").alias("manifest"), F.col("image_ref").alias("image"))), "atlases atlas_images", "SELECT asset_ref AS manifest, image_ref AS image, 'crit' AS severity FROM atlases WHERE asset_ref NOT IN (SELECT asset_ref FROM atlas_images WHERE asset_ref % 6 <> 1)")
_add("a06_format_aggregate", lambda i, f, e: A.aggregate_saving(R.format_candidates(i, f, e)), "images features encode_sizes", f"WITH {_FORMAT} SELECT count(*) AS n, sum(disk_saved)::BIGINT AS disk_saved FROM fm HAVING count(*) >= 2 AND sum(disk_saved) > 0")
_add("a07_metadata_aggregate", lambda i: A.aggregate_saving(R.strippable_metadata(i)), "images", "SELECT count(*) AS n, sum(strippable_bytes)::BIGINT AS disk_saved FROM images WHERE strippable_bytes >= 4096 HAVING count(*) >= 2 AND sum(strippable_bytes) > 0")
_add("a08_premultiplied_alpha", A.premultiplied_alpha, "features", "SELECT count(*) AS n, 'info' AS severity FROM features WHERE pma_edge_pixels >= 24 AND pma_fringe_frac >= 0.75 HAVING count(*) >= 2")
_add("a09_variant_groups", A.variant_groups, "images", f"WITH {_V} SELECT * FROM v")
_add("a10_variants", A.variants, "images", f"WITH {_V} SELECT (sum(vram) - sum(most))::BIGINT AS vram_saved, count(*) AS logical FROM v")
_add("a11_format_siblings", A.format_siblings, "siblings", f"SELECT {_STEM} AS stem, w, h, count(DISTINCT mime) AS mimes, count(*) AS n FROM siblings WHERE NOT {_RES} GROUP BY 1, 2, 3 HAVING count(DISTINCT mime) > 1")
_add("a11_redundant_formats", lambda s, i, f, e: A.redundant_formats(s, R.format_candidates(i, f, e)), "siblings images features encode_sizes", f"WITH {_FORMAT}, s AS (SELECT asset_ref, mime, concat({_STEM}, '|', w, 'x', h) AS k FROM siblings WHERE NOT {_RES}) SELECT fm.asset_ref, fm.target_mime FROM fm JOIN s USING (asset_ref) WHERE EXISTS (SELECT 1 FROM s AS o WHERE o.k = s.k AND o.mime = fm.target_mime) AND (SELECT count(DISTINCT mime) FROM s AS o WHERE o.k = s.k) > 1")
_add("a12_loose_in_atlas", A.loose_in_atlas, "features sprites", "WITH f AS (SELECT frame_hash, asset_ref AS atlas_ref, sprite_idx FROM sprites WHERE frame_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_hash ORDER BY asset_ref, sprite_idx) = 1) SELECT asset_ref, atlas_ref, sprite_idx FROM features JOIN f ON pixel_hash = frame_hash")
_add("a13_gpu_alignment", A.gpu_alignment, "images", "SELECT count(*) AS n, 'info' AS severity FROM images WHERE w % 4 <> 0 OR h % 4 <> 0 HAVING count(*) >= 2")
_add("a14_mipmap_cost", A.mipmap_cost, "images", "SELECT sum(ceil((w * h * 4)::DOUBLE * 4.0 / 3)::BIGINT - w * h * 4)::BIGINT AS extra FROM images HAVING sum(ceil((w * h * 4)::DOUBLE * 4.0 / 3)::BIGINT - w * h * 4) > 4194304")
_U = "u AS (SELECT frame_hash, asset_ref, sprite_idx, w * h AS area FROM sprites WHERE frame_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_hash, asset_ref ORDER BY sprite_idx) = 1), o AS (SELECT frame_hash, count(*) AS sheets, min(asset_ref) AS owner FROM u GROUP BY 1 HAVING count(*) > 1)"
_add("a14_gates_of_few", lambda i: A.mipmap_cost(i.filter("asset_ref % 500 = 1 and w < 700")).select(F.lit("mipmaps").alias("gate")).unionByName(A.gpu_alignment(i.filter("asset_ref = 1")).select(F.lit("alignment").alias("gate"))).unionByName(A.aggregate_saving(R.strippable_metadata(i.filter("asset_ref between 400 and 402"))).select(F.lit("metadata").alias("gate"))).unionByName(A.gpu_alignment(i.filter("asset_ref < 9")).select(F.lit("alignment of several").alias("gate"))), "images",
"""SELECT 'mipmaps' AS gate FROM images WHERE asset_ref % 500 = 1 AND w < 700 HAVING sum(ceil((w * h * 4)::DOUBLE * 4.0 / 3)::BIGINT - w * h * 4) > 4194304 UNION ALL SELECT 'alignment' FROM images WHERE asset_ref = 1 AND (w % 4 <> 0 OR h % 4 <> 0) HAVING count(*) >= 2
UNION ALL SELECT 'metadata' FROM images WHERE asset_ref BETWEEN 400 AND 402 AND strippable_bytes >= 4096 HAVING count(*) >= 2 AND sum(strippable_bytes) > 0 UNION ALL SELECT 'alignment of several' FROM images WHERE asset_ref < 9 AND (w % 4 <> 0 OR h % 4 <> 0) HAVING count(*) >= 2""")
_add("a15_cross_atlas_redundancy", A.cross_atlas_redundancy, "sprites atlas_images", f"WITH {_U}, d AS (SELECT asset_ref, count(*) AS dupes, sum(area)::BIGINT AS area FROM u JOIN o USING (frame_hash) WHERE asset_ref <> owner GROUP BY 1), t AS (SELECT asset_ref, sum(w * h)::BIGINT AS total FROM sprites GROUP BY 1) SELECT asset_ref, dupes, area, area * 4 AS vram_saved, floor((byte_size * area)::DOUBLE / total + 0.5)::BIGINT AS disk_saved FROM d JOIN t USING (asset_ref) LEFT JOIN atlas_images USING (asset_ref)")
_add("a17_merge_shared_atlases", A.merge_shared_atlases, "sprites atlases", "SELECT image_ref, name, asset_ref, sprite_idx FROM sprites JOIN atlases USING (asset_ref) QUALIFY row_number() OVER (PARTITION BY image_ref, name ORDER BY ord, sprite_idx) = 1")
_add("a18_totals", A.totals, "images", f"WITH {_V} SELECT sum(byte_size)::BIGINT AS disk, sum(w * h * 4)::BIGINT AS vram, sum(ceil((w * h * 4)::DOUBLE * 4.0 / 3)::BIGINT)::BIGINT AS vram_mipmapped, count(*) AS textures, (SELECT sum(most) FROM v)::BIGINT AS loaded, ceil((SELECT sum(most) FROM v) * 4 / 3.0::DOUBLE)::BIGINT AS loaded_mipmapped, (SELECT count(*) FROM v) AS loaded_textures FROM images")
def _saved(images: DataFrame, features: DataFrame, sizes: DataFrame) -> DataFrame:
    i, f, e = images, features, sizes
    return A.potential_disk_saved(R.format_candidates(i, f, e).select("asset_ref", "disk_saved").unionByName(R.strippable_metadata(i).select("asset_ref", "disk_saved")).unionByName(R.wasted_alpha(i, f, e).select("asset_ref", "disk_saved")), i, f)


_SAVED = f"""{_FORMAT}, {_DUP}, wa AS (SELECT i.asset_ref, byte_size - bytes AS disk_saved FROM images i JOIN features USING (asset_ref) JOIN encode_sizes e ON e.asset_ref = i.asset_ref AND e.target_mime = i.mime AND e.opaque WHERE features.opaque AND i.mime IN ('image/png', 'image/webp') AND least(w, h) >= 64 AND byte_size - bytes > 0 AND (byte_size - bytes)::DOUBLE / byte_size >= 0.05),
per AS (SELECT asset_ref, max(disk_saved) AS best FROM (SELECT asset_ref, disk_saved FROM fm UNION ALL SELECT asset_ref, strippable_bytes FROM images WHERE strippable_bytes >= 4096 UNION ALL SELECT * FROM wa) GROUP BY 1),
gone AS (SELECT asset_ref FROM images JOIN features USING (asset_ref) JOIN dup USING (content_hash) WHERE asset_ref <> first), b AS (SELECT coalesce(sum(best), 0)::BIGINT AS best FROM per WHERE asset_ref NOT IN (SELECT asset_ref FROM gone))"""
_POTENTIAL = "SELECT best, (SELECT coalesce(sum(disk_saved), 0) FROM dup)::BIGINT AS copies, (best + (SELECT coalesce(sum(disk_saved), 0) FROM dup))::BIGINT AS potential FROM b"
_add("a19_potential_disk_saved", _saved, "images features encode_sizes", f"WITH {_SAVED} {_POTENTIAL}")


def _guard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a7", "a8"), ("a9", "a10")], "key string, value string")


_QUERIES["d05_dedup_edges"] = lambda spark, d: A.dedup_edges(relation(spark, d, "assets").distinct(), relation(spark, d, "marking"), _guard(spark))
_EDGES = """WITH f AS (SELECT DISTINCT asset_ref, content_hash, pool, split_part(asset_ref, '/', 1) AS bundle, CASE WHEN regexp_extract(asset_ref, '([^/]*)\\.png$', 1) IN ('a7', 'a9') THEN 'key' WHEN regexp_extract(asset_ref, '([^/]*)\\.png$', 1) IN ('a8', 'a10') THEN 'value' ELSE 'general' END AS skin FROM assets),
m AS (SELECT f.*, coalesce(availability, 'isolated') AS availability FROM f LEFT JOIN marking USING (bundle)),
g AS (SELECT *, count(*) OVER k AS n, min(CASE WHEN availability = 'eager' THEN asset_ref END) OVER k AS eager, min(asset_ref) OVER (PARTITION BY content_hash, pool, skin, bundle) AS local FROM m WINDOW k AS (PARTITION BY content_hash, pool, skin))
SELECT content_hash, pool, skin, asset_ref, coalesce(eager, local) AS owner, CASE WHEN asset_ref = coalesce(eager, local) THEN NULL WHEN eager IS NULL THEN concat('same-', availability, '-bundle') WHEN bundle = split_part(eager, '/', 1) THEN 'same-eager-bundle' ELSE 'eager-owner-cross-bundle' END AS reason FROM g WHERE n > 1"""
_SQL["d05_dedup_edges"] = with_relations(_EDGES)

_RANK = "CASE severity WHEN 'crit' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"
_PER_RULE = ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS \"findings.{r}\"" for r in B.RULES)
_PER_SEVERITY = ", ".join(f"count(*) FILTER (WHERE severity = '{r}') AS \"findings.{r}\"" for r in ("crit", "warn", "info"))
_add("b01_global_metrics", lambda i, f, e, n: B.global_metrics(A.totals(i), n, _saved(i, f, e), i), "images features encode_sizes found", f"WITH {_V}, {_SAVED}, n AS (SELECT {_PER_SEVERITY}, count(*) AS \"findings.total\", {_PER_RULE}, (SELECT sum(byte_size) FROM images)::BIGINT AS \"totals.diskBytes\", (SELECT sum(w * h * 4) FROM images)::BIGINT AS \"totals.vramBytes\", (SELECT sum(most) FROM v)::BIGINT AS \"totals.loadedVramBytes\", (SELECT potential FROM ({_POTENTIAL}))::BIGINT AS \"totals.potentialDiskSaved\", (SELECT count(*) FROM images) AS \"drawCallsLowerBound\" FROM found) UNPIVOT n ON COLUMNS(*) INTO NAME metric VALUE value")
_METRICS = "SELECT 'asset' AS scope, path AS ref, 'vramBytes' AS metric, (w * h * 4)::DOUBLE AS value FROM images UNION ALL SELECT 'asset', path, 'diskBytes', byte_size::DOUBLE FROM images UNION ALL SELECT 'asset', path, 'oversizePx', greatest(w, h)::DOUBLE FROM images"


def _gate(images: DataFrame) -> DataFrame:
    from glyphmill.config import parse_budget

    m = B.asset_metrics(images.select(F.col("path").alias("asset_ref"), S.vram_bytes(F.col("w"), F.col("h")).alias("vram"), F.col("byte_size").alias("disk"), F.lit(None).alias("occupancy"), F.greatest("w", "h").alias("oversizePx")))
    rows, _ = parse_budget({"version": 1, "budgets": {}, "assets": [{"match": "dir1/**", "budgets": {"vramBytes": {"error": {"max": "8 MB"}}, "diskBytes": {"warn": {"max": "100 KB"}}}}, {"match": "**/*.png", "budgets": {"oversizePx": {"warn": {"max": 2000}}}}]})
    budgets = images.sparkSession.createDataFrame(rows, "ord int, scope string, match string, metric string, level string, chk string, budget double")
    return B.evaluate(m.select(F.lit("asset").alias("scope"), F.col("asset_ref").alias("ref"), "metric", "value"), budgets).drop("delta_pct")


_add("b05_gate", _gate, "images", f"WITH m AS ({_METRICS}), c AS (SELECT *, CASE WHEN ref LIKE 'dir1/%' THEN 0 WHEN ref LIKE '%.png' THEN 1 END AS ord FROM m), b AS (SELECT 0 AS ord, 'vramBytes' AS metric, 'error' AS level, 'max' AS chk, 8388608::DOUBLE AS budget UNION ALL SELECT 0, 'diskBytes', 'warn', 'max', 102400 UNION ALL SELECT 1, 'oversizePx', 'warn', 'max', 2000) SELECT scope, ref, metric, level, chk, value, budget, value > budget AS breach FROM c JOIN b USING (ord, metric)")
_add("b06_verdict", lambda i: B.verdict(_gate(i)), "images", f"WITH m AS ({_METRICS}), c AS (SELECT *, CASE WHEN ref LIKE 'dir1/%' THEN 0 WHEN ref LIKE '%.png' THEN 1 END AS ord FROM m), n AS (SELECT count(*) FILTER (WHERE ord = 0 AND metric = 'vramBytes' AND value > 8388608) AS errors, count(*) FILTER (WHERE (ord = 0 AND metric = 'diskBytes' AND value > 102400) OR (ord = 1 AND metric = 'oversizePx' AND value > 2000)) AS warnings FROM c) SELECT errors, warnings, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS verdict, CASE WHEN errors > 0 THEN 1 ELSE 0 END AS exit_code FROM n")
_add("k03_worst_first", lambda i: B.worst_first(_gate(i)), "images", f"WITH m AS ({_METRICS}), c AS (SELECT *, CASE WHEN ref LIKE 'dir1/%' THEN 0 WHEN ref LIKE '%.png' THEN 1 END AS ord FROM m), b AS (SELECT 0 AS ord, 'vramBytes' AS metric, 'error' AS level, 'max' AS chk, 8388608::DOUBLE AS budget UNION ALL SELECT 0, 'diskBytes', 'warn', 'max', 102400 UNION ALL SELECT 1, 'oversizePx', 'warn', 'max', 2000) SELECT scope, ref, metric, level, chk, value, budget, value > budget AS breach, abs((value - budget) / budget) AS over FROM c JOIN b USING (ord, metric) WHERE value > budget ORDER BY CASE WHEN level = 'error' THEN 0 ELSE 1 END, over DESC, ref, metric LIMIT 10")
_add("b07_diff_metrics", lambda b, a: B.diff_metrics(b.groupBy(F.col("severity").alias("metric")).agg(F.count("*").alias("value")), a.groupBy(F.col("severity").alias("metric")).agg(F.count("*").alias("value"))), "before after", "WITH b AS (SELECT severity AS metric, count(*) AS before FROM before GROUP BY 1), a AS (SELECT severity AS metric, count(*) AS after FROM after GROUP BY 1) SELECT metric, b.before, a.after, a.after - b.before AS delta, (a.after - b.before)::DOUBLE * 100 / b.before AS pct FROM b JOIN a USING (metric)")
_DIFF = "x AS (SELECT id, arg_max(severity, ord) AS before FROM before GROUP BY 1), y AS (SELECT id, arg_max(severity, ord) AS after FROM after GROUP BY 1), df AS (SELECT id, x.before, y.after, CASE WHEN x.before IS NULL THEN 'added' WHEN y.after IS NULL THEN 'resolved' WHEN x.before <> y.after THEN 'changed' END AS status FROM x FULL JOIN y USING (id))"
_add("b08_diff_findings", B.diff_findings, "before after", f"WITH {_DIFF} SELECT id, before, after, status FROM df WHERE status IS NOT NULL")
_add("b09_has_regression", lambda b, a: B.has_regression(B.diff_findings(b, a), "warn"), "before after", f"WITH {_DIFF} SELECT count(*) FILTER (WHERE (status = 'added' OR (status = 'changed' AND {_RANK.replace('severity', 'after')} < {_RANK.replace('severity', 'before')})) AND {_RANK.replace('severity', 'after')} <= 1) > 0 AS regression FROM df")
_add("b10_biggest_wins", B.biggest_wins, "found", f"WITH u AS (SELECT id, asset_ref, {_RANK} AS r, 'disk_saved' AS axis, disk_saved AS bytes FROM found UNION ALL SELECT id, asset_ref, {_RANK}, 'vram_saved', vram_saved FROM found) SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY bytes DESC, r, asset_ref, id)::INT AS place, id, asset_ref, bytes FROM u WHERE bytes > 0 QUALIFY place <= 3")
_add("b12_filter_findings", lambda f: B.filter_findings(f, "warn").select("id", "severity"), "found", "SELECT id, severity FROM found WHERE severity IN ('crit', 'warn')")
_add("k05_sorted_findings", lambda f: B.sorted_findings(f), "found", "SELECT * FROM found")
_add("u01_triage", lambda f: B.triage(f, f.select("asset_ref").distinct()), "found", "SELECT count(*) FILTER (WHERE severity = 'crit') AS crit, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'ok') AS ok, (SELECT count(*) FROM (SELECT asset_ref FROM found GROUP BY 1 HAVING count(*) FILTER (WHERE severity <> 'ok') = 0)) AS clean FROM found")
_add("u02_worst_per_asset", B.worst_per_asset, "found", f"SELECT asset_ref, id, rule, severity FROM found QUALIFY row_number() OVER (PARTITION BY asset_ref ORDER BY {_RANK}, id) = 1")
_add("u03_loose_dominated", lambda f, i: B.loose_dominated(f, i.withColumn("loose", F.col("loose") | (F.col("asset_ref") % 3 == 0)), small=3000), "found images", """WITH i AS (SELECT asset_ref, loose OR asset_ref % 3 = 0 AS loose, greatest(w, h) <= 3000 AS small FROM images), s AS (SELECT count(*) FILTER (WHERE loose AND small)::DOUBLE / count(*) AS share, count(*) FILTER (WHERE loose AND small) AS k FROM i)
SELECT asset_ref, id, rule, share FROM found, s WHERE share >= 0.5 AND k >= 8 AND rule IN ('dimensions-npot', 'format') AND severity <> 'crit' AND asset_ref IN (SELECT asset_ref FROM i WHERE loose)""")
_add("u04_budget_model", lambda i: B.budget_model(A.totals(i), 256 << 20), "images", f"WITH {_V}, l AS (SELECT sum(most)::BIGINT AS loaded FROM v) SELECT loaded, 268435456::BIGINT AS \"limit\", floor(loaded * 1000.0::DOUBLE / 268435456 + 0.5) / 10 AS pct, loaded > 268435456 AS over, greatest(268435456 - loaded, 0) AS left FROM l".replace("AS left FROM", 'AS "left" FROM'))
_add("u07_rule_rollup", B.rule_rollup, "ruled", """WITH f AS (SELECT *, CASE WHEN rule IN ('integrity-missing-image', 'dimension-mismatch', 'bleeding', 'icc-non-srgb', 'premultiplied-alpha', 'dimensions-npot', 'dimensions-oversize') THEN 'integrity'
WHEN rule IN ('variants', 'gpu-compression-alignment', 'mipmap-cost', 'font-glyph-page') THEN 'vram' WHEN rule IN ('occupancy', 'wasted-regions', 'trim-margin', 'excessive-gutter', 'spine-unreferenced-regions', 'interior-transparency', 'should-atlas', 'atlas-merge', 'repack-opportunity') THEN 'packing'
WHEN rule = 'own-rule' THEN 'other' ELSE 'savings' END AS rule_group FROM ruled) SELECT rule_group, rule, severity, count(*) AS n FROM f GROUP BY ROLLUP (rule_group, rule, severity)""")

_WIN = "wf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS nth, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM frames) WHERE back <= 1800), pl AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY dt, seq) AS k, count(*) OVER (PARTITION BY session) AS n FROM wf WHERE nth > 30)"
_REP = f"{_WIN}, rp AS (SELECT session, a.frames, a.duration, play_frames, avg_draws, max_draws, p95, median, redundant FROM (SELECT session, count(*) AS frames, sum(dt) AS duration FROM wf GROUP BY 1) a LEFT JOIN (SELECT session, count(*) AS play_frames, avg(CASE WHEN draws > 0 THEN draws END) AS avg_draws, max(draws) AS max_draws, max(CASE WHEN k - 1 = least(n - 1, n * 95 // 100) THEN dt END) AS p95, max(CASE WHEN k - 1 = least(n - 1, n // 2) THEN dt END) AS median, sum(redundant)::BIGINT AS redundant FROM pl GROUP BY 1) b USING (session))"
_add("t01_redundant_binds", T.redundant_binds, "calls", "SELECT session, count(*) AS binds, count(*) FILTER (WHERE same) AS redundant FROM (SELECT session, texture = lag(texture) OVER (PARTITION BY session, target ORDER BY seq) AS same FROM calls) GROUP BY 1")
_add("t02_counters", lambda f: f.groupBy("session").agg(F.sum("draws").alias("draws"), F.sum("binds").alias("binds"), F.bool_or(F.col("uploads") > 0).alias("any_upload")), "frames", "SELECT session, sum(draws)::BIGINT AS draws, sum(binds)::BIGINT AS binds, bool_or(uploads > 0) AS any_upload FROM frames GROUP BY 1")
_add("t03_window_frames", lambda f: T.window_frames(f, 40).filter("nth > 30").select("session", "seq", "nth"), "frames", "SELECT session, seq, seq::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM frames) WHERE back <= 40 AND seq > 30")
_add("t04_session_reports", T.session_reports, "frames", f"WITH {_REP} SELECT * FROM rp")
_add("t05_hitches", T.hitches, "frames", f"WITH {_REP} SELECT session, seq, dt, CASE WHEN uploads > 0 THEN 'texture upload' WHEN compiles > 0 THEN 'shader compile' ELSE 'cpu/gpu spike' END AS cause, row_number() OVER (PARTITION BY session ORDER BY seq)::INT AS place FROM wf JOIN rp USING (session) WHERE nth > 30 AND median > 0 AND dt > 2 * median AND dt > 16 QUALIFY place <= 20")
GL_SQL = """gb AS (SELECT *, last_value(CASE WHEN call = 'bindTexture' THEN {'o': object} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS b FROM gl_calls),
ge AS (SELECT session, seq, call, level, w, h, bytes, CASE WHEN call IN ('createTexture', 'deleteTexture') THEN object ELSE b.o END AS texture FROM gb WHERE call IN ('createTexture', 'deleteTexture', 'texImage2D', 'compressedTexImage2D', 'generateMipmap')),
gx AS (SELECT *, count(*) FILTER (WHERE call = 'createTexture') OVER k AS gen, last_value(CASE WHEN call IN ('createTexture', 'deleteTexture') THEN call END IGNORE NULLS) OVER k = 'createTexture' AS alive FROM ge WHERE texture IS NOT NULL WINDOW k AS (PARTITION BY session, texture ORDER BY seq ROWS UNBOUNDED PRECEDING)),
gy AS (SELECT *, max(gen) OVER p AS gens, arg_max(alive, seq) OVER p AS lives, max(CASE WHEN call = 'compressedTexImage2D' AND level = 0 AND alive THEN seq END) OVER (PARTITION BY session, texture, gen) AS chain FROM gx WINDOW p AS (PARTITION BY session, texture)),
gz AS (SELECT * FROM gy WHERE lives AND alive AND gen = gens),
gl AS (SELECT session, texture, sum(bytes)::BIGINT AS compressed FROM (SELECT session, texture, level, arg_max(bytes, seq) AS bytes FROM gz WHERE call = 'compressedTexImage2D' AND seq >= coalesce(chain, 0) GROUP BY ALL) GROUP BY ALL),
gt AS (SELECT session, texture, coalesce(arg_max(w, seq) FILTER (WHERE call IN ('texImage2D', 'compressedTexImage2D') AND level = 0 AND w > 0 AND h > 0), 0)::BIGINT AS w, coalesce(arg_max(h, seq) FILTER (WHERE call IN ('texImage2D', 'compressedTexImage2D') AND level = 0 AND w > 0 AND h > 0), 0)::BIGINT AS h, bool_or(call = 'generateMipmap') AS mipmapped FROM gz GROUP BY ALL),
tx AS (SELECT session, texture, w, h, mipmapped, coalesce(compressed, 0)::BIGINT AS compressed FROM gt LEFT JOIN gl USING (session, texture)),
lv AS (SELECT session, count(*) AS live_textures, floor(sum(CASE WHEN compressed > 0 THEN compressed::DOUBLE WHEN mipmapped THEN w * h * 4 * 4 / 3.0::DOUBLE ELSE (w * h * 4)::DOUBLE END) + 0.5)::BIGINT AS vram, sum(compressed)::BIGINT AS compressed FROM tx GROUP BY 1)"""
_add("t01_textures", GL.textures, "gl_calls", f"WITH {GL_SQL} SELECT * FROM tx")
_add("t01_gl_counters", GL.session_counters, "gl_calls", f"""WITH {GL_SQL}, bt AS (SELECT session, count(*) AS texture_binds, count(*) FILTER (WHERE prior IS NOT NULL AND object IS NOT DISTINCT FROM was) AS redundant_texture_binds FROM (SELECT session, object, lag(seq) OVER k AS prior, lag(object) OVER k AS was FROM gl_calls WHERE call = 'bindTexture' WINDOW k AS (PARTITION BY session, target ORDER BY seq)) GROUP BY 1),
bp AS (SELECT session, count(*) AS program_binds, count(*) FILTER (WHERE prior IS NOT NULL AND object IS NOT DISTINCT FROM was) AS redundant_program_binds FROM (SELECT session, object, lag(seq) OVER k AS prior, lag(object) OVER k AS was FROM gl_calls WHERE call = 'useProgram' WINDOW k AS (PARTITION BY session ORDER BY seq)) GROUP BY 1),
n AS (SELECT session, count(*) FILTER (WHERE call IN ('drawElements', 'drawElementsInstanced')) AS draw_elements, count(*) FILTER (WHERE call IN ('drawArrays', 'drawArraysInstanced')) AS draw_arrays, count(*) FILTER (WHERE call IN ('texImage2D', 'texSubImage2D', 'compressedTexImage2D', 'compressedTexSubImage2D')) AS uploads,
count(*) FILTER (WHERE call = 'compileShader') AS compiles, count(*) FILTER (WHERE call = 'linkProgram') AS links, count(*) FILTER (WHERE call = 'frame') AS frames, coalesce(bool_or(call = 'blendFunc' AND value = 1), FALSE) AS premultiplied, bool_or(call = 'blendFunc' AND value = 770) AS straight, bool_or(call = 'pixelStorei' AND value = 37441 AND level <> 0) AS unpack_premultiply FROM gl_calls GROUP BY 1)
SELECT n.*, coalesce(texture_binds, 0) AS texture_binds, coalesce(redundant_texture_binds, 0) AS redundant_texture_binds, coalesce(program_binds, 0) AS program_binds, coalesce(redundant_program_binds, 0) AS redundant_program_binds, coalesce(live_textures, 0) AS live_textures, coalesce(vram, 0) AS vram, coalesce(compressed, 0) AS compressed
FROM n LEFT JOIN bt USING (session) LEFT JOIN bp USING (session) LEFT JOIN lv USING (session)""")
_STATIC = ((6, 0, False), (2, 5, False), (2, 0, True), (3, 0, False))


def _batching(frames: DataFrame) -> DataFrame:
    """Each of a few static findings against all sessions."""
    reports, out = T.session_reports(frames), None
    for i, row in enumerate(_STATIC):
        static = frames.sparkSession.createDataFrame([row], "atlases long, loose long, mergeable boolean")
        one = T.batching(static, reports.withColumn("max_draws", F.col("max_draws") - 60 * (F.col("session") % 2))).withColumn("static", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


_add("t06_batching", _batching, "frames", f"WITH {_REP}, st(static, atlases, loose, mergeable) AS (VALUES {', '.join(str((i, *row)) for i, row in enumerate(_STATIC))}), k AS (SELECT *, CASE WHEN loose > 0 THEN atlases + 1 ELSE greatest(2, ceil(atlases / 2.0)) END::BIGINT AS ideal FROM st), m AS (SELECT session, max_draws - 60 * (session % 2) AS max_draws FROM rp) SELECT session, max_draws, ideal, static FROM m, k WHERE (loose > 0 OR mergeable OR atlases >= 4) AND (max_draws > 50 OR (max_draws >= 4 AND max_draws > 3 * ideal))")
_add("t08_hitch_costs", lambda f: T.hitch_costs(T.hitches(f)), "frames", f"WITH {_REP}, h AS (SELECT session, dt, CASE WHEN uploads > 0 THEN 'texture upload' WHEN compiles > 0 THEN 'shader compile' ELSE 'cpu/gpu spike' END AS cause, row_number() OVER (PARTITION BY session ORDER BY seq) AS place FROM wf JOIN rp USING (session) WHERE nth > 30 AND median > 0 AND dt > 2 * median AND dt > 16 QUALIFY place <= 20) SELECT session, cause, count(*) AS n, sum(dt) AS ms FROM h GROUP BY 1, 2")
_add("t09_redundant_state", lambda f: T.redundant_state(T.session_reports(f.withColumn("redundant", F.col("redundant") * 2))), "frames", f"WITH {_REP} SELECT session, 2 * redundant::DOUBLE / frames AS per_frame FROM rp WHERE frames > 0 AND 2 * redundant::DOUBLE / frames > 5")
_add("t10_premultiplied_blend", lambda f, b: T.premultiplied_blend(A.premultiplied_alpha(f), b), "features blends", "WITH h AS (SELECT count(*) AS n FROM features WHERE pma_edge_pixels >= 24 AND pma_fringe_frac >= 0.75) SELECT session, n, CASE WHEN straight AND premultiplied THEN 'inconclusive' WHEN straight THEN 'halo' WHEN premultiplied THEN 'safe' ELSE 'inconclusive' END AS result FROM blends, h WHERE n >= 2 AND (straight OR premultiplied OR unpacked)")
_add("t11_correlate_fix", lambda i: T.correlate_fix(i.select(F.col("byte_size").cast("double").alias("before"), (F.col("byte_size") - F.col("strippable_bytes")).cast("double").alias("after"))), "images", "WITH s AS (SELECT sum(byte_size)::DOUBLE AS before, sum(byte_size - strippable_bytes)::DOUBLE AS after FROM images WHERE strippable_bytes IS NOT NULL) SELECT before, after, after / before AS ratio, CASE WHEN after / before <= 0.34 THEN 'crit' WHEN after / before <= 0.67 THEN 'warn' ELSE 'info' END AS severity FROM s")
_REPORT = """{w} AS (SELECT *, nth > 30 AS play, nth > 30 AND dt > 0 AS timed FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS nth, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM {src}) WHERE back <= 1800),
{w}k AS (SELECT *, row_number() OVER (PARTITION BY session, timed ORDER BY dt, seq) - 1 AS k, count(*) OVER (PARTITION BY session, timed) AS n FROM {w}),
{w}r AS (SELECT session, count(*) AS frames, floor(sum(dt) + 0.5)::BIGINT AS duration, floor(coalesce(avg(draws) FILTER (WHERE play AND draws > 0), 0) * 10 + 0.5) / 10 AS draws_avg, coalesce(max(draws) FILTER (WHERE play), 0)::BIGINT AS draws_max,
floor(coalesce(avg(binds) FILTER (WHERE play AND draws > 0), 0) * 10 + 0.5) / 10 AS binds_avg, coalesce(max(binds) FILTER (WHERE play), 0)::BIGINT AS binds_max, coalesce(sum(redundant) FILTER (WHERE play), 0)::BIGINT AS redundant, coalesce(sum(uploads) FILTER (WHERE play), 0)::BIGINT AS uploads,
coalesce(sum(compiles) FILTER (WHERE play), 0)::BIGINT AS compiles, floor(coalesce(1000.0::DOUBLE / avg(dt) FILTER (WHERE timed), 0) * 10 + 0.5) / 10 AS fps, floor(coalesce(avg(dt) FILTER (WHERE timed), 0) * 10 + 0.5) / 10 AS frame_ms,
floor(coalesce(max(dt) FILTER (WHERE timed AND k = least(n - 1, n * 95 // 100)), 0) * 10 + 0.5) / 10 AS frame_ms_p95, coalesce(max(dt) FILTER (WHERE timed AND k = least(n - 1, n // 2)), 0) AS median FROM {w}k GROUP BY 1),
{w}h AS (SELECT session, count(*) FILTER (WHERE play AND median > 0 AND dt > 2 * median AND dt > 16) AS hitches FROM {w} JOIN {w}r USING (session) GROUP BY 1),
{w}f AS (SELECT session, frames, duration, draws_avg, draws_max, binds_avg, binds_max, redundant, uploads, compiles, fps, frame_ms, frame_ms_p95, least(hitches, 20)::BIGINT AS hitches FROM {w}r JOIN {w}h USING (session))"""
def _probed(images: DataFrame, calls: DataFrame) -> DataFrame:
    sheets = calls.select("session").distinct().withColumn("asset_ref", F.col("session") * 3)
    metrics = images.select("asset_ref", S.vram_bytes(F.col("w"), F.col("h")).alias("vram"))
    return T.attach_probe(metrics, T.probe_readings(GL.session_counters(calls), sheets))


_PROBED = f"""{GL_SQL}, rd AS (SELECT session * 3 AS asset_ref, count(*) FILTER (WHERE call IN ('drawElements', 'drawElementsInstanced', 'drawArrays', 'drawArraysInstanced')) AS draw_calls, any_value(coalesce(lv.vram, 0)) AS vram, any_value(coalesce(live_textures, 0)) AS live_textures,
count(*) FILTER (WHERE call IN ('texImage2D', 'texSubImage2D', 'compressedTexImage2D', 'compressedTexSubImage2D')) AS uploads, count(*) FILTER (WHERE call = 'compileShader') AS compiles FROM gl_calls LEFT JOIN lv USING (session) GROUP BY session),
pb AS (SELECT i.asset_ref, w * h * 4 AS vram, rd.draw_calls AS probe_draw_calls, rd.vram AS probe_vram, rd.live_textures AS probe_live_textures, rd.uploads AS probe_uploads, rd.compiles AS probe_compiles FROM images i LEFT JOIN rd USING (asset_ref))"""
_add("t13_probed_metrics", _probed, "images gl_calls", f"WITH {_PROBED} SELECT * FROM pb")
_add("t13_probe_totals", lambda i, c: T.probe_totals(_probed(i, c)), "images gl_calls", f"WITH {_PROBED} SELECT sum(probe_draw_calls)::BIGINT AS draw_calls, sum(probe_vram)::BIGINT AS vram, count(*) AS sheets, sum(vram)::BIGINT AS declared_vram FROM pb WHERE probe_vram IS NOT NULL HAVING count(*) > 0")
_add("t07_live_vram", lambda i, c: T.live_vram(A.totals(i.filter("asset_ref = 1")), GL.live_textures(c)), "images gl_calls", f"WITH {GL_SQL}, t AS (SELECT w * h * 4 AS loaded FROM images WHERE asset_ref = 1) SELECT session, vram, loaded FROM lv, t WHERE vram > 1.5 * loaded")
_add("t13_probe_canvas", T.probe_canvas, "sprites", "SELECT asset_ref, greatest(1, least(4096, max(x + w)))::BIGINT AS canvas_w, greatest(1, least(4096, max(y + h)))::BIGINT AS canvas_h FROM sprites GROUP BY 1")
_add("t01_frame_counters", GL.frame_counters, "gl_calls", """WITH f AS (SELECT *, count(*) FILTER (WHERE call = 'frame') OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS n, max(CASE WHEN call = 'frame' THEN seq END) OVER (PARTITION BY session) AS ended,
CASE call WHEN 'useProgram' THEN 'p' ELSE concat('t', target) END AS k FROM gl_calls), g AS (SELECT *, call IN ('bindTexture', 'useProgram') AND lag(seq) OVER w IS NOT NULL AND object IS NOT DISTINCT FROM lag(object) OVER w AS again FROM f WINDOW w AS (PARTITION BY session, call IN ('bindTexture', 'useProgram'), k ORDER BY seq))
SELECT session, n AS seq, count(*) FILTER (WHERE call IN ('drawElements', 'drawElementsInstanced', 'drawArrays', 'drawArraysInstanced')) AS draws, count(*) FILTER (WHERE call = 'bindTexture') AS binds, count(*) FILTER (WHERE again) AS redundant, count(*) FILTER (WHERE call IN ('texImage2D', 'texSubImage2D', 'compressedTexImage2D', 'compressedTexSubImage2D')) AS uploads, count(*) FILTER (WHERE call = 'compileShader') AS compiles FROM g WHERE seq <= ended GROUP BY 1, 2""")
_add("t04_runtime_reports", lambda f, g: T.runtime_reports(f, GL.live_textures(g)), "frames gl_calls", f"WITH {GL_SQL}, {_REPORT.format(w='wf', src='frames')} SELECT wff.*, coalesce(live_textures, 0) AS live_textures, coalesce(vram, 0) AS vram, coalesce(compressed, 0) AS compressed FROM wff LEFT JOIN lv USING (session)")


def _compare(frames: DataFrame, calls: DataFrame) -> DataFrame:
    live = GL.live_textures(calls)
    return T.compare_sessions(T.runtime_reports(frames, live), T.runtime_reports(frames.filter("seq % 5 <> 0 and not (session % 4 = 0 and seq % 2 = 0)"), live.withColumn("compressed", F.when(F.col("session") % 3 > 0, F.col("compressed") + 10))), least=24)


_KEYS = ", ".join(f"({i}, '{k}', '{kind}', a.{c}::DOUBLE, b.{c}::DOUBLE)" for i, (k, kind, c) in enumerate(T.COMPARED))
_add("t12_compare_sessions", _compare, "frames gl_calls", f"""WITH {GL_SQL}, g AS (SELECT * FROM frames WHERE seq % 5 <> 0 AND NOT (session % 4 = 0 AND seq % 2 = 0)), {_REPORT.format(w='wf', src='frames')}, {_REPORT.format(w='wg', src='g')},
x AS (SELECT wff.*, coalesce(live_textures, 0) AS live_textures, coalesce(vram, 0) AS vram, coalesce(compressed, 0) AS compressed FROM wff LEFT JOIN lv USING (session)), y AS (SELECT wgf.*, coalesce(live_textures, 0) AS live_textures, coalesce(vram, 0) AS vram, CASE WHEN lv.session IS NULL THEN 0 WHEN session % 3 > 0 THEN compressed + 10 END AS compressed FROM wgf LEFT JOIN lv USING (session)),
j AS (SELECT a.session, (floor(abs(a.duration - b.duration)::DOUBLE / greatest(a.duration, b.duration) * 100 * 10 + 0.5) / 10) / 100 AS skew, a.frames < 24 OR b.frames < 24 AS short, t.* FROM x a JOIN y b USING (session), LATERAL (VALUES {_KEYS}) AS t(place, key, class, before, after))
SELECT session, CASE WHEN short THEN 'too-short' WHEN skew > 0.3 THEN 'duration-skewed' ELSE 'comparable' END AS verdict, skew, place, key, class, before, after, floor((after - before) * 10 + 0.5) / 10 AS delta, CASE WHEN before <> 0 THEN floor((after - before) / before * 100 * 10 + 0.5) / 10 END AS pct,
CASE class WHEN 'device' THEN FALSE WHEN 'session-total' THEN NOT short AND skew <= 0.3 ELSE NOT short END AS comparable FROM j WHERE before IS NOT NULL AND after IS NOT NULL""")

_add("x03_pack", lambda s: X.packed_sizes(X.pack(s)), "sprites")
_add("x04_scale_atlas", lambda s, a: X.scale_atlas(s, a, 0.5), "sprites atlases", """WITH j AS (SELECT asset_ref, sprite_idx, greatest(1, floor(decl_w * 0.5::DOUBLE + 0.5))::BIGINT AS sheet_w, greatest(1, floor(decl_h * 0.5::DOUBLE + 0.5))::BIGINT AS sheet_h, x, y, w, h FROM sprites JOIN atlases USING (asset_ref)),
n AS (SELECT asset_ref, sprite_idx, sheet_w, sheet_h, least(floor(x * 0.5::DOUBLE + 0.5)::BIGINT, sheet_w - 1) AS x, least(floor(y * 0.5::DOUBLE + 0.5)::BIGINT, sheet_h - 1) AS y, greatest(1, floor(w * 0.5::DOUBLE + 0.5)::BIGINT) AS w, greatest(1, floor(h * 0.5::DOUBLE + 0.5)::BIGINT) AS h FROM j)
SELECT asset_ref, sprite_idx, sheet_w, sheet_h, x, y, least(w, sheet_w - x) AS w, least(h, sheet_h - y) AS h FROM n""")


def _to_repack(sprites: DataFrame) -> DataFrame:
    return sprites.withColumns({"off_x": F.when(F.col("trimmed"), F.col("trim_x")), "off_y": F.when(F.col("trimmed"), F.col("trim_y"))})


def _merges(atlases: DataFrame) -> DataFrame:
    return atlases.select(F.expr("asset_ref div 12").alias("group"), "asset_ref", F.col("asset_ref").alias("ord"))


_ITEMS = """i AS (SELECT *, asset_ref // 12 AS grp FROM sprites WHERE asset_ref IN (SELECT asset_ref FROM atlases)),
c AS (SELECT grp, frame_hash, count(DISTINCT (asset_ref, x, y, w, h)) AS places, min({'a': asset_ref, 'i': sprite_idx}) AS rep FROM i WHERE frame_hash IS NOT NULL GROUP BY ALL HAVING count(DISTINCT (asset_ref, x, y, w, h)) >= 2),
r AS (SELECT i.*, coalesce(places, 1) AS places, coalesce(rep.a, asset_ref) AS rep_ref, coalesce(rep.i, sprite_idx) AS rep_idx FROM i LEFT JOIN c USING (grp, frame_hash)),
b AS (SELECT grp, rep_ref, rep_idx, bool_or((asset_ref, sprite_idx) <> (rep_ref, rep_idx) AND (trimmed OR rotated)) AS blocked FROM r GROUP BY ALL),
t AS (SELECT r.grp, r.rep_ref, r.rep_idx, w, h, trim_w, trim_h, coalesce(NOT blocked AND NOT trimmed AND NOT rotated AND trim_w > 0 AND trim_h > 0 AND (trim_x > 0 OR trim_y > 0 OR trim_w < w OR trim_h < h), FALSE) AS tight FROM r JOIN b USING (grp, rep_ref, rep_idx) WHERE asset_ref = rep_ref AND sprite_idx = rep_idx),
g AS (SELECT grp, bool_or(rotated) AS turned FROM r GROUP BY 1), q AS (SELECT grp, bool_or(tight) AS any_tight FROM t GROUP BY 1)"""
_add("x03_repack_items", lambda s, a: RP.repack_items(_to_repack(s), _merges(a)).select("group", "asset_ref", "sprite_idx", "rep_ref", "rep_idx", "pack_w", "pack_h", "tight", "turnable"), "sprites atlases", f"""WITH {_ITEMS}
SELECT grp AS "group", asset_ref, sprite_idx, rep_ref, rep_idx, CASE WHEN tight THEN t.trim_w ELSE t.w END AS pack_w, CASE WHEN tight THEN t.trim_h ELSE t.h END AS pack_h, tight, NOT turned AND NOT any_tight AS turnable FROM r JOIN t USING (grp, rep_ref, rep_idx) JOIN g USING (grp) JOIN q USING (grp)""")
_add("x03_repack", lambda s, a: RP.repack(_to_repack(s), a), "sprites atlases")
_add("x07_alias_map", X.alias_map, "sprites", "WITH g AS (SELECT asset_ref, frame_hash, min(sprite_idx) AS alias_of FROM sprites WHERE frame_hash IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT (x, y, w, h)) >= 2) SELECT asset_ref, sprite_idx, alias_of FROM sprites JOIN g USING (asset_ref, frame_hash) WHERE sprite_idx <> alias_of")
_add("x09_source_rects", lambda s: X.source_rects(s.filter("trim_w is not null")), "sprites", "SELECT asset_ref, sprite_idx, trim_x, trim_y, src_h - trim_y - trim_h AS bottom_y FROM sprites WHERE trim_w IS NOT NULL")


def _plan(findings: DataFrame, related: DataFrame, owners: DataFrame, packs: DataFrame) -> DataFrame:
    sheets = findings.filter("rule in ('occupancy', 'wasted-regions', 'trim-margin', 'frame-redundancy')").select("report", "ref")
    return PL.plan(findings, related, owners, packs, sheets, o=PL.PlanOptions(aggressive=True, opaque=True, strip=True, best_format=True, extrude=2))


_PLAN = """ow AS (SELECT DISTINCT report, owner AS ref FROM plan_owners), sh AS (SELECT DISTINCT report, ref FROM plan_findings WHERE rule IN ('occupancy', 'wasted-regions', 'trim-margin', 'frame-redundancy')),
dr AS (SELECT report, consumer AS ref, min((grp, owner)) AS g FROM plan_owners WHERE consumer IS NOT NULL AND (report, consumer) NOT IN (SELECT report, ref FROM ow) GROUP BY ALL),
pk AS (SELECT * FROM plan_packs WHERE (report, ref) NOT IN (SELECT report, ref FROM dr)),
mm AS (SELECT DISTINCT report, ord, ref FROM plan_related SEMI JOIN (SELECT report, ord FROM plan_findings WHERE rule = 'atlas-merge') USING (report, ord) WHERE (report, ref) NOT IN (SELECT report, ref FROM ow) AND (report, ref) NOT IN (SELECT report, ref FROM dr)),
mg AS (SELECT report, ord, ref FROM mm QUALIFY count(*) OVER (PARTITION BY report, ord) > 1),
base AS (SELECT report, ref FROM plan_findings UNION SELECT report, ref FROM plan_related),
fl AS (SELECT base.*, ow.ref IS NOT NULL AS owns, dr.ref IS NOT NULL AS dropped, pk.ref IS NOT NULL AS packed, mg.ref IS NOT NULL AS merged FROM base LEFT JOIN ow USING (report, ref) LEFT JOIN dr USING (report, ref) LEFT JOIN (SELECT DISTINCT report, ref FROM pk) pk USING (report, ref) LEFT JOIN (SELECT DISTINCT report, ref FROM mg) mg USING (report, ref)),
rp AS (SELECT report, ref, min(ord) AS "at" FROM plan_findings JOIN fl USING (report, ref) WHERE (rule IN ('occupancy', 'wasted-regions') OR (rule IN ('frame-redundancy', 'trim-margin') AND NOT folder)) AND NOT owns AND NOT merged GROUP BY ALL),
rs AS (SELECT report, ref, arg_min((w, h), ord) AS s, min(ord) AS ord FROM plan_findings WHERE rule = 'dimensions-oversize' AND NOT folder AND greatest(w, h) > 2048 GROUP BY ALL),
rz AS (SELECT rs.* FROM rs JOIN fl USING (report, ref) LEFT JOIN rp USING (report, ref) WHERE NOT owns AND NOT merged AND (rp."at" IS NULL OR rs.ord < rp."at")),
cp AS (SELECT report, r.ref, min(ord) AS ord FROM plan_related r SEMI JOIN (SELECT report, ord FROM plan_findings WHERE rule = 'duplicate-similar') USING (report, ord) WHERE place > 0 GROUP BY ALL),
cd AS (SELECT cp.* FROM cp JOIN fl USING (report, ref) LEFT JOIN rp USING (report, ref) WHERE NOT owns AND NOT merged AND NOT dropped AND (rp."at" IS NULL OR cp.ord < rp."at")),
tk AS (SELECT fl.*, dropped OR packed OR rz.ref IS NOT NULL OR cd.ref IS NOT NULL AS taken, merged OR rp.ref IS NOT NULL AS again FROM fl LEFT JOIN rz USING (report, ref) LEFT JOIN cd USING (report, ref) LEFT JOIN rp USING (report, ref)),
wo AS (SELECT report, ref, min(ord) AS ord FROM plan_findings WHERE rule = 'wasted-alpha' AND NOT folder GROUP BY ALL),
ft AS (SELECT report, ref, min(ord) AS ord, arg_min({'m': best_mime, 'c': content_class}, ord) AS f FROM plan_findings WHERE rule = 'format' AND NOT folder GROUP BY ALL),
tc AS (SELECT ft.*, wo.ref IS NOT NULL AS opaque FROM ft JOIN tk USING (report, ref) LEFT JOIN wo USING (report, ref) WHERE NOT taken AND NOT again),
oq AS (SELECT wo.* FROM wo JOIN tk USING (report, ref) WHERE NOT taken AND (report, ref) NOT IN (SELECT report, ref FROM tc)),
sp AS (SELECT report, ref, min(ord) AS ord FROM plan_findings JOIN tk USING (report, ref) WHERE rule = 'strippable-metadata' AND NOT folder AND NOT taken AND NOT again AND NOT owns AND (report, ref) NOT IN (SELECT report, ref FROM tc) AND (report, ref) NOT IN (SELECT report, ref FROM oq) GROUP BY ALL),
pl AS (SELECT report, 1 AS pass, g[1] AS ord, 'drop' AS op, ref, g[2] AS owner, NULL::BIGINT AS to_w, NULL::BIGINT AS to_h, NULL AS target_mime, NULL::BOOLEAN AS lossless, NULL::BOOLEAN AS opaque, (report, ref) IN (SELECT report, ref FROM sh) AS repoint, FALSE AS keep_consumer, NULL::BIGINT AS extrude FROM dr
UNION ALL SELECT report, 2, pack, 'pack', ref, NULL, NULL, NULL, 'image/webp', NULL, NULL, NULL, NULL, 2 FROM pk UNION ALL SELECT report, 3, ord, 'repack', ref, NULL, NULL, NULL, 'image/webp', NULL, NULL, NULL, NULL, 2 FROM mg
UNION ALL SELECT report, 4, "at", 'repack', ref, NULL, NULL, NULL, 'image/webp', NULL, NULL, NULL, NULL, 2 FROM rp
UNION ALL SELECT report, 4, ord, 'resize', ref, NULL, floor(s[1] * (2048.0::DOUBLE / greatest(s[1], s[2])) + 0.5)::BIGINT, floor(s[2] * (2048.0::DOUBLE / greatest(s[1], s[2])) + 0.5)::BIGINT, 'image/webp', NULL, NULL, NULL, NULL, NULL FROM rz
UNION ALL SELECT report, 4, ord, 'drop', ref, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cd
UNION ALL SELECT report, 5, ord, 'transcode', ref, NULL, NULL, NULL, CASE WHEN f.m IN ('image/avif', 'image/png') THEN f.m ELSE 'image/webp' END, coalesce(f.c = 'flat', FALSE), opaque, NULL, NULL, NULL FROM tc
UNION ALL SELECT report, 6, ord, 'transcode', ref, NULL, NULL, NULL, 'image/webp', FALSE, TRUE, NULL, NULL, NULL FROM oq UNION ALL SELECT report, 7, ord, 'strip', ref, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sp)"""
_add("x10_plan_repairs", _plan, "plan_findings plan_related plan_owners plan_packs", f"WITH {_PLAN} SELECT * FROM pl")
_add("x11_plan_footprint", lambda f, r, w, p, i: X.plan_footprint(_plan(f, r, w, p), i.select("report", "ref", "disk_saved", "vram_saved")), "plan_findings plan_related plan_owners plan_packs plan_figures", f"""WITH {_PLAN}, q AS (SELECT pl.*, disk_saved, vram_saved FROM pl LEFT JOIN plan_figures USING (report, ref))
SELECT report, op, count(DISTINCT (pass, ord)) AS ops, count(*) AS refs, sum(CASE WHEN op <> 'pack' THEN disk_saved END)::BIGINT AS disk_saved, sum(CASE WHEN op IN ('repack', 'resize', 'drop') THEN vram_saved END)::BIGINT AS vram_saved, count(*) FILTER (WHERE op = 'pack' OR (disk_saved IS NULL AND (op NOT IN ('repack', 'resize', 'drop') OR vram_saved IS NULL))) AS deferred FROM q GROUP BY 1, 2""")


def _scalars(images: DataFrame) -> DataFrame:
    w, h, p = F.col("w"), F.col("h"), F.col("path")
    return images.select("asset_ref", S.vram_bytes(w, h).alias("vram"), S.vram_bytes_mipmapped(w, h).alias("mip"), S.is_power_of_two(w).alias("pot"), S.next_power_of_two(w).alias("next_pot"), S.stem_of(p).alias("stem"), S.has_resolution_token(p).alias("res"), S.aspect_bucket(w, h).alias("aspect"), S.default_cell(w, h).cast("long").alias("cell"), S.bundle_of(p).alias("bundle"), S.dir_of(p).alias("dir"), S.exceeds_scan_budget(w * 3, h).alias("too_big"), S.percent1(w.cast("double") / (w + h)).alias("pct"), S.normalize_path(F.concat(F.lit("./a/../"), p)).alias("norm"), S.signed_area2(F.lit(0), F.lit(0), w, F.lit(3), F.lit(5), h).alias("area2"))


_add("f_scalars", _scalars, "images", f"SELECT asset_ref, w * h * 4 AS vram, ceil((w * h * 4)::DOUBLE * 4.0 / 3)::BIGINT AS mip, (w & (w - 1)) = 0 AS pot, CAST(pow(2, ceil(log2(w))) AS BIGINT) AS next_pot, {_STEM} AS stem, {_RES} AS res, floor(w::DOUBLE / h * 50 + 0.5)::BIGINT AS aspect, greatest(8, floor(greatest(w, h) / 64.0 + 0.5))::BIGINT AS cell, split_part(path, '/', 1) AS bundle, split_part(path, '/', 1) AS dir, w * 3 * h > 25165824 AS too_big, floor(w::DOUBLE / (w + h) * 1000 + 0.5) / 10 AS pct, path AS norm, w * h - 3 * 5 AS area2 FROM images")


def _findings(sprites: DataFrame, atlases: DataFrame, images: DataFrame, features: DataFrame) -> DataFrame:
    """The report: firings of several rules in one schema, with their ids."""
    none = F.lit(None).cast("long")
    parts = [("occupancy", R.occupancy(sprites, atlases), None, None), ("dimensions-oversize", R.oversize(images), None, None), ("dimensions-npot", R.npot(images), None, "vram_saved"), ("solid-fill", R.solid_fill(images, features), None, "vram_saved"), ("strippable-metadata", R.strippable_metadata(images), "disk_saved", None), ("icc-non-srgb", R.icc_non_srgb(images), None, None)]
    out = None
    for rule, df, disk, vram in parts:
        df = df.select(F.concat(F.lit(f"{rule}:"), F.col("asset_ref").cast("string")).alias("id"), F.lit(rule).alias("rule"), "severity", "asset_ref", (F.col(disk) if disk else none).cast("long").alias("disk_saved"), (F.col(vram) if vram else none).cast("long").alias("vram_saved"))
        out = df if out is None else out.unionByName(df)
    return out


_add("findings_report", lambda s, a, i, f: _findings(s, a, i, f).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.sum("disk_saved").alias("disk_saved"), F.sum("vram_saved").alias("vram_saved")), "sprites atlases images features", f"""WITH {OCC}, {POT.replace("i AS", "ip AS")}, fs AS (SELECT 'occupancy' AS rule, CASE WHEN greatest(area - used, 0) * 4 < 262144 THEN 'info' WHEN occ < 0.6 THEN 'crit' ELSE 'warn' END AS severity, NULL::BIGINT AS disk_saved, NULL::BIGINT AS vram_saved FROM occ WHERE occ < 0.8
UNION ALL SELECT 'dimensions-oversize', CASE WHEN greatest(w, h) > 2730 THEN 'crit' ELSE 'warn' END, NULL, NULL FROM images WHERE greatest(w, h) > 2048 UNION ALL SELECT 'dimensions-npot', 'info', NULL, pw * ph * 4 - w * h * 4 FROM ip WHERE NOT (w = pw AND h = ph) AND 1 - (w * h)::DOUBLE / (pw * ph)::DOUBLE > 0.25
UNION ALL SELECT 'solid-fill', CASE WHEN greatest(w, h) >= 1024 THEN 'warn' ELSE 'info' END, NULL, w * h * 4 - 4 FROM images JOIN features USING (asset_ref) WHERE solid AND least(w, h) >= 256 UNION ALL SELECT 'strippable-metadata', CASE WHEN strippable_bytes >= 65536 THEN 'warn' ELSE 'info' END, strippable_bytes, NULL FROM images WHERE strippable_bytes >= 4096
UNION ALL SELECT 'icc-non-srgb', 'info', NULL, NULL FROM images WHERE icc_bytes IS NOT NULL AND icc_srgb IS NOT TRUE) SELECT rule, severity, count(*) AS n, sum(disk_saved)::BIGINT AS disk_saved, sum(vram_saved)::BIGINT AS vram_saved FROM fs GROUP BY 1, 2""")


def _owner_names(assets: DataFrame, marking: DataFrame) -> DataFrame:
    p = assets.select("asset_ref").distinct()
    n = F.length("asset_ref") % 4
    plan = p.select(F.col("asset_ref").alias("ref"), F.col("asset_ref").alias("image_path"), F.when(n == 1, F.concat("asset_ref", F.lit(".json"))).alias("manifest_path"), F.when(n == 0, "image/avif").when(n == 2, "image/jpeg").when(n == 3, "image/other").alias("target_mime"))
    return A.owner_final_names(A.dedup_edges(assets.distinct(), marking, _guard(assets.sparkSession)), plan)


_add("d06_owner_names", _owner_names, "assets marking", f"WITH e AS ({_EDGES}), o AS (SELECT DISTINCT owner, length(owner) % 4 AS n, left(owner, length(owner) - 4) AS bare FROM e) SELECT owner, CASE n WHEN 0 THEN bare || '.avif' WHEN 2 THEN bare || '.jpg' WHEN 3 THEN bare || '.webp' ELSE owner END AS image, CASE WHEN n = 1 THEN owner || '.json' END AS manifest FROM o")


def _format_values(images: DataFrame) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    return images.select("asset_ref", S.format_value("bytes", F.col("byte_size")).alias("bytes"), S.format_value("ratio", w.cast("double") / (w + h)).alias("ratio"), S.format_value("px", w).alias("px"), S.format_value("count", h).alias("n"), S.saved_percent(F.col("strippable_bytes"), F.col("byte_size")).alias("saved"))


_add("f15_format_values", _format_values, "images", r"SELECT asset_ref, CASE WHEN byte_size < 1024 THEN concat(byte_size, ' B') ELSE printf('%.1f KB', floor(byte_size / 1024.0::DOUBLE * 10 + 0.5) / 10) END AS bytes, concat(regexp_replace(CAST(floor(w::DOUBLE / (w + h) * 100 * 10 + 0.5) / 10 AS VARCHAR), '\.0$', ''), '%') AS ratio, concat(w, 'px') AS px, CAST(h AS VARCHAR) AS n, CASE WHEN byte_size > 0 THEN floor(strippable_bytes::DOUBLE / byte_size * 100 + 0.5)::BIGINT ELSE 0 END AS saved FROM images")
_add("f27_folder_labels", lambda i: files.folder_label(i.withColumn("part", F.expr("asset_ref % 2")).unionByName(i.filter("path like 'dir1/%'").withColumn("part", F.lit(2).cast("long"))), "part"), "images", "SELECT part, CASE WHEN count(DISTINCT split_part(path, '/', 1)) = 1 THEN min(split_part(path, '/', 1)) END AS label FROM (SELECT path, asset_ref % 2 AS part FROM images UNION ALL SELECT path, 2 FROM images WHERE path LIKE 'dir1/%') GROUP BY 1")
_add("s21_regions", lambda i: files.regions(i.select(S.pack_bucket(F.col("path"), "per-top-level-bundle").alias("group"), S.stem_of(F.col("path")).alias("name"), "path")), "images", f"WITH r AS (SELECT split_part(path, '/', 1) AS \"group\", {_STEM} AS name, path FROM images) SELECT DISTINCT \"group\", name, path, path = min(path) OVER k AS kept, (min(path) OVER k) <> (max(path) OVER k) AS collides FROM r WINDOW k AS (PARTITION BY \"group\", name)")
_add("s21_common_folders", lambda a: files.common_folders(a.select(F.col("pool").alias("group"), F.col("asset_ref").alias("path")).unionByName(a.select(S.bundle_of(F.col("asset_ref")).alias("group"), F.col("asset_ref").alias("path"))).unionByName(a.select(S.dir_of(F.col("asset_ref")).alias("group"), F.col("asset_ref").alias("path")))), "assets", """WITH p AS (SELECT asset_ref, split_part(asset_ref, '/', 1) AS a, split_part(asset_ref, '/', 2) AS b, pool FROM assets), g AS (SELECT pool AS "group", a, b FROM p UNION ALL SELECT a, a, b FROM p UNION ALL SELECT concat(a, '/', b), a, b FROM p)
SELECT "group", CASE WHEN count(DISTINCT a) > 1 THEN '' WHEN count(DISTINCT b) > 1 THEN min(a) ELSE concat(min(a), '/', min(b)) END AS folder FROM g GROUP BY 1""")


def _model(images: DataFrame) -> DataFrame:
    return A.totals(images).select("disk", "loaded", F.col("vram").alias("measured_vram"), F.lit(None).cast("long").alias("measured_draws"), F.col("loaded_textures").alias("draw_floor"))


_add("u05_budget_verdicts", lambda i: B.budget_verdicts(_model(i), vram=10 << 30, draws=2_000_000, disk=1 << 20), "images", f"""WITH {_V}, m AS (SELECT 'vram' AS metric, 'declared' AS basis, 10737418240::BIGINT AS budget, (SELECT sum(most) FROM v)::BIGINT AS value, 'overDeclared' AS o, 'withinDeclared' AS u UNION ALL SELECT 'vram', 'measured', 10737418240, (SELECT sum(w * h * 4) FROM images)::BIGINT, 'over', 'within' UNION ALL SELECT 'draw', 'floor', 2000000, (SELECT count(*) FROM v), 'floorOver', 'floorUnknown' UNION ALL SELECT 'disk', 'measured', 1048576, (SELECT sum(byte_size) FROM images)::BIGINT, 'over', 'within')
SELECT metric, basis, CASE WHEN value > budget THEN o ELSE u END AS state, budget, value, value - budget AS over_by, value::DOUBLE / budget AS ratio, least(100, floor(value::DOUBLE / budget * 100 + 0.5))::INT AS clamp_pct, CASE WHEN value > budget THEN 'crit' ELSE 'neutral' END AS tone, CASE WHEN value > budget THEN 'crit' WHEN basis = 'floor' THEN 'neutral' ELSE 'ok' END AS fill FROM m""")


def _headline(images: DataFrame) -> DataFrame:
    t = images.agg(F.sum("byte_size").alias("totals.diskBytes"), F.sum(S.vram_bytes(F.col("w"), F.col("h"))).alias("totals.vramBytes"), F.count("*").alias("drawCallsLowerBound"), F.max(F.lit(5).cast("long")).alias("totals.potentialDiskSaved"), F.count("*").alias("findings.crit"))
    return t.unpivot([], [F.col(f"`{c}`") for c in t.columns], "metric", "value")


_add("u06_history_rows", lambda i: B.history_rows(B.diff_metrics(_headline(i), _headline(i.filter("asset_ref % 3 <> 0")))), "images", "WITH h AS (SELECT sum(byte_size)::BIGINT AS d, sum(byte_size) FILTER (WHERE asset_ref % 3 <> 0)::BIGINT AS d2, sum(w * h * 4)::BIGINT AS v, sum(w * h * 4) FILTER (WHERE asset_ref % 3 <> 0)::BIGINT AS v2, count(*) AS n, count(*) FILTER (WHERE asset_ref % 3 <> 0) AS n2 FROM images) SELECT 'totals.diskBytes' AS metric, d AS before, d2 AS after, d2 - d AS delta, TRUE AS bytes FROM h UNION ALL SELECT 'totals.vramBytes', v, v2, v2 - v, TRUE FROM h UNION ALL SELECT 'drawCallsLowerBound', n, n2, n2 - n, FALSE FROM h")
_add("u06_totals_rows", lambda i: B.totals_rows(_model(i).withColumn("potential", F.expr("disk div 7"))), "images", f"WITH {_V}, t AS (SELECT sum(byte_size)::BIGINT AS disk, sum(w * h * 4)::BIGINT AS vram, (SELECT sum(most) FROM v)::BIGINT AS loaded FROM images), f AS (SELECT 0 AS place, 'disk' AS key, disk AS n FROM t UNION ALL SELECT 1, 'declared', loaded FROM t UNION ALL SELECT 2, 'measured', vram FROM t UNION ALL SELECT 3, 'saveable', disk // 7 FROM t) SELECT place, key, concat(printf('%.1f MB', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10), CASE WHEN place = 3 THEN ' · 14%' ELSE '' END) AS value FROM f")
_add("b11_budget_scaffold", lambda i: B.budget_scaffold(A.totals(i)), "images", f"WITH {_V}, t AS (SELECT sum(byte_size)::DOUBLE AS disk, (SELECT sum(most) FROM v)::DOUBLE AS loaded FROM images) SELECT 'totals.diskBytes' AS metric, 'error' AS level, 'max' AS chk, concat(greatest(1, ceil(disk * 1.2::DOUBLE / 1048576))::BIGINT, 'MB') AS budget FROM t UNION ALL SELECT 'totals.diskBytes', 'error', 'maxDeltaPct', '15' UNION ALL SELECT 'totals.loadedVramBytes', 'error', 'max', concat(greatest(1, ceil(loaded * 1.2::DOUBLE / 1048576))::BIGINT, 'MB') FROM t UNION ALL SELECT 'findings.crit', 'error', 'max', '0'")


def _scaffold_gate(images: DataFrame, features: DataFrame, sizes: DataFrame, found: DataFrame) -> DataFrame:
    """The scaffold of an audit of half the images, parsed and evaluated over all of them, with that half as the baseline."""
    from glyphmill.config import parse_budget

    half = images.filter("asset_ref % 2 = 0")
    values = lambda i, n: B.global_metrics(A.totals(i), n, _saved(i, features, sizes), i).select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("ref"), "metric", F.col("value").cast("double").alias("value"))
    rows, _ = parse_budget(B.scaffold_config(B.budget_scaffold(A.totals(half)).collect()))  # four rows
    budgets = images.sparkSession.createDataFrame(rows, "ord int, scope string, match string, metric string, level string, chk string, budget double")
    return B.evaluate(values(images, found), budgets, values(half, found)).drop("ref")


_HALF = "(SELECT * FROM images WHERE asset_ref % 2 = 0)"
_add("b03_scaffold_gate", _scaffold_gate, "images features encode_sizes found", f"""WITH {_V}, hv AS (SELECT max(w * h * 4) AS most FROM {_HALF} GROUP BY CASE WHEN {_RES} THEN {_STEM} ELSE concat({_STEM}, '|', CAST(floor(w::DOUBLE / h * 50 + 0.5) AS BIGINT)) END),
m AS (SELECT 'totals.diskBytes' AS metric, (SELECT sum(byte_size) FROM images)::DOUBLE AS value, (SELECT sum(byte_size) FROM {_HALF})::DOUBLE AS base UNION ALL SELECT 'totals.loadedVramBytes', (SELECT sum(most) FROM v)::DOUBLE, (SELECT sum(most) FROM hv)::DOUBLE UNION ALL SELECT 'findings.crit', count(*)::DOUBLE, count(*)::DOUBLE FROM found WHERE severity = 'crit'),
c AS (SELECT *, 'max' AS chk, CASE metric WHEN 'findings.crit' THEN 0 ELSE greatest(1, ceil(base * 1.2::DOUBLE / 1048576)) * 1048576 END::DOUBLE AS budget FROM m UNION ALL SELECT *, 'maxDeltaPct', 15 FROM m WHERE metric = 'totals.diskBytes')
SELECT 'global' AS scope, metric, 'error' AS level, chk, value, budget, (value - base) / base * 100 AS delta_pct, CASE chk WHEN 'max' THEN value > budget ELSE (value - base) / base * 100 > budget END AS breach FROM c""")
_add("x12_op_counts", lambda i: X.op_counts(i.select(F.expr("element_at(array('repack', 'drop', 'resize', 'transcode', 'pack'), cast(asset_ref % 5 + 1 as int))").alias("kind"), F.expr("asset_ref % 3").alias("n_atlases"), F.expr("if(asset_ref % 7 < 3, path, null)").alias("owner_ref"))), "images", "WITH o AS (SELECT CASE asset_ref % 5 WHEN 0 THEN CASE WHEN asset_ref % 3 > 1 THEN 'merge' ELSE 'repack' END WHEN 1 THEN CASE WHEN asset_ref % 7 < 3 THEN 'dedup' ELSE 'drop' END WHEN 2 THEN 'resize' WHEN 3 THEN 'transcode' ELSE 'pack' END AS kind FROM images) SELECT kind, CASE kind WHEN 'repack' THEN 1 WHEN 'merge' THEN 2 WHEN 'resize' THEN 3 WHEN 'transcode' THEN 4 WHEN 'drop' THEN 6 WHEN 'pack' THEN 7 ELSE 8 END::BIGINT AS place, count(*) AS n FROM o GROUP BY 1")


def _skeleton_texts(parts: DataFrame) -> DataFrame:
    """Attachments as the JSON texts of skeletons. Dealt by file once, for all three steps."""
    body = F.struct("type", F.col("region_path").alias("path"), "parent", F.col("parent_skin").alias("skin"))
    held = parts.repartition("path").groupBy("path", "skin", "slot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("attachment").alias("name"), F.to_json(body).alias("body"))))).alias("held"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("held"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    slots = held.select("path", "skin", F.struct("slot", F.concat(F.lit('"'), "slot", F.lit('":'), text).alias("text")).alias("s")).groupBy("path", "skin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), ",").alias("slots"))
    skin = F.concat(F.lit('{"name":"'), "skin", F.lit('","attachments":{'), "slots", F.lit("}}"))
    skins = slots.select("path", F.struct("skin", skin.alias("text")).alias("s")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), ",").alias("skins"))
    return skins.select("path", F.concat(F.lit('{"skins":['), "skins", F.lit("]}")).alias("text"))


_NEED = """ac AS (SELECT * FROM attachments), pa AS (SELECT path, skin, attachment, arg_min(coalesce(region_path, attachment), slot) AS region FROM ac GROUP BY ALL), sk AS (SELECT DISTINCT path, skin FROM ac),
nd AS (SELECT path, skin, slot, attachment, coalesce(region_path, attachment) AS region FROM ac WHERE type IN ('region', 'mesh') UNION ALL
SELECT a.path, a.skin, a.slot, a.attachment, pa.region FROM ac a LEFT JOIN sk ON sk.path = a.path AND sk.skin = a.parent_skin JOIN pa ON pa.path = a.path AND pa.skin = coalesce(sk.skin, a.skin) AND pa.attachment = a.parent WHERE a.type IN ('linkedmesh', 'weightedlinkedmesh'))"""
_add("x13_required_regions", lambda a: SK.required_regions(SK.attachments(_skeleton_texts(a))), "attachments", f"WITH {_NEED} SELECT * FROM nd")
_add("x13_verified_skeletons", lambda a, n: SK.verify_skeletons(SK.attachments(_skeleton_texts(a)), n)[0], "attachments packed_names", f"WITH {_NEED}, j AS (SELECT nd.path, p.name IS NOT NULL AS hit FROM nd LEFT JOIN packed_names p ON p.path = nd.path AND p.name = nd.region), f AS (SELECT DISTINCT path FROM ac) SELECT f.path, count(*) FILTER (WHERE hit) AS verified, count(*) FILTER (WHERE NOT hit) AS unmatched, FALSE AS unverified FROM f LEFT JOIN j ON j.path = f.path GROUP BY 1")
_add("s26_changes_since_last_audit", lambda a: H.changes(H.previous(H.snapshots(a), H.snapshots(a.filter("at_ms div 86400000 % 3 <> 0")))), "audits", """WITH h AS (SELECT label, at_ms, lead(at_ms) OVER (PARTITION BY label ORDER BY at_ms) AS nxt FROM (SELECT DISTINCT label, at_ms FROM audits WHERE at_ms // 86400000 % 3 <> 0)),
p AS (SELECT DISTINCT a.label, a.at_ms, h.at_ms AS before_at FROM audits a JOIN h ON h.label = a.label AND h.at_ms < a.at_ms AND (h.nxt IS NULL OR h.nxt >= a.at_ms)),
j AS (SELECT p.label, p.at_ms, before_at, a.metric, b.value AS before, a.value AS after FROM p JOIN audits a ON a.label = p.label AND a.at_ms = p.at_ms JOIN audits b ON b.label = p.label AND b.at_ms = p.before_at AND b.metric = a.metric)
SELECT *, after - before AS delta, CASE WHEN before <> 0 THEN (after - before) * 100 / before END AS pct FROM j WHERE before <> after""")
_add("s23_config_of_folders", lambda a, c: files.discover_configs(a.select(S.dir_of(F.col("asset_ref")).alias("folder")).unionByName(a.select(F.lit("").alias("folder"))), c), "assets configs", """WITH f AS (SELECT DISTINCT concat(split_part(asset_ref, '/', 1), '/', split_part(asset_ref, '/', 2)) AS folder FROM assets UNION SELECT ''), c AS (SELECT path, kind, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS d FROM configs)
SELECT folder, path, kind FROM f LEFT JOIN c ON d = '' OR d = folder OR starts_with(folder, concat(d, '/')) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(d) DESC, kind, path) = 1""")
_add("s20_pack_groups", lambda i, a: files.pack_groups(i.select("path", "w", "h").unionByName(a.select(F.col("asset_ref").alias("path"), F.lit(900).cast("long").alias("w"), F.lit(9).cast("long").alias("h")).distinct()), a.filter("pool = 'spine'").select(S.dir_of(F.col("asset_ref")).alias("root")).unionByName(a.filter("asset_ref like 'src1/%'").select(F.lit("src1").alias("root"))), small=1200, least=3), "images assets", """WITH i AS (SELECT DISTINCT path, w, h FROM (SELECT path, w, h FROM images UNION ALL SELECT asset_ref, 900, 9 FROM assets)), r AS (SELECT DISTINCT regexp_replace(asset_ref, '/[^/]*$', '') AS root FROM assets WHERE pool = 'spine' UNION SELECT 'src1'),
u AS (SELECT i.*, root FROM i LEFT JOIN r ON starts_with(path, concat(root, '/')) QUALIFY row_number() OVER (PARTITION BY path, w, h ORDER BY length(root) DESC NULLS LAST) = 1),
g AS (SELECT CASE WHEN root IS NOT NULL THEN concat('skeleton:', root) WHEN greatest(w, h) <= 1200 THEN concat('folder:', regexp_replace(path, '/[^/]*$', '')) END AS "group", path, w, h FROM u) SELECT * FROM g WHERE "group" IS NOT NULL QUALIFY starts_with("group", 'skeleton:') OR count(*) OVER (PARTITION BY "group") >= 3""")


def _told(sprites: DataFrame, atlases: DataFrame, images: DataFrame, features: DataFrame, sizes: DataFrame) -> DataFrame:
    """Findings of several rules, each with its texts."""
    parts = [
        ("occupancy", R.occupancy(sprites, atlases), "asset_ref"), ("dimensions-oversize", R.oversize(images), "asset_ref"), ("dimensions-npot", R.npot(images), "asset_ref"), ("strippable-metadata", R.strippable_metadata(images), "asset_ref"),
        ("format", R.format_candidates(images, features, sizes), "asset_ref"), ("duplicate-exact", A.duplicate_exact(images, features), "first"), ("trim-margin", R.trim_margin(sprites, atlases), "asset_ref"), ("dimension-mismatch", R.dimension_mismatch(atlases, _as_images(atlases), sprites), "asset_ref"),
    ]
    return M.all_findings(parts)


def _as_images(atlases: DataFrame) -> DataFrame:
    return atlases.select("asset_ref", (F.col("decl_w") - F.col("asset_ref") % 9).alias("w"), F.col("decl_h").alias("h"))


_B = lambda c: f"CASE WHEN {c} < 1024 THEN concat({c}, ' B') WHEN {c} < 1048576 THEN printf('%.1f KB', floor({c} / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor({c} / 1048576.0::DOUBLE * 10 + 0.5) / 10) END"
_P = lambda c: f"concat(regexp_replace(CAST(floor({c} * 100 * 10 + 0.5) / 10 AS VARCHAR), '\\.0$', ''), '%')"
_ONE = lambda c, one, other: f"CASE WHEN {c} = 1 THEN '{one}' ELSE concat({c}, '{other}') END"
_TOLD = f"""{OCC}, {_FORMAT}, {_DUP}, {POT.replace("i AS", "ip AS")}, oc AS (SELECT asset_ref, occ, greatest(area - used, 0) * 4 AS wasted FROM occ WHERE occ < 0.8), np AS (SELECT asset_ref, 1 - (w * h)::DOUBLE / (pw * ph)::DOUBLE AS waste, pw * ph * 4 - w * h * 4 AS saved FROM ip WHERE NOT (w = pw AND h = ph) AND 1 - (w * h)::DOUBLE / (pw * ph)::DOUBLE > 0.25),
tm AS (WITH m AS (SELECT *, CASE WHEN trim_w IS NULL THEN greatest(w, h) ELSE greatest(trim_x, trim_y, w - trim_x - trim_w, h - trim_y - trim_h) END AS margin, w * h - CASE WHEN trim_w IS NULL THEN 0 ELSE trim_w * trim_h END AS freed FROM sprites WHERE NOT trimmed),
f AS (SELECT *, row_number() OVER (PARTITION BY asset_ref, x, y, w, h ORDER BY sprite_idx) AS k FROM m WHERE margin >= 4), g AS (SELECT asset_ref, count(*) AS frames, sum(freed)::BIGINT AS freed FROM f WHERE k = 1 GROUP BY 1) SELECT asset_ref, frames, freed::DOUBLE / (decl_w * decl_h) AS share FROM g JOIN atlases USING (asset_ref) WHERE freed::DOUBLE / (decl_w * decl_h) >= 0.05),
dm AS (SELECT a.asset_ref, count(s.asset_ref) FILTER (WHERE s.x + s.w > decl_w - a.asset_ref % 9 OR s.y + s.h > decl_h) AS off FROM atlases a LEFT JOIN sprites s ON s.asset_ref = a.asset_ref WHERE a.asset_ref % 9 > 2 GROUP BY 1),
td AS (SELECT 'occupancy' AS rule, asset_ref AS ref, CASE WHEN wasted < 262144 THEN 'info' WHEN occ < 0.6 THEN 'crit' ELSE 'warn' END AS severity, NULL::BIGINT AS disk_saved, NULL::BIGINT AS vram_saved, concat('Sheet is ', {_P("occ")}, ' full') AS title, concat({_B("wasted")}, ' of texture memory hold no frame.') AS detail, 'Pack the sheet anew.' AS fix FROM oc
UNION ALL SELECT 'dimensions-oversize', asset_ref, CASE WHEN greatest(w, h) > 2730 THEN 'crit' ELSE 'warn' END, NULL, NULL, concat('Longest edge is ', greatest(w, h), 'px'), 'Devices with smaller limits scale or refuse such textures.', 'Scale it down or split it.' FROM images WHERE greatest(w, h) > 2048
UNION ALL SELECT 'dimensions-npot', asset_ref, 'info', NULL, saved, concat('Padding to powers of two would waste ', {_P("waste")}), concat({_B("saved")}, ' of texture memory where sizes are padded.'), 'Choose sizes near a power of two.' FROM np
UNION ALL SELECT 'strippable-metadata', asset_ref, CASE WHEN strippable_bytes >= 65536 THEN 'warn' ELSE 'info' END, strippable_bytes, NULL, concat({_B("strippable_bytes")}, ' of metadata'), 'Readers of the picture don''t need it.', 'Strip it; pixels stay the same.' FROM images WHERE strippable_bytes >= 4096
UNION ALL SELECT 'format', asset_ref, 'warn', disk_saved, NULL, concat({_B("disk_saved")}, ' smaller as ', target_mime), CASE rule WHEN 'format' THEN 'Measured by a trial encoding.' ELSE 'Flat art and hard edges stay crisp without loss.' END, CASE rule WHEN 'format' THEN 'Encode it so.' ELSE 'Encode it so, without loss.' END FROM fm
UNION ALL SELECT 'duplicate-exact', first, 'warn', disk_saved, NULL, concat(n, ' files of one content'), concat('All but one take ', {_B("disk_saved")}, '.'), 'Keep one and refer to it.' FROM dup
UNION ALL SELECT 'trim-margin', asset_ref, 'info', NULL, NULL, {_ONE("frames", "One frame has wide clear margins", " frames have wide clear margins")}, concat('Up to ', {_P("share")}, ' of the sheet.'), 'Trim frames when packing.' FROM tm
UNION ALL SELECT 'dimension-mismatch', asset_ref, CASE WHEN off > 0 THEN 'crit' ELSE 'warn' END, NULL, NULL, 'Image isn''t as large as its manifest says', {_ONE("off", "One frame reaches over its edge.", " frames reach over its edge.")}, 'Export both together.' FROM dm)"""
_add("f28_messages", lambda *r: _told(*r).select("rule", "ref", "severity", "disk_saved", "vram_saved", "title", "detail", "fix"), "sprites atlases images features encode_sizes", f"WITH {_TOLD} SELECT rule, CAST(ref AS VARCHAR) AS ref, severity, disk_saved, vram_saved, title, detail, fix FROM td")
_add("k07_findings_markdown", lambda i: M.findings_markdown(M.as_findings(R.oversize(i), "dimensions-oversize").unionByName(M.as_findings(R.strippable_metadata(i), "strippable-metadata"))), "images", f"""WITH td AS (SELECT 'dimensions-oversize' AS rule, CAST(asset_ref AS VARCHAR) AS ref, CASE WHEN greatest(w, h) > 2730 THEN 'crit' ELSE 'warn' END AS severity, NULL AS disk, concat('Longest edge is ', greatest(w, h), 'px') AS title, 'Devices with smaller limits scale or refuse such textures.' AS detail FROM images WHERE greatest(w, h) > 2048
UNION ALL SELECT 'strippable-metadata', CAST(asset_ref AS VARCHAR), CASE WHEN strippable_bytes >= 65536 THEN 'warn' ELSE 'info' END, {_B("strippable_bytes")}, concat({_B("strippable_bytes")}, ' of metadata'), 'Readers of the picture don''t need it.' FROM images WHERE strippable_bytes >= 4096)
SELECT 1 AS section, {_RANK} AS rank, ref, rule, concat(rule, ':', ref) AS id, concat('| ', severity, ' | ', ref, ' | ', title, ' | ', detail, ' | ', coalesce(disk, ''), ' |  |') AS line FROM td UNION ALL SELECT 0, NULL, NULL, NULL, NULL, '| Severity | Asset | Finding | Detail | Disk saved (est.) | Texture bytes saved (est.) |' UNION ALL SELECT 0, NULL, NULL, NULL, NULL, '| --- | --- | --- | --- | --- | --- |'""")


def _gate_lines(images: DataFrame, features: DataFrame, sizes: DataFrame, found: DataFrame) -> DataFrame:
    from glyphmill.config import GLOBAL_METRICS

    return M.gate_markdown(_scaffold_gate(images, features, sizes, found).withColumn("ref", F.lit(None).cast("string")), GLOBAL_METRICS)


_add("k04_gate_markdown", _gate_lines, "images features encode_sizes found", f"""WITH g AS ({_SQL["b03_scaffold_gate"]}), v AS (SELECT *, CASE WHEN metric = 'findings.crit' THEN CAST(value::BIGINT AS VARCHAR) ELSE {_B("value::BIGINT")} END AS shown, CASE WHEN chk = 'maxDeltaPct' THEN concat(budget::BIGINT, '%') WHEN metric = 'findings.crit' THEN CAST(budget::BIGINT AS VARCHAR) ELSE {_B("budget::BIGINT")} END AS most, floor(delta_pct * 10 + 0.5) / 10 AS d FROM g)
SELECT 1 AS section, metric, NULL::VARCHAR AS ref, level, chk, concat('| ', CASE WHEN breach THEN 'error' ELSE 'pass' END, ' | `', metric, '` | global | ', chk, ' ', most, ' | ', shown, ' | ', CASE WHEN d >= 0 THEN '+' ELSE '' END, regexp_replace(CAST(d AS VARCHAR), '\\.0$', ''), '% |') AS line FROM v UNION ALL SELECT 0, NULL, NULL, NULL, NULL, '| | Metric | Scope | Budget | Value | Δ |' UNION ALL SELECT 0, NULL, NULL, NULL, NULL, '| --- | --- | --- | --- | --- | --- |'""")
_add("k08_diff_markdown", lambda b, a: M.diff_markdown(B.diff_findings(b, a), a.unionByName(b).select("id").distinct().withColumns({"title": F.concat(F.lit("about | "), "id"), "ref": F.lit("x")})), "before after", f"""WITH {_DIFF}, r AS (SELECT *, {_RANK.replace("severity", "before")} AS rb, {_RANK.replace("severity", "after")} AS ra, CASE status WHEN 'added' THEN 1 WHEN 'resolved' THEN 2 ELSE 3 END AS section FROM df WHERE status IS NOT NULL)
SELECT section, CASE WHEN after IS NULL THEN rb ELSE ra END AS rank, id, concat(CASE section WHEN 1 THEN concat('- **added** `', after, '` ') WHEN 2 THEN concat('- **resolved** `', before, '` ') ELSE concat(CASE WHEN ra < rb THEN '- **worse** `' ELSE '- **better** `' END, before, '`→`', after, '` ') END, 'about \\| ', id, ' — `x`') AS line FROM r""")


def _features(pictures: DataFrame) -> DataFrame:
    from glyphmill.sources import images as I

    f = I.image_features(PX.drawn(pictures))
    return f.select("path", "mime", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), "strippable_bytes", "solid", "opaque", F.col("bbox_w").cast("long").alias("bbox_w"), F.col("bbox_h").cast("long").alias("bbox_h"), "interior_transparent", "binary_alpha", "opaque_count")


_add("p00_features_of_pictures", _features, "pictures", """SELECT path, 'image/png' AS mime, w, h, 0::BIGINT AS strippable_bytes, ground = alpha AS solid, ground = 255 AND alpha = 255 AS opaque, CASE WHEN ground > 0 THEN w ELSE box_w END AS bbox_w, CASE WHEN ground > 0 THEN h ELSE box_h END AS bbox_h, 0::BIGINT AS interior_transparent,
ground IN (0, 255) AND alpha = 255 AS binary_alpha, CASE WHEN ground = 255 THEN w * h WHEN alpha = 255 THEN box_w * box_h ELSE 0 END::BIGINT AS opaque_count FROM pictures""")
_add("s07_parsed_sheets", lambda s, a: P.sheets(AU.sheet_texts(s, a).select("path", F.decode("content", "utf-8").alias("text"))).filter("error is null").select(F.col("asset_ref").alias("path"), "name", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h", "src_w", "page_w")], "rotated", "trimmed", "page"), "sprites atlases", """WITH f AS (SELECT s.*, decl_w, decl_h, image_ref FROM sprites s JOIN atlases USING (asset_ref) QUALIFY row_number() OVER (PARTITION BY asset_ref, name ORDER BY sprite_idx) = 1)
SELECT concat('sheets/', asset_ref, '.json') AS path, name, x, y, w, h, src_w, decl_w AS page_w, rotated, trimmed, concat(image_ref, '.png') AS page FROM f WHERE x + w <= decl_w AND y + h <= decl_h""")


def _loose_regions(sprites: DataFrame) -> DataFrame:
    r = sprites.groupBy((F.col("asset_ref") % 700).alias("g"), "name").agg(F.min(F.struct("asset_ref", "sprite_idx", "src_w", "src_h", "trim_x", "trim_y", "trim_w", "trim_h")).alias("r"))
    return r.select(F.concat(F.lit("folder:dir/g"), F.col("g").cast("string")).alias("group"), (F.col("g") % 3 == 0).alias("skeleton"), "name", F.col("r.asset_ref").alias("ref"), *[f"r.{c}" for c in ("src_w", "src_h", "trim_x", "trim_y", "trim_w", "trim_h")])


_add("x08_loose_items", lambda s: SO.loose_items(_loose_regions(s)), "sprites", """WITH r AS (SELECT asset_ref % 700 AS g, name, min({'a': asset_ref, 'i': sprite_idx, 'sw': src_w, 'sh': src_h, 'x': trim_x, 'y': trim_y, 'w': trim_w, 'h': trim_h}) AS r FROM sprites GROUP BY ALL),
t AS (SELECT *, r.w IS NOT NULL AND (r.w <> r.sw OR r.h <> r.sh) AS cut FROM r) SELECT concat('folder:dir/g', g) AS "group", g % 3 = 0 AS skeleton, name, r.a AS ref, r.sw AS src_w, r.sh AS src_h, CASE WHEN r.w IS NOT NULL THEN r.w ELSE r.sw END AS pack_w, CASE WHEN r.w IS NOT NULL THEN r.h ELSE r.sh END AS pack_h,
cut AS trimmed, CASE WHEN cut THEN r.x END AS off_x, CASE WHEN cut THEN CASE WHEN g % 3 = 0 THEN r.sh - r.y - r.h ELSE r.y END END AS off_y FROM t""")
_add("x08_pack_loose", lambda s: SO.pack_loose(_loose_regions(s)), "sprites")
_BLIT = "SELECT asset_ref * 100 + sprite_idx AS id, x AS from_x, y AS from_y, w AS from_w, h AS from_h, x, y, w, h, 300 AS page_w, 280 AS page_h, rotated AS turned, sprite_idx % 5 = 4 AS clipped FROM sprites"
_add("f22_extrusions", lambda s: SO.extrusions(s.selectExpr("asset_ref * 100 + sprite_idx as id", "x as from_x", "y as from_y", "w as from_w", "h as from_h", "x", "y", "w", "h", "300 as page_w", "280 as page_h", "rotated as turned", "sprite_idx % 5 = 4 as clipped"), 5), "sprites", f"""WITH b AS ({_BLIT}), p AS (SELECT id, page_w, page_h, t.* FROM b, LATERAL (VALUES ('top', x, y, w, 1, x, y - 5, w, 5), ('bottom', x, y + h - 1, w, 1, x, y + h, w, 5), ('left', x, y, 1, h, x - 5, y, 5, h), ('right', x + w - 1, y, 1, h, x + w, y, 5, h),
('tl', x, y, 1, 1, x - 5, y - 5, 5, 5), ('tr', x + w - 1, y, 1, 1, x + w, y - 5, 5, 5), ('bl', x, y + h - 1, 1, 1, x - 5, y + h, 5, 5), ('br', x + w - 1, y + h - 1, 1, 1, x + w, y + h, 5, 5)) AS t(kind, sx, sy, sw, sh, dx, dy, dw, dh) WHERE NOT turned AND NOT clipped),
q AS (SELECT *, greatest(0, dx) AS x0, greatest(0, dy) AS y0, least(page_w, dx + dw) AS x1, least(page_h, dy + dh) AS y1 FROM p), f AS (SELECT *, (x0 - dx) / dw::DOUBLE AS l, (y0 - dy) / dh::DOUBLE AS t, (dx + dw - x1) / dw::DOUBLE AS r, (dy + dh - y1) / dh::DOUBLE AS m FROM q WHERE x1 > x0 AND y1 > y0)
SELECT id, kind, (sx + floor(sw * l + 0.5))::BIGINT AS src_x, (sy + floor(sh * t + 0.5))::BIGINT AS src_y, greatest(1, sw - floor(sw * (l + r) + 0.5))::BIGINT AS src_w, greatest(1, sh - floor(sh * (t + m) + 0.5))::BIGINT AS src_h, x0::BIGINT AS dst_x, y0::BIGINT AS dst_y, (x1 - x0)::BIGINT AS dst_w, (y1 - y0)::BIGINT AS dst_h FROM f""")
_add("x15_page_formats", lambda i: i.select("asset_ref", SO.forced_format(F.col("asset_ref") % 7 == 0, F.col("asset_ref") % 5 > 0, F.col("asset_ref") % 11 == 0, F.col("asset_ref") % 13 == 0, F.col("mime"), F.lit("image/webp")).alias("f"), SO.page_target(F.col("asset_ref") % 3 == 0, F.col("asset_ref") % 2 == 0, F.expr("slice(array('image/avif', 'image/webp'), 1, cast(asset_ref % 4 % 3 as int))"), F.col("loose"), F.lit("image/jpeg")).alias("t")).select("asset_ref", "f.force", "f.reason", "t.kind", "t.mime", "t.more"), "images", """WITH i AS (SELECT *, CASE WHEN asset_ref % 7 = 0 THEN 'another operation has the sheet' WHEN asset_ref % 5 = 0 THEN 'its manifest isn''t there' WHEN asset_ref % 11 = 0 THEN 'a skeleton''s atlas of several pages' WHEN asset_ref % 13 = 0 THEN 'pages stay of one format' END AS reason, asset_ref % 4 % 3 AS k,
CASE WHEN asset_ref % 3 = 0 AND asset_ref % 2 = 1 THEN 'png' WHEN asset_ref % 4 % 3 > 0 THEN 'profile' WHEN asset_ref % 3 > 0 AND loose THEN 'webp-lossless' ELSE 'legacy' END AS kind FROM images)
SELECT asset_ref, reason IS NULL AND mime <> 'image/webp' AS force, reason, kind, CASE kind WHEN 'png' THEN 'image/png' WHEN 'profile' THEN 'image/avif' WHEN 'webp-lossless' THEN 'image/webp' ELSE 'image/jpeg' END AS mime, kind = 'profile' AND k > 1 AS more FROM i""")


def _placed(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """Frames on their page, one of each name, as emitters of manifests take them."""
    from pyspark.sql import Window

    s = sprites.join(atlases.select("asset_ref", "image_ref", "decl_w", "decl_h"), "asset_ref").filter("x + w <= decl_w and y + h <= decl_h")
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("asset_ref", "name").orderBy("sprite_idx"))).filter("nth = 1")
    return s.select("asset_ref", "name", "x", "y", "w", "h", "rotated", "trimmed", "src_w", "src_h", F.col("trim_x").alias("off_x"), F.col("trim_y").alias("off_y"), F.concat("image_ref", F.lit(".png")).alias("page"), F.col("decl_w").alias("page_w"), F.col("decl_h").alias("page_h"))


def _audit(sprites: DataFrame, atlases: DataFrame, pictures: DataFrame) -> DataFrame:
    """Sheets and pictures written as files, read back and audited: findings by rule and severity. Every sixth picture is a sheet's page."""
    page = pictures.withColumn("path", F.concat(F.lit("sheets/img"), F.expr("cast(red * 7 % 500 as string)"), F.lit(".png"))).groupBy("path").agg(*[F.min(c).alias(c) for c in pictures.columns if c != "path"])
    # parsers, features and hashes each read the files, so they are drawn once and written
    found, _, _ = AU.audit(written(AU.sheet_texts(sprites, atlases).unionByName(PX.drawn(pictures.unionByName(page))), "audit-files"))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.sum("disk_saved").alias("disk_saved"), F.sum("vram_saved").alias("vram_saved"))


_add("k09_emitted_manifests", lambda s, a: P.sheets(RE.sheet_manifests(_placed(s, a)).select(F.concat(F.lit("k"), F.col("asset_ref").cast("string")).alias("path"), F.col("manifest").alias("text"))).filter("error is null").select("asset_ref", "name", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h", "src_w", "src_h")], "rotated", "trimmed"), "sprites atlases", """WITH f AS (SELECT s.*, decl_w, decl_h FROM sprites s JOIN atlases USING (asset_ref) WHERE x + w <= decl_w AND y + h <= decl_h QUALIFY row_number() OVER (PARTITION BY asset_ref, name ORDER BY sprite_idx) = 1) SELECT concat('k', asset_ref) AS asset_ref, name, x, y, w, h, src_w, src_h, rotated, trimmed FROM f""")
_add("k09_emitted_atlas_texts", lambda s, a: P.atlas_texts(RE.atlas_texts(_placed(s, a)).select(F.concat(F.lit("k"), F.col("asset_ref").cast("string")).alias("path"), "text")).filter("error is null").select("asset_ref", "name", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h", "src_w", "src_h")], "rotated"), "sprites atlases", """WITH f AS (SELECT s.*, decl_w, decl_h FROM sprites s JOIN atlases USING (asset_ref) WHERE x + w <= decl_w AND y + h <= decl_h QUALIFY row_number() OVER (PARTITION BY asset_ref, name ORDER BY sprite_idx) = 1) SELECT concat('k', asset_ref) AS asset_ref, name, x, y, w, h, src_w, src_h, rotated FROM f""")
_add("audit_of_files", _audit, "sprites atlases pictures")
_add("x06_sprite_meshes", lambda p: MS.sprite_meshes(PX.drawn(p), p.select("path", F.lit(0).cast("long").alias("sprite_idx"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))).select("path", F.to_json("vertices").alias("vertices"), F.size("triangles").alias("triangles")), "pictures", """WITH p AS (SELECT path, CASE WHEN ground > 0 THEN 0 ELSE from_x END AS x, CASE WHEN ground > 0 THEN 0 ELSE from_y END AS y, CASE WHEN ground > 0 THEN w ELSE box_w END AS bw, CASE WHEN ground > 0 THEN h ELSE box_h END AS bh, ground > 0 AS whole FROM pictures)
SELECT path, CASE WHEN NOT whole THEN concat('[[', x, ',', y, '],[', x + bw, ',', y, '],[', x + bw, ',', y + bh, '],[', x, ',', y + bh, ']]') END AS vertices, CASE WHEN NOT whole THEN 2 END AS triangles FROM p""")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
