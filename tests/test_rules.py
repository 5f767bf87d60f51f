"""Goldens, thresholds at their edges, silence without inputs, and independence of input order."""

import pytest
from pyspark.sql import functions as F

from glyphmill.config import DEFAULT, parse_budget, parse_bytes, parse_count, parse_ratio
from glyphmill.functions import scalars as S
from glyphmill.operators import asset_rules as R
from glyphmill.operators import folder_rules as A
from glyphmill.operators import gate as B
from glyphmill.operators import geometry as G
from glyphmill.operators import near_duplicates as ND
from glyphmill.operators import packing as X
from glyphmill.operators import runtime as T

SPRITE = "asset_ref long, sprite_idx long, name string, x int, y int, w int, h int, rotated boolean, trimmed boolean, frame_hash string"
ATLAS = "asset_ref long, decl_w int, decl_h int, source_kind string, scale double"
IMAGE = "asset_ref long, path string, w int, h int, mime string, byte_size long"


def sprites(spark, rects, hashes=None):
    return spark.createDataFrame([(1, i, f"s{i}", *r, False, False, hashes[i] if hashes else None) for i, r in enumerate(rects)], SPRITE)


def test_occupancy_of_a_quarter_full_sheet(spark):
    s = sprites(spark, [(0, 0, 512, 512)])
    a = spark.createDataFrame([(1, 1024, 1024, "pixi", 1.0)], ATLAS)
    r = R.occupancy(s, a).first()
    assert (r.occ, r.severity, r.wasted_bytes) == (0.25, "crit", 3 * 512 * 512 * 4)
    small = spark.createDataFrame([(1, 64, 64, "pixi", 1.0)], ATLAS)
    assert R.occupancy(sprites(spark, [(0, 0, 32, 32)]), small).first().severity == "info"


@pytest.mark.parametrize("longest,severity", [(2048, None), (2049, "warn"), (2730, "warn"), (2731, "crit")])
def test_oversize_edges(spark, longest, severity):
    rows = R.oversize(spark.createDataFrame([(1, "a", longest, 10, "image/png", 1)], IMAGE)).collect()
    assert [r.severity for r in rows] == ([severity] if severity else [])


@pytest.mark.parametrize("n,pot,up", [(1, True, 1), (2, True, 2), (3, False, 4), (1024, True, 1024), (1025, False, 2048)])
def test_powers_of_two(spark, n, pot, up):
    r = spark.range(1).select(S.is_power_of_two(F.lit(n)).alias("p"), S.next_power_of_two(F.lit(n)).alias("u")).first()
    assert (r.p, r.u) == (pot, up)


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../Pic_hd@x-2x_PNG.png",), ("Icon-720p.webp",), ("x_png.png",), ("../a//b",)], "p string")
    got = [tuple(r) for r in df.select(S.normalize_path(F.col("p")), S.stem_of(S.normalize_path(F.col("p"))), S.has_resolution_token(F.col("p"))).collect()]
    assert got == [("a/Pic_hd@x-2x_PNG.png", "a/pic_hd@x", True), ("Icon-720p.webp", "icon", True), ("x_png.png", "x", False), ("a/b", "a/b", False)]


def test_hamming_and_rounding(spark):
    r = spark.range(1).select(S.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001")).alias("h"), S.round_half_up(F.lit(-2.5)).alias("r"), S.format_bytes(F.lit(1536)).alias("b"), S.vram_bytes_mipmapped(F.lit(512), F.lit(512)).alias("m"), S.refs_preview(F.array(*[F.lit(str(i)) for i in range(12)])).alias("p")).first()
    assert (r.h, r.r, r.b, r.m) == (63, -2, "1.5 KB", 1398102) and r.p.endswith("… (+2)")


def test_globs():
    import re

    m = lambda g, s: bool(re.match(S.glob_to_regex(g), s))
    assert m("**/*.png", "a/b.png") and m("**/*.png", "b.png") and not m("*.png", "a/b.png") and m("a/?.png", "a/b.png") and m("a/**", "a/b/c")


def test_frame_redundancy_needs_distinct_places(spark):
    same = [(0, 0, 10, 10), (0, 0, 10, 10), (20, 0, 10, 10)]
    images = spark.createDataFrame([(1, "a", 64, 64, "image/png", 600)], IMAGE)
    assert R.frame_redundancy(sprites(spark, same, "hhh"), images).count() == 0
    r = R.frame_redundancy(sprites(spark, [*same, (40, 0, 10, 10)], "hhhh"), images).first()
    assert (r.area, r.vram_saved, r.disk_saved) == (200, 800, 300)


def test_touching_twice_counts_once(spark):
    s = sprites(spark, [(0, 0, 10, 10), (10, 0, 10, 10), (0, 10, 10, 10), (10, 10, 10, 10)])
    assert R.touching_pairs(s).count() == 4  # diagonal neighbours don't overlap
    assert R.bleeding(s).first().severity == "info"


def test_gutter_is_the_lower_median(spark):
    s = sprites(spark, [(0, 0, 10, 10), (18, 0, 10, 10), (38, 0, 10, 10), (66, 0, 10, 10), (100, 0, 10, 10)])
    assert sorted(r.gap for r in R.neighbour_gaps(s).collect()) == [8, 10, 18, 24]
    assert R.excessive_gutter(s).first().median == 10


def test_empty_space_of_a_half_covered_sheet(spark):
    a = spark.createDataFrame([(1, 64, 64, "pixi", 1.0)], ATLAS)
    rows = G.empty_rectangles(sprites(spark, [(0, 0, 64, 32), (0, 32, 32, 32)]), a).collect()
    assert [(r.x, r.y, r.w, r.h) for r in rows] == [(32, 32, 32, 32)]
    assert G.dispersion(sprites(spark, [(0, 0, 64, 64)]), a).first().fragmentation == 0


def test_null_inputs_are_silent(spark):
    images = spark.createDataFrame([(1, "a", 2000, 2000, "image/png", None)], IMAGE).withColumns({"strippable_bytes": F.lit(None).cast("long"), "icc_bytes": F.lit(None).cast("long"), "icc_srgb": F.lit(None).cast("boolean")})
    features = spark.createDataFrame([(1,)], "asset_ref long").withColumns({c: F.lit(None).cast(t) for c, t in (("solid", "boolean"), ("opaque", "boolean"), ("upscale_depth", "int"), ("bbox_w", "int"), ("bbox_h", "int"), ("interior_transparent", "long"), ("binary_alpha", "boolean"), ("content_class", "string"), ("content_hash", "string"), ("pixel_hash", "string"))})
    sizes = spark.createDataFrame([], "asset_ref long, target_mime string, opaque boolean, bytes long")
    s = sprites(spark, [(0, 0, 10, 10)])
    for rows in (R.solid_fill(images, features), R.upscaled_source(images, features), R.strippable_metadata(images), R.icc_non_srgb(images), R.interior_transparency(images, features), R.binary_alpha(images, features), R.wasted_alpha(images, features, sizes), R.format_candidates(images, features, sizes), A.duplicate_exact(images, features), A.loose_in_atlas(features, s)):
        assert rows.count() == 0


def test_similar_groups_are_complete_linkage(spark):
    rows = [(i, i, f"c{i}", h, 1.0, 1.0, 1.0) for i, h in enumerate(["0000000000000000", "000000000000003f", "0000000000000fff", "0000000000000fc0"])] + [(9, 9, "z", "ffffffffffffffff", 0.0, 0.0, 0.0), (10, 10, "z", "ffffffffffffffff", 0.0, 0.0, 0.0)]
    f = spark.createDataFrame(rows, "asset_ref long, ord long, content_hash string, d_hash string, mean_r double, mean_g double, mean_b double")
    got = sorted(map(tuple, ND.duplicate_similar(f).collect()))
    assert got == [(0, 0), (0, 1), (2, 2), (2, 3)]
    assert sorted(map(tuple, ND.duplicate_similar(f.repartition(4)).collect())) == got


def test_owners(spark):
    rows = [("main/a.png", "h", "raw"), ("fs/a.png", "h", "raw"), ("bonus/a.png", "h", "raw"), ("extra/a.png", "h", "raw"), ("bonus/b.png", "k", "raw"), ("bonus/c.png", "k", "raw"), ("extra/b.png", "k", "raw")]
    f = spark.createDataFrame(rows, "asset_ref string, content_hash string, pool string")
    marking = spark.createDataFrame([("main", "eager"), ("fs", "eager"), ("bonus", "lazy")], "bundle string, availability string")
    got = {r.asset_ref: (r.owner, r.reason) for r in A.dedup_edges(f, marking, spark.createDataFrame([], "key string, value string")).collect()}
    assert got == {
        "fs/a.png": ("fs/a.png", None), "main/a.png": ("fs/a.png", "eager-owner-cross-bundle"), "bonus/a.png": ("fs/a.png", "eager-owner-cross-bundle"), "extra/a.png": ("fs/a.png", "eager-owner-cross-bundle"),
        "bonus/b.png": ("bonus/b.png", None), "bonus/c.png": ("bonus/b.png", "same-lazy-bundle"), "extra/b.png": ("extra/b.png", None),
    }


def test_gate(spark):
    rows, ignore = parse_budget({"version": 1, "budgets": {"findings.crit": {"error": {"max": 0}}, "totals.diskBytes": {"warn": {"maxDeltaPct": 10}}}, "assets": [{"match": "a/**", "budgets": {"diskBytes": {"error": {"max": "1 KB"}}}}, {"match": "**", "budgets": {"diskBytes": {"error": {"max": "2 KB"}}}}], "ignore": ["tmp/**"]})
    b = spark.createDataFrame(rows, "ord int, scope string, match string, metric string, level string, chk string, budget double")
    v = spark.createDataFrame([("global", None, "findings.crit", 1.0), ("global", None, "totals.diskBytes", 5.0), ("asset", "a/x", "diskBytes", 1500.0), ("asset", "b/x", "diskBytes", 1500.0), ("asset", "tmp/x", "diskBytes", 9e9)], "scope string, ref string, metric string, value double")
    base = spark.createDataFrame([("global", None, "totals.diskBytes", 0.0)], "scope string, ref string, metric string, value double")
    got = {(r.ref, r.metric): (r.breach, r.delta_pct) for r in B.evaluate(v, b, base, ignore).collect()}
    assert got == {(None, "findings.crit"): (True, None), (None, "totals.diskBytes"): (True, float("inf")), ("a/x", "diskBytes"): (True, None), ("b/x", "diskBytes"): (False, None)}
    assert not any(r.breach for r in B.evaluate(v.filter("metric = 'totals.diskBytes'"), b).collect())
    assert B.verdict(B.evaluate(v, b, base)).first().verdict == "fail" and ignore == ["^tmp/.*$"]


def test_scaffold_parses_and_gates(spark):
    totals = spark.createDataFrame([(10 << 20, 5)], "disk long, loaded long")
    rows, _ = parse_budget(B.scaffold_config(B.budget_scaffold(totals).collect()))
    assert {(r[3], r[5]): r[6] for r in rows} == {("totals.diskBytes", "max"): 12 << 20, ("totals.diskBytes", "maxDeltaPct"): 15, ("totals.loadedVramBytes", "max"): 1 << 20, ("findings.crit", "max"): 0}


@pytest.mark.parametrize("bad", [{"version": 2}, {"version": 1, "x": 1}, {"version": 1, "budgets": {"nope": {"error": {"max": 1}}}}, {"version": 1, "budgets": {"findings.crit": {"error": {"most": 1}}}}, {"version": 1, "budgets": {"totals.diskBytes": {"error": {"max": 5}}}}, {"version": 1}, {"version": 1, "budgets": {"findings.crit": {"error": {}}}}, {"version": 1, "budgets": {"findings.format": {"error": {"max": 1}}}}, {"version": 1, "budgets": {"findings.crit": {"error": {"max": 1.5}}}}])
def test_bad_budgets_are_refused(bad):
    with pytest.raises(ValueError):
        parse_budget(bad)


def test_values():
    assert parse_bytes("1.5 MB") == 1572864 and parse_ratio("80%") == 0.8 and parse_count(3) == 3
    with pytest.raises(ValueError):
        DEFAULT.replace(nothing=1)


def test_session_reports(spark):
    f = spark.createDataFrame([(1, i, float(10 + i % 3) if i != 90 else 80.0, 5, 1, 0, int(i == 90), 0) for i in range(1, 101)], "session long, seq long, dt double, draws long, binds long, redundant long, uploads int, compiles int")
    r = T.session_reports(f).first()
    assert (r.frames, r.play_frames, r.median, r.avg_draws) == (100, 70, 11.0, 5.0)
    assert [(h.seq, h.cause) for h in T.hitches(f).collect()] == [(90, "texture upload")]
    w = T.window_frames(f, 80)
    assert w.count() == 80 and w.agg(F.min("nth")).first()[0] == 21


def test_packing_never_overlaps(spark):
    s = sprites(spark, [(0, 0, 10 + i * 7 % 50, 10 + i * 13 % 40) for i in range(60)])
    size = {r.sprite_idx: (r.w, r.h) for r in s.collect()}
    rows = X.pack(s).collect()
    assert {r.sprite_idx for r in rows} == set(size) and len({r.bin for r in rows}) == 1
    taken = set()
    for r in rows:
        w, h = size[r.sprite_idx]
        assert r.x + w <= r.bin_w and r.y + h <= r.bin_h
        cells = {(x, y) for x in range(r.x, r.x + w) for y in range(r.y, r.y + h)}
        assert not cells & taken
        taken |= cells
    assert X.packed_sizes(X.pack(sprites(spark, [(0, 0, 5000, 10), (0, 0, 4096, 4096), (0, 0, 4, 4)]))).first().bins == 3


def test_a_sheet_of_any_size_is_packed(spark):
    s = sprites(spark, [(0, 0, 3 + i % 7, 2 + i % 5) for i in range(2100)])
    assert X.packed_sizes(X.pack(s)).first().n == 2100
    assert X.pack(s, most_sprites=X.MAX_SPRITES).count() == 0


def test_sheets_of_any_number_of_sprites_are_tried_for_a_repack(spark, tmp_path):
    from glyphmill.plans import catalog

    items = [(2, 180, 180, 0, 1.0 * i, "A", "O") for i in range(2001)] + [(17, 180, 180, 0, 1.0 * i, "A", "O") for i in range(2000)]  # of 8 by 8
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(2, 17), (17, 17)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = catalog.queries()["r15_repack_opportunity"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(i, 768 * 768 * 4 - 32 * 4096 * 4, "warn") for i in (2, 17)]


def test_trial_sizes_are_those_of_the_pack_within_the_room(spark):
    sheets = {
        1: [(3 + i % 7, 2 + i % 5) for i in range(2100)], 2: [(40, 40), (30, 30), (9, 0)], 3: [(5000, 10), (4, 4)], 4: [(10, 10)], 5: [(4096, 4096), (1, 1)],
        6: [(64, 64)] * 4, 7: [(64, 64)] * 4, 8: [(64, 64)] * 4 + [(1, 1)], 9: [(8, 8)] * 3, 10: [(2**31 - 1, 2**31 - 1)] * 5, 11: [(9, 9), (7, 7)], 12: [(0, 5)],
    }
    s = spark.createDataFrame([(k, i, w, h) for k, v in sheets.items() for i, (w, h) in enumerate(v)], "asset_ref long, sprite_idx long, w int, h int")
    room = {k: 4096 * 4096 for k in sheets} | {1: 1 << 16, 6: 128 * 128, 7: 128 * 128 - 1, 8: 128 * 128, 10: 2**62}
    room.pop(9)
    r = spark.createDataFrame([*room.items(), (6, 5), (11, 1 << 60), (99, 64)], "asset_ref long, room long")
    want = [x for x in map(tuple, X.packed_sizes(X.pack(s)).collect()) if x[0] in room and x[1] == 1 and x[3] * x[4] <= room[x[0]]]
    got = X.trial_sizes(s, r)
    assert got.columns == X.packed_sizes(X.pack(s)).columns
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {x[0] for x in want} == {1, 2, 4, 6, 11}


@pytest.mark.parametrize("side", [512, 384])
def test_room_of_a_repack_ends_where_it_saves_too_little(spark, side):
    a = spark.createDataFrame([(1, side, 512, "pixi", 1.0), (2, side, 512, "bmfont", 1.0), (3, side, 512, "pixi", 1.0), (4, side, 512, None, 1.0), (5, 128, 512, "pixi", 1.0)], ATLAS)
    i = spark.createDataFrame([(k, "a", side if k != 5 else 128, 512 if k != 3 else 511, "image/png", 1) for k in range(1, 6)], IMAGE)
    room = side * 512 - 256 * 256
    assert [tuple(r) for r in R.repack_room(a, i).collect()] == [(1, room)]
    packed = lambda h: spark.createDataFrame([(1, 1, 2, 1, h)], "asset_ref long, bins long, n long, bin_w long, bin_h long")
    assert R.repack_opportunity(a, packed(room), i).first().vram_saved == 262144
    assert R.repack_opportunity(a, packed(room + 1), i).count() == 0


def test_empty_rectangles_move_boxes_and_not_cells(spark):
    from glyphmill.operators import geometry

    s = spark.createDataFrame([("a", 0, 0, 16, 16), ("a", 40, -8, 500, 16), ("b", 500, 0, 9, 9), ("b", 0, 0, 0, 9)], "asset_ref string, x long, y long, w long, h long")
    a = spark.createDataFrame([("a", 64, 32), ("b", 20, 9), ("c", 0, 9)], "asset_ref string, decl_w long, decl_h long")
    e = geometry.empty_rectangles(s, a)
    assert "Generate" not in e._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in e.collect()) == [("a", 0, 16, 64, 16), ("a", 16, 0, 24, 8), ("a", 16, 8, 48, 8), ("b", 0, 0, 20, 9)]
