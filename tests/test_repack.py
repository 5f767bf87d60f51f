"""Packing and repacking: goldens, and properties over made sheets."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.operators import packing as X
from glyphmill.operators import repack as RP
from glyphmill.operators.maxrects import pack_items

FRAME = "asset_ref long, sprite_idx long, name string, x long, y long, w long, h long, rotated boolean, trimmed boolean, frame_hash string, src_w long, src_h long, off_x long, off_y long, trim_x long, trim_y long, trim_w long, trim_h long"


def frame(idx, w, h, x=0, y=0, ref=1, turned=False, trimmed=False, key=None, src=None, off=(None, None), box=(None,) * 4):
    return (ref, idx, f"s{idx}", x, y, w, h, turned, trimmed, key, *(src or (w, h)), *off, *box)


def sheets(spark, n=1, w=256, h=256):
    return spark.createDataFrame([(i + 1, w, h) for i in range(n)], "asset_ref long, decl_w long, decl_h long")


def check(sizes, bins, most, padding, gutter):
    seen = [i for _, _, at in bins for i in at]
    assert sorted(seen) == list(range(len(sizes)))
    for w, h, at in bins:
        assert w & (w - 1) == 0 and h & (h - 1) == 0 and max(w, h) <= most
        boxes = []
        for i, (x, y, turned) in at.items():
            iw, ih = sizes[i][::-1] if turned else sizes[i]
            if max(sizes[i]) + padding + 2 * gutter <= most:
                assert x >= gutter and y >= gutter and x + iw + padding + gutter <= w and y + ih + padding + gutter <= h
            else:
                assert len(at) == 1
            boxes.append((x - gutter, y - gutter, x + iw + padding + gutter, y + ih + padding + gutter))
        for k, a in enumerate(boxes):
            assert not any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for b in boxes[:k])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(1, 90)), max_size=25), st.integers(0, 3), st.integers(0, 2), st.booleans(), st.sampled_from([64, 128, 1024]))
def test_packs_hold_everything_without_overlap(sizes, padding, gutter, turn, most):
    check(sizes, pack_items(sizes, most, padding, gutter, turn), most, padding, gutter)


def test_smallest_bin_and_spill():
    assert [(w, h) for w, h, _ in pack_items([(100, 60), (60, 100)], 4096)] == [(128, 256)]
    assert [w * h for w, h, _ in pack_items([(100, 60), (60, 100)], 4096, turn=True)] == [128 * 128]
    assert [(w, h) for w, h, _ in pack_items([(64, 64)] * 5, 128)] == [(128, 128), (128, 128)]
    assert pack_items([], 128) == [] and [len(at) for _, _, at in pack_items([(300, 9), (9, 9)], 128)] == [1, 1]


def rows(spark, frames, n=1, least=2, **options):
    groups = sheets(spark, n).selectExpr("1L as `group`", "asset_ref", "asset_ref as ord")
    items = RP.repack_items(spark.createDataFrame(frames, FRAME), groups, least)
    placed = RP.place_items(items, **options)
    out = {(r.asset_ref, r.sprite_idx): r for r in RP.repacked_frames(items, placed).collect()}
    return out, RP.repack_totals(items, placed, sheets(spark, n), groups).first()


def test_turns_only_where_they_take_fewer_bytes(spark):
    pair = [frame(0, 100, 60), frame(1, 60, 100, 100)]
    got, t = rows(spark, pair, padding=0)
    assert (t.vram_before, t.vram_after, t.turned) == (256 * 256 * 4, 128 * 128 * 4, 1)
    turned = next(r for r in got.values() if r.rotated)
    assert (turned.w, turned.h) == (turned.src_h, turned.src_w)
    got, t = rows(spark, pair, padding=0, rotation=False)
    assert t.turned == 0 and t.vram_after == 128 * 256 * 4 and not any(r.rotated for r in got.values())
    got, t = rows(spark, [frame(0, 64, 20), frame(1, 30, 40, 0, 20, turned=True, src=(40, 30))], padding=0)
    assert t.turned == 0 and got[1, 1].rotated and not got[1, 0].rotated  # a frame that is turned already keeps the group as it is


def test_aliases_share_place_and_turn(spark):
    got, t = rows(spark, [frame(0, 100, 60, 0, 0, key="a"), frame(1, 100, 60, 0, 60, key="a"), frame(2, 60, 100, 0, 120, key="b"), frame(3, 60, 100, 60, 120, key="b")], padding=0)
    assert (t.aliased, t.turned, t.vram_after) == (2, 1, 128 * 128 * 4)
    place = lambda r: (r.x, r.y, r.w, r.h, r.rotated, r.src_w, r.src_h)
    assert place(got[1, 0]) == place(got[1, 1]) and place(got[1, 2]) == place(got[1, 3])
    assert sorted(k for k, r in got.items() if r.copied) == [(1, 0), (1, 2)]


def test_an_alias_with_geometry_of_its_own_keeps_the_cluster_from_being_trimmed(spark):
    plain, box = frame(0, 20, 20, key="h", box=(2, 2, 16, 16)), (2, 2, 16, 16)
    got, t = rows(spark, [plain, frame(1, 20, 20, 40, key="h", trimmed=True, src=(100, 100), off=(30, 40))])
    assert (t.trimmed, t.aliased) == (0, 1) and (got[1, 1].src_w, got[1, 1].off_x, got[1, 1].off_y, got[1, 1].trimmed) == (100, 30, 40, True)
    assert (got[1, 0].w, got[1, 0].trimmed) == (20, False)
    got, t = rows(spark, [plain, frame(1, 20, 20, 40, key="h")])
    assert (t.trimmed, t.reclaimed) == (1, 400 - 256)
    assert {(r.w, r.h, r.trimmed, r.src_w, r.off_x, r.off_y) for r in got.values()} == {(16, 16, True, 20, 2, 2)}
    got, t = rows(spark, [frame(0, 20, 20, box=box, turned=True), frame(1, 20, 20, 40, box=(0, 0, 20, 20)), frame(2, 20, 20, 80)])
    assert t.trimmed == 0


def test_offsets_of_skeletons_count_from_the_bottom(spark):
    items = RP.repack_items(spark.createDataFrame([frame(0, 20, 30, box=(2, 3, 10, 12))], FRAME), sheets(spark).selectExpr("1L as `group`", "asset_ref", "0L as ord"))
    r = RP.repacked_frames(items, RP.place_items(items), bottom_left=True).first()
    assert (r.off_x, r.off_y, r.w, r.h) == (2, 30 - 3 - 12, 10, 12)


def test_merged_sheets_share_frames(spark):
    frames = [frame(0, 64, 64, key="k", ref=1), frame(1, 30, 64, 64, ref=1), frame(0, 64, 64, key="k", ref=2), frame(1, 64, 64, 0, 64, key="k", ref=2)]
    got, t = rows(spark, frames, n=2, padding=0)
    assert (t.sheets, t.bins, t.aliased, t.vram_before, t.vram_after) == (2, 1, 2, 2 * 256 * 256 * 4, 128 * 64 * 4)
    assert len({(r.x, r.y) for k, r in got.items() if k != (1, 1)}) == 1
    groups = sheets(spark, 2).selectExpr("1L as `group`", "asset_ref", "asset_ref as ord")
    gain = RP.merge_gain(spark.createDataFrame(frames, FRAME), groups, padding=0).first()
    assert gain.vram_reclaimed == gain.vram_plain - gain.vram_after > 0


@pytest.mark.parametrize("seed", range(3))
def test_frames_of_made_sheets_stay_apart(spark, seed):
    r = random.Random(seed)
    frames = []
    for ref in (1, 2, 3):
        for i in range(25):
            w, h = r.randint(4, 60), r.randint(4, 60)
            box = (1, 1, w - 2, h - 2) if r.random() < 0.4 else (None,) * 4
            frames.append(frame(i, w, h, r.randint(0, 200), r.randint(0, 200), ref, r.random() < 0.1 * (ref == 2), r.random() < 0.2, r.choice([None, "p", "q", "r"]), box=box))
    s = spark.createDataFrame(frames, FRAME)
    groups = sheets(spark, 3).selectExpr("asset_ref as `group`", "asset_ref", "0L as ord")
    items = RP.repack_items(s, groups)
    placed = RP.place_items(items, padding=1, most=256)
    out = RP.repacked_frames(items, placed).collect()
    assert len(out) == len(frames)
    for g in (1, 2, 3):
        boxes = [(x.bin, x.x, x.y, x.x + x.w, x.y + x.h) for x in out if x.group == g and x.copied]
        assert not any(a[0] == b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4] for k, a in enumerate(boxes) for b in boxes[:k])
        places = {(x.bin, x.x, x.y) for x in out if x.group == g and x.copied}
        assert all((x.bin, x.x, x.y) in places for x in out if x.group == g)


def test_scaled_frames_stay_on_the_sheet(spark):
    a = spark.createDataFrame([(1, 101, 101)], "asset_ref long, decl_w long, decl_h long")
    got = X.scale_atlas(spark.createDataFrame([frame(0, 51, 1, 50, 100)], FRAME), a, 0.5).first()
    assert (got.sheet_w, got.x, got.y, got.w, got.h) == (51, 25, 50, 26, 1)


def test_loose_images_pack_without_turns(spark):
    from glyphmill.operators import sheet_output as SO

    region = "group string, skeleton boolean, name string, ref string, src_w long, src_h long, trim_x long, trim_y long, trim_w long, trim_h long"
    r = random.Random(2)
    rows = [("folder:ui", False, f"n{i:02d}", f"ui/n{i}.png", w := r.randint(5, 60), h := r.randint(5, 60), *((1, 2, w - 3, h - 4) if i % 3 else (None,) * 4)) for i in range(40)] + [("skeleton:sk", True, "a", "sk/a.png", 20, 30, 2, 3, 10, 12), ("skeleton:sk", True, "b", "sk/b.png", 9, 9, 0, 0, 9, 9)]
    out = {(x.group, x.name): x for x in SO.pack_loose(spark.createDataFrame(rows, region), padding=1, most=128).collect()}
    assert len(out) == len(rows)
    a = out["skeleton:sk", "a"]
    assert (a.pack_w, a.pack_h, a.trimmed, a.off_x, a.off_y, a.page_name) == (10, 12, True, 2, 15, "sk.webp") and not out["skeleton:sk", "b"].trimmed
    ui = [x for k, x in out.items() if k[0] == "folder:ui"]
    assert {x.page for x in ui} == set(range(max(x.page for x in ui) + 1)) and {x.page_name for x in ui if x.page == 1} <= {"ui_1.webp"}
    boxes = [(x.page, x.x, x.y, x.x + x.pack_w, x.y + x.pack_h) for x in ui]
    assert not any(p[0] == q[0] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4] for k, p in enumerate(boxes) for q in boxes[:k])
    whole = SO.pack_loose(spark.createDataFrame(rows, region), trim=False).filter("name = 'a'").first()
    assert (whole.pack_w, whole.trimmed, whole.off_x) == (20, False, None)


def test_strips_around_a_frame(spark):
    from glyphmill.operators import sheet_output as SO

    blits = [(1, 10, 20, 8, 6, 50, 60, 8, 6, 256, 256, False, False), (2, 0, 0, 8, 6, 0, 0, 8, 6, 256, 256, False, False), (3, 0, 0, 8, 6, 9, 9, 8, 6, 256, 256, True, False)]
    df = spark.createDataFrame(blits, "id long, from_x long, from_y long, from_w long, from_h long, x long, y long, w long, h long, page_w long, page_h long, turned boolean, clipped boolean")
    got = {(r.id, r.kind): tuple(r)[2:] for r in SO.extrusions(df, 2).collect()}
    assert {k for i, k in got if i == 1} == {"top", "bottom", "left", "right", "tl", "tr", "bl", "br"} and {k for i, k in got if i == 2} == {"bottom", "right", "br"} and not any(i == 3 for i, _ in got)
    assert got[1, "top"] == (10, 20, 8, 1, 50, 58, 8, 2) and got[1, "br"] == (17, 25, 1, 1, 58, 66, 2, 2) and got[2, "right"] == (7, 0, 1, 6, 8, 0, 2, 6)
    assert SO.extrusions(df, 0).count() == 0


def test_items_are_dealt_once(spark):
    """Frames of a group are looked at beside each other: one shuffle by group after the join, whatever is asked of them."""
    import re

    cols = "asset_ref long, sprite_idx long, x long, y long, w long, h long, rotated boolean, trimmed boolean, frame_hash string, src_w long, src_h long, off_x long, off_y long, trim_x long, trim_y long, trim_w long, trim_h long"
    s = spark.createDataFrame([(1, 0, 0, 0, 9, 9, False, False, "a", 9, 9, None, None, 0, 0, 9, 9), (2, 0, 5, 0, 9, 9, False, False, "a", 9, 9, None, None, 0, 0, 9, 9), (2, 1, 0, 0, 8, 8, False, False, None, 8, 8, None, None, 1, 1, 5, 5)], cols)
    g = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "group long, asset_ref long, ord long")
    items = RP.repack_items(s, g)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(group", plan)) == 1 and len(re.findall("Exchange hashpartitioning", plan)) <= 3
    assert sorted((r.asset_ref, r.sprite_idx, r.rep_ref, r.rep_idx, r.pack_w, r.tight, r.places) for r in items.collect()) == [(1, 0, 1, 0, 9, False, 2), (2, 0, 1, 0, 9, False, 2), (2, 1, 2, 1, 5, True, 1)]


def test_few_and_many_free_rectangles_give_the_same_places(monkeypatch):
    import numpy as np

    from glyphmill.operators import maxrects as MR

    rng = np.random.default_rng(4)
    sets = [[tuple(map(int, v)) for v in rng.integers(1, 120, (n, 2))] for n in (1, 3, 5, 8, 40, 70)]
    few = [MR.pack_items(v, 512, 1, 0, turn) for v in sets for turn in (False, True)]
    monkeypatch.setattr(MR, "LOOP", 0)
    assert few == [MR.pack_items(v, 512, 1, 0, turn) for v in sets for turn in (False, True)]
