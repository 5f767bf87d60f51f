"""Pixel kernels against plain loops, colour profiles, folders, verdicts and tiers."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.config import is_safe_suffix, validate_tiers
from glyphmill.functions import scalars as S
from glyphmill.operators import gate as B
from glyphmill.sources import files, images
from tests.test_sources import png

NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def luma(p):
    return 0.299 * float(p[0]) + 0.587 * float(p[1]) + 0.114 * float(p[2])


def plain_edges(px):
    h, w = px.shape[:2]
    marks = []
    for y in range(h):
        for x in range(w):
            a = px[y, x, 3] / 255
            around = [px[y + dy, x + dx] for dy, dx in NEAR if 0 <= y + dy < h and 0 <= x + dx < w]
            fit = [luma(q) for q in around if q[3] >= 250 and luma(q) >= 96 and luma(q) * (1 - a) >= 24]
            if 12 <= px[y, x, 3] <= 200 and fit:
                marks.append((luma(px[y, x]) - fit[0] * a) / (1 - a) <= 40)
    return len(marks), sum(marks) / len(marks) if marks else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_dark_edges_equal_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 256, (17, 23, 4)).astype(np.uint8)
    px[..., 3] = rng.choice([0, 11, 12, 100, 200, 201, 249, 250, 255], (17, 23))
    n, share = images.dark_edges(px)
    want = plain_edges(px)
    assert n == want[0] and n > 0 and share == pytest.approx(want[1])


def test_dark_edges_of_files_premultiplied_and_not():
    straight = np.full((4, 6, 4), 255, np.uint8)
    straight[:, 3:, 3] = 100
    multiplied = straight.copy()
    multiplied[:, 3:, :3] = 100
    assert images.dark_edges(straight) == (4, 0.0) and images.dark_edges(multiplied) == (4, 1.0)
    assert images.dark_edges(np.zeros((1, 1, 4), np.uint8)) == (0, 0.0)


def test_high_frequency_energy():
    px = np.zeros((3, 3, 4), np.uint8)
    assert images.high_frequency_energy(px) == 0 and images.high_frequency_energy(px[:2]) == 0
    px[1, 1, :3] = 10
    assert images.high_frequency_energy(px) == pytest.approx(40)


def test_frame_hashes(spark):
    rng = np.random.default_rng(1)
    px = np.full((32, 40, 4), 255, np.uint8)
    px[:16, :16, :3] = px[16:, 20:36, :3] = rng.integers(0, 256, (16, 16, 3))
    f = spark.createDataFrame([("a.png", png(px)), ("b.png", b"no image")], "path string, content binary")
    rects = [(0, 0, 16, 16), (20, 16, 16, 16), (20, 0, 16, 16), (30, 20, 20, 16), (0, 0, 0, 4), (0, 0, 3, 5)]
    s = spark.createDataFrame([(p, i, *r) for p in ("a.png", "b.png") for i, r in enumerate(rects)], "path string, sprite_idx long, x int, y int, w int, h int")
    got = {(r.path, r.sprite_idx): r.frame_hash for r in images.frame_hashes(f, s).collect()}
    same = hashlib.sha256(px[:16, :16].tobytes()).hexdigest()
    assert got[("a.png", 0)] == got[("a.png", 1)] == same and set(got) == {("a.png", 0), ("a.png", 1), ("a.png", 5)}
    assert images.frame_hashes(f, s, most_sprites=5).count() == 0
    assert {(r.path, r.error) for r in images.skipped_sheets(f, s, most_sprites=5).collect()} == {("a.png", "too many frames"), ("b.png", "too many frames")}
    assert [(r.path, r.error) for r in images.skipped_sheets(f, s, most_pixels=100).collect()] == [("a.png", "too many pixels")] and images.skipped_sheets(f, s).count() == 0


def test_pixel_columns_of_a_file(spark):
    px = np.random.default_rng(2).integers(0, 256, (8, 9, 4)).astype(np.uint8)
    data = png(px, [(b"sRGB", b"\0"), (b"iCCP", b"mine\0\0zz")])
    r = images.image_features(spark.createDataFrame([("a.png", data)], "path string, content binary")).first()
    assert r.content_hash == hashlib.sha256(data).hexdigest() and r.pixel_hash == hashlib.sha256(px.tobytes()).hexdigest()
    assert (r.icc_bytes, r.icc_srgb, r.icc_label) == (20, True, "mine") and r.strippable_bytes == 20


def profile(tag):
    return bytes(128) + struct.pack(">I", 1) + b"desc" + struct.pack(">II", 144, len(tag)) + tag


def test_colour_profiles():
    old = profile(b"desc" + bytes(4) + struct.pack(">I", 5) + b"sRGB\0")
    text = "Display P3".encode("utf-16-be")
    new = profile(b"mluc" + bytes(4) + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", len(text), 28) + text)
    assert images.icc_description(old) == "sRGB" and images.icc_description(new) == "Display P3"
    assert [images.icc_description(old[:n]) for n in (0, 131, 150, len(old) - 1)] == [None] * 4
    assert images.icc_description(profile(b"what" + bytes(40))) is None
    px = np.zeros((1, 1, 4), np.uint8)
    unproven = png(px, [(b"iCCP", b"other\0\0"), (b"tIME", b"1234567")])
    assert images.icc_info(unproven) == (19, False, "other") and images.strippable_bytes(unproven) == 19
    assert images.icc_info(png(px, [(b"sRGB", b"\0")])) is None
    jpeg = b"\xff\xd8" + b"\xff\xe2" + struct.pack(">H", 16 + len(old)) + b"ICC_PROFILE\0\1\1" + old + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 1, 1) + bytes(10) + b"\xff\xda"
    assert images.icc_info(jpeg) == (18 + len(old), True, "sRGB")
    body = b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"ICCP" + struct.pack("<I", len(new)) + new + bytes(len(new) & 1)
    webp = b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    assert images.icc_info(webp) == (len(new) + 8, False, "Display P3") and images.strippable_bytes(webp) == 0


def test_folders(spark):
    p = [("g", "a/b/c/1.png"), ("g", "a/b/d/2.png"), ("one", "x/y/1.png"), ("root", "1.png"), ("root", "a/2.png"), ("part", "ab/1.png"), ("part", "a/1.png")]
    df = spark.createDataFrame(p, "group string, path string")
    assert {r.group: r.folder for r in files.common_folders(df).collect()} == {"g": "a/b", "one": "x/y", "root": "", "part": ""}
    labels = spark.createDataFrame([*p, ("lead", "/a/x.png"), ("lead", "/a/y.png")], "group string, path string")
    assert {r.group: r.label for r in files.folder_label(labels, "group").collect()} == {"g": "a", "one": "x", "root": None, "part": None, "lead": None}
    r = {x.path: (x.kept, x.collides) for x in files.regions(spark.createDataFrame([("g", "n", "b"), ("g", "n", "a"), ("g", "n", "a"), ("g", "m", "c")], "group string, name string, path string")).collect()}
    assert r == {"a": (True, True), "b": (False, True), "c": (True, False)}
    path = lambda *v: spark.createDataFrame([(x,) for x in v], "path string")
    pairs = files.skeleton_pairs(path("h/h.atlas", "k/k.atlas", "n/n.atlas"), path("h/h.json", "k/k.json"), path("k/k.skel")).collect()
    assert [tuple(x) for x in pairs] == [("h/h.atlas", "h/h.json")]


def test_path_functions(spark):
    row = spark.range(1).select(
        *[S.convention_root(F.lit(d), ["animations", "spine"]) for d in ("a/animations/x/y", "spine/a/spine/b", "a/spine", "")],
        *[S.renamed_to(F.lit(p), F.lit(m)) for p, m in (("a.b/c.png", "image/avif"), ("a.b/c", "image/avif"), ("c.PNG", "other"))],
        *[S.pack_bucket(F.lit(p), g) for p, g in (("x.png", "per-top-level-bundle"), ("a/b/x.png", "per-top-level-bundle"), ("a/b/x.png", "per-leaf-folder"), ("a/x.png", "one-sheet-for-all"))],
        *[S.dominates(F.lit(o), F.lit(b), F.lit(m)) for o, b, m in (("a", "a", None), ("a", "b", "eager"), ("a", "b", "lazy"), ("a", "b", None))], S.key_of(F.lit(None).cast("string"), F.lit("./n.png")),
    ).first()
    assert list(row) == ["a/animations/x", "spine/a/spine/b", None, None, "a.b/c.avif", "a.b/c", "c.webp", "", "a", "a/b", "", True, True, False, False, "n.png"]


def test_verdicts_at_their_edges(spark):
    m = "loaded long, measured_vram long, measured_draws long, draw_floor long, disk long"
    v = lambda row, **b: {(r.metric, r.basis): (r.state, r.fill, r.clamp_pct) for r in B.budget_verdicts(spark.createDataFrame([row], m), **b).collect()}
    assert v((100, None, None, 10, 5)) == {}
    assert v((100, None, None, 10, 5), vram=100, draws=10, disk=4) == {("vram", "declared"): ("withinDeclared", "ok", 100), ("draw", "floor"): ("floorUnknown", "neutral", 100), ("disk", "measured"): ("over", "crit", 100)}
    assert v((100, 101, 11, 10, 5), vram=100, draws=10) == {("vram", "declared"): ("withinDeclared", "ok", 100), ("vram", "measured"): ("over", "crit", 100), ("draw", "measured"): ("over", "crit", 100)}
    assert v((1, None, None, 11, 5), draws=10)[("draw", "floor")] == ("floorOver", "crit", 100)


def test_tiers():
    assert [is_safe_suffix(s) for s in ("_720p", "-@2x", "_hd", "_mobile", "_png", "__a", "_a.b", "_", "mobile", "_" + "a" * 25)] == [True] * 4 + [False] * 6
    assert validate_tiers([(0.5, "_540p"), (1, "_1080p"), (0.5, "_lq")]) == [(1, "_1080p"), (0.5, "_540p"), (0.5, "_lq")]
    for bad in ([], [(0.5, "_a")], [(1, "_a"), (2, "_b")], [(1, "_a"), (0, "_b")], [(1, "_a"), (math.nan, "_b")], [(1, "_a"), (0.5, "_A")], [(1, "_webp")]):
        with pytest.raises(ValueError):
            validate_tiers(bad)


def test_pictures_are_dealt_to_all_tasks(spark):
    from glyphmill.plans.pictures import drawn

    one = spark.createDataFrame([(f"p{i}.png", 20, 16, 1, 2, 3, 0, 255, i % 9, 2, 4, 3) for i in range(60)], "path string, w int, h int, red int, green int, blue int, ground int, alpha int, from_x int, from_y int, box_w int, box_h int").coalesce(1)
    parts = drawn(one).select("path", F.spark_partition_id().alias("p")).collect()
    assert len(parts) == 60 and len({r.p for r in parts}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_visible_box():
    a = np.zeros((5, 7), np.uint8)
    assert images.visible_box(a) is None
    a[1, 2] = a[3, 4] = 1
    assert images.visible_box(a) == (2, 1, 5, 4)
