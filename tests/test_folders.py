"""Skeletons, history, configuration and grouping of folders; clear areas of images."""

import json

import numpy as np
import pytest

from glyphmill.operators import history as H
from glyphmill.sources import files
from glyphmill.sources import images
from glyphmill.sources import skeletons as SK

MODERN = {
    "skins": [
        {"name": "default", "attachments": {"head": {"head": {"type": "region"}}, "weapon": {"sword": {"path": "items/sword"}}, "a": {"shield": {}}, "b": {"shield": {}}, "cape": {"cape": {"type": "mesh"}}, "link": {"capeLink": {"type": "linkedmesh", "parent": "cape"}}, "mask": {"mask": {"type": "clipping"}}}},
        {"name": "gold", "attachments": {"cape": {"cape": {"type": "mesh", "path": "gold/cape"}}, "l": {"own": {"type": "linkedmesh", "parent": "cape"}, "other": {"type": "linkedmesh", "parent": "cape", "skin": "default"}, "unknown": {"type": "linkedmesh", "parent": "cape", "skin": "none"}, "lost": {"type": "linkedmesh", "parent": "nobody"}, "odd": 5}}},
    ]
}
LEGACY = {"skins": {"default": {"body": {"torso": {"type": "region"}}, "gear": {"axe": {"path": "items/axe"}}, "p": {"aim": {"type": "point"}, "box": {"type": "boundingbox"}, "way": {"type": "path"}}}}}


def test_skeletons(spark):
    texts = [("m", json.dumps(MODERN)), ("l", json.dumps(LEGACY)), ("n", None), ("x", "no json"), ("s", '{"skins": 42}'), ("o", '{"bones": []}'), ("e", '{"skins": []}'), ("w", '{"skins": [{"name": "only"}]}')]
    parts = SK.attachments(spark.createDataFrame(texts, "path string, text string"))
    need = {(r.path, r.slot, r.attachment): r.region for r in SK.required_regions(parts).collect()}
    assert need == {
        ("m", "head", "head"): "head", ("m", "weapon", "sword"): "items/sword", ("m", "a", "shield"): "shield", ("m", "b", "shield"): "shield", ("m", "cape", "cape"): "gold/cape", ("m", "link", "capeLink"): "cape", ("m", "l", "own"): "gold/cape",
        ("m", "l", "other"): "cape", ("m", "l", "unknown"): "gold/cape", ("m", "l", "odd"): "odd", ("l", "body", "torso"): "torso", ("l", "gear", "axe"): "items/axe",
    } | {}
    have = spark.createDataFrame([("m", n) for n in ("head", "shield", "cape", "gold/cape", "odd")] + [("l", "torso"), ("l", "items/axe"), ("x", "torso")], "path string, name string")
    totals, gone = SK.verify_skeletons(parts, have)
    assert {r.path: (r.verified, r.unmatched, r.unverified) for r in totals.collect()} == {"m": (10, 1, False), "l": (2, 0, False), "n": (0, 0, True), "x": (0, 0, True), "s": (0, 0, True), "o": (0, 0, True), "w": (0, 0, False)} | {}
    assert [r.region for r in gone.collect()] == ["items/sword"]


def test_a_skeleton_is_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    files = spark.createDataFrame([(str(i), json.dumps(MODERN)) for i in range(20)], "path string, text string").mapInPandas(seen, "path string, text string")
    totals, gone = SK.verify_skeletons(SK.attachments(files), spark.createDataFrame([("1", "head")], "path string, name string"))
    assert totals.filter("verified = 1").count() == 1 and gone.count() == 219 and read.value == 20
    assert SK.required_regions(SK.attachments(files)).count() == 220 and read.value == 40


def test_history(spark, tmp_path):
    rows = [("a", 10, "disk", 5.0), ("a", 10, "vram", 0.0), ("a", 20, "disk", 7.0), ("a", 20, "vram", 3.0), ("b", 15, "disk", 1.0), ("a", 30, "disk", 7.0), ("a", 30, "new", 1.0)]
    m = spark.createDataFrame(rows, "label string, at_ms long, metric string, value double")
    found = spark.createDataFrame([("b", 15, "f1", "r", "x", "crit", "t" * 3_000_000)], "label string, at_ms long, id string, rule string, ref string, severity string, title string")
    H.keep(H.snapshots(m, found), str(tmp_path / "h"))
    H.keep(H.snapshots(m.filter("at_ms = 10")), str(tmp_path / "h"))  # once more
    past = H.kept(spark, str(tmp_path / "h"))
    assert {(r.label, r.at_ms) for r in past.collect()} == {("a", 10), ("a", 20), ("a", 30)}  # too large a snapshot isn't kept
    got = H.previous(H.snapshots(m), past)
    assert {(r.label, r.at_ms): r.before_at for r in got.collect()} == {("a", 10): None, ("a", 20): 10, ("a", 30): 20, ("b", 15): None}
    assert {(r.at_ms, r.metric): (r.before, r.after, r.delta, r.pct) for r in H.changes(got).collect()} == {(20, "disk"): (5, 7, 2, 40), (20, "vram"): (0, 3, 3, None)}
    past.withColumn("v", past.v + 1).write.mode("append").parquet(str(tmp_path / "other" / "day=2024-01-01"))
    assert H.kept(spark, str(tmp_path / "other")).count() == 0


def test_configuration_of_the_nearest_folder(spark):
    c = [("budget.json", "file"), ("a/package.json", "package"), ("a/b/c/budget.json", "file"), ("a/b/c/package.json", "package"), ("ab/budget.json", "file")]
    f = ["", "a", "a/b", "a/b/c", "a/b/c/d", "ab", "abc", "x/y"]
    got = files.discover_configs(spark.createDataFrame([(x,) for x in f], "folder string"), spark.createDataFrame(c, "path string, kind string"))
    top, deep = ("budget.json", "file"), ("a/b/c/budget.json", "file")
    assert {r.folder: (r.path, r.kind) for r in got.collect()} == {"": top, "a": ("a/package.json", "package"), "a/b": ("a/package.json", "package"), "a/b/c": deep, "a/b/c/d": deep, "ab": ("ab/budget.json", "file"), "abc": top, "x/y": top}
    none = files.discover_configs(spark.createDataFrame([("q",)], "folder string"), spark.createDataFrame([("a/budget.json", "file")], "path string, kind string")).first()
    assert none.folder == "q" and none.path is None


def test_groups_join_by_folder(spark):
    i = [("sk/a.png", 900, 9), ("sk/deep/b.png", 9, 9), ("skin/c.png", 9, 9), ("skin/d.png", 9, 9), ("skin/e.png", 900, 9), ("f.png", 9, 9)]
    r = spark.createDataFrame([("sk",), ("sk/deep",), ("sk",)], "root string")
    df = spark.createDataFrame(i, "path string, w int, h int")
    got = {(x.group, x.path) for x in files.pack_groups(df, r).collect()}
    assert got == {("skeleton:sk", "sk/a.png"), ("skeleton:sk/deep", "sk/deep/b.png"), ("folder:skin", "skin/c.png"), ("folder:skin", "skin/d.png")}
    assert {x.group for x in files.pack_groups(df, spark.createDataFrame([("",)], "root string")).collect()} == {"skeleton:"}
    assert {x.group for x in files.pack_groups(df, r.limit(0), granularity="one-sheet-for-all").collect()} == {"folder:"}


def plain_holes(alpha):
    h, w = alpha.shape
    ys, xs = np.nonzero(alpha)
    cell = max(8, int(max(w, h) / 64 + 0.5))
    free = set()
    for r, y0 in enumerate(range(0, h, cell)):
        for c, x0 in enumerate(range(0, w, cell)):
            y1, x1 = min(y0 + cell, h), min(x0 + cell, w)
            if ys.min() <= y0 and y1 - 1 <= ys.max() and xs.min() <= x0 and x1 - 1 <= xs.max() and not alpha[y0:y1, x0:x1].any():
                free.add((r, c))
    return free, cell


@pytest.mark.parametrize("seed", range(8))
def test_holes_cover_the_clear_cells(seed):
    r = np.random.default_rng(seed)
    alpha = np.full((r.integers(30, 140), r.integers(30, 140)), 255, np.uint8)
    for _ in range(r.integers(1, 9)):
        y, x = r.integers(0, alpha.shape[0]), r.integers(0, alpha.shape[1])
        alpha[y : y + r.integers(5, 60), x : x + r.integers(5, 60)] = 0
    got = images.hole_rects(alpha) or []
    free, cell = plain_holes(alpha)
    cells = [(y // cell, x // cell) for x0, y0, w, h in got for y in range(y0, y0 + h, cell) for x in range(x0, x0 + w, cell)]
    assert len(cells) == len(set(cells)) and set(cells) == free
    assert all(not alpha[y : y + h, x : x + w].any() for x, y, w, h in got)


def test_too_many_holes_are_no_map():
    alpha = np.full((320, 320), 255, np.uint8)
    for k in range(0, 38 * 38):
        y, x = k // 38, k % 38
        if (x + y) % 2:
            alpha[8 + y * 8 : 16 + y * 8, 8 + x * 8 : 16 + x * 8] = 0
    assert images.hole_rects(alpha) is None and images.hole_rects(np.zeros((9, 9), np.uint8)) is None and images.hole_rects(np.full((9, 9), 255, np.uint8)) is None
