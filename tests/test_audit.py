"""The whole chain over a folder of files."""

import json

import numpy as np
import pytest

from glyphmill.plans import audit as AU
from glyphmill.plans.pictures import png_bytes


def frame(name, x, y, w, h):
    return {"filename": name, "frame": {"x": x, "y": y, "w": w, "h": h}, "rotated": False, "trimmed": False, "sourceSize": {"w": w, "h": h}}


def sheet(image, size, *frames):
    return json.dumps({"frames": list(frames), "meta": {"app": "texturepacker", "image": image, "size": {"w": size, "h": size}}})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("game")
    r = np.random.default_rng(3)
    page = np.zeros((1024, 1024, 4), np.uint8)
    art = r.integers(0, 256, (64, 64, 4)).astype(np.uint8)
    art[..., 3] = 255
    page[:64, :64] = page[:64, 64:128] = page[200:264, :64] = page[400:464, 400:464] = art
    solid = np.full((300, 300, 4), 90, np.uint8)
    solid[..., 3] = 255
    for name in ("ui", "loose"):
        (root / name).mkdir()
    (root / "ui" / "a.png").write_bytes(png_bytes(page))
    (root / "ui" / "a.json").write_text(sheet("a.png", 1024, frame("one", 0, 0, 64, 64), frame("two", 64, 0, 64, 64), frame("three", 0, 200, 64, 64), frame("four", 400, 400, 64, 64), frame("off", 1000, 0, 99, 9)))
    (root / "ui" / "again.json").write_text(sheet("a.png", 1024, frame("one", 9, 9, 9, 9), frame("five", 500, 500, 32, 32)))
    (root / "ui" / "lost.json").write_text(sheet("nowhere.png", 64, frame("x", 0, 0, 9, 9)))
    (root / "ui" / "broken.json").write_text('{"frames": [], "meta": 5}')
    (root / "ui" / "note.json").write_text('{"title": "no manifest"}')
    (root / "loose" / "solid.png").write_bytes(png_bytes(solid))
    (root / "loose" / "copy.png").write_bytes(png_bytes(solid))
    (root / "loose" / "art.png").write_bytes(png_bytes(art))
    (root / "loose" / "odd.png").write_bytes(b"not a picture")
    return str(root)


def test_a_folder_from_scan_to_findings(spark, folder):
    found, totals, i = AU.audit_folder(spark, folder)
    rows = {(r.rule, r.ref): r for r in found.collect()}
    assert {r.asset_ref for r in i.atlases.collect()} == {"ui/a.png"} and i.sprites.count() == 5
    assert {(r.path, r.name) for r in i.unparsed.collect()} == {("ui/a.json", "off"), ("ui/broken.json", None), ("loose/odd.png", None)}
    occ = rows["occupancy", "ui/a.png"]
    assert (occ.severity, occ.title) == ("crit", "Sheet is 1.7% full") and float(occ.params["occ"]) == (4 * 64 * 64 + 32 * 32) / 1024**2
    assert rows["frame-redundancy", "ui/a.png"].vram_saved == 3 * 64 * 64 * 4
    assert rows["missing-image", "ui/lost.json"].title == "nowhere.png is missing" and rows["missing-image", "ui/lost.json"].severity == "crit"
    assert rows["duplicate-exact", "loose/copy.png"].title == "2 files of one content"
    assert {ref for rule, ref in rows if rule == "solid-fill"} == {"loose/solid.png", "loose/copy.png"}
    assert rows["loose-in-atlas", "loose/art.png"].params["atlas_ref"] == "ui/a.png"
    assert ("format", "ui/a.png") not in rows  # no trial encodings, so nothing is said of formats
    assert {"wasted-regions", "variants"} & {rule for rule, _ in rows} >= {"wasted-regions"}
    t = totals.first()
    assert (t.textures, t.vram) == (4, 4 * (1024 * 1024 + 2 * 300 * 300 + 64 * 64))
    assert all(r.title and r.id for r in rows.values())


def test_order_of_files_does_not_matter(spark, folder):
    from glyphmill.sources import files as FS

    f = FS.scan_folder(spark, folder).select("path", "content")
    a, _, _ = AU.audit(f.orderBy("path"))
    b, _, _ = AU.audit(f.orderBy(f.path.desc()).repartition(5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
