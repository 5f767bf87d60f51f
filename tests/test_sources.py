import json
import struct
import zlib

import numpy as np

from glyphmill.sources import files, images, manifests
from glyphmill.streaming import frames


def png(px, chunks=()):
    h, w, n = px.shape
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + b"".join(part(k, b) for k, b in chunks) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def sheet(frames_, app="https://texturepacker", **meta):
    return json.dumps({"frames": frames_, "meta": {"app": app, "image": "s.png", "size": {"w": 128, "h": 64}, **meta}})


def frame(x, y, w, h, **more):
    return {"frame": {"x": x, "y": y, "w": w, "h": h}, **more}


def test_sheets(spark):
    texts = [
        ("a.json", sheet({"one": frame(0, 0, 10, 20), "two": frame(0, 0, 30, 40, rotated=True, trimmed=True, sourceSize={"w": 50, "h": 60}), "bad": frame(0, 0, 0, 5), "off": frame(120, 0, 20, 5)})),
        ("b.json", sheet([{"filename": "x", **frame(1, 2, 3, 4)}, {"filename": "x", **frame(5, 5, 5, 5)}])), ("c.json", "{"), ("d.json", sheet({"bad": frame(-1, 0, 5, 5)})), ("e.json", sheet({"p": frame(0, 0, 1, 1)}, app="other")),
    ]
    rows = manifests.sheets(spark.createDataFrame(texts, "path string, text string")).collect()
    by = lambda p: [r for r in rows if r.asset_ref == p]
    a = {r.name: r for r in by("a.json")}
    assert (a["two"].w, a["two"].h, a["two"].src_w, a["two"].rotated) == (40, 30, 50, True) and a["one"].kind == "texturepacker-hash"
    assert a["bad"].error == 'invalid frame "bad"' and a["off"].error and a["one"].error is None
    assert [(r.x, r.kind) for r in by("b.json")] == [(1, "texturepacker-array")]
    assert by("c.json")[0].error and by("d.json")[0].error == "no valid frame" and by("e.json")[0].kind == "pixi"


def test_atlas_texts(spark):
    text = "page.png\nsize: 256,128\nfilter: Linear,Linear\nhead\n  rotate: true\n  xy: 2, 4\n  size: 30, 40\n  orig: 32, 44\n  offset: 1, 2\n  index: -1\ntail\n  bounds: 50, 60, 7, 8\n  offsets: 0, 0, 7, 8\n\nother.png\nsize: 64,64\nfoot\n  rotate: false\n  xy: 0, 0\n  size: 5, 5\n"
    rows = {r.name: r for r in manifests.atlas_texts(spark.createDataFrame([("a.atlas", text)], "path string, text string")).collect()}
    assert (rows["head"].w, rows["head"].h, rows["head"].src_w, rows["head"].trimmed, rows["head"].page_w) == (40, 30, 32, True, 256)
    assert (rows["tail"].x, rows["tail"].w, rows["tail"].trimmed) == (50, 7, False) and rows["foot"].page == "other.png"


def test_fonts_in_three_encodings(spark):
    text = 'info face="A"\ncommon lineHeight=10 base=8 scaleW=64 scaleH=32 pages=1\npage id=0 file="f.png"\nchars count=3\nchar id=65 x=1 y=2 width=3 height=4 xoffset=0 yoffset=0 xadvance=3 page=0 chnl=15\nchar id=32 x=0 y=0 width=0 height=0 page=0\nchar id=66 x=63 y=0 width=9 height=4 page=0\n'
    xml = '<?xml version="1.0"?><font><common scaleW="64" scaleH="32"/><pages><page id="0" file="f.png"/></pages><chars><char id="65" x="1" y="2" width="3" height="4" page="0"/><char id="66" x="63" y="0" width="9" height="4" page="0"/></chars></font>'
    block = lambda k, b: bytes([k]) + struct.pack("<I", len(b)) + b
    char = lambda *v: struct.pack("<IHHHHhhhBB", *v)
    binary = b"BMF\x03" + block(2, struct.pack("<HHHHHBBBBB", 10, 8, 64, 32, 1, 0, 0, 0, 0, 0)) + block(3, b"f.png\0") + block(4, char(65, 1, 2, 3, 4, 0, 0, 3, 0, 15) + char(66, 63, 0, 9, 4, 0, 0, 9, 0, 15))
    df = spark.createDataFrame([("t", text.encode()), ("x", xml.encode()), ("b", binary)], "path string, content binary")
    for p in "txb":
        rows = {r.name: r for r in manifests.fonts(df.filter(f"path = '{p}'")).collect()}
        assert (rows["65"].x, rows["65"].w, rows["65"].page, rows["65"].error) == (1, 3, "f.png", None) and rows["66"].error == "invalid glyph 66" and "32" not in rows


def test_skeletons():
    new = json.dumps({"skeleton": {}, "bones": [], "slots": [], "skins": [{"name": "d", "attachments": {"s": {"k": {}, "m": {"name": "n"}, "q": {"path": "p", "sequence": {"count": 3}}, "box": {"type": "boundingbox"}}}}]})
    assert manifests.skeleton_refs(new) == [("name", "k"), ("name", "n"), ("prefix", "p")]
    assert manifests.skeleton_refs(json.dumps({"skins": {"d": {"s": {"k": {}}}}})) == [("name", "k")] and manifests.skeleton_refs("[]") is None


def test_image_headers_and_metadata():
    px = np.zeros((4, 6, 4), np.uint8)
    data = png(px, [(b"tEXt", b"x" * 89), (b"tIME", b"1234567")])
    assert images.image_info(data) == ("image/png", 6, 4) and images.strippable_bytes(data) == 101 + 19
    assert images.strip_png(data) == png(px) and images.image_info(b"nothing") is None
    jpeg = b"\xff\xd8\xff\xe1\x00\x08Exif\0\0\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x00\x00\x00"
    assert images.image_info(jpeg) == ("image/jpeg", 32, 16) and images.strippable_bytes(jpeg) == 10
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert images.image_info(webp) == ("image/webp", 100, 50)


def test_pixel_features(spark):
    solid = np.full((32, 32, 4), 200, np.uint8)
    solid[..., 3] = 255
    noise = np.random.default_rng(0).integers(0, 256, (40, 48, 4), np.uint8)
    grown = np.repeat(np.repeat(noise[:10, :12], 4, 0), 4, 1)
    cut = np.zeros((30, 30, 4), np.uint8)
    cut[5:15, 10:25] = 255
    df = spark.createDataFrame([("solid", png(solid)), ("noise", png(noise[..., :3])), ("grown", png(grown)), ("cut", png(cut)), ("text", b"x")], "path string, content binary")
    got = {r.path: r for r in images.image_features(df).collect()}
    assert got["solid"].solid and got["solid"].opaque and got["solid"].d_hash is None and got["solid"].mean_r == 200
    assert not got["noise"].solid and got["noise"].upscale_depth == 0 and len(got["noise"].d_hash) == 16
    assert got["grown"].upscale_depth == 2 and (got["cut"].bbox_w, got["cut"].bbox_h, got["cut"].binary_alpha, got["cut"].content_class) == (15, 10, True, "alpha-art")
    assert got["text"].mime is None and got["text"].solid is None


def test_folder(spark, tmp_path):
    (tmp_path / "ui").mkdir()
    (tmp_path / "ui" / "a.json").write_text(sheet({"p": frame(0, 0, 1, 1)}))
    (tmp_path / "ui" / "s.png").write_bytes(png(np.zeros((2, 2, 4), np.uint8)))
    (tmp_path / "notes.txt").write_text("no")
    assert sorted(r.path for r in files.scan_folder(spark, str(tmp_path)).collect()) == ["ui/a.json", "ui/s.png"]
    m = spark.createDataFrame([("ui/a.json", "s.png"), ("ui/b.json", "gone.png"), ("root.json", "s.png")], "path string, image string")
    i = spark.createDataFrame([("ui/s.png", 2, 2), ("ui/l.png", 9, 9), ("sk/x/y.png", 900, 9), ("sk/z.png", 9, 9)], "path string, w int, h int")
    got = files.resolve_images(m, i)
    assert {r.path: r.image_ref for r in got.collect()} == {"ui/a.json": "ui/s.png", "ui/b.json": None, "root.json": "ui/s.png"}
    assert files.missing(got).count() == 1 and files.loose(i, got).count() == 3
    groups = files.pack_groups(files.loose(i, got), spark.createDataFrame([("sk",)], "root string")).collect()
    assert {(r.group, r.path) for r in groups} == {("skeleton:sk", "sk/x/y.png"), ("skeleton:sk", "sk/z.png")}


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(s, i, float(10 + i % 9), 2, 0, 1, 0, 0) for s in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "session long, seq long, dt double, draws long, binds long, redundant long, uploads long, compiles long").withColumn("ts", F.timestamp_seconds(F.col("seq") * 2))
    for k in range(2):
        df.filter(f"seq div 50 = {k}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out, mode in (("counters", frames.session_counters(stream), "update"), ("minutes", frames.minute_activity(stream), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    last = spark.sql("select session, max(frames) f, max(play) p, max(draws) d, max(longest) l from counters group by session").collect()
    assert {tuple(r) for r in last} == {(1, 100, 70, 140, 18.0), (2, 100, 70, 140, 18.0)}
    assert spark.sql("select sum(frames) from minutes").first()[0] == 200
