"""Graphics calls: counters and texture memory in batch, by a plain loop, and as a stream over shuffled micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import gl_calls as GL
from glyphmill.streaming.gl_sessions import gl_sessions

CALL = "session long, seq long, call string, target string, object string, level long, w long, h long, bytes long, value long"
CALLS = ["bindTexture"] * 5 + ["createTexture"] * 3 + ["texImage2D", "compressedTexImage2D"] * 3 + ["deleteTexture", "generateMipmap", "useProgram", "useProgram", "drawElements", "drawArrays", "compileShader", "linkProgram", "frame", "texSubImage2D", "compressedTexSubImage2D", "blendFunc", "pixelStorei"]


def made(session, n, seed):
    r = random.Random(seed)
    return [(session, i + 1, r.choice(CALLS), r.choice(["a", "b"]), r.choice([None, "x", "y", "z"]), r.choice([0, 0, 1, 2]), r.randint(0, 9), r.randint(0, 9), r.randint(0, 400), r.choice([1, 770, 37441, 0])) for i in range(n)]


def by_loop(rows):
    """Totals of one session: draws, binds, redundant, uploads, compiles, live, vram, compressed."""
    live, bound, last, program, n = {}, {}, None, "none yet", [0] * 5
    for _, _, call, target, obj, level, w, h, size, _ in rows:
        n[0] += call.startswith("draw")
        n[3] += call in GL.UPLOADS
        n[4] += call == "compileShader"
        if call == "bindTexture":
            n[1] += 1
            n[2] += bound.get(target, "none yet") == obj
            bound[target] = last = obj
        elif call == "useProgram":
            n[2] += program == obj
            program = obj
        elif call == "createTexture":
            if obj is not None:
                live[obj] = {"w": 0, "h": 0, "mip": False, "levels": {}}
        elif call == "deleteTexture":
            live.pop(obj, None)
        elif last in live:
            t = live[last]
            if call == "generateMipmap":
                t["mip"] = True
            if call == "compressedTexImage2D":
                t["levels"] = {} if level == 0 else t["levels"]
                t["levels"][level] = size
            if call in ("texImage2D", "compressedTexImage2D") and level == 0 and w > 0 and h > 0:
                t["w"], t["h"] = w, h
    each = [sum(t["levels"].values()) or t["w"] * t["h"] * 4 * (4 / 3 if t["mip"] else 1) for t in live.values()]
    return [*n, len(live), int(sum(each) + 0.5), sum(sum(t["levels"].values()) for t in live.values())]


@pytest.fixture(scope="module")
def sessions():
    return {s: made(s, 40 + 60 * s, s) for s in range(6)}


def test_batch_equals_a_plain_loop(spark, sessions):
    df = spark.createDataFrame([r for rows in sessions.values() for r in rows], CALL).repartition(5)
    got = {r.session: [r.draw_elements + r.draw_arrays, r.texture_binds, r.redundant_texture_binds + r.redundant_program_binds, r.uploads, r.compiles, r.live_textures, r.vram, r.compressed] for r in GL.session_counters(df).collect()}
    assert got == {s: by_loop(rows) for s, rows in sessions.items()}


def test_levels_replace_one_another_and_a_base_level_begins_anew(spark):
    rows = [("createTexture", "x", 0, 0, 0, 0), ("bindTexture", "x", 0, 0, 0, 0), ("compressedTexImage2D", None, 0, 8, 8, 64), ("compressedTexImage2D", None, 1, 4, 4, 16), ("compressedTexImage2D", None, 1, 4, 4, 20), ("compressedTexSubImage2D", None, 1, 4, 4, 99)]
    spell = lambda rows: spark.createDataFrame([(1, i + 1, c, "a", o, lv, w, h, b, 0) for i, (c, o, lv, w, h, b) in enumerate(rows)], CALL)
    assert GL.textures(spell(rows)).first()[:] == (1, "x", 8, 8, False, 84)
    assert GL.textures(spell([*rows, ("compressedTexImage2D", None, 0, 4, 4, 30)])).first()[:] == (1, "x", 4, 4, False, 30)
    raster = [*rows[:2], ("texImage2D", None, 0, 6, 5, 0), ("texImage2D", None, 1, 99, 99, 0), ("generateMipmap", None, 0, 0, 0, 0)]
    assert GL.live_textures(spell(raster)).first()[:] == (1, 1, 160, 0)
    assert GL.textures(spell([*raster, ("deleteTexture", "x", 0, 0, 0, 0)])).count() == 0
    assert GL.textures(spell([*raster, ("createTexture", "x", 0, 0, 0, 0)])).first()[:] == (1, "x", 0, 0, False, 0)


def test_stream_over_shuffled_micro_batches(spark, sessions, tmp_path):
    rows = [r for s in sessions.values() for r in s]
    order = sorted(rows, key=lambda r: (r[1] + random.Random(repr(r)).randint(0, 60)))  # calls arrive up to 60 places late
    parts = [order[i :: 1][k * len(order) // 4 : (k + 1) * len(order) // 4] for i in (0,) for k in range(4)]
    for k, part in enumerate(parts):
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, CALL).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        calls = spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        q = gl_sessions(calls, idle_ms=20000).writeStream.format("memory").queryName("gl_frames").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        try:  # timers keep batches coming, so the stream is never at an end
            for _ in range(50):
                if q.awaitTermination(1) or spark.table("gl_frames").filter("final").count() >= len(sessions):
                    break
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("gl_frames")
    totals = {r.session: [r.draws, r.binds, r.redundant, r.uploads, r.compiles, r.live_textures, r.vram, r.compressed] for r in got.filter("final").collect()}
    assert totals == {s: by_loop(rows) for s, rows in sessions.items()}
    names = ["session", "seq", "draws", "binds", "redundant", "uploads", "compiles"]
    frames = GL.frame_counters(spark.createDataFrame(rows, CALL))
    assert sorted(map(tuple, got.filter("not final").select(names).collect())) == sorted(map(tuple, frames.select(names).collect())) and frames.count() > 20
    spark.sql("drop view if exists gl_frames")


def test_frames_feed_reports(spark, sessions):
    from glyphmill.operators import runtime as T

    df = spark.createDataFrame([r for rows in sessions.values() for r in rows], CALL)
    frames = GL.frame_counters(df).withColumn("dt", F.lit(16.0))
    assert {r.session for r in T.runtime_reports(frames, GL.live_textures(df), warm_up=2).collect()} == {r[0] for r in frames.select("session").distinct().collect()}
