"""Runtime captures: frame windows, session reports, and their correlation with static findings.

frames: session, seq, dt (ms), draws, binds, redundant, uploads, compiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_FRAMES = 1800
WARM_UP = 30


def redundant_binds(calls: DataFrame) -> DataFrame:
    """calls: session, target, seq, texture. Per session the binds and those of the texture that is bound already."""
    before = F.lag("texture").over(Window.partitionBy("session", "target").orderBy("seq"))
    c = calls.withColumn("same", F.col("texture").eqNullSafe(before) & F.col("texture").isNotNull())
    return c.groupBy("session").agg(F.count("*").alias("binds"), F.count_if("same").alias("redundant"))


def live_textures(events: DataFrame) -> DataFrame:
    """events: session, texture, seq, kind (create, delete), bytes, mipmapped. What lives at the end of each session; a last
    event decides, and mipmaps take a third more."""
    last = events.groupBy("session", "texture").agg(F.max_by(F.struct("kind", "bytes", "mipmapped"), "seq").alias("e"))
    size = F.when(F.col("e.mipmapped"), F.ceil(F.col("e.bytes") * 4 / 3.0)).otherwise(F.col("e.bytes"))
    return last.filter("e.kind = 'create'").groupBy("session").agg(F.count("*").alias("textures"), F.sum(size).cast("long").alias("vram"))


def window_frames(frames: DataFrame, window: int = WINDOW_FRAMES) -> DataFrame:
    """The last frames of each session, with nth counted from its start."""
    w = Window.partitionBy("session")
    f = frames.withColumns({"nth": F.row_number().over(w.orderBy("seq")), "back": F.row_number().over(w.orderBy(F.desc("seq")))})
    return f.filter(F.col("back") <= window).drop("back")


def _at(rank: str, n: str, index: Column) -> Column:
    return F.max(F.when(F.col(rank) - 1 == F.least(F.col(n) - 1, index), F.col("dt")))


def session_reports(frames: DataFrame, warm_up: int = WARM_UP, window: int = WINDOW_FRAMES) -> DataFrame:
    """Per session: frames and duration of the window; over play (after warm-up) draws, p95 and (upper) median of frame times."""
    f = window_frames(frames, window).withColumn("play", F.col("nth") > warm_up)
    all_ = f.groupBy("session").agg(F.count("*").alias("frames"), F.sum("dt").alias("duration"))
    play = f.filter("play")
    w = Window.partitionBy("session")
    p = play.withColumns({"rank": F.row_number().over(w.orderBy("dt", "seq")), "n": F.count("*").over(w)})
    p = p.groupBy("session").agg(
        F.count("*").alias("play_frames"), F.avg(F.when(F.col("draws") > 0, F.col("draws"))).alias("avg_draws"), F.max("draws").alias("max_draws"),
        _at("rank", "n", F.floor(F.col("n") * 95 / 100)).alias("p95"), _at("rank", "n", F.floor(F.col("n") / 2)).alias("median"), F.sum("redundant").alias("redundant"),
    )
    return all_.join(p, "session", "left")


def hitches(frames: DataFrame, most: int = 20, warm_up: int = WARM_UP, window: int = WINDOW_FRAMES) -> DataFrame:
    """Frames over twice the median (above 0) and 16 ms, with their cause, an upload before a compile; the first of each session."""
    f = window_frames(frames, window).filter(F.col("nth") > warm_up)
    slow = f.join(session_reports(frames, warm_up, window).select("session", "median"), "session").filter((F.col("median") > 0) & (F.col("dt") > 2 * F.col("median")) & (F.col("dt") > 16))
    cause = F.when(F.col("uploads") > 0, "texture upload").when(F.col("compiles") > 0, "shader compile").otherwise("cpu/gpu spike")
    w = Window.partitionBy("session").orderBy("seq")
    return slow.withColumns({"cause": cause, "place": F.row_number().over(w)}).filter(F.col("place") <= most).select("session", "seq", "dt", "cause", "place")


def batching(static: DataFrame, reports: DataFrame) -> DataFrame:
    """static: one row with atlases, loose (images that should be packed; 0: no such finding) and mergeable (whether sheets should be
    merged). Sessions of fragmented assets whose most draws of a frame are over 50, or 4 and over three times the ideal."""
    ideal = F.when(F.col("loose") > 0, F.col("atlases") + 1).otherwise(F.greatest(F.lit(2).cast("long"), F.ceil(F.col("atlases") / 2)))
    s = reports.crossJoin(F.broadcast(static)).withColumn("ideal", ideal)
    fragmented = (F.col("loose") > 0) | F.col("mergeable") | (F.col("atlases") >= 4)
    many = (F.col("max_draws") > 50) | ((F.col("max_draws") >= 4) & (F.col("max_draws") > 3 * F.col("ideal")))
    return s.filter(fragmented & many).select("session", "max_draws", "ideal")


def live_vram(totals: DataFrame, live: DataFrame) -> DataFrame:
    """Sessions that hold over one and a half times the textures the assets need."""
    return live.crossJoin(F.broadcast(totals.select("loaded"))).filter(F.col("vram") > 1.5 * F.col("loaded")).select("session", "vram", "loaded")


def hitch_costs(found: DataFrame) -> DataFrame:
    return found.groupBy("session", "cause").agg(F.count("*").alias("n"), F.sum("dt").alias("ms"))


def redundant_state(reports: DataFrame) -> DataFrame:
    """Redundant binds of play over all frames of the window, above 5."""
    per = F.try_divide(F.col("redundant"), F.col("frames"))
    return reports.filter(per > 5).select("session", per.alias("per_frame"))


def premultiplied_blend(halo: DataFrame, blends: DataFrame) -> DataFrame:
    """halo: n, the images with dark fringes, a row if there is such a finding. blends: session, premultiplied, straight, unpacked (seen in
    the capture). What the two say together; a session where nothing was seen has no row."""
    both = F.col("straight") & F.col("premultiplied")
    out = F.when(both, "inconclusive").when(F.col("straight"), "halo").when(F.col("premultiplied"), "safe").when(F.col("unpacked"), "inconclusive")
    return blends.crossJoin(F.broadcast(halo.select("n"))).select("session", "n", out.alias("result")).filter("result is not null")


def correlate_fix(pairs: DataFrame) -> DataFrame:
    """pairs: before, after. Sums where both are finite; how much is left, and its severity."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    s = pairs.filter(fine("before") & fine("after")).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    ratio = F.try_divide(F.col("after"), F.col("before"))
    return s.withColumn("ratio", ratio).withColumn("severity", F.when(F.col("ratio") <= 0.34, "crit").when(F.col("ratio") <= 0.67, "warn").otherwise("info"))


def round1(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / 10


def runtime_reports(frames: DataFrame, live: DataFrame | None = None, warm_up: int = WARM_UP, window: int = WINDOW_FRAMES) -> DataFrame:
    """The whole report of each session. frames as above; live: session, live_textures, vram, compressed (absent: nothing lives).

    Frames and duration count the whole window, all else play alone; averages of calls take frames that draw, times those above 0. Sessions without
    such frames have 0. compressed is null where it wasn't recorded.
    """
    f = window_frames(frames, window).withColumn("play", F.col("nth") > warm_up)
    play, timed, drawn = F.col("play"), F.col("play") & (F.col("dt") > 0), F.col("play") & (F.col("draws") > 0)
    ranked = f.withColumns({"timed": timed, "place": F.row_number().over(Window.partitionBy("session", timed).orderBy("dt", "seq")), "of": F.count("*").over(Window.partitionBy("session", timed))})
    at = lambda index: F.coalesce(F.max(F.when(F.col("timed") & (F.col("place") - 1 == F.least(F.col("of") - 1, index)), F.col("dt"))), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    total = lambda c: zero(F.sum(F.when(play, F.col(c)))).cast("long")
    r = ranked.groupBy("session").agg(
        F.count("*").alias("frames"), F.floor(F.sum("dt") + 0.5).alias("duration"), round1(mean("draws", drawn)).alias("draws_avg"), zero(F.max(F.when(play, F.col("draws")))).cast("long").alias("draws_max"),
        round1(mean("binds", drawn)).alias("binds_avg"), zero(F.max(F.when(play, F.col("binds")))).cast("long").alias("binds_max"), total("redundant").alias("redundant"), total("uploads").alias("uploads"), total("compiles").alias("compiles"),
        round1(F.coalesce(F.try_divide(F.lit(1000.0), F.nullif(mean("dt", timed), F.lit(0.0))), F.lit(0.0))).alias("fps"), round1(mean("dt", timed)).alias("frame_ms"), round1(at(F.floor(F.col("of") * 95 / 100))).alias("frame_ms_p95"),
        at(F.floor(F.col("of") / 2)).alias("median"),
    )
    slow = ranked.select("session", "play", "dt").join(r.select("session", "median"), "session").filter(play & (F.col("median") > 0) & (F.col("dt") > 2 * F.col("median")) & (F.col("dt") > 16))
    r = r.drop("median").join(slow.groupBy("session").agg(F.least(F.count("*"), F.lit(20)).alias("hitches")), "session", "left").withColumn("hitches", zero(F.col("hitches")).cast("long"))
    if live is None:
        return r.withColumns({"live_textures": F.lit(0).cast("long"), "vram": F.lit(0).cast("long"), "compressed": F.lit(0).cast("long")})
    return r.join(live.select("session", "live_textures", "vram", "compressed", F.lit(True).alias("seen")), "session", "left").withColumns({"live_textures": zero(F.col("live_textures")), "vram": zero(F.col("vram")), "compressed": F.when(F.col("seen"), F.col("compressed")).otherwise(F.lit(0))}).drop("seen")


#: Rows of a comparison: key, class, column of a report.
COMPARED = (
    ("drawCalls.avg", "per-frame", "draws_avg"), ("drawCalls.max", "per-frame", "draws_max"), ("textureBinds.avg", "per-frame", "binds_avg"), ("liveTextures", "state", "live_textures"), ("vramBytes", "state", "vram"), ("compressedBytes", "state", "compressed"),
    ("redundantBinds", "session-total", "redundant"), ("uploadsDuringGameplay", "session-total", "uploads"), ("shaderCompilesDuringGameplay", "session-total", "compiles"), ("timing.fps", "device", "fps"), ("timing.frameTimeMsAvg", "device", "frame_ms"),
    ("timing.frameTimeMsP95", "device", "frame_ms_p95"),
)


def compare_sessions(before: DataFrame, after: DataFrame, least: int = 120, skew: float = 0.3, same_device: bool = False) -> DataFrame:
    """Reports of two captures of a session side by side: session, verdict, skew, place, key, class, before, after, delta, pct, comparable.

    All rows are shown; comparable says whether their delta means anything: none if either capture is shorter than `least` frames, totals
    only if the durations differ by no more than skew of the longer, device rows only if the caller vouches for one device. compressedBytes
    needs a record on both sides. pct is null where before is 0.
    """
    j = before.select("session", *[F.col(c).alias(f"b_{c}") for c in before.columns if c != "session"]).join(after, "session")
    longest = F.greatest("duration", "b_duration")
    j = j.withColumn("skew", F.when(longest == 0, 0.0).otherwise(round1(F.abs(F.col("duration") - F.col("b_duration")) / longest * 100) / 100))
    short = (F.col("frames") < least) | (F.col("b_frames") < least)
    verdict = F.when(short, "too-short").when(F.col("skew") > skew, "duration-skewed").otherwise("comparable")
    fair = {"session-total": ~short & (F.col("skew") <= skew), "device": ~short & F.lit(same_device)}
    rows = [F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(kind).alias("class"), F.col(f"b_{c}").cast("double").alias("before"), F.col(c).cast("double").alias("after"), fair.get(kind, ~short).alias("comparable")) for i, (k, kind, c) in enumerate(COMPARED)]
    r = j.select("session", verdict.alias("verdict"), "skew", F.inline(F.array(*rows))).filter("before is not null and after is not null")
    change = F.col("after") - F.col("before")
    return r.select("session", "verdict", "skew", "place", "key", "class", "before", "after", round1(change).alias("delta"), round1(F.try_divide(change, F.col("before")) * 100).alias("pct"), "comparable")


def probe_canvas(sprites: DataFrame, most: int = 4096) -> DataFrame:
    """asset_ref, canvas_w, canvas_h: the box that holds all frames of a sheet, at least 1 and at most so large: what a trial rendering needs so that no frame is off it."""
    side = lambda at, size: F.greatest(F.lit(1), F.least(F.lit(most), F.max(F.col(at) + F.col(size)))).cast("long")
    return sprites.groupBy("asset_ref").agg(side("x", "w").alias("canvas_w"), side("y", "h").alias("canvas_h"))


def probe_readings(counters: DataFrame, sheets: DataFrame) -> DataFrame:
    """counters: as `gl_calls.session_counters` gives them. sheets: session, asset_ref, which sheet a session rendered. asset_ref, draw_calls, vram, live_textures, uploads, compiles."""
    c = counters.select("session", (F.col("draw_elements") + F.col("draw_arrays")).alias("draw_calls"), "vram", "live_textures", "uploads", "compiles")
    return sheets.join(c, "session").drop("session")


def attach_probe(metrics: DataFrame, readings: DataFrame) -> DataFrame:
    """metrics: asset_ref, vram (declared) and others. With the readings as probe_ columns, null where a sheet wasn't measured. What is declared and what is measured stand side by
    side; their difference is no saving."""
    names = [c for c in readings.columns if c != "asset_ref"]
    return metrics.join(readings.select("asset_ref", *[F.col(c).alias(f"probe_{c}") for c in names]), "asset_ref", "left")


def probe_totals(attached: DataFrame) -> DataFrame:
    """draw_calls, vram, sheets, declared_vram over the sheets that were measured, so that both sums are of the same ones; no row without any."""
    p = attached.filter("probe_vram is not null").agg(F.sum("probe_draw_calls").alias("draw_calls"), F.sum("probe_vram").alias("vram"), F.count("*").alias("sheets"), F.sum("vram").alias("declared_vram"))
    return p.filter("sheets > 0")
