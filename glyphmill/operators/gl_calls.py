"""Counters and texture memory of captured graphics calls.

calls: session, seq, call, target, object, level, w, h, bytes, value. seq counts a session's calls from 1. object is the texture or program
of a call (null: none, which binds nothing); value the source factor of blendFunc and blendFuncSeparate or the name of
pixelStorei, whose setting is in level; `frame` ends a frame. Texture uploads and mipmaps go to what was bound last, whatever the target.

A session's calls are a sequence with state, so a session is one window; sessions spread over tasks and windows spill.
The same counters run over streams in `streaming.gl_sessions`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the calls that count as draws and uploads, and the constants that tell blending apart
DRAW_ELEMENTS = ("drawElements", "drawElementsInstanced")
DRAW_ARRAYS = ("drawArrays", "drawArraysInstanced")
UPLOADS = ("texImage2D", "texSubImage2D", "compressedTexImage2D", "compressedTexSubImage2D")
BLENDS = ("blendFunc", "blendFuncSeparate")
ONE, SRC_ALPHA, UNPACK_PREMULTIPLY = 1, 770, 37441


def textures(calls: DataFrame) -> DataFrame:
    """session, texture, w, h, mipmapped, compressed: what lives at the end of each session.

    A texture lives from its creation to its deletion, and one created anew starts afresh. The base level gives the size. A compressed level replaces
    that level's bytes; a compressed base level begins a new chain. Parts of levels that are written again take no more room.
    """
    is_ = lambda *names: F.col("call").isin(*names)
    run = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.last(F.when(is_("bindTexture"), F.struct(F.col("object").alias("o"))), ignorenulls=True).over(run)
    c = calls.filter(is_("bindTexture", "createTexture", "deleteTexture", "texImage2D", "compressedTexImage2D", "generateMipmap")).withColumn("bound", bound)
    c = c.filter(~is_("bindTexture")).withColumn("texture", F.when(is_("createTexture", "deleteTexture"), F.col("object")).otherwise(F.col("bound.o"))).filter("texture is not null")
    whole = Window.partitionBy("session", "texture")
    life = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    made = F.when(is_("createTexture", "deleteTexture"), is_("createTexture"))
    c = c.withColumns({"gen": F.count_if(is_("createTexture")).over(life), "alive": F.last(made, ignorenulls=True).over(life)})
    c = c.withColumns({"gens": F.max("gen").over(whole), "lives": F.max_by("alive", "seq").over(whole)}).filter("lives and alive and gen = gens")
    base = is_("compressedTexImage2D") & (F.col("level") == 0)
    c = c.withColumn("chain", F.max(F.when(base, F.col("seq"))).over(whole))
    levels = c.filter(is_("compressedTexImage2D") & (F.col("seq") >= F.coalesce("chain", F.lit(0)))).groupBy("session", "texture", "level").agg(F.max_by("bytes", "seq").alias("bytes"))
    compressed = levels.groupBy("session", "texture").agg(F.sum("bytes").cast("long").alias("compressed"))
    sized = F.max_by(F.when(is_("texImage2D", "compressedTexImage2D") & (F.col("level") == 0) & (F.col("w") > 0) & (F.col("h") > 0), F.struct("w", "h")), F.when(is_("texImage2D", "compressedTexImage2D") & (F.col("level") == 0) & (F.col("w") > 0) & (F.col("h") > 0), F.col("seq")))
    t = c.groupBy("session", "texture").agg(sized.alias("size"), F.bool_or(is_("generateMipmap")).alias("mipmapped")).join(compressed, ["session", "texture"], "left")
    zero = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    return t.select("session", "texture", zero("size.w").alias("w"), zero("size.h").alias("h"), "mipmapped", zero("compressed").alias("compressed"))


def texture_bytes(w: Column, h: Column, mipmapped: Column, compressed: Column) -> Column:
    """What a texture takes: its compressed levels as they are, otherwise four bytes a pixel and a third more with mipmaps."""
    raw = (w * h * 4).cast("double")
    return F.when(compressed > 0, compressed.cast("double")).when(mipmapped, raw * 4 / 3).otherwise(raw)


def live_textures(calls: DataFrame) -> DataFrame:
    """session, live_textures, vram, compressed: sums over what lives at the end."""
    size = texture_bytes(F.col("w"), F.col("h"), F.col("mipmapped"), F.col("compressed"))
    return textures(calls).groupBy("session").agg(F.count("*").alias("live_textures"), F.floor(F.sum(size) + 0.5).alias("vram"), F.sum("compressed").alias("compressed"))


def _binds(calls: DataFrame, call: str, keys: list[str], name: str) -> DataFrame:
    """Binds of a kind, and those of what the key has bound already; a first bind is never one."""
    w = Window.partitionBy(*keys).orderBy("seq")
    b = calls.filter(F.col("call") == call).select("session", F.lag("seq").over(w).isNotNull().alias("later"), F.col("object").eqNullSafe(F.lag("object").over(w)).alias("same"))
    return b.groupBy("session").agg(F.count("*").alias(f"{name}_binds"), F.count_if(F.col("later") & F.col("same")).alias(f"redundant_{name}_binds"))


def session_counters(calls: DataFrame) -> DataFrame:
    """One row a session: draws, binds and redundant binds, uploads, compiles, links, frames, what lives, and the blending that was ever seen."""
    n = lambda *names: F.count_if(F.col("call").isin(*names))
    blend = lambda factor: F.coalesce(F.bool_or(F.col("call").isin(*BLENDS) & (F.col("value") == factor)), F.lit(False))
    c = calls.groupBy("session").agg(
        n(*DRAW_ELEMENTS).alias("draw_elements"), n(*DRAW_ARRAYS).alias("draw_arrays"), n(*UPLOADS).alias("uploads"), n("compileShader").alias("compiles"), n("linkProgram").alias("links"), n("frame").alias("frames"),
        blend(ONE).alias("premultiplied"), blend(SRC_ALPHA).alias("straight"), F.coalesce(F.bool_or((F.col("call") == "pixelStorei") & (F.col("value") == UNPACK_PREMULTIPLY) & (F.col("level") != 0)), F.lit(False)).alias("unpack_premultiply"),
    )
    out = c.join(_binds(calls, "bindTexture", ["session", "target"], "texture"), "session", "left").join(_binds(calls, "useProgram", ["session"], "program"), "session", "left").join(live_textures(calls), "session", "left")
    return out.fillna(0, ["texture_binds", "redundant_texture_binds", "program_binds", "redundant_program_binds", "live_textures", "vram", "compressed"])


def frame_counters(calls: DataFrame) -> DataFrame:
    """session, seq (frames from 1), draws, binds, redundant (textures and programs), uploads, compiles of each frame that has ended."""
    run = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = calls.withColumn("frame", F.coalesce(F.count_if(F.col("call") == "frame").over(run), F.lit(0)) + 1)
    ended = F.max(F.when(F.col("call") == "frame", F.col("frame"))).over(Window.partitionBy("session"))
    kind = F.when(F.col("call") == "useProgram", "program").otherwise(F.concat(F.lit("texture:"), F.coalesce("target", F.lit(""))))
    w = Window.partitionBy("session", F.col("call").isin("bindTexture", "useProgram"), kind).orderBy("seq")
    c = c.withColumns({"ended": ended, "redundant": F.col("call").isin("bindTexture", "useProgram") & F.lag("seq").over(w).isNotNull() & F.col("object").eqNullSafe(F.lag("object").over(w))})
    n = lambda *names: F.count_if(F.col("call").isin(*names))
    c = c.filter("frame <= ended").groupBy("session", F.col("frame").alias("seq"))
    return c.agg(n(*DRAW_ELEMENTS, *DRAW_ARRAYS).alias("draws"), n("bindTexture").alias("binds"), F.count_if("redundant").alias("redundant"), n(*UPLOADS).alias("uploads"), n("compileShader").alias("compiles"))
