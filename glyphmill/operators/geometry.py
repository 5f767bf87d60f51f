"""Empty space of sheets: coverage by cells, and maximal rectangles of empty cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.config import DEFAULT, Thresholds
from glyphmill.functions import scalars as S
from glyphmill.operators.asset_rules import atlas_occupancy
from glyphmill.operators.groups import over_chunks

#: Sheets whose cells are counted at once.
SHEETS = 64


def grid(atlases: DataFrame) -> DataFrame:
    """Cell side, rows and columns of each sheet; a sheet has some 64 cells along its longest edge, so cells stay few."""
    c = S.default_cell(F.col("decl_w"), F.col("decl_h"))
    return atlases.filter("decl_w > 0 and decl_h > 0").select("asset_ref", "decl_w", "decl_h", c.alias("cell"), F.ceil(F.col("decl_w") / c).alias("cols"), F.ceil(F.col("decl_h") / c).alias("rows"))


def covered_boxes(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """Each frame's cells, r0, r1, c0, c1 (all inclusive), with its sheet's grid; a sheet without any has one row of nulls there."""
    s = sprites.filter("w > 0 and h > 0").select("asset_ref", "x", "y", "w", "h")
    j = grid(atlases).filter("asset_ref is not null").join(s, "asset_ref", "left")
    seen = (F.col("x") < F.col("cols") * F.col("cell")) & (F.col("y") < F.col("rows") * F.col("cell")) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0)
    first = lambda at: F.when(seen, F.greatest(F.lit(0).cast("long"), F.floor(F.col(at) / F.col("cell"))))
    last = lambda at, size, n: F.when(seen, F.least(F.col(n) - 1, F.floor((F.col(at) + F.col(size) - 1) / F.col("cell"))))
    whole = [F.col(c).cast("long").alias(c) for c in ("decl_w", "decl_h", "cell", "cols", "rows")]
    return j.select("asset_ref", *whole, first("y").alias("r0"), last("y", "h", "rows").alias("r1"), first("x").alias("c0"), last("x", "w", "cols").alias("c1"))


def _empty_blocks(sheet: np.ndarray, box: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """sheet, r0, r1, c0, c1 of the blocks that no box (sheet, r0, r1, c0, c1) covers: runs along a row, and equal runs of rows that follow each other."""
    n, high, wide = len(rows), int(rows.max()), int(cols.max())
    kind = np.int16 if len(sheet) < 30_000 else np.int32
    cover = np.zeros((n, high + 1, wide + 1), kind)
    r0, r1, c0, c1 = box
    for r, c, by in ((r0, c0, 1), (r0, c1 + 1, -1), (r1 + 1, c0, -1), (r1 + 1, c1 + 1, 1)):
        np.add.at(cover, (sheet, r, c), kind(by))
    np.cumsum(cover, axis=1, dtype=kind, out=cover)
    np.cumsum(cover, axis=2, dtype=kind, out=cover)
    free = np.zeros((n, high, wide + 2), bool)
    np.equal(cover[:, :-1, :-1], 0, out=free[:, :, 1:-1])
    free[:, :, 1:-1] &= (np.arange(high) < rows[:, None])[:, :, None] & (np.arange(wide) < cols[:, None])[:, None]
    flat = free.ravel()  # each row begins and ends with a cell that isn't free, so runs and turns alternate
    turn = np.flatnonzero(flat[1:] != flat[:-1])
    line, first = np.divmod(turn[::2], wide + 2)
    last = turn[1::2] - line * (wide + 2) - 1
    at, r = np.divmod(line, high)
    by = np.argsort(((at * (wide + 2) + first) * (wide + 2) + last) * high + r)
    at, r, first, last = at[by], r[by], first[by], last[by]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (r[1:] != r[:-1] + 1)
    end = np.append(np.flatnonzero(new)[1:], len(at)) - 1 if len(at) else np.zeros(0, np.int64)
    return at[new], r[new], r[end], first[new], last[new]


def empty_rectangles(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """asset_ref, x, y, w, h: gaps between covered columns along rows of cells, then rows of equal gaps joined downwards.

    Frames reach a task by sheet, as their boxes of cells; cells are counted there, in tables of some 64 x 64 for some sheets at once.
    """

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        ref = pdf["asset_ref"].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(ref[1:] != ref[:-1]) + 1, [len(ref)]])
        side = {c: pdf[c].to_numpy()[cut[:-1]] for c in ("decl_w", "decl_h", "cell", "rows", "cols")}
        box = pdf[["r0", "r1", "c0", "c1"]].to_numpy(np.float64, na_value=np.nan)
        sheet, inside = np.repeat(np.arange(len(cut) - 1), np.diff(cut)), ~np.isnan(box[:, 0])
        out = []
        for a in range(0, len(cut) - 1, SHEETS):
            mine = inside & (sheet >= a) & (sheet < a + SHEETS)
            at, r0, r1, c0, c1 = _empty_blocks(sheet[mine] - a, box[mine].astype(np.int64).T, side["rows"][a : a + SHEETS], side["cols"][a : a + SHEETS])
            at = at + a
            cell = side["cell"][at]
            x, y = c0 * cell, r0 * cell
            out.append(pd.DataFrame({"asset_ref": ref[cut[at]], "x": x, "y": y, "w": np.minimum(side["decl_w"][at], (c1 + 1) * cell) - x, "h": np.minimum(side["decl_h"][at], (r1 + 1) * cell) - y}))
        return pd.concat(out, ignore_index=True)

    boxes = covered_boxes(sprites, atlases)
    schema = StructType().add("asset_ref", boxes.schema["asset_ref"].dataType)
    for c in "xywh":
        schema = schema.add(c, "long")
    return over_chunks(boxes, "asset_ref", [], blocks, schema)


def empty_summary(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """Number, total and largest area of empty rectangles, and the largest's share (null without any)."""
    a = F.col("w") * F.col("h")
    e = empty_rectangles(sprites, atlases).groupBy("asset_ref").agg(F.count("*").alias("n"), F.sum(a).alias("area"), F.max(a).alias("largest"))
    return e.withColumn("share", F.try_divide(F.col("largest").cast("double"), F.col("area").cast("double")))


def wasted_regions(sprites: DataFrame, atlases: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Empty space of sheets that are too empty; only their frames are gone through."""
    low = atlas_occupancy(sprites, atlases).filter(F.col("occ") < t.occupancy_warn).select("asset_ref")
    few = lambda df: df.join(low, "asset_ref", "left_semi")
    return empty_summary(few(sprites), few(atlases)).select("asset_ref", "n", "area", "largest", "share", F.lit("info").alias("severity"))


def dispersion(sprites: DataFrame, atlases: DataFrame) -> DataFrame:
    """How scattered a sheet's empty space is: 0 for one rectangle or none, towards 1 for many small ones."""
    e = atlases.select("asset_ref").join(empty_summary(sprites, atlases), "asset_ref", "left")
    return e.select("asset_ref", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (1 - F.coalesce("share", F.lit(1.0))).alias("fragmentation"))
