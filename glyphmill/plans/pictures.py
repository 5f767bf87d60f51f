"""PNG files drawn from rows, so that parsers and pixel features run over the driver's tables: a filled box on a clear or filled ground."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def png_bytes(px: np.ndarray) -> bytes:
    """8-bit RGBA pixels as a PNG."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((px.shape[0], 1), np.uint8), px.reshape(px.shape[0], -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b"")


def drawn(rows: DataFrame) -> DataFrame:
    """rows: path, w, h, red, green, blue, ground (alpha of the ground), alpha (of the box), from_x, from_y, box_w, box_h. path, content.

    Rows are few bytes and pictures take long, so they are dealt to as many tasks as a shuffle has, not to those of a small file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                px = np.zeros((r.h, r.w, 4), np.uint8)
                px[..., :3] = r.red, r.green, r.blue
                px[..., 3] = r.ground
                px[r.from_y : r.from_y + r.box_h, r.from_x : r.from_x + r.box_w, 3] = r.alpha
                out.append((r.path, png_bytes(px)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(run, "path string, content binary")
