"""Image headers, strippable metadata and pixel features, as kernels over batches of files."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that an encoder can drop without changing pixels.
PNG_METADATA = {b"tEXt", b"zTXt", b"iTXt", b"tIME", b"eXIf", b"iCCP"}


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if at + 12 + n > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def image_info(data: bytes) -> tuple[str, int, int] | None:
    """mime, width, height from the header alone."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("image/png", *struct.unpack_from(">II", data, 16))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "image/webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "image/webp", 1 + (bits & 0x3FFF), 1 + ((bits >> 14) & 0x3FFF)
        if kind == b"VP8 ":
            w, h = struct.unpack_from("<HH", data, 26)
            return "image/webp", w & 0x3FFF, h & 0x3FFF
    if data[4:12] in (b"ftypavif", b"ftypavis") and (i := data.find(b"ispe")) > 0 and len(data) >= i + 16:
        return ("image/avif", *struct.unpack_from(">II", data, i + 8))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return "image/jpeg", w, h
            at += 2 + n
    return None


def icc_description(profile: bytes) -> str | None:
    """The description of a colour profile, of version 2 or 4; None if it can't be read."""
    if len(profile) < 132:
        return None
    n = int.from_bytes(profile[128:132], "big")
    if not 0 < n <= (len(profile) - 132) // 12:
        return None
    at = next((struct.unpack_from(">I", profile, 136 + 12 * i)[0] for i in range(n) if profile[132 + 12 * i : 136 + 12 * i] == b"desc"), None)
    if at is None or at + 12 > len(profile):
        return None
    kind, count = profile[at : at + 4], int.from_bytes(profile[at + 8 : at + 12], "big")
    if kind == b"desc":
        lo, hi, encoding = at + 12, at + 12 + count, "latin-1"
    elif kind == b"mluc" and at + 28 <= len(profile):
        size, offset = struct.unpack_from(">II", profile, at + 20)
        lo, hi, encoding = at + offset, at + offset + size, "utf-16-be"
    else:
        return None
    if not count or hi > len(profile):
        return None
    return _label(profile[lo:hi].decode(encoding, "replace"))


def _label(text: str) -> str | None:
    return text.rstrip("\0").strip()[:80] or None


def icc_info(data: bytes) -> tuple[int, bool, str | None] | None:
    """Bytes of an embedded colour profile, whether the header proves that it is sRGB, and its name; None without a profile."""
    info = image_info(data)
    mime, size, name, proven = info[0] if info else None, 0, None, False
    if mime == "image/png":
        for kind, body in png_chunks(data):
            proven |= kind == b"sRGB"
            if kind == b"iCCP":
                size, name = size + len(body) + 12, _label(body[:80].split(b"\0")[0].decode("latin-1"))
    elif mime == "image/jpeg":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            n = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE2 and data[at + 4 : at + 16] == b"ICC_PROFILE\0":
                size += n + 2
                if data[at + 16] == 1:
                    name = icc_description(data[at + 18 : at + 2 + n])
            at += 2 + n
    elif mime == "image/webp" and data[12:16] == b"VP8X":
        at = 12
        while at + 8 <= len(data):
            n = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] == b"ICCP":
                size, name = n + 8, icc_description(data[at + 8 : at + 8 + n])
                break
            at += 8 + n + (n & 1)
    return (size, proven or "srgb" in (name or "").lower(), name) if size else None


def strippable_bytes(data: bytes) -> int | None:
    """Bytes of metadata that could go, by format; null for formats that aren't read. A colour profile that isn't proven sRGB stays."""
    total, icc = metadata_bytes(data), icc_info(data)
    return total if total is None or icc is None or icc[1] else max(0, total - icc[0])


def metadata_bytes(data: bytes) -> int | None:
    """Bytes of all metadata."""
    info = image_info(data)
    if info is None:
        return None
    if info[0] == "image/png":
        return sum(len(body) + 12 for kind, body in png_chunks(data) if kind in PNG_METADATA)
    if info[0] == "image/jpeg":
        at, total = 2, 0
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            n = struct.unpack_from(">H", data, at + 2)[0]
            if 0xE1 <= data[at + 1] <= 0xEF or data[at + 1] == 0xFE:
                total += n + 2
            at += 2 + n
        return total
    if info[0] == "image/webp":
        at, total = 12, 0
        while at + 8 <= len(data):
            n = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] in (b"EXIF", b"XMP ", b"ICCP"):
                total += 8 + n
            at += 8 + n + (n & 1)
        return total
    return None


def strip_png(data: bytes) -> bytes:
    """A PNG without its metadata chunks."""
    out, at = [data[:8]], 8
    for kind, body in png_chunks(data):
        if kind not in PNG_METADATA:
            out.append(data[at : at + 12 + len(body)])
        at += 12 + len(body)
    return b"".join(out)


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels (h, w, 4) of an 8-bit RGB or RGBA PNG that isn't interlaced; None for others."""
    head = struct.unpack_from(">IIBBBBB", data, 16)
    w, h, depth, color, _, _, laced = head
    if depth != 8 or color not in (2, 6) or laced:
        return None
    bpp = 3 if color == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in png_chunks(data) if k == b"IDAT")), np.uint8).reshape(h, 1 + w * bpp)
    plain = not raw[:, 0].any()
    out, above = raw[:, 1:].copy() if plain else np.zeros((h, w * bpp), np.uint8), np.zeros(w * bpp, np.int32)
    for y in range(0 if plain else h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(w, bpp), axis=0).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = line.reshape(w, bpp).copy()
            up = above.reshape(w, bpp)
            left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
            for x in range(w):
                if kind == 3:
                    left = (line[x] + (left + up[x]) // 2) & 255
                else:
                    p = left + up[x] - corner
                    pa, pb, pc = abs(p - left), abs(p - up[x]), abs(p - corner)
                    left = (line[x] + np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up[x], corner))) & 255
                    corner = up[x]
                line[x] = left
            line = line.ravel()
        above = line & 255
        out[y] = above
    px = out.reshape(h, w, bpp)
    return px if bpp == 4 else np.concatenate([px, np.full((h, w, 1), 255, np.uint8)], axis=2)


def luma(px: np.ndarray) -> np.ndarray:
    return px[..., 0] * 0.299 + px[..., 1] * 0.587 + px[..., 2] * 0.114


@lru_cache(maxsize=4096)
def _box_edges(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n boxes along an edge begins and ends."""
    at = np.linspace(0, size, n + 1)
    first = np.floor(at[:-1]).astype(int)
    return first, np.maximum(np.ceil(at[1:]).astype(int), first + 1)


def box_gray(gray: np.ndarray, w: int = 9, h: int = 8) -> np.ndarray:
    """Mean luma over w x h boxes."""
    total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    np.cumsum(gray.cumsum(0), axis=1, out=total[1:, 1:])
    (y0, y1), (x0, x1) = _box_edges(gray.shape[0], h), _box_edges(gray.shape[1], w)
    low, high = total[y1], total[y0]
    s = low[:, x1] - high[:, x1] - low[:, x0] + high[:, x0]
    return s / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def visible_box(alpha: np.ndarray) -> tuple[int, int, int, int] | None:
    """Left, top, right, bottom (beyond the last) of the pixels that aren't clear."""
    rows, cols = alpha.any(axis=1), alpha.any(axis=0)
    if not rows.any():
        return None
    return int(cols.argmax()), int(rows.argmax()), len(cols) - int(cols[::-1].argmax()), len(rows) - int(rows[::-1].argmax())


def pixel_features(px: np.ndarray) -> dict:
    """What the rules ask of an image's pixels."""
    alpha, fine = px[..., 3], luma(px)
    gray = box_gray(fine)
    spread_gray = gray.std()
    flat = spread_gray < 6
    bits = (gray[:, :-1] < gray[:, 1:]).ravel()
    flat_alpha = alpha.ravel().astype(np.float64)
    weight = int(flat_alpha.sum())
    # sums of whole numbers below 2**53 are exact
    mean = flat_alpha @ px[..., :3].reshape(-1, 3).astype(np.float64) / weight if weight else [None] * 3
    channels = np.ascontiguousarray(px.reshape(-1, 4).T)
    spread = int((channels.max(axis=1) - channels.min(axis=1)).max())
    edge = visible_box(alpha)
    box = (edge[2] - edge[0], edge[3] - edge[1]) if edge else (None, None)
    inside = alpha[edge[1] : edge[3], edge[0] : edge[2]] if edge else alpha[:0]
    depth, level = 0, px
    while min(level.shape[:2]) >= 2 and level.shape[0] % 2 == 0 and level.shape[1] % 2 == 0:
        a = level[::2, ::2]
        if not all((a == level[i::2, j::2]).all() for i, j in ((0, 1), (1, 0), (1, 1))):
            break
        depth, level = depth + 1, a
    solid_enough, clear = np.count_nonzero(alpha >= 250) / alpha.size, np.count_nonzero(alpha <= 8) / alpha.size
    full = np.count_nonzero(alpha == 255)
    kind = "alpha-art" if solid_enough >= 0.12 and clear >= 0.12 else "flat" if spread_gray < 12 else "photographic"
    edges, dark = dark_edges(px, fine)
    return {
        "pixel_hash": hashlib.sha256(px.tobytes()).hexdigest(), "pma_edge_pixels": edges, "pma_fringe_frac": dark, "hf_energy": high_frequency_energy(px, fine),
        "d_hash": None if flat else f"{int(''.join('1' if b else '0' for b in bits), 2):016x}", "solid": bool(spread_gray < 2 and spread <= 8), "opaque": full == alpha.size, "mean_r": mean[0], "mean_g": mean[1], "mean_b": mean[2],
        "holes": hole_rects(alpha), "upscale_depth": depth, "bbox_w": box[0], "bbox_h": box[1], "interior_transparent": inside.size - np.count_nonzero(inside), "binary_alpha": np.count_nonzero(alpha) == full, "opaque_count": full, "content_class": kind,
    }


def hole_rects(alpha: np.ndarray, most: int = 64) -> list[list[int]] | None:
    """Rectangles (x, y, w, h) of grid cells that lie whole inside the box of visible pixels and have none, by row; cells of one row join, and rows of one
    extent that follow each other. None if there are none or over `most`: a cut list would hide the rest."""
    edge = visible_box(alpha)
    if edge is None:
        return None
    h, w = alpha.shape
    cell = max(8, int(max(w, h) / 64 + 0.5))
    at_y, at_x = np.arange(0, h, cell), np.arange(0, w, cell)
    end_y, end_x = np.minimum(at_y + cell, h), np.minimum(at_x + cell, w)
    whole = ((at_y >= edge[1]) & (end_y <= edge[3]))[:, None] & ((at_x >= edge[0]) & (end_x <= edge[2]))[None]
    if not whole.any():
        return None
    seen = np.logical_or.reduceat(np.logical_or.reduceat(alpha > 0, at_y, axis=0), at_x, axis=1)
    clear = ~seen & whole
    if not clear.any():
        return None
    out, open_ = [], {}
    for r in range(len(at_y) + 1):
        row = np.concatenate([[False], clear[r], [False]]) if r < len(at_y) else np.zeros(2, bool)
        turn = np.flatnonzero(row[1:] != row[:-1])
        runs = set(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
        for run in [k for k in open_ if k not in runs]:
            top = open_.pop(run)
            out.append([int(at_x[run[0]]), int(at_y[top]), int(end_x[run[1] - 1] - at_x[run[0]]), int(end_y[r - 1] - at_y[top])])
        for run in runs:
            open_.setdefault(run, r)
    return sorted(out, key=lambda b: (b[1], b[0])) if 0 < len(out) <= most else None


def dark_edges(px: np.ndarray, gray: np.ndarray | None = None) -> tuple[int, float]:
    """Soft pixels next to a bright opaque one, and the share of them whose implied backdrop is near black, as premultiplied files have."""
    gray = luma(px) if gray is None else gray
    y, x = np.nonzero((px[..., 3] >= 12) & (px[..., 3] <= 200))
    bright = (px[..., 3] >= 250) & (gray >= 96)
    if not len(y) or not bright.any():
        return 0, 0.0
    padded_gray, padded_bright = np.pad(gray, 1), np.pad(bright, 1)
    alpha = px[y, x, 3].astype(np.float64)
    rest = 1 - alpha / 255
    near = np.full(len(y), -1.0)
    for dy, dx in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)):  # in reading order; the first that qualifies counts
        q = padded_gray[y + dy, x + dx]
        near = np.where((near < 0) & padded_bright[y + dy, x + dx] & (q * rest >= 24), q, near)
    edge = near >= 0
    n = int(edge.sum())
    backdrop = (gray[y, x][edge] - near[edge] * alpha[edge] / 255) / rest[edge]
    return n, float((backdrop <= 40).mean()) if n else 0.0


def high_frequency_energy(px: np.ndarray, gray: np.ndarray | None = None) -> float:
    """Mean absolute Laplacian of the luma inside the border; 0 for images without an inside."""
    if min(px.shape[:2]) < 3:
        return 0.0
    g = luma(px) if gray is None else gray
    return float(np.abs(4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]).mean())


def region_hash(px: np.ndarray, x: int, y: int, w: int, h: int) -> str | None:
    """SHA-256 of a frame's pixels; None where it is flat or lies outside."""
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > px.shape[1] or y + h > px.shape[0]:
        return None
    region = px[y : y + h, x : x + w]
    gray = luma(region)
    rows, cols = np.arange(9) * h // 8, np.arange(10) * w // 9
    ends_r, ends_c = np.maximum(rows[1:], rows[:-1] + 1), np.maximum(cols[1:], cols[:-1] + 1)
    total = np.pad(gray.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cell = total[np.ix_(ends_r, ends_c)] - total[np.ix_(rows[:-1], ends_c)] - total[np.ix_(ends_r, cols[:-1])] + total[np.ix_(rows[:-1], cols[:-1])]
    cell = cell / ((ends_r - rows[:-1])[:, None] * (ends_c - cols[:-1])[None, :])
    return None if cell.std() < 6 else hashlib.sha256(region.tobytes()).hexdigest()


def frame_hashes(files: DataFrame, sprites: DataFrame, most_sprites: int = 4096, most_pixels: int = 25_165_824) -> DataFrame:
    """files: path, content. sprites: path, sprite_idx, x, y, w, h. path, sprite_idx, frame_hash of the frames that have one. Sheets of over
    most_sprites frames or most_pixels pixels, and those that aren't decoded, have none."""
    s = sprites.join(sprites.groupBy("path").count().filter(F.col("count") <= most_sprites).select("path"), "path", "left_semi")
    rects = s.groupBy("path").agg(F.collect_list(F.struct("sprite_idx", "x", "y", "w", "h")).alias("rects"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, found in zip(pdf["path"], pdf["content"], pdf["rects"], strict=True):
                info = image_info(data)
                px = decode_png(data) if info and info[0] == "image/png" and info[1] * info[2] <= most_pixels else None
                for r in found if px is not None else ():
                    if (key := region_hash(px, r["x"], r["y"], r["w"], r["h"])) is not None:
                        rows.append((path, r["sprite_idx"], key))
            yield pd.DataFrame(rows, columns=["path", "sprite_idx", "frame_hash"])

    return files.select("path", "content").join(rects, "path").mapInPandas(run, "path string, sprite_idx long, frame_hash string")


def skipped_sheets(files: DataFrame, sprites: DataFrame, most_sprites: int = 4096, most_pixels: int = 25_165_824) -> DataFrame:
    """path, name (null), error: sheets whose frames aren't hashed, since they have too many of them or too many pixels. Only headers are read."""

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            info = [image_info(data) for data in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "pixels": pd.array([i[1] * i[2] if i else None for i in info], "Int64")})

    n = sprites.groupBy("path").count()
    j = files.select("path", "content").join(n.select("path"), "path", "left_semi").mapInPandas(size, "path string, pixels long").join(n, "path")
    why = F.when(F.col("count") > most_sprites, "too many frames").when(F.col("pixels") > most_pixels, "too many pixels")
    return j.select("path", F.lit(None).cast("string").alias("name"), why.alias("error")).filter("error is not null")


_FEATURES = "content_hash string, pixel_hash string, icc_bytes long, icc_srgb boolean, icc_label string, pma_edge_pixels long, pma_fringe_frac double, hf_energy double, path string, mime string, w int, h int, byte_size long, strippable_bytes long, d_hash string, solid boolean, opaque boolean, mean_r double, mean_g double, mean_b double, upscale_depth int, bbox_w int, bbox_h int, interior_transparent long, binary_alpha boolean, opaque_count long, content_class string, holes array<array<int>>"


def image_features(files: DataFrame, most_pixels: int = 25_165_824) -> DataFrame:
    """files: path, content. One pass over each file: header, metadata and, for a PNG within the pixel budget, pixel features; else null."""
    names = [c.split()[0] for c in _FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                info = image_info(data)
                row = {"path": path, "holes": None, "byte_size": len(data), "strippable_bytes": strippable_bytes(data), "content_hash": hashlib.sha256(data).hexdigest()}
                if (icc := icc_info(data)) is not None:
                    row |= {"icc_bytes": icc[0], "icc_srgb": icc[1], "icc_label": icc[2]}
                if info:
                    row |= {"mime": info[0], "w": info[1], "h": info[2]}
                    px = decode_png(data) if info[0] == "image/png" and info[1] * info[2] <= most_pixels else None
                    row |= pixel_features(px) if px is not None and px.size else {}
                rows.append(row)
            kinds = {c: k for c, k in (x.split() for x in _FEATURES.split(", "))}
            cast = {"int": "Int32", "long": "Int64", "boolean": "boolean", "double": "float64", "string": "object", "array<array<int>>": "object"}
            yield pd.DataFrame(rows, columns=names).astype({c: cast[k] for c, k in kinds.items()})

    return files.select("path", "content").mapInPandas(run, _FEATURES)
