"""Parsers of sheet manifests, skeletons and fonts: each maps texts to rows, one batch at a time, and quarantines what is bad."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SPRITE = "asset_ref string, sprite_idx long, name string, x int, y int, w int, h int, rotated boolean, trimmed boolean, src_w int, src_h int, page string, page_w int, page_h int, kind string, error string"
_COLUMNS = [c.split()[0] for c in SPRITE.split(", ")]


def _rows(parse: Callable[[str], list[tuple]], column: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ref, body in zip(pdf["path"], pdf[column], strict=True):
                try:
                    out += [(ref, *r) for r in parse(body)]
                except (ValueError, KeyError, TypeError, AttributeError, IndexError, struct.error) as e:
                    out.append((ref, *[None] * (len(_COLUMNS) - 2), str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"sprite_idx": "Int64", **{c: "Int32" for c in ("x", "y", "w", "h", "src_w", "src_h", "page_w", "page_h")}, "rotated": "boolean", "trimmed": "boolean"})

    return run


def _whole(v: object) -> int:
    if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v):
        raise ValueError(f"not a whole number: {v!r}")
    return int(v)


def parse_sheet(text: str) -> list[tuple]:
    """Frames of a sheet manifest, as a map by name or a list with file names (of equal names the first counts). Frames with bad
    rectangles or off the declared page become errors; a rotated frame is as placed, so its sides are swapped."""
    doc = json.loads(text)
    meta, frames = doc["meta"], doc["frames"]
    pw, ph = _whole(meta["size"]["w"]), _whole(meta["size"]["h"])
    as_list = isinstance(frames, list)
    named: dict[str, dict] = {}
    for name, body in ((f["filename"], f) for f in frames) if as_list else frames.items():
        named.setdefault(name, body)
    app = str(meta.get("app", ""))
    kind = ("texturepacker-array" if as_list else "texturepacker-hash") if "texturepacker" in app.lower() else "pixi"
    out = []
    for i, (name, body) in enumerate(named.items()):
        try:
            x, y, w, h = (_whole(body["frame"][k]) for k in "xywh")
            if w <= 0 or h <= 0 or x < 0 or y < 0:
                raise ValueError("bad rectangle")
            rotated, trimmed = bool(body.get("rotated", False)), bool(body.get("trimmed", False))
            source = body.get("sourceSize") or {"w": w, "h": h}
            w_, h_ = (h, w) if rotated else (w, h)
            if x + w_ > pw or y + h_ > ph:
                raise ValueError("off the page")
            out.append((i, name, x, y, w_, h_, rotated, trimmed, _whole(source["w"]), _whole(source["h"]), meta.get("image"), pw, ph, kind, None))
        except (ValueError, KeyError, TypeError):
            out.append((i, name, *[None] * 8, meta.get("image"), pw, ph, kind, f'invalid frame "{name}"'))
    if out and all(r[-1] for r in out):
        raise ValueError("no valid frame")
    return out


def parse_atlas_text(text: str) -> list[tuple]:
    """Regions of an .atlas text: a blank line closes a page; lines `key: values` belong to the page or region named before them."""
    out: list[tuple] = []
    page: str | None = None
    size = (None, None)
    region: dict | None = None
    index = 0

    def close() -> None:
        nonlocal region, index
        if region is not None:
            rotated = region.get("rotate", ["false"])[0] in ("true", "90")
            x, y, w, h = (int(v) for v in region["bounds"]) if "bounds" in region else (*map(int, region["xy"]), *map(int, region["size"]))
            src = [int(v) for v in region["offsets"][2:4]] if "offsets" in region else [int(v) for v in region.get("orig", (w, h))]
            w_, h_ = (h, w) if rotated else (w, h)
            bad = w <= 0 or h <= 0 or x < 0 or y < 0
            out.append((index, region["name"], x, y, w_, h_, rotated, src != [w, h], *src, page, *size, "spine", f'invalid frame "{region["name"]}"' if bad else None))
            index += 1
            region = None

    for line in [*text.splitlines(), ""]:
        s = line.strip()
        if not s:
            close()
            page, size = None, (None, None)
        elif ":" in s:
            key, values = s.split(":", 1)
            v = [x.strip() for x in values.split(",")]
            if region is not None:
                region[key.strip()] = v
            elif key.strip() == "size":
                size = int(v[0]), int(v[1])
        elif page is None:
            page = s
        else:
            close()
            region = {"name": s}
    return out


def _font_rows(pages: dict[int, str], size: tuple[int, int], glyphs: list[tuple[int, int, int, int, int, int]]) -> list[tuple]:
    out = []
    for i, (char, x, y, w, h, page) in enumerate(glyphs):
        if w == 0 or h == 0:
            continue
        bad = page not in pages or w < 0 or h < 0 or x < 0 or y < 0 or x + w > size[0] or y + h > size[1]
        out.append((i, str(char), x, y, w, h, False, False, w, h, pages.get(page), *size, "bmfont", f"invalid glyph {char}" if bad else None))
    return out


def parse_font(body: bytes) -> list[tuple]:
    """Glyphs of a bitmap font in any of its three encodings."""
    if body[:3] == b"BMF":
        at, pages, size, glyphs = 4, {}, (0, 0), []
        while at + 5 <= len(body):
            kind, n = body[at], struct.unpack_from("<I", body, at + 1)[0]
            part = body[at + 5 : at + 5 + n]
            if kind == 2:
                size = struct.unpack_from("<HH", part, 4)
            elif kind == 3:
                pages = dict(enumerate(p.decode() for p in part.split(b"\0") if p))
            elif kind == 4:
                for c in range(0, n - 19, 20):
                    char, x, y, w, h, _, _, _, page, _ = struct.unpack_from("<IHHHHhhhBB", part, c)
                    glyphs.append((char, x, y, w, h, page))
            at += 5 + n
        return _font_rows(pages, size, glyphs)
    text = body.decode("utf-8", "replace")
    pattern = r'(\w+)=(?:"([^"]*)"|(\S+))'
    fields = lambda s: {k: a or b for k, a, b in re.findall(pattern, s)}
    xml = text.lstrip().startswith("<")
    rows = lambda tag: [fields(m) for m in re.findall(rf"<{tag}\s([^>]*?)/?>" if xml else rf"(?m)^{tag}\s+(.*)$", text)]
    common = rows("common")[0]
    pages = {int(p["id"]): p["file"] for p in rows("page")}
    return _font_rows(pages, (int(common["scaleW"]), int(common["scaleH"])), [tuple(int(c[k]) for k in ("id", "x", "y", "width", "height", "page")) for c in rows("char")])


def skeleton_refs(text: str) -> list[tuple[str, str]] | None:
    """(kind, value) of the names and, for sequences, prefixes that a skeleton's attachments ask for; None for an odd shape."""
    try:
        skins = json.loads(text)["skins"]
        skins = skins if isinstance(skins, list) else [{"attachments": a} for a in skins.values()]
        out = []
        for skin in skins:
            for slot in (skin.get("attachments") or {}).values():
                for key, body in slot.items():
                    if body.get("type", "region") in ("region", "mesh", "linkedmesh"):
                        out.append(("prefix" if body.get("sequence") else "name", body.get("path") or body.get("name") or key))
        return sorted(set(out))
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def sheets(files: DataFrame) -> DataFrame:
    """files: path, text."""
    return files.select("path", "text").mapInPandas(_rows(parse_sheet, "text"), SPRITE)


def atlas_texts(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInPandas(_rows(parse_atlas_text, "text"), SPRITE)


def fonts(files: DataFrame) -> DataFrame:
    """files: path, content."""
    return files.select("path", "content").mapInPandas(_rows(parse_font, "content"), SPRITE)


def skeletons(files: DataFrame) -> DataFrame:
    """path, kind, value; a skeleton of an odd shape has one row of nulls, which makes its folder's check silent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ref, text in zip(pdf["path"], pdf["text"], strict=True):
                refs = skeleton_refs(text)
                out += [(ref, None, None)] if refs is None else [(ref, *r) for r in refs]
            yield pd.DataFrame(out, columns=["path", "kind", "value"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, value string")
