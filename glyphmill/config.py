"""Thresholds of the rules, and the gate's configuration, checked on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields

from glyphmill.functions.scalars import glob_to_regex


@dataclass(frozen=True)
class Thresholds:
    """Fixed values that results depend on."""

    occupancy_warn: float = 0.8
    occupancy_crit: float = 0.6
    occupancy_floor_bytes: int = 262_144
    longest_warn: int = 2048
    longest_crit: int = 2730
    npot_waste: float = 0.25
    solid_shorter: int = 256
    solid_longest_warn: int = 1024
    upscaled_longest: int = 256
    redundant_frames: int = 3
    trim_margin: int = 4
    trim_share: float = 0.05
    alpha_shorter: int = 64
    alpha_share: float = 0.05
    strip_info: int = 4096
    strip_warn: int = 65_536
    interior_pixels: int = 16_384
    interior_share: float = 0.6
    binary_longest: int = 128
    bleed_info: int = 4
    bleed_warn: int = 16
    gutter: int = 8
    gutter_gaps: int = 4
    repack_saved: int = 262_144
    matched_share: float = 0.5
    mismatch: int = 2
    format_saved: int = 4096
    format_share: float = 0.25
    glyphs: int = 16
    glyph_occupancy: float = 0.5
    hamming: int = 6
    color: int = 24
    small: int = 512
    small_count: int = 8
    merge_occupancy: float = 0.5
    merge_side: int = 2048
    fringe_pixels: int = 24
    fringe_share: float = 0.75
    mipmap_bytes: int = 4_194_304
    merge_fill: float = 0.8

    def replace(self, **values: float) -> Thresholds:
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown thresholds: {sorted(unknown)}")
        return Thresholds(**{**{f.name: getattr(self, f.name) for f in fields(self)}, **values})


DEFAULT = Thresholds()
SEVERITIES = ("crit", "warn", "info", "ok")
# fixed values: rules that have a metric of their own, and those of them that only a build with more inputs measures
RULES = ("occupancy", "wasted-regions", "format", "dimensions-npot", "dimensions-oversize", "duplicate-exact", "duplicate-similar", "should-atlas", "atlas-merge", "integrity-missing-image", "variants")
NEEDS = {"findings.format": "encoders", "findings.duplicate-similar": "pixels"}
#: Units of the metrics that a budget may name.
GLOBAL_METRICS = {
    **dict.fromkeys(("totals.diskBytes", "totals.vramBytes", "totals.loadedVramBytes", "totals.potentialDiskSaved"), "bytes"), **dict.fromkeys(("findings.crit", "findings.warn", "findings.info", "findings.total", "drawCallsLowerBound"), "count"),
    **{f"findings.{r}": "count" for r in RULES},
}
ASSET_METRICS = {"vramBytes": "bytes", "diskBytes": "bytes", "occupancy": "ratio", "oversizePx": "px"}
_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}


def parse_bytes(value: object) -> int:
    """`1.5 MB` and the like; a bare number has no unit and is refused."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(b|kb|mb|gb)\s*", str(value).lower()) if isinstance(value, str) else None
    if not m:
        raise ValueError(f"bytes need a unit: {value!r}")
    return math.floor(float(m[1]) * _UNITS[m[2]] + 0.5)


def parse_number(value: object, most: float = math.inf) -> float:
    """A number from 0 to most, or text that spells one, with or without a sign for percent behind it."""
    if isinstance(value, str):
        try:
            value = float(value.strip().removesuffix("%"))
        except ValueError:
            raise ValueError(f"not a number: {value!r}") from None
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= most:
        raise ValueError(f"not a number between 0 and {most}: {value!r}")
    return float(value)


def parse_count(value: object) -> int:
    n = parse_number(value)
    if n != int(n):
        raise ValueError(f"a count is a whole number of at least 0: {value!r}")
    return int(n)


def parse_ratio(value: object) -> float:
    """0..1, or a percentage."""
    return parse_number(value, 100) / 100 if isinstance(value, str) and value.strip().endswith("%") else parse_number(value, 1)


_PARSE = {"bytes": parse_bytes, "count": parse_count, "ratio": parse_ratio, "px": parse_number}


def parse_budget(config: dict, measures: frozenset[str] = frozenset()) -> tuple[list[tuple], list[str]]:
    """Rows (ord, scope, match regex or null, metric, level, check, budget) and regexes to ignore.

    Unknown keys, metrics, levels and checks, a level without checks, values of another unit and metrics that need what
    isn't measured (see NEEDS) are errors: a gate that can't be evaluated as written must not pass.
    """
    known = {"version", "budgets", "thresholds", "assets", "ignore", "$schema"}
    if set(config) - known:
        raise ValueError(f"unknown keys: {sorted(set(config) - known)}")
    if config.get("version") != 1:
        raise ValueError("version must be 1")
    if not isinstance(config.get("budgets"), dict):
        raise ValueError("budgets are missing")
    rows: list[tuple] = []

    def add(scope: str, match: str | None, ord_: int, budgets: dict, units: dict[str, str]) -> None:
        for metric, levels in budgets.items():
            if metric not in units or NEEDS.get(metric, "") not in {"", *measures}:
                raise ValueError(f"{metric} can't be measured for {scope}")
            if levels == "off":
                continue
            if not isinstance(levels, dict) or not levels or set(levels) - {"warn", "error"}:
                raise ValueError(f"{metric} needs the levels warn or error, or off: {levels!r}")
            for level, checks in levels.items():
                if not isinstance(checks, dict) or not checks or set(checks) - {"max", "min", "maxDeltaPct"}:
                    raise ValueError(f"{metric}.{level} needs max, min or maxDeltaPct: {checks!r}")
                for check, value in checks.items():
                    rows.append((ord_, scope, match, metric, level, check, float(parse_number(value) if check == "maxDeltaPct" else _PARSE[units[metric]](value))))

    add("global", None, 0, config["budgets"], GLOBAL_METRICS)
    for i, entry in enumerate(config.get("assets", [])):
        if not isinstance(entry.get("match"), str) or not isinstance(entry.get("budgets"), dict):
            raise ValueError(f"an entry for assets needs a match and budgets: {entry!r}")
        add("asset", glob_to_regex(entry["match"]), i, entry["budgets"], ASSET_METRICS)
    return rows, [glob_to_regex(g) for g in config.get("ignore", [])]


_RESOLUTION_SUFFIX = re.compile(r"[_-](\d{2,4}p|@?\d+x|hd|sd)", re.I)
_FREE_SUFFIX = re.compile(r"[_-][A-Za-z0-9][A-Za-z0-9_-]{0,23}")


def is_safe_suffix(suffix: str) -> bool:
    """A resolution suffix, or a free one that is safe in file names and doesn't spell a format."""
    if _RESOLUTION_SUFFIX.fullmatch(suffix):
        return True
    return bool(_FREE_SUFFIX.fullmatch(suffix)) and suffix[1:].lower() not in {"png", "webp", "avif", "jpg", "jpeg"}


def validate_tiers(tiers: list[tuple[float, str]]) -> list[tuple[float, str]]:
    """(scale, suffix) from the largest scale down; a ladder has a tier of scale 1, scales in (0, 1] and safe suffixes, no two alike."""
    problems = [] if any(scale == 1 for scale, _ in tiers) else ["no tier of scale 1"]
    for scale, suffix in tiers:
        if not 0 < scale <= 1:  # false for NaN too
            problems.append(f"scale outside (0, 1]: {scale}")
        if not is_safe_suffix(suffix):
            problems.append(f"unsafe suffix: {suffix!r}")
    names = [suffix.lower() for _, suffix in tiers]
    problems += [f"suffix given twice: {n!r}" for n in sorted({n for n in names if names.count(n) > 1})]
    if problems:
        raise ValueError("; ".join(problems))
    return sorted(tiers, key=lambda t: (-t[0], t[1]))
