"""Texts of findings: templates with typed places, compiled once into column expressions, and reports printed as ordered lines.

A template holds `{name}` or `{name:kind}`; kinds are bytes, mb, pct (of a share) and sev (a severity's word). A dict with `count` has a form for one and
one for all other counts of that parameter. Values come from a map column; one that is missing prints as nothing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import scalars as S
from glyphmill.operators.gate import SEVERITY_RANK

Template = str | dict[str, str]
SEVERITY_WORDS = {"crit": "critical", "warn": "warning", "info": "note", "ok": "fine"}

#: By message: title, detail and, where there is one, a remedy.
ENGLISH: dict[str, dict[str, Template]] = {
    "occupancy": {"title": "Sheet is {occ:pct} full", "detail": "{wasted_bytes:bytes} of texture memory hold no frame.", "fix": "Pack the sheet anew."},
    "dimensions-oversize": {"title": "Longest edge is {longest}px", "detail": "Devices with smaller limits scale or refuse such textures.", "fix": "Scale it down or split it."},
    "dimensions-npot": {"title": "Padding to powers of two would waste {waste:pct}", "detail": "{vram_saved:bytes} of texture memory where sizes are padded.", "fix": "Choose sizes near a power of two."},
    "solid-fill": {"title": "One colour throughout", "detail": "A single pixel shows the same and frees {vram_saved:bytes} of texture memory.", "fix": "Stretch a pixel or tint a quad."},
    "upscaled-source": {"title": {"count": "upscale_depth", "one": "Enlarged once from half its size", "other": "Enlarged {upscale_depth} times over"}, "detail": "Its source frees {vram_saved:bytes} of texture memory.", "fix": "Ship the source and scale it when drawn."},
    "frame-redundancy": {"title": {"count": "clusters", "one": "One frame lies on the sheet several times", "other": "{clusters} frames lie on the sheet several times"}, "detail": "One copy of each frees {vram_saved:bytes} of texture memory.", "fix": "Let equal frames share a place."},
    "trim-margin": {"title": {"count": "frames", "one": "One frame has wide clear margins", "other": "{frames} frames have wide clear margins"}, "detail": "Up to {share:pct} of the sheet.", "fix": "Trim frames when packing."},
    "wasted-alpha": {"title": "Opaque, with an alpha channel", "detail": "Without it the file is {disk_saved:bytes} smaller.", "fix": "Encode without alpha."},
    "strippable-metadata": {"title": "{disk_saved:bytes} of metadata", "detail": "Readers of the picture don't need it.", "fix": "Strip it; pixels stay the same."},
    "icc-non-srgb": {"title": "Colour profile that may not be sRGB", "detail": "{icc_bytes:bytes} of profile; renderers that ignore it show other colours.", "fix": "Convert to sRGB."},
    "interior-transparency": {"title": "{share:pct} of its box is clear", "detail": "Clear pixels inside the picture are drawn all the same.", "fix": "Cut it to a mesh or into parts."},
    "binary-alpha": {"title": "Alpha is all or nothing", "detail": "A cut-out needs one bit of it.", "fix": "Consider a format with one bit of alpha."},
    "bleeding": {"title": {"count": "pairs", "one": "One pair of frames touches", "other": "{pairs} pairs of frames touch"}, "detail": "Filtering mixes what lies side by side.", "fix": "Pad frames, and extrude their edges."},
    "excessive-gutter": {"title": "Median gap of {median}px between frames", "detail": {"count": "gaps", "one": "One gap was measured.", "other": "{gaps} gaps were measured."}, "fix": "Pack with less padding."},
    "repack-opportunity": {"title": "A trial pack frees {vram_saved:bytes}", "detail": "Its frames fit a smaller sheet.", "fix": "Pack the sheet anew."},
    "spine-unreferenced-regions": {"title": {"count": "dead", "one": "One region that no skeleton names", "other": "{dead} regions that no skeleton names"}, "detail": "They take {area} pixels.", "fix": "Leave them out."},
    "dimension-mismatch": {"title": "Image isn't as large as its manifest says", "detail": {"count": "off_edge", "one": "One frame reaches over its edge.", "other": "{off_edge} frames reach over its edge."}, "fix": "Export both together."},
    "wasted-regions": {"title": {"count": "n", "one": "One empty area", "other": "{n} empty areas"}, "detail": "They take {area} pixels, the largest {largest}.", "fix": "Pack the sheet anew."},
    "format": {"title": "{disk_saved:bytes} smaller as {target_mime}", "detail": "Measured by a trial encoding.", "fix": "Encode it so."},
    "format-lossless": {"title": "{disk_saved:bytes} smaller as {target_mime}", "detail": "Flat art and hard edges stay crisp without loss.", "fix": "Encode it so, without loss."},
    "font-glyph-page": {"title": {"count": "glyphs", "one": "Font page with one glyph", "other": "Font page with {glyphs} glyphs"}, "detail": "It is {occ:pct} full.", "fix": "Drop glyphs that aren't used."},
    "duplicate-exact": {"title": {"count": "n", "one": "One file", "other": "{n} files of one content"}, "detail": "All but one take {disk_saved:bytes}.", "fix": "Keep one and refer to it."},
    "missing-image": {"title": "{image} is missing", "detail": "{manifest} names it.", "fix": "Add the file or correct the name."},
}


def compile_template(template: Template, params: Column) -> Column:
    """A template as an expression over a map of texts."""
    value = lambda name: F.try_element_at(params, F.lit(name))
    if isinstance(template, dict):
        return F.when(value(template["count"]).try_cast("double") == 1, compile_template(template["one"], params)).otherwise(compile_template(template["other"], params))

    def spelled(name: str, kind: str) -> Column:
        v = value(name)
        n = v.try_cast("double")
        if kind == "bytes":
            v = F.when(v.isNotNull(), F.when(n.isNotNull(), S.format_bytes(n)).otherwise("—"))
        elif kind == "mb":
            v = F.when(v.isNotNull(), F.when(n.isNotNull(), F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB"))).otherwise("—"))
        elif kind == "pct":
            v = F.when(v.isNotNull(), F.when(n.isNotNull(), S.format_value("ratio", n)).otherwise("—"))
        elif kind == "sev":
            v = reduce(lambda c, kv: F.when(v == kv[0], kv[1]).otherwise(c), SEVERITY_WORDS.items(), v)
        elif kind:
            raise ValueError(f"unknown kind of place: {kind}")
        return F.coalesce(v, F.lit(""))

    parts = re.split(r"\{(\w+)(?::(\w+))?\}", template)
    cols = [F.lit(parts[0])]
    for name, kind, rest in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        cols += [spelled(name, kind or ""), F.lit(rest)]
    return F.concat(*cols)


def render(findings: DataFrame, catalog: dict[str, dict[str, Template]] = ENGLISH) -> DataFrame:
    """findings with message and params (map<string,string>): title, detail and fix by the catalogue. Where it has none, the finding's own columns of these names
    stay, if there are such; a message without any title is printed as its key."""
    params = F.col("params")

    def text(part: str) -> Column:
        own = F.col(part) if part in findings.columns else F.lit(None).cast("string")
        out = F.coalesce(own, F.col("message")) if part == "title" else own
        for key, entry in catalog.items():
            if part in entry:
                out = F.when(F.col("message") == key, compile_template(entry[part], params)).otherwise(out)
        return out

    return findings.withColumns({part: text(part) for part in ("title", "detail", "fix")})


def firings(rows: DataFrame, rule: str, ref: str = "asset_ref") -> DataFrame:
    """A rule's firings in the one shape of all rules, without texts: id, rule, severity, ref, message, params, disk_saved, vram_saved. All columns of the rule's
    rows are its parameters; a rule column of theirs, as formats have, names the message."""
    names = [c for c in rows.columns if c not in ("severity", "rule", ref)]
    params = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names])), lambda k, v: v.isNotNull()) if names else F.expr("map()").cast("map<string,string>")
    message = F.col("rule") if "rule" in rows.columns else F.lit(rule)
    figure = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast("long").alias(c)
    severity = F.col("severity") if "severity" in rows.columns else F.lit("warn")
    key = F.col(ref).cast("string")
    return rows.select(F.concat(F.lit(f"{rule}:"), key).alias("id"), F.lit(rule).alias("rule"), severity.alias("severity"), key.alias("ref"), message.alias("message"), params.alias("params"), figure("disk_saved"), figure("vram_saved"))


def as_findings(rows: DataFrame, rule: str, ref: str = "asset_ref") -> DataFrame:
    """A rule's firings as findings with texts: title, detail, fix beside the columns of `firings`."""
    return render(firings(rows, rule, ref))


def all_findings(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Findings with texts of several rules (rule, its rows, the column that is their ref). The texts of all messages are one large expression, which
    takes seconds to make and compile, so it stands once over the firings of all rules."""
    return render(reduce(DataFrame.unionAll, [firings(rows, rule, ref) for rule, rows, ref in parts]))


def _cell(c: Column) -> Column:
    """A cell of a table in Markdown: pipes escaped, line ends as spaces."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"\|", r"\\|"), r"\r?\n", " ")


def _table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(_cell(c), F.lit("")) for c in cells]), F.lit(" |"))


def _printed(head: list[str], rows: DataFrame, keys: list[str]) -> DataFrame:
    """section, keys, line: a table's head and its rows, in order. Order comes from a sort over ranges, so no task holds a whole report."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    top = rows.sparkSession.createDataFrame([(0, t, *[None] * len(keys)) for t in head], f"section int, line string, {kinds}")
    return top.unionByName(rows).select("section", *keys, "line").orderBy("section", *[F.asc_nulls_first(k) for k in keys], F.desc("line"))


def findings_markdown(findings: DataFrame) -> DataFrame:
    """section, rank, ref, rule, id, line: a table of findings, worst first. Savings that weren't measured are blank, not zero."""
    size = lambda c: F.when(F.col(c).isNotNull(), S.format_bytes(F.col(c)))
    line = _table_row(F.col("severity"), F.col("ref"), F.col("title"), F.col("detail"), size("disk_saved"), size("vram_saved"))
    rows = findings.select(F.lit(1).alias("section"), F.expr(SEVERITY_RANK).alias("rank"), "ref", "rule", "id", line.alias("line"))
    return _printed(["| Severity | Asset | Finding | Detail | Disk saved (est.) | Texture bytes saved (est.) |", "| --- | --- | --- | --- | --- | --- |"], rows, ["rank", "ref", "rule", "id"])


def gate_markdown(rows: DataFrame, units: dict[str, str]) -> DataFrame:
    """section, metric, ref, level, chk, line: a table of a gate's checks, as `gate.evaluate` gives them."""
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    show = lambda c: reduce(lambda out, u: F.when(F.try_element_at(unit, F.col("metric")) == u, S.format_value(u, F.col(c))).otherwise(out), ("bytes", "ratio", "px", "count"), F.col(c).cast("string"))
    state = F.when(~F.col("breach"), "pass").when(F.col("level") == "error", "error").otherwise("warn")
    budget = F.concat(F.col("chk"), F.lit(" "), F.when(F.col("chk") == "maxDeltaPct", F.concat(S.format_value("count", F.col("budget")), F.lit("%"))).otherwise(show("budget")))
    rounded = S.round_half_up(F.col("delta_pct"), 1)
    delta = F.when(F.col("delta_pct").isNull(), "—").when(F.col("delta_pct") == float("inf"), "new").otherwise(F.concat(F.when(rounded >= 0, "+").otherwise(""), S.format_value("count", rounded), F.lit("%")))
    line = _table_row(state, F.concat(F.lit("`"), "metric", F.lit("`")), F.coalesce("ref", F.lit("global")), budget, show("value"), delta)
    out = rows.select(F.lit(1).alias("section"), "metric", "ref", "level", "chk", line.alias("line"))
    return _printed(["| | Metric | Scope | Budget | Value | Δ |", "| --- | --- | --- | --- | --- | --- |"], out, ["metric", "ref", "level", "chk"])


def diff_markdown(diff: DataFrame, titles: DataFrame) -> DataFrame:
    """diff: as `gate.diff_findings` gives it. titles: id, title, ref. section, rank, id, line: added findings, then resolved and changed ones; a change for the worse is
    told from one for the better."""
    rank = lambda c: F.expr(SEVERITY_RANK.replace("severity", c))
    d = diff.join(titles, "id", "left").withColumn("section", F.when(F.col("status") == "added", 1).when(F.col("status") == "resolved", 2).otherwise(3))
    head = F.when(F.col("section") == 1, F.concat(F.lit("- **added** `"), "after", F.lit("` "))).when(F.col("section") == 2, F.concat(F.lit("- **resolved** `"), "before", F.lit("` ")))
    head = head.otherwise(F.concat(F.when(rank("after") < rank("before"), "- **worse** `").otherwise("- **better** `"), "before", F.lit("`→`"), "after", F.lit("` ")))
    line = F.concat(head, F.coalesce(_cell(F.col("title")), F.col("id")), F.lit(" — `"), F.coalesce(_cell(F.col("ref")), F.lit("")), F.lit("`"))
    return _printed([], d.select("section", F.when(F.col("after").isNull(), rank("before")).otherwise(rank("after")).alias("rank"), "id", line.alias("line")), ["rank", "id"])
