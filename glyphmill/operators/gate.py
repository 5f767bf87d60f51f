"""Budget gate, diffs of audits, rankings and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.config import RULES
from glyphmill.functions import scalars as S

SEVERITY_RANK = "case severity when 'crit' then 0 when 'warn' then 1 when 'info' then 2 else 3 end"


def global_metrics(totals: DataFrame, findings: DataFrame, saved: DataFrame, assets: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """metric, value in long form. saved: one row, potential; assets: a row for each texture, each of which takes a draw call at least."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"findings.{s}") for s in ("crit", "warn", "info")], F.count("*").alias("findings.total"), *[F.count_if(F.col("rule") == r).alias(f"findings.{r}") for r in rules])
    t = totals.select(F.col("disk").alias("totals.diskBytes"), F.col("vram").alias("totals.vramBytes"), F.col("loaded").alias("totals.loadedVramBytes"))
    t = t.crossJoin(saved.select(F.col("potential").cast("long").alias("totals.potentialDiskSaved"))).crossJoin(assets.agg(F.count("*").alias("drawCallsLowerBound"))).crossJoin(n)
    return t.unpivot([], [F.col(f"`{c}`") for c in t.columns], "metric", "value")


def asset_metrics(metrics: DataFrame) -> DataFrame:
    """asset_ref, metric, value of what is measured."""
    names = {"vramBytes": "vram", "diskBytes": "disk", "occupancy": "occupancy", "oversizePx": "oversizePx"}
    m = metrics.select("asset_ref", *[F.col(c).cast("double").alias(k) for k, c in names.items()])
    return m.unpivot(["asset_ref"], list(names), "metric", "value").filter("value is not null")


def evaluate(values: DataFrame, budgets: DataFrame, baseline: DataFrame | None = None, ignore: list[str] | None = None) -> DataFrame:
    """values: scope, ref, metric, value. budgets: ord, scope, match, metric, level, chk, budget. A row for each value and check, the passing too:
    scope, ref, metric, level, chk, value, budget, delta_pct, breach.

    An asset has the first entry whose pattern matches it; what a pattern to ignore matches has none. Growth over a baseline of nothing is infinite, and passes without a baseline.
    """
    w = Window.partitionBy("ref").orderBy("ord")
    refs = values.filter("scope = 'asset'").select("ref").distinct()
    for pattern in ignore or []:
        refs = refs.filter(~F.regexp_like("ref", F.lit(pattern)))
    entries = F.broadcast(budgets.filter("scope = 'asset'").select("ord", "match").distinct())
    first = refs.join(entries, F.regexp_like("ref", F.col("match"))).withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("ref", "ord")
    asset = values.filter("scope = 'asset'").join(first, "ref").join(F.broadcast(budgets.filter("scope = 'asset'").drop("match")), ["scope", "ord", "metric"])
    overall = values.filter("scope = 'global'").join(F.broadcast(budgets.filter("scope = 'global'").drop("match", "ord")), ["scope", "metric"])
    cols = ["scope", "ref", "metric", "level", "chk", "value", "budget"]
    rows = asset.select(cols).unionByName(overall.select(cols))
    if baseline is None:
        rows = rows.withColumn("base", F.lit(None).cast("double"))
    else:
        b = baseline.select("scope", "ref", "metric", F.col("value").alias("base"))
        rows = rows.join(b.withColumnsRenamed({"scope": "bs", "ref": "br", "metric": "bm"}), (F.col("scope") == F.col("bs")) & F.col("ref").eqNullSafe(F.col("br")) & (F.col("metric") == F.col("bm")), "left")
    pct = F.when(F.col("base").isNull(), None).when((F.col("base") <= 0) & (F.col("value") > 0), float("inf")).when(F.col("base") <= 0, 0.0).otherwise((F.col("value") - F.col("base")) / F.col("base") * 100)
    rows = rows.withColumn("delta_pct", pct)
    breach = F.when(F.col("chk") == "max", F.col("value") > F.col("budget")).when(F.col("chk") == "min", F.col("value") < F.col("budget")).otherwise(F.coalesce(F.col("delta_pct") > F.col("budget"), F.lit(False)))
    return rows.select(*cols, "delta_pct", breach.alias("breach"))


def verdict(rows: DataFrame) -> DataFrame:
    """One row: errors, warnings, verdict, exit code."""
    n = rows.agg(F.count_if(F.col("breach") & (F.col("level") == "error")).alias("errors"), F.count_if(F.col("breach") & (F.col("level") == "warn")).alias("warnings"))
    return n.select("errors", "warnings", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass").alias("verdict"), F.when(F.col("errors") > 0, 1).otherwise(0).alias("exit_code"))


def worst_first(rows: DataFrame, most: int = 10) -> DataFrame:
    """Breaches, errors first, then by how far they are over."""
    over = F.abs(F.try_divide(F.col("value") - F.col("budget"), F.col("budget")))
    return rows.filter("breach").withColumn("over", over).orderBy(F.when(F.col("level") == "error", 0).otherwise(1), F.desc_nulls_last("over"), "ref", "metric").limit(most)


def diff_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta, pct (null where before is 0)."""
    j = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric")
    d = F.col("after") - F.col("before")
    return j.select("metric", "before", "after", d.alias("delta"), F.try_divide(d.cast("double") * 100, F.col("before").cast("double")).alias("pct"))


def diff_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, status (added, resolved, changed), severities: of rows with one id the last (by ord) holds."""

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("id").agg(F.max_by("severity", "ord").alias(name))

    j = last(before, "before").join(last(after, "after"), "id", "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "resolved").when(F.col("before") != F.col("after"), "changed")
    return j.withColumn("status", status).filter("status is not null")


def has_regression(diff: DataFrame, level: str = "crit") -> DataFrame:
    """Whether findings of at least that severity were added or got worse."""
    rank = lambda c: F.expr(SEVERITY_RANK.replace("severity", c))
    most = {"crit": 0, "warn": 1, "any": 3}[level]
    worse = (F.col("status") == "added") | ((F.col("status") == "changed") & (rank("after") < rank("before")))
    return diff.agg((F.count_if(worse & (rank("after") <= most)) > 0).alias("regression"))


def biggest_wins(findings: DataFrame, most: int = 3) -> DataFrame:
    """The findings that free most, for disk and for texture bytes apart."""
    f = findings.withColumn("rank_", F.expr(SEVERITY_RANK)).unpivot(["id", "asset_ref", "severity", "rank_"], ["disk_saved", "vram_saved"], "axis", "bytes").filter("bytes > 0")
    w = Window.partitionBy("axis").orderBy(F.desc("bytes"), "rank_", "asset_ref", "id")
    return f.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("axis", "place", "id", "asset_ref", "bytes")


def filter_findings(findings: DataFrame, severity: str) -> DataFrame:
    rank = {"crit": 0, "warn": 1, "info": 2, "ok": 3}[severity]
    return findings.filter(F.expr(SEVERITY_RANK) <= rank)


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.expr(SEVERITY_RANK), "asset_ref", "rule", "id")


def triage(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Tally by severity, and assets without any finding beyond ok."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("crit", "warn", "info", "ok")])
    clean = assets.join(findings.filter("severity <> 'ok'").select("asset_ref"), "asset_ref", "left_anti").agg(F.count("*").alias("clean"))
    return n.crossJoin(clean)


def worst_per_asset(findings: DataFrame) -> DataFrame:
    """Each asset's worst finding, ties by id."""
    w = Window.partitionBy("asset_ref").orderBy(F.expr(SEVERITY_RANK), "id")
    return findings.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("asset_ref", "id", "rule", "severity")


def loose_dominated(findings: DataFrame, images: DataFrame, fraction: float = 0.5, small: int = 512, least: int = 8) -> DataFrame:
    """images: asset_ref, loose, w, h. asset_ref, id, rule, share: the notes that fold into one recommendation to pack, where small loose images are at least that
    fraction of all and `least` in number: sizes and formats of loose images, never critical ones."""
    is_small = F.col("loose") & (F.greatest("w", "h") <= small)
    share = images.agg(F.count_if(is_small).alias("k"), F.try_divide(F.count_if(is_small), F.count("*")).alias("share")).filter((F.col("share") >= fraction) & (F.col("k") >= least)).select("share")
    fold = findings.filter(F.col("rule").isin("dimensions-npot", "format") & (F.col("severity") != "crit")).join(images.filter("loose").select("asset_ref").distinct(), "asset_ref", "left_semi")
    return fold.select("asset_ref", "id", "rule").crossJoin(F.broadcast(share))  # one row or none


def budget_model(totals: DataFrame, limit: int) -> DataFrame:
    """Share of a texture budget that is used, whether it is over, and what is left."""
    return totals.select("loaded", F.lit(limit).cast("long").alias("limit"), (F.floor(F.col("loaded") * 1000.0 / limit + 0.5) / 10).alias("pct"), (F.col("loaded") > limit).alias("over"), F.greatest(F.lit(limit).cast("long") - F.col("loaded"), F.lit(0).cast("long")).alias("left"))


# fixed values: the groups of rules in their order, and the rules of each
RULE_GROUPS = {
    "integrity": ("integrity-missing-image", "dimension-mismatch", "bleeding", "icc-non-srgb", "premultiplied-alpha", "dimensions-npot", "dimensions-oversize"),
    "savings": ("format", "strippable-metadata", "solid-fill", "upscaled-source", "wasted-alpha", "binary-alpha", "duplicate-exact", "duplicate-similar", "frame-redundancy", "cross-atlas-redundancy", "loose-in-atlas"),
    "packing": ("occupancy", "wasted-regions", "trim-margin", "excessive-gutter", "spine-unreferenced-regions", "interior-transparency", "should-atlas", "atlas-merge", "repack-opportunity"),
    "vram": ("variants", "gpu-compression-alignment", "mipmap-cost", "font-glyph-page"),
}


def rule_rollup(findings: DataFrame) -> DataFrame:
    """Findings by group, rule and severity, with subtotals."""
    names = F.create_map(*[F.lit(x) for group, rules in RULE_GROUPS.items() for rule in rules for x in (rule, group)])
    f = findings.withColumn("rule_group", F.coalesce(F.try_element_at(names, F.col("rule")), F.lit("other")))
    return f.rollup("rule_group", "rule", "severity").agg(F.count("*").alias("n"))


def budget_verdicts(model: DataFrame, vram: int | None = None, draws: int | None = None, disk: int | None = None) -> DataFrame:
    """model: loaded, measured_vram, measured_draws (both null without a probe), draw_floor, disk. A row for each budget that is set, and
    a second for measured texture bytes: metric, basis, state, budget, value, over_by, ratio, clamp_pct, tone, fill.

    A value at its budget is within it. The draw floor is a lower bound: it can prove that a budget is broken, never that it is kept.
    """
    rows = []
    if vram is not None:
        rows += [("vram", "declared", vram, "loaded", "overDeclared", "withinDeclared"), ("vram", "measured", vram, "measured_vram", "over", "within")]
    if draws is not None:
        rows += [("draw", "measured", draws, "measured_draws", "over", "within"), ("draw", "floor", draws, "draw_floor", "floorOver", "floorUnknown")]
    if disk is not None:
        rows += [("disk", "measured", disk, "disk", "over", "within")]
    kind = "array<struct<metric string, basis string, budget long, value long, over string, under string>>"
    each = [F.struct(F.lit(m), F.lit(b), F.lit(n).cast("long"), F.col(c).cast("long"), F.lit(over), F.lit(under)) for m, b, n, c, over, under in rows]
    r = model.select("measured_draws", F.inline((F.array(*each) if each else F.array()).cast(kind)))
    r = r.filter("value is not null and not (basis = 'floor' and measured_draws is not null)")
    is_over, ratio = F.col("value") > F.col("budget"), F.when(F.col("budget") > 0, F.col("value").cast("double") / F.col("budget")).otherwise(0.0)
    return r.select(
        "metric", "basis", F.when(is_over, F.col("over")).otherwise(F.col("under")).alias("state"), "budget", "value", (F.col("value") - F.col("budget")).alias("over_by"), ratio.alias("ratio"), F.least(F.lit(100), F.floor(ratio * 100 + 0.5)).cast("int").alias("clamp_pct"),
        F.when(is_over, "crit").otherwise("neutral").alias("tone"), F.when(is_over, "crit").when(F.col("basis") == "floor", "neutral").otherwise("ok").alias("fill"),
    )


# fixed values: metrics that the history shows
HISTORY_METRICS = ("totals.diskBytes", "totals.vramBytes", "totals.loadedVramBytes", "totals.potentialDiskSaved", "drawCallsLowerBound")


def history_rows(diff: DataFrame) -> DataFrame:
    """Headline metrics of a diff that moved: metric, before, after, delta, bytes."""
    return diff.filter(F.col("metric").isin(*HISTORY_METRICS) & (F.col("delta") != 0)).select("metric", "before", "after", "delta", (F.col("metric") != "drawCallsLowerBound").alias("bytes"))


def totals_rows(model: DataFrame) -> DataFrame:
    """model: disk, loaded, measured_vram (null without a probe), potential. place, key, value as reports print them."""
    text = lambda c: S.format_value("bytes", F.col(c))
    saveable = F.concat(text("potential"), F.lit(" · "), S.saved_percent(F.col("potential"), F.col("disk")).cast("string"), F.lit("%"))
    rows = [("disk", text("disk")), ("declared", text("loaded")), ("measured", text("measured_vram")), ("saveable", saveable)]
    return model.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(rows)]))).filter("value is not null")


def budget_scaffold(totals: DataFrame) -> DataFrame:
    """metric, level, chk, budget: a first gate with a fifth of headroom over what was measured, in whole megabytes, one at least."""
    mb = lambda c: F.concat(F.greatest(F.lit(1), F.ceil(F.col(c).cast("double") * 1.2 / 1048576)).cast("string"), F.lit("MB"))
    rows = [("totals.diskBytes", "max", mb("disk")), ("totals.diskBytes", "maxDeltaPct", F.lit("15")), ("totals.loadedVramBytes", "max", mb("loaded")), ("findings.crit", "max", F.lit("0"))]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("error").alias("level"), F.lit(c).alias("chk"), b.alias("budget")) for m, c, b in rows])))


def scaffold_config(rows: list) -> dict:
    """The rows of a scaffold (a handful, collected) as the configuration that parse_budget reads."""
    budgets: dict = {}
    for r in rows:
        budgets.setdefault(r["metric"], {}).setdefault(r["level"], {})[r["chk"]] = r["budget"]
    return {"version": 1, "budgets": budgets}
