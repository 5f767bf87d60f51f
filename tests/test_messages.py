"""Texts of findings and printed reports."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import messages as M

CASES = [
    ("{n} files", {"n": "3"}, "3 files"), ("{a}{b}", {"b": "x"}, "x"), ("{size:bytes} and {size:mb}", {"size": "1572864"}, "1.5 MB and 1.5 MB"), ("{size:bytes}", {"size": "900"}, "900 B"), ("{s:pct}", {"s": "0.4567"}, "45.7%"), ("{s:pct}", {"s": "0.5"}, "50%"),
    ("{s:sev}!", {"s": "crit"}, "critical!"), ("{s:sev}", {"s": "odd"}, "odd"), ("plain", {}, "plain"), ("{size:bytes}", {"size": "many"}, "—"), ({"count": "n", "one": "one file", "other": "{n} files"}, {"n": "1"}, "one file"), ({"count": "n", "one": "one file", "other": "{n} files"}, {"n": "0"}, "0 files"),
    ({"count": "n", "one": "one file", "other": "{n} files"}, {}, " files"),
]


@pytest.mark.parametrize("template,params,want", CASES)
def test_templates(spark, template, params, want):
    df = spark.createDataFrame([(params,)], "params map<string,string>")
    assert df.select(M.compile_template(template, F.col("params"))).first()[0] == want


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        M.compile_template("{x:furlongs}", F.lit(None))


def test_findings_without_an_entry_keep_their_own_texts(spark):
    f = spark.createDataFrame([("own", {"a": "1"}, "baked", "in"), ("occupancy", {"occ": "0.25", "wasted_bytes": "2048"}, "baked", "in"), ("bare", {}, None, None)], "message string, params map<string,string>, title string, detail string")
    got = {r.message: (r.title, r.detail, r.fix) for r in M.render(f).collect()}
    assert got == {"own": ("baked", "in", None), "occupancy": ("Sheet is 25% full", "2.0 KB of texture memory hold no frame.", "Pack the sheet anew."), "bare": ("bare", None, None)}


def test_every_rule_has_a_title():
    from glyphmill.operators.gate import RULE_GROUPS

    whole_folder = {"premultiplied-alpha", "duplicate-similar", "cross-atlas-redundancy", "loose-in-atlas", "should-atlas", "atlas-merge", "variants", "gpu-compression-alignment", "mipmap-cost", "integrity-missing-image"}
    assert {r for rules in RULE_GROUPS.values() for r in rules} - whole_folder <= set(M.ENGLISH)
    assert all({"title", "detail", "fix"} == set(e) for e in M.ENGLISH.values())


def test_printed_findings_are_in_order_and_cells_are_safe(spark):
    f = spark.createDataFrame([("a:2", "r", "warn", "b|c", "one\ntwo", "d", 2048, None), ("a:1", "r", "crit", "z", "t", "d", None, 0), ("a:3", "q", "warn", "b|c", "t", None, 1, 1)], "id string, rule string, severity string, ref string, title string, detail string, disk_saved long, vram_saved long")
    got = [r.line for r in M.findings_markdown(f).collect()]
    assert got[0].startswith("| Severity") and got[1].startswith("| ---")
    assert got[2:] == ["| crit | z | t | d |  | 0 B |", "| warn | b\\|c | t |  | 1 B | 1 B |", "| warn | b\\|c | one two | d | 2.0 KB |  |"]


def test_printed_diffs(spark):
    d = spark.createDataFrame([("f1", None, "crit", "added"), ("f2", "warn", None, "resolved"), ("f3", "warn", "crit", "changed"), ("f4", "crit", "info", "changed")], "id string, before string, after string, status string")
    t = spark.createDataFrame([("f1", "new", "x"), ("f3", "hot", "y")], "id string, title string, ref string")
    assert [r.line for r in M.diff_markdown(d, t).collect()] == ["- **added** `crit` new — `x`", "- **resolved** `warn` f2 — ``", "- **worse** `warn`→`crit` hot — `y`", "- **better** `crit`→`info` f4 — ``"]


def test_texts_of_several_rules_are_one_expression(spark, monkeypatch):
    a = spark.createDataFrame([(1, 3000, "crit"), (2, 2100, "warn")], "asset_ref long, longest long, severity string")
    b = spark.createDataFrame([("x.png", 2048, 9)], "first string, disk_saved long, n long")
    calls = []
    once = M.render
    monkeypatch.setattr(M, "render", lambda f: calls.append(f) or once(f))
    got = M.all_findings([("dimensions-oversize", a, "asset_ref"), ("duplicate-exact", b, "first")])
    assert len(calls) == 1
    apart = M.as_findings(a, "dimensions-oversize").unionByName(M.as_findings(b, "duplicate-exact", "first"))
    assert got.columns == apart.columns and sorted(map(str, got.collect())) == sorted(map(str, apart.collect()))
