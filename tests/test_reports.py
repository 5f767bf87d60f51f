import json

import pytest
from pyspark.sql import functions as F

from glyphmill.plans import reports as P


@pytest.fixture
def findings(spark):
    return spark.createDataFrame([("b", "npot", "info", "x", None, 5), ("a", "occ", "crit", 'y "q"', 7, None)], "id string, rule string, severity string, asset_ref string, disk_saved long, vram_saved long")


def test_lines_and_csv(spark, findings, tmp_path):
    rows = [json.loads(r.value) for r in P.json_lines(findings).collect()]
    assert [r["id"] for r in rows] == ["a", "b"] and "vram_saved" not in rows[0]
    P.write_csv(findings.coalesce(1), str(tmp_path / "csv"))
    text = [p.read_text() for p in (tmp_path / "csv").glob("*.csv")]
    assert '"y ""q"""' in "".join(text) and ",7," in "".join(text)


def test_audits_and_sessions_read_back(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"findings": [{"id": "a", "rule": "r", "severity": "warn", "asset_ref": "x"}], "totals": {"disk": 1}}))
    assert [(r.id, r.ord, r.disk_saved) for r in P.read_audits(spark, str(tmp_path / "a.json")).collect()] == [("a", 0, None)]
    (tmp_path / "s.json").write_text(json.dumps({"runtime": {"session": "s", "frames": 5, "duration": 1.0}}))
    assert P.read_sessions(spark, str(tmp_path / "s.json")).first().frames == 5
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(Exception, match="no frames"):
        P.read_sessions(spark, str(tmp_path / "n.json")).collect()


def test_manifests_profiles_and_skeletons(spark):
    placed = spark.createDataFrame([("s", "b", 0, 0, 1, 2, "p.png", 8, 8), ("s", "a", 1, 0, 3, 4, "p.png", 8, 8)], "asset_ref string, name string, x int, y int, w int, h int, page string, page_w int, page_h int")
    m = json.loads(P.sheet_manifests(placed).first().manifest)
    assert list(m["frames"]) == ["a", "b"] and m["frames"]["a"]["frame"]["w"] == 3 and m["meta"]["size"] == {"w": 8, "h": 8}
    refs = spark.createDataFrame([("ui/a",), ("b",)], "ref string")
    over = spark.createDataFrame([(0, ".*", 80, "webp"), (1, "^ui/", 60, None)], "ord int, match string, quality int, format string")
    assert {r.ref: (r.quality, r.format) for r in P.resolved_profiles(refs, over, ("quality", "format")).collect()} == {"ui/a": (60, "webp"), "b": (80, "webp")}
    asked = spark.createDataFrame([("s", "name", "x"), ("s", "name", "y"), ("s", "prefix", "run_"), ("s", "prefix", "fly_")], "path string, kind string, value string")
    gaps = P.skeleton_gaps(asked, spark.createDataFrame([("x",), ("run_01",)], "name string")).collect()
    assert {r.value for r in gaps} == {"y", "fly_"}
    n = spark.range(1).select(P.hashed_name(F.lit("a/b.png"), F.lit("x").cast("binary")).alias("n")).first().n
    assert n.startswith("a/b-") and n.endswith(".png") and len(n) == len("a/b-12345678.png")
    b = spark.createDataFrame([("m", "x/a.png", "@1x"), ("m", "y/a.png", "@1x"), ("m", "y/b.png", "@1x")], "bundle string, path string, suffix string")
    assert P.bundle_manifest(b).first().paths == "x/a.png,y/b.png"
    br = spark.createDataFrame([(None, "crit", "error", 3.0, 0.0, True), ("x", "disk", "warn", 3.0, 9.0, False)], "ref string, metric string, level string, value double, budget double, breach boolean")
    assert [(r.ruleId, r.level, r.uri) for r in P.sarif_results(br).collect()] == [("budget/crit", "error", ".")]
