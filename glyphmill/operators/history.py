"""Metric history: a versioned table of snapshots, and each audit against the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
SNAPSHOT = "v int, label string, at_ms long, metrics map<string,double>, size long"
#: Bytes beyond which a snapshot isn't kept: a cut one would give a wrong difference.
MOST_BYTES = 2 * 1024 * 1024


def snapshots(metrics: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """metrics: label, at_ms, metric, value. A snapshot of each audit of a label; findings (label, at_ms, id, rule, ref, severity, title) count towards its size."""
    m = metrics.groupBy("label", "at_ms").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"), F.sum(F.length("metric") + F.lit(20)).alias("size"))
    if findings is not None:
        f = findings.groupBy("label", "at_ms").agg(F.sum(F.length(F.to_json(F.struct("id", "rule", "ref", "severity", "title"))) + 1).alias("more"))
        m = m.join(f, ["label", "at_ms"], "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
    return m.select(F.lit(VERSION).alias("v"), "label", "at_ms", "metrics", F.col("size").cast("long").alias("size"))


def keep(snaps: DataFrame, path: str, most: int = MOST_BYTES) -> None:
    """Append snapshots to the table at a path, by day of the audit. Those that are too large are left out whole."""
    day = F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd")
    snaps.filter(F.col("size") <= most).withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots at a path. Of several of one label and time the largest counts, by its metrics' order; other versions and snapshots without a label, time or
    metrics are passed over, as if there were none."""
    s = spark.read.schema(SNAPSHOT + ", day string").parquet(path).drop("day")
    s = s.filter((F.col("v") == VERSION) & F.col("label").isNotNull() & F.col("at_ms").isNotNull() & F.col("metrics").isNotNull())
    w = Window.partitionBy("label", "at_ms").orderBy(F.desc("size"), F.map_entries("metrics"))
    return s.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def previous(audits: DataFrame, history: DataFrame) -> DataFrame:
    """An as-of join: each audit (label, at_ms, metrics) with the latest snapshot of its label from before it, as before_at and before; null where there is none.

    Both sides run through one window by label and time, so no pair is built but the one that is asked for. A snapshot of the audit's own time isn't
    before it.
    """
    both = audits.select("label", "at_ms", F.lit(0).alias("side"), F.col("metrics").alias("mine"), F.lit(None).cast("struct<at_ms:bigint,metrics:map<string,double>>").alias("snap"))
    both = both.unionByName(history.select("label", "at_ms", F.lit(1).alias("side"), F.lit(None).cast("map<string,double>").alias("mine"), F.struct("at_ms", "metrics").alias("snap")))
    w = Window.partitionBy("label").orderBy("at_ms", "side").rowsBetween(Window.unboundedPreceding, -1)
    j = both.withColumn("last", F.last("snap", ignorenulls=True).over(w)).filter("side = 0")
    return j.select("label", "at_ms", F.col("mine").alias("metrics"), F.col("last.at_ms").alias("before_at"), F.col("last.metrics").alias("before"))


def changes(audits: DataFrame) -> DataFrame:
    """audits: as `previous` gives them. label, at_ms, before_at, metric, before, after, delta, pct (null where before is 0) of the metrics that both have and that moved."""
    m = audits.filter("before is not null").select("label", "at_ms", "before_at", "before", F.explode("metrics").alias("metric", "after"))
    m = m.withColumn("before", F.try_element_at("before", F.col("metric"))).filter("before is not null and before <> after")
    d = F.col("after") - F.col("before")
    return m.select("label", "at_ms", "before_at", "metric", "before", "after", d.alias("delta"), F.try_divide(d * 100, F.col("before")).alias("pct"))
