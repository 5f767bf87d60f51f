"""Skeleton files: their attachments as rows, and whether the regions that these need are there."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.storage import written

# fixed values: kinds of attachments that need no region, and those that take their parent's
WITHOUT_REGION = ("clipping", "point", "boundingbox", "path")
LINKED = ("linkedmesh", "weightedlinkedmesh")
_COLUMNS = ("skin_ord", "skin", "slot_ord", "slot", "attachment", "type", "region_path", "parent", "parent_skin", "whole")
ATTACHMENT = "path string, skin_ord long, skin string, slot_ord long, slot string, attachment string, type string, region_path string, parent string, parent_skin string, whole boolean"


def attachment_rows(text: str | None) -> list[tuple] | None:
    """A skeleton's attachments in order; None where the text isn't a skeleton whose skins have one of the two known shapes. whole: the
    attachment has a body of its own."""
    try:
        skins = json.loads(text or "")["skins"]
    except (ValueError, KeyError, TypeError):
        return None
    if isinstance(skins, dict):
        skins = [{"name": k, "attachments": v} for k, v in skins.items()]
        if not all(isinstance(s["attachments"], dict) for s in skins):
            return None
    if not isinstance(skins, list) or not all(isinstance(s, dict) for s in skins):
        return None
    text_of = lambda v: v if isinstance(v, str) else None
    rows = []
    for i, skin in enumerate(skins):
        slots = skin.get("attachments")
        for j, (slot, held) in enumerate(slots.items() if isinstance(slots, dict) else ()):
            for name, body in held.items() if isinstance(held, dict) else ():
                b = body if isinstance(body, dict) else {}
                rows.append((i, text_of(skin.get("name")) or "", j, slot, name, text_of(b.get("type")) or "region", text_of(b.get("path")), text_of(b.get("parent")), text_of(b.get("skin")), isinstance(body, dict)))
        if not (isinstance(slots, dict) and slots):
            rows.append((i, text_of(skin.get("name")) or "", *[None] * 7, False))
    return rows


def attachments(files: DataFrame) -> DataFrame:
    """files: path, text. A row for each attachment; skins without any have a row of their own, and a file of an unknown shape one of nulls alone."""

    types = dict(zip(("path", *_COLUMNS), (pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 6, pa.bool_()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = attachment_rows(text)
                out += [(path, *[None] * 10)] if rows is None else [(path, *r) for r in rows]
            cols = list(zip(*out, strict=True)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))

    return files.select("path", "text").mapInArrow(run, ATTACHMENT)


def required_regions(parts: DataFrame) -> DataFrame:
    """path, skin, slot, attachment, region: what each attachment asks for. A linked mesh takes its parent's region, from the skin it names if the
    file has that, otherwise from its own; of several slots with the parent the first counts. Without a parent there it asks for nothing.

    Parts are written once, since they are read several times and files would be parsed as often."""
    return _required(written(parts, "attachments"))


def _required(parts: DataFrame) -> DataFrame:
    a = parts.filter("attachment is not null")
    plain = a.filter(~F.col("type").isin(*WITHOUT_REGION, *LINKED)).select("path", "skin", "slot", "attachment", F.coalesce("region_path", "attachment").alias("region"))
    skins = parts.filter("skin is not null").groupBy("path", "skin").agg(F.max("skin_ord").alias("skin_ord"))  # of skins that share a name the last is meant
    linked = a.filter(F.col("type").isin(*LINKED) & F.col("parent").isNotNull())
    linked = linked.join(skins.select("path", F.col("skin").alias("parent_skin"), F.col("skin_ord").alias("named")), ["path", "parent_skin"], "left")
    linked = linked.join(skins.select("path", "skin", F.col("skin_ord").alias("own")), ["path", "skin"]).withColumn("look", F.coalesce("named", "own"))
    parents = a.filter("whole").groupBy("path", F.col("skin_ord").alias("look"), F.col("attachment").alias("parent")).agg(F.min_by(F.coalesce("region_path", "attachment"), "slot_ord").alias("region"))
    return plain.unionByName(linked.join(parents, ["path", "look", "parent"]).select("path", "skin", "slot", "attachment", "region"))


def verify_skeletons(parts: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """regions: path, name, what was packed for each skeleton. (path, verified, unmatched, unverified of each file; the attachments whose region is missing.)

    A file of an unknown shape is unverified: nothing is counted for it, rather than none of none.
    """
    parts = written(parts, "attachments")
    need = _required(parts)
    have = regions.select("path", F.col("name").alias("region")).distinct().withColumn("there", F.lit(True))
    j = need.join(have, ["path", "region"], "left")
    counts = j.groupBy("path").agg(F.count("there").alias("verified"), F.count_if(F.col("there").isNull()).alias("unmatched"))
    shape = parts.groupBy("path").agg((F.count("skin") == 0).alias("unverified"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = shape.join(counts, "path", "left").select("path", zero(F.col("verified")).alias("verified"), zero(F.col("unmatched")).alias("unmatched"), "unverified")
    return total, j.filter("there is null").drop("there")
