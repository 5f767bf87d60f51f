"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_glyphmill_shared", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:  # tests
        root = "file://" + tempfile.mkdtemp(prefix="glyphmill-shared-")
        sc._glyphmill_shared = root
        sc.setCheckpointDir(root)
    return (root if "://" in root else f"file://{root}").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a table and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
