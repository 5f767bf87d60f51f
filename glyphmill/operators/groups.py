"""Kernels over whole groups: rows reach a task sorted by group, and many small groups share a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut anew so that no group goes on in the next: what is held is one batch and the group at hand."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held and held[-1][key].iloc[-1] != pdf[key].iloc[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = int((pdf[key] == pdf[key].iloc[-1]).to_numpy().argmax())  # where the last group begins
        if last:
            yield pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
            held = []
        held.append(pdf.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def over_chunks(df: DataFrame, key: str, order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema, spread: bool = False) -> DataFrame:
    """Run a kernel over frames of whole groups. spread: groups that lie together already are dealt anew too, into as many tasks; otherwise Spark
    spares that shuffle and may put all of few rows into one task, however long the kernel takes for them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(key) if spread else key).sortWithinPartitions(key, *order).mapInPandas(lambda batches: map(kernel, whole_groups(batches, key)), schema)


def over_groups(df: DataFrame, key: str, order: list[str], kernel: Callable[[dict[str, list]], list[tuple]], names: list[str], schema, spread: bool = False) -> DataFrame:
    """Run a kernel over each group's rows, as lists by column. spread: as in `over_chunks`."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(pdf)]
        cols = {c: pdf[c].tolist() for c in pdf.columns}
        return pd.DataFrame([r for a, b in zip(cuts, cuts[1:], strict=False) for r in kernel({c: v[a:b] for c, v in cols.items()})], columns=names)

    return over_chunks(df, key, order, settle, schema, spread)
