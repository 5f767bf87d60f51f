"""Runtime frames as a stream: per-session counters over an unbounded stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WARM_UP = 30


def minute_activity(frames: DataFrame, late: str = "1 minute", size: str = "1 minute") -> DataFrame:
    """Frames, draws and slow frames by session and event-time window; state is dropped behind the watermark."""
    f = frames.withWatermark("ts", late)
    return f.groupBy(F.window("ts", size), "session").agg(F.count("*").alias("frames"), F.sum("draws").alias("draws"), F.count_if(F.col("dt") > 16).alias("slow"))


def session_counters(frames: DataFrame, warm_up: int = WARM_UP) -> DataFrame:
    """Running totals of each session, in update mode: frames, those after warm-up, and of the latter draws, redundant binds, uploads and the longest frame.

    The state of a session is a handful of numbers, however long the session runs.
    """
    names = ["frames", "play", "draws", "redundant", "uploads", "longest"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = list(state.get) if state.exists else [0, 0, 0, 0, 0, 0.0]
        for pdf in batches:
            pdf = pdf.sort_values("seq", kind="stable")
            seen = total[0]
            after = pdf.iloc[max(0, warm_up - seen) :]
            total = [seen + len(pdf), total[1] + len(after), total[2] + int(after["draws"].sum()), total[3] + int(after["redundant"].sum()), total[4] + int(after["uploads"].sum()), max(total[5], float(after["dt"].max()) if len(after) else 0.0)]
        state.update(tuple(total))
        yield pd.DataFrame([[key[0], *total]], columns=["session", *names])

    kind = frames.schema["session"].dataType.simpleString()
    out = "frames long, play long, draws long, redundant long, uploads long, longest double"
    return frames.groupBy("session").applyInPandasWithState(update, f"session {kind}, {out}", out, "update", GroupStateTimeout.NoTimeout)
