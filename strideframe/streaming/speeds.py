"""Speeds over a stream of points: the last present point of each series is state, so that a batch boundary is no gap.

A row that comes late, behind one of a later time, has no speed and does not become the last point. State is three numbers for
each series and stays: a time-out would end series that pause, and by the clock it would never let a finite stream end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "clip_id string, joint_name string, frame_index long, timestamp_sec double, speed double"


def _speeds(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable")
    out = []
    for frame, t, x, y in rows[["frame_index", "timestamp_sec", "x", "y"]].itertuples(index=False):
        speed = None
        if not (pd.isna(x) or pd.isna(y)):
            if last is not None and t > last[2]:
                speed = float(np.hypot(x - last[0], y - last[1]) / (t - last[2]))
            if last is None or t >= last[2]:
                last = (float(x), float(y), float(t))
        out.append((key[0], key[1], int(frame), float(t), speed))
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["clip_id", "joint_name", "frame_index", "timestamp_sec", "speed"]).astype({"speed": "Float64"})


def stream_speeds(points: DataFrame) -> DataFrame:
    """Speed of every row of a stream of (clip_id, joint_name, frame_index, timestamp_sec, x, y), frames in order over batches."""
    return points.groupBy("clip_id", "joint_name").applyInPandasWithState(_speeds, SCHEMA, "x double, y double, t double", "append", GroupStateTimeout.NoTimeout)


def windowed_motion(points: DataFrame, *, time: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Count and mean of a value by series and event-time window, late rows admitted up to a watermark."""
    return points.withWatermark(time, late).groupBy(F.window(time, window), "clip_id", "joint_name").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x")).select("clip_id", "joint_name", F.col("window.start").alias("start"), "n", "mean_x")
