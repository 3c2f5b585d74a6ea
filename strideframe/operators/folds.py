"""Order-dependent folds: whether a row is accepted depends on the rows accepted before it, so no window function can say it.

Each one is a small loop over one series; Spark deals the series out and puts their rows in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, StructField, StructType

from ..functions.geometry import distance
from .series import along


def accepted(points: np.ndarray, frames: np.ndarray, limit: float, *, by_gap: bool) -> np.ndarray:
    """Accept a point within limit (times the root of the frames passed) of the last accepted one; missing points are neither."""
    out, last = np.zeros(len(points), dtype=bool), -1
    for i in np.flatnonzero(~np.isnan(points).any(axis=1)):
        reach = limit * max(1, frames[i] - frames[last]) ** 0.5 if by_gap else limit
        if last < 0 or np.sqrt(((points[i] - points[last]) ** 2).sum()) <= reach:
            out[i], last = True, i
    return out


def _median_step(points: np.ndarray) -> float:
    present = points[~np.isnan(points).any(axis=1)]
    step = np.sqrt((np.diff(present, axis=0) ** 2).sum(axis=1))
    return float(np.median(step[step > 0])) if (step > 0).any() else 0.0


def _fold(df: DataFrame, keys: list[str], columns: dict[str, DataType], inputs: list[str], state: Callable[[], Callable[..., tuple]], order: str = "frame_index") -> DataFrame:
    """New columns from a state that a series' rows pass in order: state() begins one, and gives a function from a row's inputs (NaN where missing) to its new values.

    The rows of all series of a partition pass one task as a stream, batch by batch: short series cost no group each, long ones are never held.
    """
    schema = StructType([*df.schema.fields, *[StructField(c, t) for c, t in columns.items()]])
    kinds = [pa.bool_() if isinstance(t, BooleanType) else pa.float64() for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = [table[c].cast(pa.float64()).fill_null(float("nan")).to_numpy().tolist() for c in inputs]
            out = []
            for first, row in zip(table["_first"].to_pylist(), zip(*values, strict=True), strict=True):
                if first:
                    step = state()
                out.append(step(*row))
            table = table.drop_columns(["_first"])
            for c, kind, new in zip(columns, kinds, zip(*out, strict=True) if out else [()] * len(columns), strict=True):
                table = table.append_column(c, pa.array(new, kind))
            yield from table.to_batches()

    return df.withColumn("_first", F.row_number().over(along(keys, order)) == 1).mapInArrow(run, schema)


def _near_accepted(df: DataFrame, keys: list[str], axes: list[str], limit: Column, name: str, *, by_gap: bool, least: int = 0) -> DataFrame:
    """name: points beyond a limit (times the root of the frames passed, by_gap) from the last accepted one. limit may use `_median`, the series' median
    step that is not zero; there are none without one, or under `least` points."""
    whole, here = Window.partitionBy(*keys), F.lit(True)
    for a in axes:
        here = here & F.col(a).isNotNull() & ~F.isnan(a)
    df = df.withColumn("_here", F.when(here, F.struct(*axes)))
    before = F.last("_here", ignorenulls=True).over(along(keys).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_step", distance([before[a] for a in axes], [F.col(f"_here.{a}") for a in axes]))
    df = df.withColumns({"_median": F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(whole), "_points": F.count("_here").over(whole)})
    df = df.withColumn("_limit", F.when(F.col("_points") >= least, limit)).drop("_here", "_step", "_median", "_points")

    def state() -> Callable[..., tuple]:
        last = None

        def step(most: float, frame: float, *point: float) -> tuple:
            nonlocal last
            if most != most or any(v != v for v in point):
                return (False,)
            if last is not None:
                reach = most * max(1.0, frame - last[0]) ** 0.5 if by_gap else most
                if math.sqrt(sum((v - u) ** 2 for v, u in zip(point, last[1], strict=True))) > reach:
                    return (True,)
            last = frame, point
            return (False,)

        return step

    return _fold(df, keys, {name: BooleanType()}, ["_limit", "frame_index", *axes], state).drop("_limit")


def torso_rejects(points: np.ndarray, frames: np.ndarray, multiplier: float, floor: float) -> np.ndarray:
    """Centres too far from the last accepted one. Under five centres or without a step there are none."""
    there, median = ~np.isnan(points).any(axis=1), _median_step(points)
    if there.sum() < 5 or median == 0:
        return np.zeros(len(points), dtype=bool)
    return there & ~accepted(points, frames, max(median * multiplier, floor), by_gap=True)


def torso_continuity(centers: DataFrame, keys: list[str], multiplier: float, floor: float) -> DataFrame:
    """rejected: frames whose centre (cx, cy) is too far from the last accepted one. Under five centres or without a step nothing is."""

    return _near_accepted(centers, keys, ["cx", "cy"], F.greatest(F.col("_median") * multiplier, F.lit(floor)), "rejected", by_gap=True, least=5)


def jumps_3d(df: DataFrame, keys: list[str], axes: list[str], multiplier: float) -> DataFrame:
    """jump: points farther than multiplier times the median step from the last kept one."""

    return _near_accepted(df, keys, axes, F.col("_median") * multiplier, "jump", by_gap=False)


def object_speed(df: DataFrame, keys: list[str], most: float | None) -> DataFrame:
    """speed_px_s and speed_norm_s against the last kept detection.

    A detection is not kept where time does not advance, where a size is unknown (it still has a normalised speed) or where it would be faster than `most`.
    """

    def state() -> Callable[..., tuple]:
        kept = None

        def step(x: float, y: float, t: float, w: float, h: float) -> tuple:
            nonlocal kept
            if x != x or y != y:
                return None, None
            if kept is None:
                kept = (x, y, t, w, h)
                return None, None
            x0, y0, t0, w0, h0 = kept
            if not (dt := t - t0) > 0:
                return None, None
            slow = math.hypot(x - x0, y - y0) / dt
            if w != w or h != h or w0 != w0 or h0 != h0:
                return None, slow
            fast = math.hypot(x * w - x0 * w0, y * h - y0 * h0) / dt
            if most is not None and fast > most:
                return None, None
            kept = (x, y, t, w, h)
            return fast, slow

        return step

    return _fold(df, keys, {"speed_px_s": DoubleType(), "speed_norm_s": DoubleType()}, ["x", "y", "timestamp_sec", "width", "height"], state)


def object_features(tracks: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """One row a frame: place, confidence and speeds of each object, by a prefix for each object_name; rows as object_speed gives them."""
    columns = [c for c in ("x", "y", "confidence", "speed_px_s", "speed_norm_s") if c in tracks.columns]
    pick = [F.max(F.when(F.col("object_name") == name, F.col(c))).alias(f"{prefix}_{c}") for prefix, name in names.items() for c in columns]
    return tracks.filter(F.col("object_name").isin(*names.values())).groupBy(*keys, "frame_index").agg(F.min("timestamp_sec").alias("timestamp_sec"), *pick)


def bounded_tracker(df: DataFrame, keys: list[str], *, warm_up: int = 3, share: float = 0.35, most: float = 0.08, growth: tuple[float, float] = (0.35, 2.8)) -> DataFrame:
    """tracked: a centre that follows proposals (x, area) by a bounded exponential step; after the warm-up, proposals whose area leaves the growth range are passed over."""

    def state() -> Callable[..., tuple]:
        at = area = None
        seen = 0

        def step(x: float, a: float) -> tuple:
            nonlocal at, area, seen
            if x == x and a == a:
                if at is None:
                    at, area, seen = x, a, 1
                elif seen < warm_up or (area > 0 and growth[0] <= a / area <= growth[1]):
                    at += min(max((x - at) * share, -most), most)
                    area += (a - area) * share
                    seen += 1
            return (at,)

        return step

    return _fold(df, keys, {"tracked": DoubleType()}, ["x", "area"], state)
