"""Action windows: a motion score for each frame, the burst around its peak, padded and cropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import mark_around_peak
from .series import Keys, moving_average


@dataclass(frozen=True)
class WindowRule:
    """Weights of hand, trunk and pelvis motion; padding and least and most frames of the compact and the wide window."""

    weights: tuple[float, float, float]
    pad: tuple[int, int]
    frames: tuple[int, int]
    search: tuple[int, int]
    wide_pad: tuple[int, int]
    wide_frames: tuple[int, int]


# Fixed values of the two kinds of action.
BATTING = WindowRule((0.55, 0.25, 0.20), (8, 8), (24, 54), (45, 35), (18, 4), (48, 90))
PITCHING = WindowRule((0.30, 0.38, 0.32), (10, 10), (30, 72), (55, 45), (14, 14), (48, 108))
SIGNALS = ("hand_speed_proxy", "trunk_rotation_velocity_deg_s", "pelvis_rotation_velocity_deg_s")


def motion_score(df: DataFrame, keys: Keys, rule: WindowRule = BATTING, signals: tuple[str, ...] = SIGNALS, radius: int = 3) -> DataFrame:
    """score: each signal's size over the larger of 1 and the 95th percentile of its positive values, at most 2, weighted, then averaged over seven rows. Missing counts as 0."""
    size = {s: F.abs(F.coalesce(s, F.lit(0.0))) for s in signals}
    whole, raw = Window.partitionBy(*keys), F.lit(0.0)
    for v, weight in zip(size.values(), rule.weights, strict=True):
        p95 = F.percentile(F.when(v > 0, v), F.lit(0.95)).over(whole)
        raw = raw + weight * F.least(v / F.greatest(F.coalesce(p95, F.lit(1.0)), F.lit(1.0)), F.lit(2.0))
    return moving_average(df.withColumn("_raw", raw), keys, "_raw", radius, name="score").drop("_raw")


def _constrained(core: DataFrame, pad: tuple[int, int], frames: tuple[int, int], start: str, end: str) -> DataFrame:
    least, most = frames
    n, zero = F.col("n"), F.lit(0)
    core = core.withColumns({"_a": F.greatest(zero, F.col(start) - pad[0]), "_b": F.least(n - 1, F.col(end) + pad[1])})
    short = F.greatest(zero, least - (F.col("_b") - F.col("_a") + 1))
    before = F.floor(short / 2)
    core = core.withColumns({"_a": F.greatest(zero, F.col("_a") - before), "_b": F.least(n - 1, F.col("_b") + (short - before))})
    long_ = F.col("_b") - F.col("_a") + 1 > most
    first = F.greatest(zero, F.col("peak_pos") - most // 2)
    last = F.least(n - 1, first + most - 1)
    first = F.when(last - first + 1 < most, F.greatest(zero, last - most + 1)).otherwise(first)
    return core.withColumns({"start_index": F.when(long_, first).otherwise(F.col("_a")), "end_index": F.when(long_, last).otherwise(F.col("_b"))}).drop("_a", "_b")


def _core(scored: DataFrame, keys: Keys) -> DataFrame:
    """All rows, each with the stretch around its series' peak; every step below is a window over the same keys."""
    return mark_around_peak(scored, keys, "score", F.greatest(F.col("peak") * 0.42, F.lit(0.28))).filter("peak is not null")


def action_window(scored: DataFrame, keys: Keys, rule: WindowRule = BATTING) -> DataFrame:
    """One row for each series: the stretch around the peak with scores of at least 42 % of it (and .28), padded to the rule's frames; the whole series where nothing moves."""
    return _placed(_constrained(_core(scored, keys), rule.pad, rule.frames, "start_pos", "end_pos"), keys)


def action_rows(scored: DataFrame, keys: Keys, rule: WindowRule = BATTING) -> DataFrame:
    """The rows inside each series' action window, marked where they are: no join of the scores with their own windows."""
    rows = _constrained(_core(scored, keys), rule.pad, rule.frames, "start_pos", "end_pos")
    inside = F.col("pos").between(F.col("start_index"), F.col("end_index")) | ~F.coalesce(F.col("peak") > 0, F.lit(False))
    return rows.filter(inside).select(*scored.columns)


def video_window(scored: DataFrame, keys: Keys, rule: WindowRule = BATTING) -> DataFrame:
    """A wider window: from the last quiet frame of the search range on either side of the core."""
    rows, pos, whole = _core(scored, keys), F.col("pos"), Window.partitionBy(*keys)
    left = (pos >= F.greatest(F.lit(0), F.col("start_pos") - rule.search[0])) & (pos <= F.col("start_pos"))
    right = (pos >= F.col("end_pos")) & (pos <= F.least(F.col("n") - 1, F.col("end_pos") + rule.search[1]))
    for name, on in (("left", left), ("right", right)):
        rows = rows.withColumn("_low", F.min(F.when(on, F.col("score"))).over(whole))
        quiet = F.col("score") <= F.col("_low") + F.greatest(F.lit(0.02), F.col("_low") * 0.1)
        rows = rows.withColumn(f"{name}_valley", F.max(F.when(on & quiet, pos)).over(whole))
    return _placed(_constrained(rows, rule.wide_pad, rule.wide_frames, "left_valley", "right_valley"), keys)


def _placed(rows: DataFrame, keys: Keys) -> DataFrame:
    """Frames at the window's indices; the whole series where nothing moves."""
    moving = F.col("peak") > 0
    rows = rows.withColumns({
        "start_index": F.when(moving, F.col("start_index")).otherwise(0), "end_index": F.when(moving, F.col("end_index")).otherwise(F.col("n") - 1),
        "peak_index": F.when(moving, F.col("peak_pos")).otherwise(0), "peak_score": F.greatest("peak", F.lit(0.0)),
    })
    at = lambda c: F.max(F.when(F.col("pos") == F.col(c), F.col("frame_index")))
    indices = ("start_index", "end_index", "peak_index", "peak_score")
    out = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in indices], *[at(f"{e}_index").alias(f"{e}_frame") for e in ("start", "end", "peak")])
    return out.withColumn("frame_count", F.col("end_index") - F.col("start_index") + 1)


def rows_in_window(df: DataFrame, keys: Keys, windows: DataFrame) -> DataFrame:
    """Rows of a series from its window's first to its last frame."""
    w = windows.select(*keys, "start_frame", "end_frame")
    return df.join(w, keys).filter(F.col("frame_index").between(F.col("start_frame"), F.col("end_frame"))).drop("start_frame", "end_frame")
