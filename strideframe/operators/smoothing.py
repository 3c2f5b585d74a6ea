"""Smoothing of whole trajectories: gates, then for each series jumps, gaps, median, polynomial and mean filters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import by_joint, not_distrusted, pose_score
from ..schemas import FOOT_SEGMENTS, LIMB_SEGMENTS, MARKER_JOINTS
from . import folds, gates, islands, kernels
from .series import Keys, along


@dataclass(frozen=True)
class Pose2dRule:
    """Settings of smooth_pose2d; tables go by joint, joint group or "default"."""

    threshold: float = 0.5
    thresholds: Mapping[str, float] | None = None
    max_gap: int = 3
    gaps: Mapping[str, float] | None = None
    jump: float = 6.0
    jumps: Mapping[str, float] | None = None
    window: int = 15
    order: int = 2
    median: int = 5
    refine: int = 9
    torso_gate: bool = True
    torso_jump: float = 8.0
    least_torso_jump: float = 0.08
    least_torso_frames: int = 1
    limb_tolerance: float = 0.28
    foot_tolerance: float = 1.20


AXES = ["x", "y"]
#: Groups among which the torso's series are dealt; a group holds a row a frame.
TORSO_GROUPS = 1024


def _torso_flags(df: DataFrame, keys: Keys, rule: Pose2dRule) -> DataFrame:
    """Frames without a believable torso: too far from the last accepted one, or in a run of fewer consecutive frames than asked for (none where the whole series has fewer)."""
    centers = gates.torso_centers(df, keys, rule.threshold)
    least = rule.least_torso_frames

    def flags(p: np.ndarray, frames: np.ndarray) -> np.ndarray:
        out = folds.torso_rejects(p, frames, rule.torso_jump, rule.least_torso_jump) if rule.torso_gate else np.zeros(len(p), dtype=bool)
        there = np.flatnonzero(~np.isnan(p).any(axis=1) & ~out)
        if least > 1 and len(there) >= least:
            number = np.concatenate(([0], np.cumsum(np.diff(frames[there]) > 1)))
            out[there[np.bincount(number)[number] < least]] = True
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_series=pdf.groupby(keys, dropna=False, sort=False).ngroup()).sort_values(["_series", "frame_index"], kind="stable")
        p, frames, series = pdf[["cx", "cy"]].to_numpy(dtype=float, na_value=np.nan), pdf["frame_index"].to_numpy(), pdf["_series"].to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(series)) + 1), len(pdf)]
        out = np.concatenate([flags(p[a:b], frames[a:b]) for a, b in zip(ends, ends[1:], strict=False)])
        return pdf.loc[out, [*keys, "frame_index"]]

    kept = centers.select(*keys, "frame_index")
    # Series share groups: one of its own each, of some thirty rows, costs more than its fold.
    return centers.groupBy(F.pmod(F.hash(*keys), F.lit(TORSO_GROUPS)).alias("_group")).applyInPandas(run, kept.schema)


def gate_pose2d(df: DataFrame, keys: Keys, rule: Pose2dRule) -> DataFrame:
    """Points out of frames whose torso jumps or is seen too briefly, and of joints whose limb or foot is off its usual length. Rows stay.

    The torso's frames are folded once and joined back once; limbs are windows over the frame and the series. All of it follows one
    partitioning by series, which later windows over joints share.
    """
    df = df.repartition(*keys)
    if rule.torso_gate or rule.least_torso_frames > 1:
        df = gates.without_frames(df, keys, _torso_flags(df, keys, rule), AXES).repartition(*keys)
    ok = not_distrusted(pose_score(), by_joint(rule.thresholds, rule.threshold))
    for segments, tolerance in ((LIMB_SEGMENTS, rule.limb_tolerance), (FOOT_SEGMENTS, rule.foot_tolerance)):
        df = gates.limb_gate_by_windows(df, keys, AXES, tolerance, usable=ok, segments=segments)
    return df


def smooth_pose2d(df: DataFrame, keys: Keys, rule: Pose2dRule = Pose2dRule()) -> DataFrame:
    """2-D points: gates, distrusted points and isolated jumps out, short gaps filled, then median, polynomial and mean filters, gaps and edges filled again."""
    joint = [*keys, "joint_name"]
    df = gate_pose2d(df, keys, rule)
    ok = not_distrusted(pose_score(), by_joint(rule.thresholds, rule.threshold))
    df = df.withColumns({a: F.when(ok, F.col(a)) for a in AXES})
    df = gates.isolated_jumps(df, joint, by_joint(rule.jumps, rule.jump))
    df = df.withColumns({a: F.when(~F.col("jump"), F.col(a)) for a in AXES}).drop("jump")
    gap = by_joint(rule.gaps, rule.max_gap).cast("int")
    df = islands.fill_short_gaps(df, joint, AXES, gap)
    df = kernels.median_filter(df, joint, AXES, rule.median)
    df = kernels.mean_filter(kernels.savitzky_golay(df, joint, AXES, rule.window, rule.order), joint, AXES, rule.refine)
    return islands.fill_short_gaps(df, joint, AXES, gap, edges=True)


def smooth_pose3d(df: DataFrame, keys: Keys, *, max_gap: int = 3, window: int = 15, order: int = 2, median: int = 5, refine: int = 9, jump: float = 3.0, threshold: float = 0.5, limb_tolerance: float = 0.28, marker_joints: tuple[str, ...] = MARKER_JOINTS) -> DataFrame:
    """3-D points: limbs of odd length and jumps against the last kept point out, short gaps filled, then the "skip" filters; a point with a missing axis loses its quality.

    Sequences of a reconstructed skeleton (at least four of marker_joints) have no detector to doubt: nothing is taken out of them.
    """
    joint, axes = [*keys, "joint_name"], ["x_3d", "y_3d", "z_3d"]
    df = has_marker_skeleton(df, keys, list(marker_joints)).withColumns({f"_raw_{a}": F.col(a) for a in axes})
    usable = ~F.col("marker_skeleton") & not_distrusted(F.col("input_quality_score"), threshold)
    df = gates.limb_length_gate(df, keys, axes, limb_tolerance, usable=usable)
    df = folds.jumps_3d(df, joint, axes, jump)
    whole = F.lit(True)
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    df = df.withColumns({a: F.when(F.col("marker_skeleton"), F.col(f"_raw_{a}")).when(whole & ~F.col("jump"), F.col(a)) for a in axes})
    df = islands.fill_short_gaps(df.drop("jump", "marker_skeleton", *[f"_raw_{a}" for a in axes]), joint, axes, max_gap)
    df = kernels.median_filter(df, joint, axes, median, "skip")
    df = kernels.mean_filter(kernels.savitzky_golay(df, joint, axes, window, order), joint, axes, refine, "skip")
    return df.withColumns({c: F.when(whole, F.col(c)) for c in [*axes, "input_quality_score"]})


def has_marker_skeleton(df: DataFrame, keys: Keys, names: list[str], least: int = 4) -> DataFrame:
    """marker_skeleton: whether a sequence uses at least so many of the names."""
    used = df.groupBy(*keys).agg(*[F.max((F.col("joint_name") == n).cast("int")).alias(f"_{i}") for i, n in enumerate(names)])
    found = sum([F.coalesce(f"_{i}", F.lit(0)) for i in range(len(names))], F.lit(0))
    used = used.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (found >= least).alias("marker_skeleton"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(used, same, "left").drop(*[f"_k_{k}" for k in keys])


def weighted_fit(values: np.ndarray, weights: np.ndarray, at: np.ndarray, target: float) -> float:
    """Value at the target of a weighted polynomial: quadratic from five points on, a line below."""
    on = ~np.isnan(values) & (weights > 0)
    if on.sum() < 2:
        return float(values[on][0]) if on.any() else np.nan
    degree = 2 if on.sum() >= 5 else 1
    return float(np.polyval(np.polyfit(at[on] - target, values[on], degree, w=np.sqrt(weights[on])), 0.0))


def smooth_sticks(df: DataFrame, keys: Keys, *, radius: int = 3, order: str = "frame_index") -> DataFrame:
    """Detections of a stick (x, y) - (x2, y2): centre, angle and length are fitted over runs of consecutive frames, near and confident detections weighing more."""
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        frame = pdf[order].to_numpy(float)
        ends = pdf[["x", "y", "x2", "y2"]].to_numpy(dtype=float, na_value=np.nan)
        trust = pdf["confidence"].to_numpy(dtype=float, na_value=np.nan)
        trust = np.where(np.isnan(trust), 1.0, trust)
        d = ends[:, :2] - ends[:, 2:]
        angle = np.arctan2(d[:, 1], d[:, 0])
        parts = [(ends[:, 0] + ends[:, 2]) / 2, (ends[:, 1] + ends[:, 3]) / 2, angle, np.hypot(d[:, 0], d[:, 1])]
        number = np.concatenate(([0], np.cumsum(np.diff(frame) > 1))) if len(frame) else np.zeros(0)
        out = ends.copy()
        for i in range(len(frame)):
            near = np.flatnonzero((number == number[i]) & (np.abs(frame - frame[i]) <= radius))
            if len(near) < 3 or np.isnan(ends[i]).any():
                continue
            weight = trust[near] * (1 - np.abs(frame[near] - frame[i]) / (radius + 1))
            turn = angle[near]
            there = ~np.isnan(turn)
            turn[there] = np.unwrap(turn[there], period=np.pi)
            cx, cy, a, length = (weighted_fit(turn if k == 2 else p[near], weight, frame[near], frame[i]) for k, p in enumerate(parts))
            if np.cos(a - angle[i]) < 0:
                a += np.pi
            half = np.array([np.cos(a), np.sin(a)]) * length / 2
            out[i] = [cx + half[0], cy + half[1], cx - half[0], cy - half[1]]
        for k, c in enumerate(("x", "y", "x2", "y2")):
            pdf[c] = pd.array(out[:, k], dtype="Float64")
            pdf.loc[np.isnan(out[:, k]), c] = pd.NA
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)


def blend(smoothed: DataFrame, original: DataFrame, weights: DataFrame, keys: Keys, columns: list[str]) -> DataFrame:
    """Smoothed values drawn back to the original by a weight for each frame (at most 1; none where it is 0 or missing); where one of the two is missing, the other."""
    o = original.select(*keys, "frame_index", *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = smoothed.join(o, [*keys, "frame_index"], "left").join(weights.select(*keys, "frame_index", F.col("weight").alias("_w")), [*keys, "frame_index"], "left")
    w = F.least(F.coalesce("_w", F.lit(0.0)), F.lit(1.0))
    drawn = lambda c: F.coalesce(F.col(c) * (1 - w) + F.col(f"_o_{c}") * w, F.col(c), F.col(f"_o_{c}"))
    return joined.withColumns({c: F.when(w > 0, drawn(c)).otherwise(F.col(c)) for c in columns}).drop("_w", *[f"_o_{c}" for c in columns])


def protected_frames(centers: DataFrame, keys: Keys, *, margin: int, weight: float) -> DataFrame:
    """Weights around given frames: full at the frame, falling in a line to nothing beyond the margin; the largest counts."""
    step = F.explode(F.sequence(F.lit(-margin), F.lit(margin)))
    out = centers.select(*keys, "frame_index", step.alias("_d"))
    return out.select(*keys, (F.col("frame_index") + F.col("_d")).alias("frame_index"), (weight * (1 - F.abs("_d") / (margin + 1))).alias("weight")).groupBy(*keys, "frame_index").agg(F.max("weight").alias("weight"))


# ---- a stick's swing


def stick_angle() -> Column:
    """Degrees; 0 for a stick that is not whole."""
    return F.coalesce(F.degrees(F.atan2(F.col("y") - F.col("y2"), F.col("x") - F.col("x2"))), F.lit(0.0))


def axis_turn(before: Column, after: Column) -> Column:
    """Signed turn of an undirected axis, in [-90, 90)."""
    return F.pmod(after - before + 90.0, F.lit(180.0)) - 90.0


def _run_means(columns: list[str], keys: Keys, window: int, order: str = "frame_index") -> dict[str, Column]:
    """Weighted means over the rows of a run around each row."""
    w, reach = along([*keys, "run"], order), range(-(window // 2), window // 2 + 1)
    near = lambda c, k: c if k == 0 else F.lag(c, -k).over(w)
    trust = F.greatest(F.lit(0.05), F.coalesce("confidence", F.lit(0.5)))
    out = {}
    for c in columns:
        total, weight = F.lit(0.0), F.lit(0.0)
        for k in reach:
            share = F.when(near(F.col(c), k).isNotNull(), near(trust, k) / (1 + abs(k)))
            total, weight = total + F.coalesce(near(F.col(c), k) * share, F.lit(0.0)), weight + F.coalesce(share, F.lit(0.0))
        out[c] = total / F.when(weight > 0, weight)
    return out


def smooth_coordinates(df: DataFrame, keys: Keys, columns: list[str], window: int, *, order: str = "frame_index") -> DataFrame:
    """Means over runs of consecutive frames, each row weighing its confidence (0.5 where unknown, at least 0.05) over one more than its distance in rows; missing values are left out."""
    df = islands.consecutive_runs(df, keys, order=order)
    return df.withColumns(_run_means(columns, keys, window, order)).drop("run")


def fast_steps(sticks: DataFrame, keys: Keys, least: float, *, order: str = "frame_index") -> DataFrame:
    """Frames on either side of a turn of at least so many degrees between consecutive frames."""
    w = along(keys, order)
    turned = F.abs(axis_turn(F.lag(stick_angle()).over(w), stick_angle()))
    fast = F.coalesce((turned >= least) & (F.col(order) - F.lag(order).over(w) <= 1), F.lit(False))
    df = sticks.withColumn("_fast", fast)
    return df.withColumn("_next", F.coalesce(F.lead("_fast").over(w), F.lit(False))).filter("_fast or _next").drop("_fast", "_next")


def swing_frames(sticks: DataFrame, balls: DataFrame, keys: Keys, *, margin: int, fast: float, order: str = "frame_index") -> DataFrame:
    """Frames of sticks in the swing: around the span of the ball's frames, else around the largest cluster of fast frames (the first of equals); none without either."""
    span = balls.groupBy(*keys).agg((F.min(order) - margin).alias("_a"), (F.max(order) + margin).alias("_b"))
    clusters = islands.consecutive_runs(fast_steps(sticks, keys, fast, order=order), keys, max_gap=margin, order=order)
    sizes = clusters.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_from"), F.max(order).alias("_to"))
    best = sizes.groupBy(*keys).agg(F.max_by(F.struct("_from", "_to"), F.struct("_n", -F.col("run"))).alias("_c"))
    df = sticks.select(*keys, order).join(span, keys, "left").join(best, keys, "left")
    first, last = F.coalesce("_a", F.col("_c._from") - margin), F.coalesce("_b", F.col("_c._to") + margin)
    return df.filter(F.col(order).between(first, last)).select(*keys, order)


def original_weights(sticks: DataFrame, balls: DataFrame, swing: DataFrame, keys: Keys, *, contact: tuple[int, float], fast: float, quick: tuple[int, float]) -> DataFrame:
    """How much of the original each frame keeps: around ball frames by contact (margin, weight), and, in series without a swing, around fast frames by quick."""
    near_ball = protected_frames(balls.select(*keys, "frame_index").distinct(), keys, margin=contact[0], weight=contact[1])
    still = fast_steps(sticks, keys, fast).select(*keys, "frame_index").join(swing.select(*keys).distinct(), keys, "left_anti")
    near_fast = protected_frames(still, keys, margin=quick[0], weight=quick[1])
    return near_ball.unionByName(near_fast).groupBy(*keys, "frame_index").agg(F.max("weight").alias("weight"))


def tune_swing(smoothed: DataFrame, original: DataFrame, swing: DataFrame, keys: Keys, *, step: float, lengths: tuple[float, float], least: int = 1) -> DataFrame:
    """In the swing the original's angle, at most `step` degrees (57.3 at least) a frame, about the smoothed centre, with a length within a share of the median original one.

    Every run of consecutive frames starts anew. A run with an original that is not whole stays as it is, and so does a series
    with fewer than `least` rows in its swing. Rows that are not whole themselves are stepped over.
    """
    o = original.select(*keys, "frame_index", *[F.col(c).alias(f"_o_{c}") for c in ENDS])
    df = smoothed.join(swing, [*keys, "frame_index"], "left_semi").join(o, [*keys, "frame_index"], "left")
    df = islands.consecutive_runs(df, keys)
    whole = F.lit(True)
    for c in ENDS:
        whole = whole & F.col(f"_o_{c}").isNotNull()
    in_run, in_series = Window.partitionBy(*keys, "run"), Window.partitionBy(*keys)
    df = df.withColumns({"_whole": F.min(whole).over(in_run), "_n": F.count(F.lit(1)).over(in_series)}).filter((F.col("_n") >= least) & F.col("_whole")).drop("_n", "_whole")
    most = max(1.0, float(np.radians(step)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index", kind="stable")
        angles = np.unwrap(np.arctan2(pdf["_o_y"] - pdf["_o_y2"], pdf["_o_x"] - pdf["_o_x2"]).to_numpy(float))
        there = pdf[list(ENDS)].notna().all(axis=1).to_numpy()
        last = None
        for i in np.flatnonzero(there):
            last = angles[i] = angles[i] if last is None else np.clip(angles[i], last - most, last + most)
        usual = np.hypot(pdf["_o_x"] - pdf["_o_x2"], pdf["_o_y"] - pdf["_o_y2"])
        length = np.clip(np.hypot(pdf["x"] - pdf["x2"], pdf["y"] - pdf["y2"]), np.median(usual) * lengths[0], np.median(usual) * lengths[1])
        half = np.where(length > 0, length, usual) / 2
        cx, cy = (pdf["x"] + pdf["x2"]) / 2, (pdf["y"] + pdf["y2"]) / 2
        return pdf.assign(x=cx + np.cos(angles) * half, y=cy + np.sin(angles) * half, x2=cx - np.cos(angles) * half, y2=cy - np.sin(angles) * half)[there]

    tuned = df.groupBy(*keys, "run").applyInPandas(run, df.schema).select(*keys, "frame_index", *[F.col(c).alias(f"_t_{c}") for c in ENDS])
    out = smoothed.join(tuned, [*keys, "frame_index"], "left")
    return out.withColumns({c: F.coalesce(f"_t_{c}", c) for c in ENDS}).drop(*[f"_t_{c}" for c in ENDS])


# ---- the whole of a stick's track

#: Both ends of a stick.
ENDS = ("x", "y", "x2", "y2")


@dataclass(frozen=True)
class StickRule:
    """Settings of smooth_stick_tracks. Margins are frames, weights shares of the original, angles degrees; a window of 1 or less smooths nothing."""

    window: int = 0
    least_rows: int = 3
    passes: int = 1
    contact_margin: int = 0
    contact_weight: float = 0.0
    fast: float = 0.0
    fast_margin: int = 0
    fast_weight: float = 0.0
    swing_margin: int = 0
    step: float = 35.0
    lengths: tuple[float, float] = (0.45, 1.35)


def _window_sums(df: DataFrame, values: list[str], keys: Keys, half: int) -> DataFrame:
    """Adds the sums of a weighted fit over rows -half .. half of the run: _n, _m (weights), _s0 .. _s4, and for each value _m_v, _t0_v .. _t2_v."""
    w = along([*keys, "run"])
    near = lambda c, k: F.col(c) if k == 0 else F.lag(c, -k).over(w)
    steps = range(-half, half + 1)
    df = df.withColumns({f"_u{k + half}": near("_trust", k) / (1 + abs(k)) for k in steps})
    weight = lambda k: F.coalesce(F.col(f"_u{k + half}"), F.lit(0.0))
    total = lambda parts: sum(parts[1:], parts[0])
    sums = {"_n": total([F.col(f"_u{k + half}").isNotNull().cast("int") for k in steps]), "_m": total([weight(k) for k in steps])}
    sums |= {f"_s{j}": total([weight(k) * weight(k) * float(k**j) for k in steps]) for j in range(5)}
    for v in values:
        at = lambda k, v=v: F.coalesce(near(v, k), F.lit(0.0))
        sums |= {f"_m_{v}": total([weight(k) * at(k) for k in steps])} | {f"_t{j}_{v}": total([weight(k) * weight(k) * float(k**j) * at(k) for k in steps]) for j in range(3)}
    return df.withColumns(sums).drop(*[f"_u{k + half}" for k in steps])


def _fitted(v: str) -> Column:
    """Value in the middle: of a weighted parabola from five rows on, of a line from three, else the weighted mean. Weights count squared in fits."""
    s, t = [F.col(f"_s{j}") for j in range(5)], [F.col(f"_t{j}_{v}") for j in range(3)]
    minor = [s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2]]
    parabola = (t[0] * minor[0] - t[1] * minor[1] + t[2] * minor[2]) / (s[0] * minor[0] - s[1] * minor[1] + s[2] * minor[2])
    line = (s[2] * t[0] - s[1] * t[1]) / (s[0] * s[2] - s[1] * s[1])
    return F.when(F.col("_n") >= 5, parabola).when(F.col("_n") >= 3, line).otherwise(F.col(f"_m_{v}") / F.col("_m"))


def smooth_stick_pass(df: DataFrame, keys: Keys, window: int, least_rows: int) -> DataFrame:
    """One pass over the runs of consecutive frames: centre, unwrapped angle and length are fitted; where a run has an open end somewhere, its coordinates are averaged; short runs stay."""
    columns = df.columns
    df = islands.consecutive_runs(df, keys)
    in_run = Window.partitionBy(*keys, "run")
    df = df.withColumns({"_rows": F.count(F.lit(1)).over(in_run), "_open": F.max(F.col("x2").isNull() | F.col("y2").isNull()).over(in_run), "_raw": F.atan2(F.col("y") - F.col("y2"), F.col("x") - F.col("x2"))})
    turn = F.col("_raw") - F.lag("_raw").over(along([*keys, "run"]))
    df = df.withColumn("_turn", F.when(turn > np.pi, turn - 2 * np.pi).when(turn < -np.pi, turn + 2 * np.pi).otherwise(F.coalesce(turn, F.col("_raw"))))
    df = df.withColumns({
        "_cx": (F.col("x") + F.col("x2")) / 2, "_cy": (F.col("y") + F.col("y2")) / 2, "_len": F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")),
        "_angle": F.sum("_turn").over(along([*keys, "run"]).rowsBetween(Window.unboundedPreceding, 0)), "_trust": F.greatest(F.lit(0.05), F.coalesce("confidence", F.lit(0.5))),
    })
    parts = ["_cx", "_cy", "_angle", "_len"]
    df = _window_sums(df, parts, keys, window // 2).withColumns({f"_f{v}": _fitted(v) for v in parts})
    df = df.withColumns({f"_p_{c}": mean for c, mean in _run_means(list(ENDS), keys, window).items()})
    dx, dy = F.cos("_f_angle") * F.col("_f_len") / 2, F.sin("_f_angle") * F.col("_f_len") / 2
    fit = {"x": F.col("_f_cx") + dx, "y": F.col("_f_cy") + dy, "x2": F.col("_f_cx") - dx, "y2": F.col("_f_cy") - dy}
    return df.withColumns({c: F.when(F.col("_rows") < least_rows, F.col(c)).when(F.col("_open"), F.col(f"_p_{c}")).otherwise(fit[c]) for c in ENDS}).select(*columns)


def smooth_stick_tracks(tracks: DataFrame, keys: Keys, rule: StickRule, *, stick: str = "bat", ball: str = "ball") -> DataFrame:
    """Tracks (object_name, frame_index, x, y, x2, y2, confidence, ...) with the stick's rows smoothed; all other rows stay.

    Passes of smoothing, then the swing is drawn back to the original's angles, then frames near the ball (and, without a swing,
    near fast turns) are drawn back to the original by their weights. Swing and weights are those of the original track.
    """
    window = rule.window if rule.window % 2 else rule.window - 1
    if window <= 1:
        return tracks
    sticks, balls = tracks.filter(F.col("object_name") == stick), tracks.filter(F.col("object_name") == ball)
    others = tracks.filter(F.coalesce(F.col("object_name") != stick, F.lit(True)))
    none = sticks.select(*keys, "frame_index").limit(0)
    swings = rule.fast > 0 and rule.swing_margin >= 0
    swing = swing_frames(sticks, balls, keys, margin=rule.swing_margin, fast=rule.fast) if swings else none
    quick = (rule.fast_margin, rule.fast_weight if rule.fast > 0 else 0.0)
    weights = original_weights(sticks, balls, swing, keys, contact=(rule.contact_margin, rule.contact_weight), fast=rule.fast, quick=quick)
    smoothed = sticks
    for _ in range(max(1, rule.passes)):
        smoothed = smooth_stick_pass(smoothed, keys, window, rule.least_rows)
    tuned = tune_swing(smoothed, sticks, swing, keys, step=rule.step, lengths=rule.lengths, least=rule.least_rows)
    return blend(tuned, sticks, weights, keys, list(ENDS)).select(*tracks.columns).unionByName(others)
