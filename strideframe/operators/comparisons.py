"""Bundles of measures side by side: public values, a pitch against a coach's, angles by kind of action, first values, chosen trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import delta_degrees, joint_angle
from ..functions.scoring import band_status, percent_gap, percent_of, percent_status
from .bundles import at, lean_2d, yaw
from .series import Keys

#: Measures of the public table, the column each comes from, and whether its size, 180 less it, or it itself counts.
PUBLIC = (
    ("trunk_rotation_velocity", "trunk_rotation_velocity_deg_s", "size"), ("pelvis_rotation_velocity", "pelvis_rotation_velocity_deg_s", "size"), ("hip_shoulder_separation", "hip_shoulder_separation_deg", "size"),
    ("hand_speed_proxy", "hand_speed_proxy", "size"), ("left_knee_flexion", "left_knee_angle_deg", "flexion"), ("right_knee_flexion", "right_knee_angle_deg", "flexion"), ("left_wrist_speed", "left_wrist_speed", "value"), ("right_wrist_speed", "right_wrist_speed", "value"),
)


def public_values(features: DataFrame, keys: Keys, *, share: float = 0.95) -> DataFrame:
    """95th percentiles of eight measures of motion features; one aggregate."""
    kinds = {"size": F.abs, "flexion": lambda c: 180.0 - F.col(c), "value": F.col}
    return features.groupBy(*keys).agg(*[F.percentile(kinds[kind](column), F.lit(share)).alias(name) for name, column, kind in PUBLIC])


#: A pitch's measures, their unit, and how each is judged: an angle (or its size) by its usual range, a share by what warns and what is good, or not at all.
PITCH = (
    ("elbow_bend", "elbow_bend_deg", "deg", "angle", 145, 175), ("arm_abduction", "arm_abduction_deg", "deg", "angle", 85, 115), ("trunk_lean", "trunk_lean_deg", "deg", "angle", 10, 35), ("stride_angle", "stride_angle_deg", "deg", "angle", 45, 75),
    ("lead_knee", "lead_knee_deg", "deg", "angle", 115, 155), ("hip_shoulder_sep", "hip_shoulder_sep_deg", "deg", "size", 35, 65), ("arm_speed", "arm_speed_mps", "%", "relative", 70, 100), ("stride_length", "stride_length_pct_height", "%height", "share", 75, 95),
    ("weight_transfer", "weight_transfer_pct", "%stride", "none", 0, 0), ("head_stability", "head_stability_pct", "%", "share", 65, 85), ("foot_direction", "foot_direction_deg", "deg", "size", 0, 20), ("wrist_snap", "wrist_snap_deg", "deg", "angle", 145, 180),
    ("fingertip_speed", "fingertip_speed_mps", "%", "relative", 70, 100),
)


def compared_pitch(bundles: DataFrame, coach: DataFrame, keys: Keys, on: Keys) -> DataFrame:
    """Thirteen rows for each pitch: position, metric, value, coach_value, unit, status and gap_score against the coach's bundle of its key (if there is one).

    Speeds are percent of the coach's, whose own value then is 100.
    """
    theirs = coach.select(*on, *[F.col(c).alias(f"_{c}") for _, c, *_ in PITCH])
    df = bundles.join(theirs, on, "left")
    rows = []
    for i, (name, column, unit, how, low, high) in enumerate(PITCH):
        own, other = F.col(column), F.col(f"_{column}")
        value, reference = (percent_of(own, other), F.when(other.isNotNull(), 100.0)) if how == "relative" else (own, other)
        judged = F.abs(value) if how == "size" else value
        status = F.lit("warn") if how == "none" else percent_status(value, low, high) if how in ("share", "relative") else band_status(judged, F.lit(low), F.lit(high))
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("metric"), value.alias("value"), reference.cast("double").alias("coach_value"), F.lit(unit).alias("unit"), status.alias("status")))
    out = df.select(*keys, F.inline(F.array(*rows)))
    return out.withColumn("gap_score", percent_gap(F.col("value"), F.col("coach_value")))


def angle_series(frames: DataFrame, keys: Keys, pitching: Column) -> DataFrame:
    """frame_index, name, value: knee (the left one of pitches, else the right), elbow, trunk tilt and hip-shoulder separation of every frame; four rows a frame."""
    knee = lambda s: joint_angle(at(f"{s}_hip"), at(f"{s}_knee"), at(f"{s}_ankle"))
    values = {
        "knee": F.when(pitching, knee("left")).otherwise(knee("right")), "elbow": joint_angle(at("right_shoulder"), at("right_elbow"), at("right_wrist")), "trunk_tilt": lean_2d(at("neck")[:2], at("hip")[:2]),
        "hip_shoulder_separation": F.abs(delta_degrees(yaw("right_hip", "left_hip"), yaw("right_shoulder", "left_shoulder"))),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    return frames.select(*keys, "frame_index", F.inline(rows))


def first_value(rows: DataFrame, keys: Keys, value: str, order: list[str]) -> DataFrame:
    """The first finite value of each key in the order given; null where there is none."""
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf"))
    return rows.groupBy(*keys).agg(F.min_by(F.when(finite, F.col(value)), F.when(finite, F.struct(*order))).alias(value))


def selected_trial(trials: DataFrame, order: list[str], *, trial_id: str | None = None, action_type: str | None = None) -> DataFrame:
    """One row: the trial of the id given, else the first one of the action (whatever the case of its letters); an error without one."""
    name = f"trial {trial_id}" if trial_id else f"trial of action {action_type}"
    wanted = F.col("trial_id").cast("string") == trial_id if trial_id else F.lower(F.col("action_type")) == (action_type or "").lower()
    wanted = wanted & F.col("trial_id").isNotNull()
    best = trials.agg(F.min_by(F.struct(*trials.columns), F.when(wanted, F.struct(*order))).alias("_t"), F.count(F.when(wanted, 1)).alias("_n"))
    found = best.select(F.when(F.col("_n") > 0, F.col("_t")).otherwise(F.raise_error(F.lit(f"no {name}"))).alias("_t"))
    return found.select("_t.*")
