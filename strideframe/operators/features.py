"""Motion features of a frame: angles, rotations, velocities, centre of mass, wrist speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .series import Keys, angular_velocity, change_from_start, speed

BODY = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")


def pivot_joints(df: DataFrame, keys: Keys, joints: list[str], axes: list[str], *, last: str | None = None) -> DataFrame:
    """One row for each frame with a struct of the axes for each joint (null where missing); of repeated rows the one with the largest `last` wins."""
    present = F.lit(True)
    for a in axes:
        present = present & F.col(a).isNotNull()
    order = F.col(last) if last else F.lit(1)
    pick = [F.max_by(F.when(present & (F.col("joint_name") == j), F.struct(*axes)), F.when(present & (F.col("joint_name") == j), order)).alias(j) for j in joints]
    return df.groupBy(*keys, "frame_index").agg(F.min("timestamp_sec").alias("timestamp_sec"), *pick)


def point(joint: str, axes: tuple[str, ...] = ("x", "y")) -> list[Column]:
    return [F.col(f"{joint}.{a}") for a in axes]


def center_of_mass(joints: list[str], axis: str) -> Column:
    """Mean of the joints that are there."""
    values = F.filter(F.array(*[F.col(f"{j}.{axis}") for j in joints]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return total / F.when(F.size(values) > 0, F.size(values))


def motion_features(df: DataFrame, keys: Keys, *, last: str | None = None) -> DataFrame:
    """Per frame: elbow and knee angles, shoulder and pelvis rotation, their separation and velocities, trunk tilt, centre of mass, wrist speeds."""
    joints = [f"{s}_{j}" for j in ("shoulder", "elbow", "wrist", "hip", "knee", "ankle") for s in ("left", "right")]
    f = pivot_joints(df, keys, joints, ["x", "y"], last=last)
    for s in ("left", "right"):
        f = f.withColumn(f"{s}_elbow_angle_deg", G.joint_angle(point(f"{s}_shoulder"), point(f"{s}_elbow"), point(f"{s}_wrist")))
        f = f.withColumn(f"{s}_knee_angle_deg", G.joint_angle(point(f"{s}_hip"), point(f"{s}_knee"), point(f"{s}_ankle")))
    f = f.withColumns({
        "trunk_rotation_deg": G.image_heading(point("left_shoulder"), point("right_shoulder")),
        "pelvis_rotation_deg": G.image_heading(point("left_hip"), point("right_hip")),
        "trunk_tilt_deg": G.tilt(G.midpoint(point("left_shoulder"), point("right_shoulder")), G.midpoint(point("left_hip"), point("right_hip"))),
        "com_x": center_of_mass(joints[:2] + joints[6:], "x"), "com_y": center_of_mass(joints[:2] + joints[6:], "y"),
    })
    f = f.withColumn("hip_shoulder_separation_deg", G.delta_degrees(F.col("pelvis_rotation_deg"), F.col("trunk_rotation_deg")))
    for name in ("trunk_rotation", "pelvis_rotation"):
        f = angular_velocity(f, keys, f"{name}_deg", name=f"{name}_velocity_deg_s")
    for s in ("left", "right"):
        f = angular_velocity(f, keys, f"{s}_elbow_angle_deg", name=f"{s}_elbow_velocity_deg_s", wrap=False)
        f = change_from_start(f, keys, f"{s}_knee_angle_deg", name=f"{s}_knee_extension_deg")
        f = f.withColumns({"_x": F.col(f"{s}_wrist.x"), "_y": F.col(f"{s}_wrist.y")})
        f = speed(f, keys, ["_x", "_y"], name=f"{s}_wrist_speed").drop("_x", "_y")
    return f.withColumn("hand_speed_proxy", F.greatest("left_wrist_speed", "right_wrist_speed")).drop(*joints)
