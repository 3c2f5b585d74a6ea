"""Table schemas and the small dimensions of a body model."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType()}


def _schema(text: str) -> T.StructType:
    """From "name type, ..."; works before there is a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


KEYS = ["clip_id", "condition_id"]
_KEYED = "clip_id string, condition_id string, frame_index bigint, timestamp_sec double"

POSE2D = _schema(f"{_KEYED}, joint_name string, x double, y double, visibility double, confidence double, backend string, inference_time_ms double")
POSE3D = _schema(f"{_KEYED}, joint_name string, x_3d double, y_3d double, z_3d double, scale_mode string, lift_backend string, input_quality_score double")
OBJECT_TRACK = _schema(f"{_KEYED}, object_name string, x double, y double, x2 double, y2 double, confidence double, width int, height int, source string")
FRAME_MANIFEST = _schema(f"{_KEYED}, frame_path string, width int, height int")
CLIPS = _schema("clip_id string, source_path string, action_type string, fps_target double, difficulty_tags string, notes string")
MARKERS = _schema("trial_id string, frame_index bigint, timestamp_sec double, point string, x_mm double, y_mm double, z_mm double, residual double, valid int")
METRICS = _schema("clip_id string, condition_id string, metric_name string, joint_group string, value double, aggregation string, notes string")

# Joint groups, limb and foot segments (proximal, distal, joint to reject) and limb chains.
TORSO = ("nose", "head", "neck", "hip", "left_shoulder", "right_shoulder", "left_hip", "right_hip")
DISTAL = (
    "left_wrist", "right_wrist", "left_ankle", "right_ankle", "left_big_toe", "right_big_toe", "left_small_toe", "right_small_toe",
    "left_heel", "right_heel", "left_foot_index", "right_foot_index",
)
MID_LIMB = ("left_elbow", "right_elbow", "left_knee", "right_knee")
SIDES = ("left", "right")
LIMB_SEGMENTS = tuple((f"{s}_{a}", f"{s}_{b}", f"{s}_{b}") for a, b in (("shoulder", "elbow"), ("elbow", "wrist"), ("hip", "knee"), ("knee", "ankle")) for s in SIDES)
FOOT_SEGMENTS = tuple((f"{s}_ankle", f"{s}_{b}", f"{s}_{b}") for s in SIDES for b in ("big_toe", "small_toe", "heel"))
#: Joints that only a reconstructed skeleton has.
MARKER_JOINTS = ("spine1", "spine2", "spine3", *[f"{s}_{j}" for j in ("collar", "hand", "foot") for s in SIDES])
LIMB_CHAINS = tuple((f"{s}_{a}", f"{s}_{b}", f"{s}_{c}") for a, b, c in (("shoulder", "elbow", "wrist"), ("hip", "knee", "ankle")) for s in SIDES)
