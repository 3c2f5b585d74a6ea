"""Poses as arrays of points and as sets of named points: re-indexing between joint orders, centres, signs, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .series import Keys

# Places in the 17-point and 133-point orders, and the order of the foot points in the 26-point one.
SHOULDERS, HIPS, KNEES, ANKLES = (5, 6), (11, 12), (13, 14), (15, 16)
FEET = {"left": (17, 18, 19), "right": (20, 21, 22)}  # big toe, small toe, heel
BODY = 17


def _point(points: Column, k: int) -> Column:
    return F.get(points, F.lit(k))


def _middle(points: Column, pair: tuple[int, int]) -> Column:
    a, b = (_point(points, k) for k in pair)
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def _mean(scores: Column, pair: tuple[int, int]) -> Column:
    return (F.get(scores, F.lit(pair[0])) + F.get(scores, F.lit(pair[1]))) / 2


def _with_feet(points: Column, scores: Column, feet: list[Column], feet_scores: list[Column]) -> tuple[Column, Column]:
    """Body, head, neck, hip and feet in the 26-point order; feet: left and right of big toe, small toe and heel in turn."""
    body = F.slice(points, 1, BODY)
    out = F.concat(body, F.array(_point(points, 0), _middle(points, SHOULDERS), _middle(points, HIPS), *feet))
    out_scores = F.concat(F.slice(scores, 1, BODY), F.array(F.get(scores, F.lit(0)), _mean(scores, SHOULDERS), _mean(scores, HIPS), *feet_scores))
    return out, out_scores


def whole_body_to_26(points: Column, scores: Column) -> tuple[Column, Column]:
    """133 points (arrays of struct(x, y) and of scores) as 26: the body, head, a neck and a hip between the sides, feet."""
    order = [k for pair in zip(FEET["left"], FEET["right"], strict=True) for k in pair]
    return _with_feet(points, scores, [_point(points, k) for k in order], [F.get(scores, F.lit(k)) for k in order])


def fused_body_and_feet(body: Column, body_scores: Column, whole: Column, whole_scores: Column) -> tuple[Column, Column]:
    """A 17-point body with the feet of a 133-point pose; a foot that is too far from its ankle or too wide for the leg lies at the ankle with little trust."""
    points, scores = {}, {}
    for side, (knee, ankle) in enumerate(zip(KNEES, ANKLES, strict=True)):
        name = ("left", "right")[side]
        foot = [_point(whole, k) for k in FEET[name]]
        at, up = _point(body, ankle), _point(body, knee)
        gap = lambda a, b: distance([a["x"], a["y"]], [b["x"], b["y"]])
        leg = F.greatest(gap(at, up), F.lit(1.0))
        far, wide = F.greatest(*[gap(at, p) for p in foot]), F.greatest(gap(foot[0], foot[1]), gap(foot[0], foot[2]), gap(foot[1], foot[2]))
        good = (far <= leg * 0.75) & (wide <= leg * 0.55)
        points[name] = [F.when(good, p).otherwise(at) for p in foot]
        low = F.least(F.get(body_scores, F.lit(ankle)), F.lit(0.35))
        scores[name] = [F.when(good, F.get(whole_scores, F.lit(k))).otherwise(low) for k in FEET[name]]
    turns = lambda of: [p for pair in zip(of["left"], of["right"], strict=True) for p in pair]
    return _with_feet(body, body_scores, turns(points), turns(scores))


def pelvis_center(joints: list[str], axes: tuple[str, ...]) -> list[Column]:
    """The hip, else the middle of both hips, else one of them, else the nose, else the first joint that is there (columns of structs)."""
    have = [j for j in ("hip", "left_hip", "right_hip", "nose") if j in joints]
    middle = [[(F.col(f"left_hip.{a}") + F.col(f"right_hip.{a}")) / 2 for a in axes]] if {"left_hip", "right_hip"} <= set(joints) else []
    chain = lambda i, a: [F.col(f"{j}.{a}") for j in have[:1] if j == "hip"] + [m[i] for m in middle] + [F.col(f"{j}.{a}") for j in [*have, *joints] if j != "hip"]
    return [F.coalesce(*chain(i, a)) for i, a in enumerate(axes)]


def vertical_sign(points: DataFrame, keys: Keys, upper: list[str], lower: list[str], axis: str) -> DataFrame:
    """sign of an axis: 1 where the upper joints' median is above the lower ones' (or either is missing), else -1."""
    of = lambda names: F.median(F.when(F.col("joint_name").isin(*names), F.col(axis)))
    return points.groupBy(*keys).agg(F.when(of(upper) < of(lower), -1).otherwise(1).alias("sign"))


def complete_mean(structs: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> list[Column]:
    """Mean of the points that have all axes."""
    whole = [F.greatest(*[F.col(f"{s}.{a}").isNull().cast("int") for a in axes], F.lit(0)) == 0 for s in structs]
    n = sum((w.cast("int") for w in whole), F.lit(0))
    return [sum((F.when(w, F.col(f"{s}.{a}")).otherwise(0.0) for s, w in zip(structs, whole, strict=True)), F.lit(0.0)) / F.when(n > 0, n) for a in axes]


def prior_box(width: Column, height: Column, *, center: tuple[float, float] = (0.5, 0.5), share: tuple[float, float] = (0.5, 0.8)) -> list[Column]:
    """(x, y, width, height) about a usual centre, kept inside the image."""
    w, h = width * share[0], height * share[1]
    at = lambda size, part, c: F.greatest(F.lit(0.0), F.least(size - part, size * c - part / 2))
    return [at(width, w, center[0]), at(height, h, center[1]), w, h]
