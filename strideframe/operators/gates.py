"""Gates: rows or points that a quality rule takes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import not_distrusted, pose_score
from ..functions.geometry import distance, midpoint
from ..schemas import LIMB_SEGMENTS
from .islands import position
from .series import Keys, along, next_present

Segments = tuple[tuple[str, str, str], ...]


def segment_lengths(points: DataFrame, frame_keys: Keys, axes: list[str], segments: Segments = LIMB_SEGMENTS) -> DataFrame:
    """A row for each frame and segment with both ends: the frame's joints side by side, then a row for each segment of the edge list."""
    joints = sorted({j for a, b, _ in segments for j in (a, b)})
    present = points.dropna(subset=axes).filter(F.col("joint_name").isin(*joints))
    wide = present.groupBy(*frame_keys).agg(*[F.max(F.when(F.col("joint_name") == j, F.struct(*axes))).alias(f"_{j}") for j in joints])
    ends = lambda j: [F.col(f"_{j}.{a}") for a in axes]
    row = lambda a, b, r: F.struct(F.lit(a).alias("proximal"), F.lit(b).alias("distal"), F.lit(r).alias("reject_joint"), distance(ends(a), ends(b)).alias("length"))
    return wide.select(*frame_keys, F.inline(F.array(*[row(*s) for s in segments]))).filter(F.col("length").isNotNull())


def limb_length_gate(df: DataFrame, keys: Keys, axes: list[str], tolerance: float, *, usable: Column | None = None, segments: Segments = LIMB_SEGMENTS) -> DataFrame:
    """Take out the joints whose segment is off its median length by more than a share of it."""
    points = df if usable is None else df.filter(usable)
    lengths = segment_lengths(points, [*keys, "frame_index"], axes, segments)
    lengths = lengths.withColumn("median", F.median("length").over(Window.partitionBy(*keys, "proximal", "distal")))
    bad = lengths.filter((F.col("median") > 0) & (F.abs(F.col("length") - F.col("median")) / F.col("median") > tolerance))
    bad = bad.select(*keys, "frame_index", F.col("reject_joint").alias("joint_name")).distinct().withColumn("_bad", F.lit(True))
    out = df.join(bad, [*keys, "frame_index", "joint_name"], "left")
    return out.withColumns({a: F.when(F.col("_bad").isNull(), F.col(a)) for a in axes}).drop("_bad")


def limb_gate_by_windows(df: DataFrame, keys: Keys, axes: list[str], tolerance: float, *, usable: Column, segments: Segments = LIMB_SEGMENTS) -> DataFrame:
    """limb_length_gate for segments that reject one joint each: the other end is looked up in a window over the frame, the median taken in one over the series. No join."""
    whole = usable
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    rejects = {r: b if r == a else a for a, b, r in segments}
    if len(rejects) != len(segments):
        raise ValueError("a joint is rejected by two segments")
    frame, joint = Window.partitionBy(*keys, "frame_index"), F.col("joint_name")
    others = sorted(set(rejects.values()))
    # The greatest of repeated points, as among the rejected ones.
    df = df.withColumns({f"_at_{o}": F.max(F.when(whole & (joint == o), F.struct(*axes))).over(frame) for o in others})
    df = df.withColumn("_own", F.max(F.when(whole, F.struct(*axes))).over(Window.partitionBy(*keys, "frame_index", "joint_name")))
    other = F.coalesce(*[F.when(joint == r, F.col(f"_at_{o}")) for r, o in rejects.items()])
    df = df.withColumn("_other", other).drop(*[f"_at_{o}" for o in others])
    df = df.withColumn("_length", distance([F.col(f"_own.{a}") for a in axes], [F.col(f"_other.{a}") for a in axes]))
    first = F.row_number().over(Window.partitionBy(*keys, "frame_index", "joint_name").orderBy(*axes)) == 1
    df = df.withColumn("_first", first)
    df = df.withColumn("_usual", F.median(F.when(F.col("_first"), F.col("_length"))).over(Window.partitionBy(*keys, "joint_name")))
    off = F.coalesce((F.col("_usual") > 0) & (F.abs(F.col("_length") - F.col("_usual")) / F.col("_usual") > tolerance), F.lit(False))
    return df.withColumns({a: F.when(~off, F.col(a)) for a in axes}).drop("_own", "_other", "_length", "_first", "_usual")


def without_frames(df: DataFrame, keys: Keys, frames: DataFrame, axes: list[str]) -> DataFrame:
    """All points of some frames are taken out; the rows stay."""
    out = df.join(frames.select(*keys, "frame_index").distinct().withColumn("_bad", F.lit(True)), [*keys, "frame_index"], "left")
    return out.withColumns({a: F.when(F.col("_bad").isNull(), F.col(a)) for a in axes}).drop("_bad")


def torso_centers(df: DataFrame, keys: Keys, threshold: float) -> DataFrame:
    """(cx, cy) of every frame: middle of the hips, else of the shoulders, else mean of what there is of both; null without any."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & not_distrusted(pose_score(), threshold)
    pick = lambda joint: F.max_by(F.when(ok & (F.col("joint_name") == joint), F.struct("x", "y")), F.when(ok & (F.col("joint_name") == joint), F.lit(1)))
    torso = ["left_hip", "right_hip", "left_shoulder", "right_shoulder"]
    any_ = lambda a: F.avg(F.when(ok & F.col("joint_name").isin(*torso), F.col(a)))
    frames = df.groupBy(*keys, "frame_index").agg(*[pick(j).alias(j) for j in torso], any_("x").alias("ax"), any_("y").alias("ay"))
    both = lambda a, b: midpoint([F.col(f"{a}.x"), F.col(f"{a}.y")], [F.col(f"{b}.x"), F.col(f"{b}.y")])
    hips, shoulders = both("left_hip", "right_hip"), both("left_shoulder", "right_shoulder")
    return frames.select(*keys, "frame_index", F.coalesce(hips[0], shoulders[0], "ax").alias("cx"), F.coalesce(hips[1], shoulders[1], "ay").alias("cy"))


def isolated_jumps(df: DataFrame, keys: Keys, multiplier: float | Column, *, floor: float = 0.03, least: int = 5) -> DataFrame:
    """Mark points far from both neighbours while the neighbours are close: column `jump`. First and last rows are never marked.

    Far is beyond the larger of the floor and multiplier times the median step that is not zero.
    """
    w, whole = along(keys), Window.partitionBy(*keys)
    here = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))
    df = position(df, keys).withColumn("_here", here)
    df = df.withColumns({
        "_prev": F.last("_here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_next": next_present("_here", keys),
    })
    gap = lambda a, b: distance([F.col(f"{a}.x"), F.col(f"{a}.y")], [F.col(f"{b}.x"), F.col(f"{b}.y")])
    df = df.withColumn("_step", gap("_prev", "_here"))
    df = df.withColumns({"_median": F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(whole), "_points": F.count("_here").over(whole)})
    far = F.greatest(F.col("_median") * multiplier, F.lit(floor))
    jump = (F.col("_points") >= least) & F.col("_median").isNotNull() & (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)
    jump = jump & (F.col("_step") > far) & (gap("_here", "_next") > far) & (gap("_prev", "_next") < far)
    return df.withColumn("jump", F.coalesce(jump, F.lit(False))).drop("pos", "n", "_here", "_prev", "_next", "_step", "_median", "_points")


def prior_gate(points3d: DataFrame, points2d: DataFrame, keys: Keys, threshold: float) -> DataFrame:
    """3-D points whose 2-D observation is not trusted lose their coordinates and take its score; others keep the smaller score."""
    score = points2d.select(*keys, "frame_index", "joint_name", pose_score().alias("prior"))
    out = points3d.join(score, [*keys, "frame_index", "joint_name"], "left")
    rejected = F.coalesce(F.col("prior") < threshold, F.lit(False))
    out = out.withColumns({a: F.when(~rejected, F.col(a)) for a in ("x_3d", "y_3d", "z_3d")})
    return out.withColumn("input_quality_score", F.when(rejected, F.col("prior")).otherwise(F.least("input_quality_score", "prior"))).drop("prior")
