"""Quality metrics, numeric profiles, regions of interest and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import pose_score, trusted
from ..functions.geometry import distance
from .gates import segment_lengths
from .series import Keys, along


def frame_completeness(df: DataFrame, keys: Keys, joints: list[str], threshold: float) -> DataFrame:
    """Mean over frames of the share of wanted joints that are present and trusted."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & trusted(pose_score(), threshold) & F.col("joint_name").isin(*joints)
    frames = df.groupBy(*keys, "frame_index").agg((F.count_distinct(F.when(ok, F.col("joint_name"))) / len(joints)).alias("share"))
    return frames.groupBy(*keys).agg(F.avg("share").alias("completeness"), F.count(F.lit(1)).alias("frames"))


def completeness(df: DataFrame, keys: Keys, joints: list[str]) -> DataFrame:
    """Share of wanted joints that occur at all."""
    here = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("joint_name").isin(*joints), F.col("joint_name"))
    return df.groupBy(*keys).agg((F.count_distinct(here) / len(joints)).alias("completeness"))


def missing_rate(df: DataFrame, keys: Keys, joint: str, threshold: float) -> DataFrame:
    """Share of frames without a trusted observation of a joint."""
    ok = (F.col("joint_name") == joint) & F.col("x").isNotNull() & F.col("y").isNotNull() & trusted(pose_score(), threshold)
    frames = df.groupBy(*keys, "frame_index").agg(F.max(ok.cast("int")).alias("ok"))
    return frames.groupBy(*keys).agg((1 - F.avg("ok")).alias("missing_rate"))


def first_per_frame(df: DataFrame, keys: Keys, value: str, order: str) -> DataFrame:
    """Mean of a value that all rows of a frame repeat, taken once a frame."""
    frames = df.groupBy(*keys, "frame_index").agg(F.min_by(value, order).alias("v"))
    return frames.groupBy(*keys).agg(F.avg("v").alias(f"mean_{value}"))


def joint_stability(df: DataFrame, keys: Keys, threshold: Column | float, *, multiplier: float = 3.5, floor: float = 0.03) -> DataFrame:
    """Frames, valid frames and ratio, low-score frames, median score, mean and p95 step, jumps beyond the larger of floor and multiplier times the median step."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & trusted(pose_score(), threshold)
    df = df.withColumns({"score": pose_score(), "ok": ok})
    whole, here = Window.partitionBy(*keys), F.when(F.col("ok"), F.struct("x", "y"))
    before = F.last(here, ignorenulls=True).over(along(keys).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_before", before)
    step = F.when(F.col("ok"), distance([F.col("_before.x"), F.col("_before.y")], [F.col("x"), F.col("y")]))
    df = df.withColumn("step", step)
    median = F.median(F.when(F.col("step") > 0, F.col("step"))).over(whole)
    df = df.withColumns({"_n": F.count("step").over(whole), "_median": median})
    limit = F.when(F.col("_n") >= 3, F.greatest(F.coalesce("_median", F.lit(0.0)) * multiplier, F.lit(floor)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"), F.count_if("ok").alias("valid_frames"), F.avg(F.col("ok").cast("double")).alias("valid_ratio"),
        F.count_if(F.coalesce(F.col("score") < threshold, F.lit(False))).alias("low_visibility_frames"), F.median("score").alias("median_score"), F.avg("step").alias("mean_step"),
        F.percentile("step", F.lit(0.95)).alias("p95_step"), F.count_if(F.coalesce(F.col("step") > limit, F.lit(False))).alias("jump_outlier_frames"),
    )


def limb_stability(points: DataFrame, keys: Keys, axes: list[str], tolerance: float) -> DataFrame:
    """Samples, median, population deviation, coefficient of variation and outliers of every limb segment."""
    seg = [*keys, "proximal", "distal"]
    lengths = segment_lengths(points, [*keys, "frame_index"], axes)
    lengths = lengths.withColumn("_median", F.median("length").over(Window.partitionBy(*seg)))
    off = F.abs(F.col("length") - F.col("_median")) / F.when(F.col("_median") > 0, F.col("_median")) > tolerance
    mean = F.avg("length")
    return lengths.groupBy(*seg).agg(
        F.count(F.lit(1)).alias("samples"), F.first("_median").alias("median_length"), F.stddev_pop("length").alias("stdev_length"),
        (F.stddev_pop("length") / F.when(mean > 0, mean)).alias("cv_length"), F.count_if(F.coalesce(off, F.lit(False))).alias("outlier_samples"),
    )


def numeric_profile(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """count, mean, median, min, max, range, peak_abs, p05, p95, p95_abs; percentiles are exact."""
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"),
        F.max(F.abs(x)).alias("peak_abs"), F.percentile(x, F.lit(0.05)).alias("p05"), F.percentile(x, F.lit(0.95)).alias("p95"), F.percentile(F.abs(x), F.lit(0.95)).alias("p95_abs"),
    )


def profile_columns(df: DataFrame, keys: Keys, columns: list[str]) -> DataFrame:
    """The profile of several columns, one row each."""
    return numeric_profile(df.unpivot(keys, columns, "column_name", "value"), [*keys, "column_name"], "value")


def robust_scale(value: Column, share: float = 0.95, floor: float = 1.0) -> Column:
    """Percentile of the positive values, at least the floor; an aggregate expression."""
    return F.greatest(F.coalesce(F.percentile(F.when(value > 0, value), F.lit(share)), F.lit(floor)), F.lit(floor))


def frame_boxes(df: DataFrame, keys: Keys, *, least_joints: int, threshold: float) -> DataFrame:
    """Bounding box of the trusted joints of every frame with enough of them."""
    ok = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & trusted(pose_score(), threshold))
    boxes = ok.groupBy(*keys, "frame_index").agg(F.count(F.lit(1)).alias("joints"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return boxes.filter(F.col("joints") >= least_joints)


def prior_region(boxes: DataFrame, keys: Keys, *, pad: float = 0.1) -> DataFrame:
    """One region for a series: low percentiles of the boxes' left and top edges, high ones of the right and bottom, padded and kept in [0, 1]."""
    edge = boxes.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(c) for c, q in (("x0", 0.10), ("y0", 0.05), ("x1", 0.90), ("y1", 0.95))], F.count(F.lit(1)).alias("frames"))
    w, h = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    keep = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return edge.select(*keys, keep(F.col("x0") - w).alias("x0"), keep(F.col("y0") - h).alias("y0"), keep(F.col("x1") + w).alias("x1"), keep(F.col("y1") + h).alias("y1"), "frames")


def union_box(boxes: DataFrame, keys: Keys) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def supplement(main: DataFrame, more: DataFrame, on: Keys, value: str) -> DataFrame:
    """Full outer join of two metric tables in which the first one's values win."""
    a, b = main.select(*on, F.col(value).alias("_a")), more.select(*on, F.col(value).alias("_b"))
    return a.join(b, on, "full").select(*on, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNull(), "supplement").otherwise("main").alias("origin"))


def weighted_score(scores: DataFrame, keys: Keys, weights: DataFrame, component: str) -> DataFrame:
    """Weighted mean over the components that have a score; weights is a small table (component, weight)."""
    joined = scores.filter("score is not null").join(weights, component)
    return joined.groupBy(*keys).agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.count(F.lit(1)).alias("components"))
