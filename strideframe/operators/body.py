"""Body measures over frames with a struct for each joint or marker: heights, stability, strides, normalised poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .series import Keys


def mean_point(structs: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> list[Column]:
    """Mean of the points that are there, by axis."""
    out = []
    for a in axes:
        there = F.filter(F.array(*[F.col(f"{s}.{a}") for s in structs]), lambda v: v.isNotNull())
        out.append(F.aggregate(there, F.lit(0.0), lambda t, v: t + v) / F.when(F.size(there) > 0, F.size(there)))
    return out


def first_pair(pairs: list[tuple[str, str]]) -> Column:
    """struct(a, b) of the first pair of points that are both there."""
    return F.coalesce(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("a"), F.col(b).alias("b"))) for a, b in pairs])


def column_median(values: list[Column]) -> Column:
    """Median over columns of a row, of those that are there."""
    there = F.array_sort(F.filter(F.array(*values), lambda v: v.isNotNull()))
    n = F.size(there)
    at = lambda i: F.get(there, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def body_scale(pairs: list[tuple[str, str]], axes: tuple[str, ...]) -> Column:
    """Median of the lengths between pairs of points."""
    return column_median([distance([F.col(f"{a}.{x}") for x in axes], [F.col(f"{b}.{x}") for x in axes]) for a, b in pairs])


def height_span(points: DataFrame, keys: Keys, axis: str, share: float = 0.9) -> DataFrame:
    """Percentile over frames of the span of all points on an axis."""
    frames = points.groupBy(*keys, "frame_index").agg((F.max(axis) - F.min(axis)).alias("span"))
    return frames.groupBy(*keys).agg(F.percentile("span", F.lit(share)).alias("height"))


def stability(df: DataFrame, keys: Keys, axes: list[str]) -> DataFrame:
    """100 less the largest distance from the mean place, as a share of the length of the ranges' vector; 0 to 100."""
    w = Window.partitionBy(*keys)
    off = distance([F.avg(a).over(w) for a in axes], [F.col(a) for a in axes])
    span = F.lit(0.0)
    for a in axes:
        span = span + (F.max(a) - F.min(a)) ** 2
    out = df.dropna(subset=axes).withColumn("_off", off).groupBy(*keys).agg(F.max("_off").alias("_off"), F.sqrt(span).alias("_span"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - F.col("_off") / F.when(F.col("_span") > 1e-9, F.col("_span")))))
    return out.select(*keys, F.when(F.col("_span") > 1e-9, score).alias("stability"))


def unit_square(points: DataFrame, keys: Keys, across: str, up: str) -> DataFrame:
    """Points on the plane of two axes, scaled by the series' own range to [0, 1]; y grows downwards."""
    w = Window.partitionBy(*keys)
    part = lambda a: (F.col(a) - F.min(a).over(w)) / F.nullif(F.max(a).over(w) - F.min(a).over(w), F.lit(0.0))
    return points.withColumns({"px": part(across), "py": 1.0 - part(up)})


def centred(points: DataFrame, keys: Keys, axes: list[str], center: DataFrame, scale: str) -> DataFrame:
    """Points relative to a centre (c_<axis>) and divided by a scale that a table gives for each frame."""
    joined = points.join(center, [*keys, "frame_index"])
    return joined.withColumns({f"n_{a}": (F.col(a) - F.col(f"c_{a}")) / F.when(F.col(scale) > 0, F.col(scale)) for a in axes})


def stride_direction(df: DataFrame, keys: Keys, left: str, right: str, hip: str, axes: tuple[str, str]) -> DataFrame:
    """Unit vector between the ankles where they are farthest apart, turned to the side the hip moved to."""
    sep = distance([F.col(f"{left}.{a}") for a in axes], [F.col(f"{right}.{a}") for a in axes])
    at = F.max_by(F.struct(*[(F.col(f"{left}.{a}") - F.col(f"{right}.{a}")).alias(a) for a in axes]), F.struct(sep, -F.col("frame_index")))
    first, last = F.min_by(hip, "frame_index"), F.max_by(hip, "frame_index")
    g = df.groupBy(*keys).agg(at.alias("v"), F.max(sep).alias("d"), first.alias("h0"), last.alias("h1"))
    turn = sum((F.col(f"h1.{a}") - F.col(f"h0.{a}")) * F.col(f"v.{a}") for a in axes)
    sign = F.when(turn < 0, -1.0).otherwise(1.0)
    return g.select(*keys, *[(sign * F.col(f"v.{a}") / F.when(F.col("d") > 0, F.col("d"))).alias(f"dir_{a}") for a in axes])
