"""Ordered-series operators: steps, speeds, turns, smoothing windows, gradients, nearest neighbours, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import delta_degrees, distance

Keys = list[str]


def along(keys: Keys, order: str = "frame_index"):
    return Window.partitionBy(*keys).orderBy(order)


def next_present(column: str, keys: Keys, order: str = "frame_index") -> Column:
    """First non-null value behind the row, in one pass over the series; a frame from the row to the series' end is read anew for every row."""
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    return F.expr(f"lead({quoted([column])}) IGNORE NULLS OVER (PARTITION BY {quoted(keys)} ORDER BY {quoted([order])})")


def steps(df: DataFrame, keys: Keys, axes: list[str], *, order: str = "frame_index", name: str = "step") -> DataFrame:
    """Distance from the row before. Filter missing rows first to step over them, or keep them to get null beside a gap."""
    w = along(keys, order)
    return df.withColumn(name, distance([F.lag(a).over(w) for a in axes], [F.col(a) for a in axes]))


def temporal_jitter(df: DataFrame, keys: Keys, axes: list[str]) -> DataFrame:
    """Mean step between consecutive present points of each series."""
    present = df.dropna(subset=axes)
    return steps(present, keys, axes).groupBy(*keys).agg(F.avg("step").alias("jitter"), F.count("step").alias("n_steps"))


def second_difference(df: DataFrame, keys: Keys, axes: list[str]) -> DataFrame:
    """Mean length of x(t + 1) - 2 x(t) + x(t - 1) over consecutive present points."""
    w, total = along(keys), F.lit(0.0)
    for a in axes:
        d = F.col(a) - 2 * F.lag(a, 1).over(w) + F.lag(a, 2).over(w)
        total = total + d * d
    found = df.dropna(subset=axes).withColumn("_d2", F.sqrt(total))
    return found.groupBy(*keys).agg(F.avg("_d2").alias("smoothness"), F.count("_d2").alias("n_triples"))


def _previous(keys: Keys, value: Column, order: str) -> Column:
    """Last non-null value before this row."""
    return F.last(value, ignorenulls=True).over(along(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def speed(df: DataFrame, keys: Keys, axes: list[str], *, time: str = "timestamp_sec", order: str = "frame_index", name: str = "speed") -> DataFrame:
    """Distance to the last present point, by time; null where time does not advance."""
    present = F.when(F.greatest(*[F.col(a).isNull().cast("int") for a in axes], F.lit(0)) == 0, F.struct(*axes, time))
    before = _previous(keys, present, order)
    dt = F.col(time) - before[time]
    return df.withColumn(name, distance([before[a] for a in axes], [F.col(a) for a in axes]) / F.when(dt > 0, dt))


def angular_velocity(df: DataFrame, keys: Keys, angle: str, *, time: str = "timestamp_sec", order: str = "frame_index", name: str = "velocity", wrap: bool = True) -> DataFrame:
    """Change of an angle since its last present value, by time; wrap takes the shortest turn."""
    before = _previous(keys, F.when(F.col(angle).isNotNull(), F.struct(angle, time)), order)
    dt = F.col(time) - before[time]
    turn = delta_degrees(before[angle], F.col(angle)) if wrap else F.col(angle) - before[angle]
    return df.withColumn(name, turn / F.when(dt > 0, dt))


def change_from_start(df: DataFrame, keys: Keys, value: str, *, order: str = "frame_index", name: str = "change") -> DataFrame:
    first = F.first(value, ignorenulls=True).over(along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.col(value) - first)


def moving_average(df: DataFrame, keys: Keys, value: str, radius: int, *, order: str = "frame_index", name: str = "smooth") -> DataFrame:
    """Centred mean of the present values; windows are cut at the ends."""
    return df.withColumn(name, F.avg(value).over(along(keys, order).rowsBetween(-radius, radius)))


def unwrapped(df: DataFrame, keys: Keys, angle: str, *, period: float = 360.0, order: str = "frame_index", name: str = "unwrapped") -> DataFrame:
    """Angles in degrees made continuous: the first one plus the sum of the shortest turns; a period of 180 for the axis of a stick without a front."""
    w = along(keys, order)
    turn = F.coalesce(F.pmod(F.col(angle) - F.lag(angle).over(w) + period / 2, F.lit(period)) - period / 2, F.lit(0.0))
    df = df.withColumn("_turn", turn)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.first(angle).over(upto) + F.sum("_turn").over(upto)).drop("_turn")


def rotation_range(df: DataFrame, keys: Keys, angle: str) -> DataFrame:
    out = unwrapped(df.dropna(subset=[angle]), keys, angle)
    return out.groupBy(*keys).agg((F.max("unwrapped") - F.min("unwrapped")).alias("rotation_range"))


def gradient(df: DataFrame, keys: Keys, value: str, *, time: str = "timestamp_sec", order: str = "frame_index", name: str = "gradient") -> DataFrame:
    """Second-order central difference with uneven spacing; one-sided at the ends."""
    w = along(keys, order)
    x, t = F.col(value), F.col(time)
    before, after = x - F.lag(x).over(w), F.lead(x).over(w) - x
    hb, ha = t - F.lag(t).over(w), F.lead(t).over(w) - t
    zero = F.lit(0.0)
    middle = (hb * hb * after + ha * ha * before) / F.nullif(ha * hb * (ha + hb), zero)
    return df.withColumn(name, F.coalesce(middle, after / F.nullif(ha, zero), before / F.nullif(hb, zero)))


def curvature(df: DataFrame, keys: Keys, axes: list[str], *, order: str = "frame_index", name: str = "curvature") -> DataFrame:
    """One over the radius of the circle through three consecutive points; null at the ends and for equal points."""
    w = along(keys, order)
    p, q, r = [F.lag(a).over(w) for a in axes], [F.col(a) for a in axes], [F.lead(a).over(w) for a in axes]
    a, b, c = distance(q, r), distance(p, r), distance(p, q)
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))
    sides = a * b * c
    return df.withColumn(name, F.when(sides.isNotNull(), 4 * area / F.when(sides > 0, sides)))


def sampling_rate(df: DataFrame, keys: Keys, *, time: str = "timestamp_sec", order: str = "frame_index") -> DataFrame:
    """One over the median positive time step."""
    dt = F.col(time) - F.lag(time).over(along(keys, order))
    return df.withColumn("_dt", dt).groupBy(*keys).agg((1.0 / F.median(F.when(F.col("_dt") > 0, F.col("_dt")))).alias("rate_hz"))


def neighbours(df: DataFrame, keys: Keys, usable: Column, columns: list[str], *, order: str = "frame_index") -> DataFrame:
    """Nearest usable rows strictly before and behind each row, as structs `before` and `after`."""
    df = df.withColumn("_found", F.when(usable, F.struct(order, *columns)))
    before = F.last("_found", ignorenulls=True).over(along(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"before": before, "after": next_present("_found", keys, order)}).drop("_found")


def first_peak(df: DataFrame, keys: Keys, value: Column, *, order: str = "frame_index", carry: list[str] | None = None) -> DataFrame:
    """Largest value of each series with the first row that has it."""
    best = F.max_by(F.struct(order, *(carry or [])), F.struct(value, -F.col(order)))
    out = df.filter(value.isNotNull()).groupBy(*keys).agg(F.max(value).alias("peak"), best.alias("_at"))
    return out.select(*keys, "peak", F.col(f"_at.{order}").alias("peak_frame"), *[F.col(f"_at.{c}").alias(c) for c in carry or []])


def nearest_frame(df: DataFrame, keys: Keys, target: Column, *, order: str = "frame_index") -> DataFrame:
    """The frame of each series nearest to a target; the earlier of two."""
    return df.groupBy(*keys).agg(F.min_by(order, F.struct(F.abs(F.col(order) - target), F.col(order))).alias("nearest_frame"))


def end_displacement(df: DataFrame, keys: Keys, axes: list[str], *, share: float = 0.1, order: str = "frame_index") -> DataFrame:
    """Mean of the last tenth minus mean of the first tenth of the rows, at least one row each."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy(order))})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    part = lambda a, on: F.avg(F.when(on, F.col(a)))
    return df.groupBy(*keys).agg(*[(part(a, F.col("_i") > F.col("_n") - k) - part(a, F.col("_i") <= k)).alias(f"d_{a}") for a in axes])


def along_movement_axis(df: DataFrame, keys: Keys, axes: list[str], *, order: str = "frame_index", name: str = "along_axis") -> DataFrame:
    """Position on the line from the first to the last point of the series, from the first point on."""
    whole = along(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = [F.first(a).over(whole) for a in axes], [F.last(a).over(whole) for a in axes]
    size = distance(first, last)
    total = F.lit(0.0)
    for a, f, l in zip(axes, first, last, strict=True):
        total = total + (F.col(a) - f) * (l - f)
    return df.withColumn(name, total / F.when(size > 0, size))
