"""Grids of frames and names without holes, time axes, unions of frames, evenly placed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import fill_short_gaps, position
from .series import Keys, along

#: A gap of any length.
ANY_GAP = 2**31 - 1


def pivoted(df: DataFrame, keys: Keys, names: list[str], axes: list[str], *, index: str = "frame_index", name: str = "joint_name", scale: float = 1.0) -> DataFrame:
    """One row for each value of the index and a column <name>_<axis> for each wanted name.

    Repeated points are averaged. Missing values lie on the line between their neighbours at any distance, by rows and not by the
    index; before the first and behind the last value that one holds. A name without a value in a series stays null there.
    """
    columns = {f"{n}_{a}": F.avg(F.when(F.col(name) == n, F.col(a) * scale)) for n in names for a in axes}
    wide = df.groupBy(*keys, index).agg(*[value.alias(c) for c, value in columns.items()])
    return fill_short_gaps(wide, keys, list(columns), ANY_GAP, edges=True, order=index)


def time_axis(df: DataFrame, keys: Keys, *, frames: DataFrame | None = None, time: str = "timestamp_sec", order: str = "frame_index") -> DataFrame:
    """Mean time of each frame (of those given, or of its own), mended like the values of a grid."""
    times = df.groupBy(*keys, order).agg(F.avg(time).alias(time))
    if frames is not None:
        times = frames.select(*keys, order).distinct().join(times, [*keys, order], "left")
    return fill_short_gaps(times, keys, [time], ANY_GAP, edges=True, order=order)


def frame_times(df: DataFrame, keys: Keys, first_by: list[str], *, time: str = "timestamp_sec", order: str = "frame_index") -> DataFrame:
    """The time of each frame's first row in the order of the columns given."""
    return df.groupBy(*keys, order).agg(F.min_by(time, F.struct(*first_by)).alias(time))


def frame_union(tables: dict[str, DataFrame], keys: Keys, value: str, *, order: str = "frame_index") -> DataFrame:
    """Every frame that any of the tables has, with a column for each table's value; null where it has none.

    The tables are stacked and grouped: one shuffle, whatever their number.
    """
    stacked = None
    for name, df in tables.items():
        one = df.select(*keys, order, F.lit(name).alias("_of"), F.col(value).alias("_value"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return frame_columns(stacked, list(tables), keys, "_value", name="_of", order=order)


def frame_columns(df: DataFrame, names: list[str], keys: Keys, value: str, *, name: str = "joint_name", order: str = "frame_index") -> DataFrame:
    """frame_union of the wanted names of one table, which is read once."""
    return df.filter(F.col(name).isin(*names)).groupBy(*keys, order).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def combined_score(union: DataFrame, keys: Keys, weights: dict[str, float], *, name: str = "score") -> DataFrame:
    """Weighted sum of the columns, each as a share of its series' largest size (0 where that is 0 or the value is missing)."""
    whole, total = Window.partitionBy(*keys), F.lit(0.0)
    for c, weight in weights.items():
        most = F.max(F.abs(c)).over(whole)
        total = total + weight * F.coalesce(F.abs(c) / F.when(most > 0, most), F.lit(0.0))
    return union.withColumn(name, total)


def sampled_trajectory(df: DataFrame, keys: Keys, axes: list[str], *, most: int = 24, radius: int = 0, order: str = "frame_index") -> DataFrame:
    """At most `most` rows of a series, evenly placed with both ends among them; each the median of the whole points at most `radius` rows off.

    Rows whose neighbourhood has no whole point are left out. Places are found by arithmetic on the row's number: no list of the series.
    """
    whole = F.lit(True)
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    df = position(df, keys, order=order)
    # Row p is sample k if k * (n - 1) / (most - 1), rounded down, is p.
    k = F.ceil(F.col("pos") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    placed = (F.col("n") <= most) | ((k < most) & (F.floor(k * (F.col("n") - 1) / (most - 1)) == F.col("pos")))
    around = along(keys, order).rowsBetween(-radius, radius)
    near = lambda a: F.array_sort(F.collect_list(F.when(whole, F.col(a))).over(around))
    df = df.withColumns({f"_{a}": near(a) for a in axes} | {"_placed": placed})
    at = lambda a, i: F.get(F.col(f"_{a}"), i.cast("int"))
    n = F.size(f"_{axes[0]}")
    median = {a: (at(a, F.floor((n - 1) / 2)) + at(a, F.floor(n / 2))) / 2 for a in axes}
    df = df.filter(F.col("_placed") & (n > 0)).withColumns(median)
    return df.drop("pos", "n", "_placed", *[f"_{a}" for a in axes])


def projection_bounds(points: DataFrame, keys: Keys, projections: dict[str, tuple[str, str]], *, low: float = 0.05, high: float = 0.95, pad: float = 0.15, least_pad: float = 1e-4) -> DataFrame:
    """Bounds of a series' points on several planes: low and high percentiles of both axes, padded by a share of their distance. One row a plane, one pass over the points."""
    flat = points.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("projection"), F.col(a).alias("h"), F.col(b).alias("v")) for p, (a, b) in projections.items()])).alias("p")).select(*keys, "p.*")
    share = lambda c: F.percentile(c, F.array(F.lit(low), F.lit(high)))
    found = flat.groupBy(*keys, "projection").agg(share("h").alias("h"), share("v").alias("v"))
    edge = lambda c, i, sign: F.get(c, i) + sign * F.greatest((F.get(c, 1) - F.get(c, 0)) * pad, F.lit(least_pad))
    return found.select(*keys, "projection", *[edge(c, i, s).alias(f"{name}_{c}") for c in "hv" for name, i, s in (("min", 0, -1), ("max", 1, 1))])


def projection_context(frames: DataFrame, keys: Keys, joints: list[str], center: list[Column], scale: Column, sign: Column, projections: dict[str, tuple[str, str]]) -> DataFrame:
    """Bounds of a body on several planes: points about each frame's centre, the second axis turned up by the frame's sign, over the median of the frames' positive scales (1 without any).

    frames has a struct (x, y, z) for each joint.
    """
    there = F.coalesce(*[F.col(j) for j in joints]).isNotNull()
    df = frames.filter(there).withColumns({"_scale": scale, "_sign": sign, **{f"_c{a}": c for a, c in zip("xyz", center, strict=True)}})
    stable = F.coalesce(F.median(F.when(F.col("_scale") > 0, F.col("_scale"))).over(Window.partitionBy(*keys)), F.lit(1.0))
    df = df.withColumn("body_scale", stable)
    point = lambda j: F.struct(*[((F.col(f"{j}.{a}") - F.col(f"_c{a}")) * (F.col("_sign") if a == "y" else 1.0) / F.col("body_scale")).alias(a) for a in "xyz"])
    points = df.select(*keys, "body_scale", F.explode(F.array(*[F.when(F.col(j).isNotNull(), point(j)) for j in joints])).alias("p")).filter("p IS NOT NULL").select(*keys, "body_scale", "p.*")
    return projection_bounds(points, [*keys, "body_scale"], projections)
