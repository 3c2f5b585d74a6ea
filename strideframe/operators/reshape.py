"""Long and wide tables, first-of-a-name rules and small set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_wide(df: DataFrame, keys: list[str], name: str, value: str, wanted: list[str], *, order: str | None = None) -> DataFrame:
    """One column for each wanted name; with `order` the last of repeated rows wins, else the largest."""
    pick = lambda n: F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))) if order else F.max(F.when(F.col(name) == n, F.col(value)))
    return df.groupBy(*keys).agg(*[pick(n).alias(n) for n in wanted])


def to_long(df: DataFrame, keys: list[str], columns: list[str], *, name: str = "metric_name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def explode_points(df: DataFrame, keys: list[str], array: str, names: str) -> DataFrame:
    """Arrays of (x, y, z) and of names, one row for each point."""
    return df.select(*keys, F.posexplode(F.arrays_zip(F.col(names).alias("point"), F.col(array).alias("xyz"))).alias("point_index", "p")).select(*keys, "point_index", "p.point", "p.xyz.*")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_i = 1").drop("_i")


def lowest(df: DataFrame, keys: list[str], value: str, k: int, *, order: str = "frame_index") -> DataFrame:
    """The k rows of each key with the smallest value, earlier rows first among equals."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value, order))).filter(F.col("rank") <= k)


def edges_present(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (first, second) of which a frame has both ends."""
    a = points.select(*keys, F.col("joint_name").alias("first"))
    b = points.select(*keys, F.col("joint_name").alias("second"))
    return a.join(F.broadcast(edges), "first").join(b, [*keys, "second"], "left_semi")
