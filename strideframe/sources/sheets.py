"""Workbooks by header position: marker exports and peer metrics, from the cells that read_cells gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """A finite number, or null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def marker_rows(cells: DataFrame, *, usual_rate: float = 100.0) -> DataFrame:
    """path, rate_hz, frame_index, joint_name, x, y, z from the first sheet of each workbook; a row for each frame and marker, axes null where blank.

    The rate is in A2, labels in the third row from the third column on, each for three columns; numbers begin in the sixth row,
    with the frame (from 1) in the first column. Rows without a frame are left out.
    """
    first = cells.groupBy("path").agg(F.min("sheet_index").alias("_first"))
    cells = cells.join(first, "path").filter(F.col("sheet_index") == F.col("_first")).select("path", "row", "column", "value")
    rate = cells.filter("row = 1 AND column = 0").select("path", _number(F.col("value")).alias("rate_hz"))
    labels = cells.filter("row = 2 AND column >= 2").select("path", F.col("column").alias("_start"), F.element_at(F.split("value", ":"), -1).alias("joint_name"))
    frames = cells.filter("row >= 5 AND column = 0").select("path", "row", (F.floor(_number(F.col("value"))) - 1).cast("long").alias("frame_index")).filter("frame_index IS NOT NULL")
    # A label holds for its own column and the two behind it.
    spots = labels.select("path", "joint_name", "_start", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_axis")).withColumn("column", F.col("_start") + F.col("_axis"))
    numbers = cells.filter("row >= 5").join(spots, ["path", "column"]).groupBy("path", "row", "_start").agg(*[F.max(F.when(F.col("_axis") == i, _number(F.col("value")))).alias(a) for i, a in enumerate("xyz")])
    every = frames.join(labels, "path").join(numbers, ["path", "row", "_start"], "left").join(rate, "path", "left")
    return every.select("path", F.coalesce("rate_hz", F.lit(usual_rate)).alias("rate_hz"), "frame_index", "joint_name", "x", "y", "z")


def peer_metrics(cells: DataFrame, names: DataFrame, units: dict[str, str], *, sheet: str, about: str, source: str, of_height: str, ending: str = ".xlsx") -> DataFrame:
    """path, athlete, metric_key, metric_name, value, unit: the metrics of peers' workbooks.

    The metric sheet has a name in the third column, a value in the fourth and a unit in the fifth; names maps names to keys, other
    names and rows without a number are left out, the last row of a key counts. Values in the unit of_height are percent and become
    shares. The athlete is the second part of the source's path in the sheet about the workbook, else the file's name.
    """
    name_of = lambda row: F.when(F.col("column") == row, F.col("value"))
    rows = cells.filter(F.col("sheet") == sheet).groupBy("path", "row").agg(*[F.max(name_of(i)).alias(c) for i, c in ((2, "metric_name"), (3, "_text"), (4, "_unit"))])
    rows = rows.withColumns({"metric_name": F.trim("metric_name"), "value": _number(F.col("_text")), "_unit": F.coalesce("_unit", F.lit(""))}).filter("value IS NOT NULL")
    known = rows.join(names.select(F.col("name").alias("metric_name"), "metric_key"), "metric_name")
    renamed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), F.col("_unit")), F.col("_unit")) if units else F.col("_unit")
    value = F.when(F.col("_unit") == of_height, F.col("value") / 100).otherwise(F.col("value"))
    last = known.groupBy("path", "metric_key").agg(F.max_by(F.struct("metric_name", value.alias("value"), renamed.alias("unit")), "row").alias("m"))
    said = cells.filter((F.col("sheet") == about) & F.col("column").isin(0, 1)).groupBy("path", "row").agg(F.max(name_of(0)).alias("_key"), F.max(name_of(1)).alias("_source"))
    said = said.filter(F.col("_key") == source).groupBy("path").agg(F.min_by(F.get(F.split("_source", "/"), 1), F.when(F.size(F.split("_source", "/")) >= 2, F.col("row"))).alias("_athlete"))
    file = F.element_at(F.split("path", "/"), -1)
    plain = F.when(file.endswith(ending), F.substring(file, F.lit(1), F.length(file) - len(ending))).otherwise(file)
    return last.join(said, "path", "left").select("path", F.coalesce("_athlete", plain).alias("athlete"), "metric_key", "m.*")
