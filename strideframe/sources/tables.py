"""Typed CSV and Parquet tables. Schemas are never inferred; NaN becomes null on the way in and empty text on the way out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def without_nan(df: DataFrame) -> DataFrame:
    """Missing numbers as null only."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return without_nan(spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "nan").csv(path))


def read_pose2d(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.POSE2D)


def read_pose3d(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.POSE3D)


def read_object_tracks(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.OBJECT_TRACK)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.FRAME_MANIFEST)


def read_clips(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Clips with their tags as an array and their paths below a root."""
    df = read_csv(spark, path, schemas.CLIPS)
    tags = F.filter(F.transform(F.split(F.coalesce("difficulty_tags", F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    return df.withColumns({"difficulty_tags": tags, "source_path": F.concat_ws("/", F.lit(root) if root else F.lit(None), "source_path")})


def read_external_3d(spark: SparkSession, path: str, names: Mapping[str, str], *, clip_id: str, condition_id: str, frames: DataFrame | None = None) -> DataFrame:
    """A CSV of foreign 3-D joints: frame_index, joint_name, x, y, z and perhaps timestamp_sec and a score, as POSE3D rows with our joint names.

    The time comes from the row, else from the frame manifest, else it is the frame number.
    """
    raw = spark.read.option("header", True).csv(path)
    if lost := {"frame_index", "joint_name", "x", "y", "z"} - set(raw.columns):
        raise ValueError(f"columns missing: {', '.join(sorted(lost))}")
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    number = lambda c: F.nanvl(text(c).try_cast("double"), F.lit(None))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    joint = F.coalesce(F.try_element_at(table, F.col("joint_name")), F.col("joint_name")) if table is not None else F.col("joint_name")
    df = raw.select(text("frame_index").try_cast("long").alias("frame_index"), number("timestamp_sec").alias("_t"), joint.alias("joint_name"), *[number(a).alias(f"{a}_3d") for a in "xyz"], F.coalesce(*[number(c) for c in ("input_quality_score", "score", "confidence")]).alias("input_quality_score"))
    if frames is not None:
        df = df.join(frames.select("frame_index", F.col("timestamp_sec").alias("_m")).dropDuplicates(["frame_index"]), "frame_index", "left")
    else:
        df = df.withColumn("_m", F.lit(None).cast("double"))
    df = df.withColumns({"clip_id": F.lit(clip_id), "condition_id": F.lit(condition_id), "timestamp_sec": F.coalesce("_t", "_m", F.col("frame_index").cast("double")), "scale_mode": F.lit("external"), "lift_backend": F.lit("external")})
    return df.select(*schemas.POSE3D.names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def write_table(df: DataFrame, path: str, keys: tuple[str, ...] = ("clip_id", "condition_id")) -> None:
    """Parquet in folders by the keys, so that readers of one clip open its folder only."""
    df.repartition(*keys).write.partitionBy(*keys).mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a row."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def read_untyped(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the frame number and the time as numbers where they are there; empty cells are null."""
    df = spark.read.option("header", True).option("nullValue", "").csv(path)
    kinds = {"frame_index": "bigint", "timestamp_sec": "double"}
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in df.columns})


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or one without rows where nothing lies at the path."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def dense_points(points: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Rows of valid points (valid = 1) with frames numbered from 0 over those that have any; every point has a row in each, null where it was lost."""
    kept = points.filter(F.col("valid").cast("int") == 1)
    frames = kept.select(*keys, "frame_index").distinct().withColumn("dense_frame", F.row_number().over(Window.partitionBy(*keys).orderBy("frame_index")) - 1)
    grid = frames.join(kept.select(*keys, point).distinct(), keys)
    return grid.join(kept, [*keys, "frame_index", point], "left")


def plot_sequence(points: DataFrame, keys: list[str]) -> DataFrame:
    """3-D points with missing coordinates at 0, and the mean quality of each frame's points."""
    w = Window.partitionBy(*keys, "frame_index")
    return points.withColumns({**{f"{a}_3d": F.coalesce(f"{a}_3d", F.lit(0.0)) for a in "xyz"}, "frame_quality": F.avg("input_quality_score").over(w)})


def timeline(frames: DataFrame | None, points: DataFrame, keys: list[str]) -> DataFrame:
    """(frame_index, timestamp_sec) of each series: from the frame manifest, or from its 2-D points where the manifest has nothing of it."""
    seen = points.groupBy(*keys, "frame_index").agg(F.min("timestamp_sec").alias("timestamp_sec"))
    if frames is None:
        return seen
    known = frames.groupBy(*keys, "frame_index").agg(F.min("timestamp_sec").alias("timestamp_sec"))
    return known.unionByName(seen.join(known.select(*keys).distinct(), keys, "left_anti"))
