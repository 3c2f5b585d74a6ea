"""Settings as tables: defaults with a clip's own values, switches, calibrations, choices of marker names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Keys


def clip_settings(clips: DataFrame, overrides: DataFrame, defaults: Column, *, clip: str = "clip_id", name: str = "settings") -> DataFrame:
    """Adds a map of settings: the defaults (a map column) with a clip's own entries on top. overrides: (clip_id, setting, value), the last by value of repeated ones."""
    own = overrides.groupBy(clip, "setting").agg(F.max("value").alias("value")).groupBy(clip).agg(F.map_from_entries(F.collect_list(F.struct("setting", "value"))).alias("_own"))
    joined = clips.join(own, clip, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    merged = F.map_zip_with(defaults, F.coalesce("_own", none), lambda k, d, o: F.coalesce(o, d))
    return joined.withColumn(name, merged).drop("_own")


def equipment_switches(
    clips: DataFrame, disabled_sticks: DataFrame, enabled_balls: DataFrame, *, stick: bool = True, ball: bool = True, ball_for_pitching: bool = False, ball_for_batting: bool = False, clip: str = "clip_id", action: str = "action_type"
) -> DataFrame:
    """detect_stick and detect_ball for each clip.

    Sticks are sought but in pitching clips and in those of the list; balls in clips of the other list, in the actions that are
    asked for, and in clips of any other action (an unknown one too).
    """
    mark = lambda df, c: df.select(clip).distinct().withColumn(c, F.lit(True))
    df = clips.join(mark(disabled_sticks, "_off"), clip, "left").join(mark(enabled_balls, "_on"), clip, "left")
    is_action = lambda a: F.coalesce(F.col(action) == a, F.lit(False))
    asked = (is_action("pitching") & ball_for_pitching) | (is_action("batting") & ball_for_batting) | ~(is_action("pitching") | is_action("batting"))
    return df.withColumns({"detect_stick": F.lit(stick) & ~is_action("pitching") & F.col("_off").isNull(), "detect_ball": F.lit(ball) & (F.col("_on").isNotNull() | asked)}).drop("_off", "_on")


def source_condition(condition: Column) -> Column:
    """The condition that a smoothed or completed one was made from."""
    return F.regexp_replace(F.regexp_replace(condition, "_smooth$", ""), "_complete$", "")


def calibrated_speed(df: DataFrame, calibration: DataFrame, *, height_m: float, speed: str, clip: str = "clip_id", pixels: str = "body_height_px", name: str = "speed_kmh") -> DataFrame:
    """Pixels a second as km/h by the clip's calibration (a body's height in pixels); null where there is no usable one."""
    known = calibration.groupBy(clip).agg(F.max(F.when(F.col(pixels) > 0, F.col(pixels))).alias("_px"))
    return df.join(known, clip, "left").withColumn(name, F.col(speed) * height_m / F.col("_px") * 3.6).drop("_px")


def first_owner(df: DataFrame, keys: Keys, owner: str, item: str, wanted: list[str], *, required: bool = False) -> DataFrame:
    """For each key the alphabetically first owner that has all the wanted items; null where none has, or an error if it is required."""
    owners = df.filter(F.col(item).isin(*wanted)).groupBy(*keys, owner).agg(F.count_distinct(item).alias("_n")).filter(F.col("_n") == len(set(wanted)))
    best = owners.groupBy(*keys).agg(F.min(owner).alias(owner))
    out = df.select(*keys).distinct().join(best, keys, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {owner} has all of {', '.join(sorted(set(wanted)))}: "), F.to_json(F.struct(*keys))))
    return out.withColumn(owner, F.coalesce(F.col(owner), missing)) if required else out


def first_existing(df: DataFrame, keys: Keys, item: str, candidates: list[str], present: Column, *, required: bool = False) -> DataFrame:
    """For each key the first candidate, in the order given, that has a row where `present` holds; null or an error without one."""
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col(item))
    best = df.groupBy(*keys).agg(F.min(F.when(present & (rank > 0), rank)).alias("_rank"))
    name = F.get(F.array(*map(F.lit, candidates)), F.col("_rank").cast("int") - 1)
    missing = F.raise_error(F.concat(F.lit(f"none of {', '.join(candidates)}: "), F.to_json(F.struct(*keys))))
    return best.select(*keys, (F.coalesce(name, missing) if required else name).alias(item))
