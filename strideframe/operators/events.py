"""Events in a motion: frames picked by a rule, phases around them, sides, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import around_peak, mark_around_peak, position
from .series import Keys, along


def frame_nearest_value(df: DataFrame, keys: Keys, value: Column, target: float, *, order: str = "frame_index") -> DataFrame:
    """The frame whose value is nearest to a target; the earliest of equals."""
    return df.filter(value.isNotNull()).groupBy(*keys).agg(F.min_by(order, F.struct(F.abs(value - target), F.col(order))).alias("event_frame"))


def event_frame(frames: Column) -> Column:
    """An aggregate: median of frame numbers, rounded half to even."""
    return F.bround(F.median(frames)).cast("long")


def first_complete_rows(df: DataFrame, keys: Keys, columns: list[str], k: int, *, order: str = "frame_index") -> DataFrame:
    """The first k rows with all columns present; where there are none, the first k rows."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    df = df.withColumn("_full", full)
    df = df.withColumn("_any", F.max("_full").over(Window.partitionBy(*keys)))
    df = df.filter(F.col("_full") | ~F.col("_any"))
    return df.withColumn("_i", F.row_number().over(along(keys, order))).filter(F.col("_i") <= k).drop("_full", "_any", "_i")


def ready_block(df: DataFrame, keys: Keys, speed: str, height: str, *, size: int, most_speed: float, before: Column, order: str = "frame_index") -> DataFrame:
    """First frame of the block of `size` rows before a position in which all rows are present and slow and mean height less a fiftieth of mean speed is largest; the earliest of equals."""
    df = position(df, keys, order=order)
    block = along(keys, order).rowsBetween(0, size - 1)
    ok = F.coalesce((F.col(speed) <= most_speed) & F.col(height).isNotNull(), F.lit(False)).cast("int")
    df = df.withColumns({"_good": F.sum(ok).over(block), "_score": F.avg(height).over(block) - 0.02 * F.avg(speed).over(block)})
    df = df.filter((F.col("_good") == size) & (F.col("pos") + size <= before))
    return df.groupBy(*keys).agg(F.max_by(order, F.struct("_score", -F.col("pos"))).alias("ready_frame"), F.max("_score").alias("ready_score"))


def phase_around(df: DataFrame, keys: Keys, score: str, *, share: float, middle: tuple[float, float] = (0.0, 1.0), order: str = "frame_index") -> DataFrame:
    """Event frame: first maximum among the middle part of the rows; phase: consecutive frames around it with at least a share of its score."""
    df = position(df, keys, order=order)
    inside = (F.col("pos") >= F.floor(F.col("n") * middle[0])) & (F.col("pos") <= F.floor(F.col("n") * middle[1]))
    w = Window.partitionBy(*keys)
    df = df.withColumn("_peak", F.max(F.when(inside, F.col(score))).over(w))
    df = df.withColumn("_at", F.min(F.when(inside & (F.col(score) == F.col("_peak")), F.col(order))).over(w))
    df = df.withColumn("_gap", F.col(order) - F.lag(order).over(along(keys, order)) > 1)
    low = ~F.coalesce(F.col(score) >= F.col("_peak") * share, F.lit(False)) & (F.col(order) != F.col("_at"))
    left = F.max(F.when((F.col(order) < F.col("_at")) & low, F.col(order)).when(F.col("_gap") & (F.col(order) <= F.col("_at")), F.col(order) - 1)).over(w)
    right = F.min(F.when((F.col(order) > F.col("_at")) & (low | F.col("_gap")), F.col(order))).over(w)
    df = df.withColumns({"_l": left, "_r": right})
    df = df.filter((F.col(order) > F.coalesce("_l", F.lit(-(2**62)))) & (F.col(order) < F.coalesce("_r", F.lit(2**62))))
    return df.groupBy(*keys).agg(F.first("_at").alias("event_frame"), F.first("_peak").alias("peak"), F.min(order).alias("start_frame"), F.max(order).alias("end_frame"))


def active_duration(df: DataFrame, keys: Keys, speed: str, rate: float, *, share: float = 0.3) -> DataFrame:
    """Seconds of the stretch around the peak with at least a share of it."""
    return around_peak(df, keys, speed, F.col("peak") * share).select(*keys, ((F.col("end_pos") - F.col("start_pos") + 1) / rate).alias("active_sec"))


def first_reaching(df: DataFrame, keys: Keys, value: Column, share: float, *, order: str = "frame_index") -> DataFrame:
    """First frame with at least a share of the series' maximum."""
    df = df.withColumn("_v", value).withColumn("_max", F.max("_v").over(Window.partitionBy(*keys)))
    return df.filter(F.col("_v") >= share * F.col("_max")).groupBy(*keys).agg(F.min(order).alias("landing_frame"))


def larger_side(df: DataFrame, keys: Keys, left: str, right: str) -> DataFrame:
    """The side with the larger peak; right where they are equal."""
    return df.groupBy(*keys).agg(F.when(F.max(left) > F.coalesce(F.max(right), F.lit(float("-inf"))), "left").otherwise("right").alias("side"))


def snap(df: DataFrame, keys: Keys, angle: str, *, reach: int = 2, order: str = "frame_index", name: str = "snap") -> DataFrame:
    """Size of the change from `reach` rows before to `reach` rows behind, held at the ends of the series."""
    w = along(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.coalesce(F.lag(angle, reach).over(w), F.first(angle).over(whole)), F.coalesce(F.lead(angle, reach).over(w), F.last(angle).over(whole))
    return df.withColumn(name, F.abs(after - before))


def even_samples(first: Column, last: Column, most: int) -> Column:
    """At most so many evenly spaced whole numbers of a range, both ends among them."""
    k = F.least(F.lit(most), last - first + 1)
    spaced = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (first + F.floor(i * (last - first) / F.greatest(k - 1, F.lit(1)))).cast("long"))
    return F.array_distinct(spaced)


def best_frame(points: DataFrame, keys: Keys, core: list[str], score: Column) -> DataFrame:
    """The frame with the largest 10 points a joint, 3 more a core joint, plus the sum of scores; the earliest of equals."""
    frames = points.groupBy(*keys, "frame_index").agg((10 * F.count(F.lit(1)) + 3 * F.count_if(F.col("joint_name").isin(*core)) + F.sum(score)).alias("_s"))
    return frames.groupBy(*keys).agg(F.max_by("frame_index", F.struct("_s", -F.col("frame_index"))).alias("best_frame"), F.max("_s").alias("frame_score"))


def thin_out(df: DataFrame, keys: Keys, source_fps: float, target_fps: float, *, most: int | None = None, order: str = "frame_index") -> DataFrame:
    """Every so-many-th row and new frame numbers from 0; at most `most` rows."""
    step = max(1, round(source_fps / target_fps))
    df = position(df, keys, order=order).filter(F.col("pos") % step == 0).withColumn("new_frame", F.floor(F.col("pos") / step)).drop("pos", "n")
    return df if most is None else df.filter(F.col("new_frame") < most)


def swing_segment(df: DataFrame, keys: Keys, speed: str, rate: float, *, share: float = 0.20, least: float = 8.0, expansion_sec: float = 0.15, radius: int = 2, order: str = "frame_index") -> DataFrame:
    """A row for each series: its smoothed peak, the threshold, the stretch around the peak that reaches it, and that stretch widened by seconds inside the series.

    A series without any speed is one stretch, with its middle row for a peak and no threshold.
    """
    margin = max(1, round(expansion_sec * rate))
    near = along(keys, order).rowsBetween(-radius, radius)
    df = df.withColumn("_smooth", F.avg(speed).over(near))
    df = mark_around_peak(df, keys, "_smooth", F.greatest(F.lit(least), F.col("peak") * share), order=order)
    one = df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("peak", "peak_pos", "start_pos", "end_pos", "n")])
    last = F.col("n") - 1
    start, end = F.coalesce("start_pos", F.lit(0)), F.coalesce("end_pos", last)
    widened = lambda c, by: F.when(F.col("peak").isNull(), c).otherwise(by)
    return one.select(
        *keys, "peak", F.when(F.col("peak").isNotNull(), F.greatest(F.lit(least), F.col("peak") * share)).alias("threshold"),
        F.coalesce("peak_pos", F.floor(F.col("n") / 2)).cast("long").alias("peak_pos"), start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"),
        widened(start, F.greatest(F.lit(0), start - margin)).cast("long").alias("from_pos"), widened(end, F.least(last, end + margin)).cast("long").alias("to_pos"), "n",
    )


def first_rule(df: DataFrame, keys: Keys, rules: list[Column]) -> DataFrame:
    """Rows of the first rule that holds for any row of the series, with its number from 1: a chain of fallbacks as rows."""
    numbers = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(i + 1)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    df = df.withColumn("_rules", numbers).withColumn("rule", F.min(F.array_min("_rules")).over(Window.partitionBy(*keys)))
    return df.filter(F.array_contains("_rules", F.col("rule"))).drop("_rules")


def ready_rows(df: DataFrame, keys: Keys, swings: DataFrame, points: list[str], speed: str, height: str, *, rate: float, size: int, lookback_sec: float, valid_from: Column | None = None, order: str = "frame_index") -> DataFrame:
    """The rows of a series' ready stance, with the rule that found them.

    Rows count that lie before the swing's start, at most the lookback away and not before valid_from (a position). Rules in turn:
    1 the block of `size` whole slow rows with the largest mean height less a fiftieth of its mean speed, the earliest of equals;
    2 the first `size` whole slow rows, if there are so many; 3 the first whole rows; 4 the first rows of the series with all
    points; 5 its first rows. Slow is at most 12 % of the swing's peak, or 6. swings: a row a series with start_pos and peak.
    """
    df = position(df, keys, order=order).join(swings.select(*keys, F.col("start_pos").alias("_swing"), F.col("peak").alias("_peak")), keys)
    there = F.lit(True)
    for p in points:
        there = there & F.col(p).isNotNull()
    back = max(size, round(lookback_sec * rate))
    start = F.greatest(F.lit(0), F.col("_swing") - back, F.coalesce(valid_from, F.lit(0)) if valid_from is not None else F.lit(0))
    stop = F.greatest(start, F.col("_swing"))
    df = df.withColumns({"_full": there, "_valid": there & F.col(speed).isNotNull() & (F.col("pos") >= start) & (F.col("pos") < stop), "_limit": F.greatest(F.lit(6.0), F.coalesce(F.col("_peak") * 0.12, F.lit(6.0)))})
    df = df.withColumn("_slow", F.coalesce(F.col("_valid") & (F.col(speed) <= F.col("_limit")), F.lit(False)))
    w, block, whole = along(keys, order), along(keys, order).rowsBetween(0, size - 1), Window.partitionBy(*keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.sum(F.col(c).cast("int"))
    score = F.when(count("_slow").over(block) == size, F.avg(height).over(block) - 0.02 * F.avg(speed).over(block))
    df = df.withColumns({"_score": score, **{f"{c}_i": count(c).over(so_far) for c in ("_slow", "_valid", "_full")}, "_n_slow": count("_slow").over(whole)})
    df = df.withColumns({"_best": F.max("_score").over(whole)})
    df = df.withColumn("_at", F.min(F.when(F.col("_score") == F.col("_best"), F.col("pos"))).over(whole))
    rules = [
        F.col("pos").between(F.col("_at"), F.col("_at") + size - 1), F.col("_slow") & (F.col("_slow_i") <= size) & (F.col("_n_slow") >= size), F.col("_valid") & (F.col("_valid_i") <= size),
        F.col("_full") & (F.col("_full_i") <= size), F.col("pos") < size,
    ]
    out = first_rule(df, keys, rules)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in keys], "pos", "n")
