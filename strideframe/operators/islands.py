"""Gaps and islands: runs of rows, short-gap filling, clusters, windows around a peak, tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import lerp
from .series import Keys, along, next_present


def position(df: DataFrame, keys: Keys, *, order: str = "frame_index") -> DataFrame:
    """pos: 0-based place in the series, and n: its length."""
    return df.withColumns({"pos": F.row_number().over(along(keys, order)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def runs(df: DataFrame, keys: Keys, starts: Column, *, order: str = "frame_index", name: str = "run") -> DataFrame:
    """Number the runs of a series; `starts` is true on a row that begins one."""
    return df.withColumn("_s", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(
        name, F.sum("_s").over(along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("_s")


def consecutive_runs(df: DataFrame, keys: Keys, *, max_gap: int = 0, order: str = "frame_index") -> DataFrame:
    """Runs of frame numbers with at most max_gap numbers missing between neighbours."""
    return runs(df, keys, F.col(order) - F.lag(order).over(along(keys, order)) > max_gap + 1, order=order)


def drop_short_runs(df: DataFrame, keys: Keys, least: int, *, order: str = "frame_index") -> DataFrame:
    """Rows of consecutive-frame runs of at least `least` rows."""
    found = consecutive_runs(df, keys, order=order).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    return found.filter(F.col("_len") >= least).drop("_len", "run")


def valid_segments(df: DataFrame, keys: Keys, value: str, *, order: str = "frame_index") -> DataFrame:
    """One row for each stretch without a missing value: first and last position and length."""
    df = position(df, keys, order=order)
    df = df.withColumn("seg", F.sum(F.col(value).isNull().cast("int")).over(along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, "seg").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("length")).drop("seg")


def missing_runs(df: DataFrame, keys: Keys, usable: Column, *, order: str = "frame_index") -> DataFrame:
    """Stretches of unusable rows as [start, end): end is the next usable frame, or one past the last row."""
    df = df.withColumn("_ok", usable).withColumn("_at", F.when(F.col("_ok"), F.col(order)))
    df = df.withColumns({"_next": next_present("_at", keys, order), "_last": F.max(order).over(Window.partitionBy(*keys))})
    df = df.filter(~F.col("_ok")).withColumn("end", F.coalesce("_next", F.col("_last") + 1))
    return df.groupBy(*keys, "end").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("rows")).select(*keys, "start", "end", "rows")


def fill_short_gaps(df: DataFrame, keys: Keys, values: list[str], max_gap: int | Column, *, edges: bool = False, order: str = "frame_index") -> DataFrame:
    """Fill missing stretches of at most max_gap rows: inside a series on the line between their ends, at its ends (edges) by the nearest value."""
    w = along(keys, order)
    limit = F.lit(max_gap) if isinstance(max_gap, int) else max_gap
    df = position(df, keys, order=order)
    df = df.withColumns({f"_at_{v}": F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col("pos").alias("p"))) for v in values})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_a_{v}": F.last(f"_at_{v}", ignorenulls=True).over(upto) for v in values} | {f"_b_{v}": F.coalesce(f"_at_{v}", next_present(f"_at_{v}", keys, order)) for v in values})
    filled = {}
    for v in values:
        before, after = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        gap = after["p"] - before["p"] - 1
        inside = F.when((gap <= limit) & (gap > 0), lerp(before["v"], after["v"], (F.col("pos") - before["p"]) / (gap + 1)))
        ends = [F.when(before.isNull() & (after["p"] <= limit), after["v"]), F.when(after.isNull() & (F.col("n") - before["p"] - 1 <= limit), before["v"])] if edges else []
        filled[v] = F.coalesce(F.col(v), inside, *ends)
    return df.withColumns(filled).drop("pos", "n", *[f"_{k}_{v}" for k in ("at", "a", "b") for v in values])


def new_rows_in_gaps(df: DataFrame, keys: Keys, frames: DataFrame, values: list[str], max_gap: int, *, scale: float = 0.75) -> DataFrame:
    """Rows for the frames missing between two detections, on the line between them; confidence is the smaller one's times scale.

    Only frames of the manifest get a row; detections without the first two values are no ends of a gap.
    """
    w = along(keys)
    nxt = lambda c: F.lead(c).over(w)
    pairs = df.withColumns({f"_n_{c}": nxt(c) for c in ["frame_index", "confidence", *values]})
    gap = F.col("_n_frame_index") - F.col("frame_index") - 1
    whole = [F.col(c).isNotNull() & F.col(f"_n_{c}").isNotNull() for c in values[:2]]
    pairs = pairs.filter((gap > 0) & (gap <= max_gap) & whole[0] & whole[1]).withColumn("_step", F.explode(F.sequence(F.lit(1).cast("long"), gap)))
    ratio = F.col("_step") / (gap + 1)
    rows = pairs.select(
        *keys, (F.col("frame_index") + F.col("_step")).alias("frame_index"), *[lerp(F.col(v), F.col(f"_n_{v}"), ratio).alias(v) for v in values],
        F.when(F.col("confidence").isNotNull() & F.col("_n_confidence").isNotNull(), F.least("confidence", "_n_confidence") * scale).alias("confidence"),
    )
    return rows.join(frames, [k for k in keys if k in frames.columns] + ["frame_index"])


def long_tracks(df: DataFrame, keys: Keys, *, least: int, max_gap: int, max_jump: float, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Detections of tracks with at least `least` rows; a track ends at a gap of frames or a jump beyond max_jump image diagonals (0: any jump)."""
    w = along(keys)
    jump = F.sqrt(((F.col("x") - F.lag("x").over(w)) * width) ** 2 + ((F.col("y") - F.lag("y").over(w)) * height) ** 2)
    far = F.coalesce(jump > max_jump * (width**2 + height**2) ** 0.5, F.lit(False)) if max_jump > 0 else F.lit(False)
    late = F.col("frame_index") - F.lag("frame_index").over(w) > max_gap + 1
    found = runs(df, keys, late | far).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    return found.filter(F.col("_len") >= least).drop("_len")


def mark_around_peak(df: DataFrame, keys: Keys, value: str, least: Column, *, order: str = "frame_index") -> DataFrame:
    """Adds to every row its series' peak, peak_pos, and start_pos and end_pos of the stretch around it whose rows all reach `least`, besides pos and n.

    `least` may use `peak`. The peak itself always belongs to the stretch; all are null in a series without a value.
    """
    df = position(df, keys, order=order)
    whole = Window.partitionBy(*keys)
    df = df.withColumn("peak", F.max(value).over(whole)).withColumn("peak_pos", F.min(F.when(F.col(value) == F.col("peak"), F.col("pos"))).over(whole))
    low = ~F.coalesce(F.col(value) >= least, F.lit(False)) & (F.col("pos") != F.col("peak_pos"))
    left = F.max(F.when(low & (F.col("pos") < F.col("peak_pos")), F.col("pos"))).over(whole)
    right = F.min(F.when(low & (F.col("pos") > F.col("peak_pos")), F.col("pos"))).over(whole)
    there = F.col("peak").isNotNull()
    return df.withColumns({"start_pos": F.when(there, F.coalesce(left, F.lit(-1)) + 1), "end_pos": F.when(there, F.coalesce(right, F.col("n")) - 1)})


def around_peak(df: DataFrame, keys: Keys, value: str, least: Column, *, order: str = "frame_index") -> DataFrame:
    """The stretch of mark_around_peak, one row for each series with a value, with its first and last frame."""
    df = mark_around_peak(df, keys, value, least, order=order)
    df = df.filter(F.col("pos").between(F.col("start_pos"), F.col("end_pos")))
    return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("peak", "peak_pos", "start_pos", "end_pos", "n")], F.min(order).alias("start_frame"), F.max(order).alias("end_frame"))
