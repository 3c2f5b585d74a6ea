"""Lookups, checks and mappings over long metric tables and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import pose_score, trusted
from ..functions.geometry import distance, norm
from .series import Keys, along


# ---- checks of dimensions


def clip_checks(clips: DataFrame, *, key: str, action: str, fps: str, actions: list[str]) -> DataFrame:
    """(problem, n): how many clips have no id, an id that is not their own alone, an unknown action or no positive rate; one row for each kind, also with 0."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(key))
    marked = clips.withColumn("_n", twice)
    empty = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    kinds = {
        "empty_id": empty, "repeated_id": ~empty & (F.col("_n") > 1), "unknown_action": ~F.coalesce(F.col(action).isin(*actions), F.lit(False)),
        "bad_rate": ~F.coalesce(F.col(fps) > 0, F.lit(False)),
    }
    counts = marked.agg(*[F.count_if(v).alias(k) for k, v in kinds.items()])
    return counts.unpivot([], list(kinds), "problem", "n")


def unknown_names(points: DataFrame, names: DataFrame, column: str = "joint_name") -> DataFrame:
    """Names that a dimension does not have, with their number of rows."""
    return points.join(names.select(column).distinct(), column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_trial(trials: DataFrame, keys: Keys, order: str) -> DataFrame:
    """The first row of each key in the order of input."""
    return trials.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_i = 1").drop("_i")


def last_of_each(rows: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Of repeated keys the row that comes last."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def as_ratio(value: Column, unit: Column) -> Column:
    """Values in percent as shares."""
    return F.when(F.trim(unit).startswith("%"), value / 100).otherwise(value)


# ---- names


def action_of(name: Column) -> Column:
    return F.when(F.lower(name).contains("bat"), "batting").otherwise("pitching")


def relative_path(path: Column, root: str) -> Column:
    """Path below a root folder; others stay."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def athlete_of(sheet: Column, file: Column) -> Column:
    """The name behind the last colon of a sheet's title, else the file's first part."""
    named = F.trim(F.regexp_extract(sheet, r"[:：]\s*([^:：]+)$", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.regexp_extract(file, r"([^/_.]+)[^/]*$", 1))


def metric_key(name: Column) -> Column:
    """One spelling: lower case, other signs as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


# ---- lookups


def metrics_in_order(rows: DataFrame, keys: Keys, wanted: list[str], *, metric: str = "metric", value: str = "value", order: Column | None = None) -> DataFrame:
    """The wanted metrics of each key in the wanted order, the first of repeated ones: position, metric, value. Keys without one have no row for it."""
    place = F.create_map(*[x for i, m in enumerate(wanted) for x in (F.lit(m), F.lit(i + 1))])
    found = rows.filter(F.col(metric).isin(*wanted) & F.col(value).isNotNull())
    best = F.min_by(value, order) if order is not None else F.min(value)
    return found.groupBy(*keys, metric).agg(best.alias(value)).select(*keys, F.element_at(place, F.col(metric)).alias("position"), metric, value)


def means_by(rows: DataFrame, keys: Keys, metric: str, *, value: str = "value") -> DataFrame:
    """Mean and number of the finite values of one metric by key."""
    there = rows.filter((F.col("metric") == metric) & F.col(value).isNotNull() & ~F.isnan(value))
    return there.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def axis_ranges(rows: DataFrame, keys: Keys, *, value: str = "value", pad: float = 0.1) -> DataFrame:
    """Least and greatest value of each metric over peers, and an axis a little wider."""
    span = F.max(value) - F.min(value)
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.min(value) - span * pad).alias("axis_low"), (F.max(value) + span * pad).alias("axis_high"))


# ---- observed metrics against standards


def reference_context(references: DataFrame, group: str | None) -> DataFrame:
    """One context for each metric from rows (metric, kind, name, position, mean, sd): a cohort_reference's first one goes before the wanted athlete group, that before the metric's own values."""
    rank = F.when((F.col("kind") == "cohort_reference") & (F.col("position") == 0), 0)
    if group is not None:
        rank = rank.when((F.col("kind") == "athlete_group") & (F.col("name") == group), 1)
    rank = rank.when(F.col("kind") == "own", 2)
    best = F.min_by(F.struct("kind", "name", "mean", "sd"), F.col("_rank"))
    return references.withColumn("_rank", rank).filter("_rank is not null").groupBy("metric").agg(best.alias("r")).select("metric", "r.*")


def mapped_metrics(rules: DataFrame, observed: DataFrame, contexts: DataFrame) -> DataFrame:
    """rules (metric, match: exact, partial or none, note) with what was observed (metric, value) and the reference: status, match_type, value, context, comparison, reason."""
    df = rules.join(observed, "metric", "left").join(contexts, "metric", "left")
    there = F.col("value").isNotNull() & (F.col("match") != "none")
    status = F.when(~there, "unavailable").when(F.col("match") == "exact", "available").otherwise("partial")
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    compared = F.when((F.col("match") == "exact") & there, F.when(z.isNull(), "no_reference").when(z < -1, "below_1sd").when(z > 1, "above_1sd").otherwise("within_1sd"))
    kind = F.when(F.col("match") == "partial", F.when(there, "proxy").otherwise("partial")).otherwise(F.col("match"))
    reason = F.when(there, F.col("note")).when(F.col("match") == "none", F.col("note")).otherwise(F.concat("metric", F.lit(" is missing")))
    return df.select("metric", status.alias("status"), kind.alias("match_type"), F.when(there, F.col("value")).alias("value"), F.col("name").alias("context"), compared.alias("comparison"), reason.alias("reason"))


def observation_only(observed: DataFrame, names: DataFrame) -> DataFrame:
    """Wanted metrics that no standard is known for: available with their value, or unavailable."""
    return names.join(observed, "metric", "left").select("metric", F.when(F.col("value").isNull(), "unavailable").otherwise("available").alias("status"), F.lit("observation_only").alias("match_type"), "value")


def metric_cards(mapped: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles of the metrics that can be shown, and a line of text for each."""
    df = titles.join(mapped.filter("status != 'unavailable'"), "metric")
    line = F.format_string("%s: %.2f (%s)", F.col("title"), F.col("value"), F.coalesce("comparison", F.lit("partial")))
    return df.select("metric", "title", "status", "value", line.alias("text"))


def suspicious(rows: DataFrame, keys: Keys) -> DataFrame:
    """A message for each rule that a metric row (metric_name, value, event_frame) breaks."""
    name, value = F.col("metric_name"), F.col("value")
    landing = name.isin("Lead Knee Angle", "Stride Angle", "Stride Length", "Foot Direction")
    rules = [
        ((name == "Weight Transfer") & value.isin(0.0, 100.0), "saturated"), (landing & (F.col("event_frame") == 0), "landing_at_frame_0"),
        ((name == "Wrist/Hand Speed") & (value < 0.5), "event_mismatch"), ((name == "Attack Angle") & (F.abs(value) > 45), "not_a_true_angle"),
    ]
    found = F.filter(F.array(*[F.when(on, message) for on, message in rules]), lambda m: m.isNotNull())
    return rows.select(*keys, "metric_name", F.explode(found).alias("message"))


def phase_rows(phases: DataFrame, keys: Keys, frames: DataFrame, *, rate: float = 30.0) -> DataFrame:
    """Three rows a series: start, event and end of its phase with the frame's time, else frame over rate."""
    names = {"Phase Start": "phase_start", "Event": "event_frame", "Phase End": "phase_end"}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(c).alias("frame_index")) for n, c in names.items()])).alias("r")
    long = phases.select(*keys, rows).select(*keys, "r.*")
    time = frames.groupBy(*keys, "frame_index").agg(F.min("timestamp_sec").alias("_t"))
    return long.join(time, [*keys, "frame_index"], "left").select(*keys, "metric_name", "frame_index", F.coalesce("_t", F.col("frame_index") / rate).alias("value"))


def ablation_rows(points: DataFrame, keys: Keys, joints: dict[str, list[str]], wrists: list[str], threshold: float, *, runtime: str | None = None) -> DataFrame:
    """The long table of an ablation: completeness of joint groups, mean confidence a frame, mean runtime over frames (if its column is named), and missing rate, jitter and second difference of each wrist.

    One row a frame, windows over the series, one aggregate, then a row for each metric: the points are read once.
    """
    name, ok = F.col("joint_name"), F.col("x").isNotNull() & F.col("y").isNotNull() & trusted(pose_score(), threshold)
    share = {g: F.count_distinct(F.when(ok & name.isin(*names), name)) / len(names) for g, names in joints.items()}
    place = {w: F.max(F.when(ok & (name == w), F.struct("x", "y"))).alias(f"_p_{w}") for w in wrists}
    # A frame's runtime is that of its first row, if that has one.
    took = [F.min_by(runtime, name).alias("_took")] if runtime else []
    frames = points.groupBy(*keys, "frame_index").agg(*[v.alias(f"_s_{g}") for g, v in share.items()], F.min_by("confidence", "joint_name").alias("_c"), *took, *place.values())
    before = along(keys).rowsBetween(Window.unboundedPreceding, -1)
    metrics = [("keypoint_completeness", g, F.avg(f"_s_{g}")) for g in joints] + [("mean_confidence", "all", F.avg("_c"))]
    metrics += [("runtime_ms_per_frame", "all", F.avg("_took"))] if runtime else []
    for w in wrists:
        p, q, r = f"_p_{w}", f"_q_{w}", f"_r_{w}"
        frames = frames.withColumn(q, F.last(p, ignorenulls=True).over(before))
        pair = F.when(F.col(p).isNotNull(), F.struct(F.col(q).alias("was")))
        frames = frames.withColumn(r, F.last(pair, ignorenulls=True).over(before)["was"])
        bend = [F.col(f"{p}.{a}") - 2 * F.col(f"{q}.{a}") + F.col(f"{r}.{a}") for a in "xy"]
        metrics += [
            ("missing_rate", w, F.avg(F.col(p).isNull().cast("double"))), ("temporal_jitter", w, F.avg(distance([F.col(f"{q}.{a}") for a in "xy"], [F.col(f"{p}.{a}") for a in "xy"]))),
            ("second_difference", w, F.avg(norm(bend))),
        ]
    out = frames.groupBy(*keys).agg(*[v.alias(f"_m{i}") for i, (_, _, v) in enumerate(metrics)])
    rows = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.lit(g).alias("joint_group"), F.col(f"_m{i}").alias("value")) for i, (n, g, _) in enumerate(metrics)])
    return out.select(*keys, F.inline(rows))
