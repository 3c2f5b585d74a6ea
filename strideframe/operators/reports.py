"""Report tables: measures with availability, references, coverage, ordered lists, chosen sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import deviation_band, difference_percent
from .series import Keys


def availability(value: Column, known: Column | None = None) -> Column:
    """available, partial (there, but by an approximation) or unavailable."""
    return F.when(value.isNull(), "unavailable").when(known if known is not None else F.lit(True), "available").otherwise("partial")


def value_text(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise("")


def against_reference(df: DataFrame, reference: DataFrame, on: Keys) -> DataFrame:
    """Measures with their reference (mean, sd, target; a small table): the band, or the difference to the target, or "no_reference"."""
    j = df.join(reference, on, "left")
    band = deviation_band(F.col("value"), F.col("mean"), F.col("sd"))
    how = F.when(F.col("value").isNull(), "unavailable").when(F.col("mean").isNotNull() & F.col("sd").isNotNull(), band).when(F.col("target").isNotNull(), "target").otherwise("no_reference")
    return j.withColumns({"assessment": how, "difference": F.col("value") - F.coalesce("mean", "target")})


def comparison(left: DataFrame, right: DataFrame, on: Keys, value: str = "value") -> DataFrame:
    """Full outer join of two value tables with difference and difference in percent of the right one."""
    a, b = left.select(*on, F.col(value).alias("left_value")), right.select(*on, F.col(value).alias("right_value"))
    return a.join(b, on, "full").withColumns({"difference": F.col("left_value") - F.col("right_value"), "difference_pct": difference_percent(F.col("left_value"), F.col("right_value"))})


def coverage(details: DataFrame, keys: Keys, status: str, kinds: list[str]) -> DataFrame:
    """How many rows of each status."""
    return details.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == k).alias(k) for k in kinds])


def distinct_in_order(df: DataFrame, keys: Keys, items: str, order: str) -> DataFrame:
    """Items of arrays over rows, each once, in order of first occurrence."""
    flat = df.select(*keys, order, F.posexplode(items).alias("_p", "item"))
    first = flat.groupBy(*keys, "item").agg(F.min(F.struct(order, "_p")).alias("at"))
    return first.select(*keys, "item", F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("position"))


def planned(left: DataFrame, right: DataFrame, found: DataFrame, on: Keys) -> DataFrame:
    """Every clip under every condition, with the rows that were found and a note where there are none. Both sides are short lists of a run's plan."""
    plan = left.crossJoin(F.broadcast(right))
    there = found.select(*on).distinct().withColumn("_there", F.lit(True))
    return plan.join(there, on, "left").withColumn("notes", F.when(F.col("_there").isNull(), "missing_pose_file")).drop("_there")


def preferred(df: DataFrame, keys: Keys, name: str, endings: list[str]) -> DataFrame:
    """For each key the row whose name has the most wanted ending; the alphabetically first of equals."""
    rank = F.coalesce(*[F.when(F.col(name).endswith(e), i) for i, e in enumerate(endings)], F.lit(len(endings)))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, name))).filter("_r = 1").drop("_r")


def frame_list(text: Column) -> Column:
    """Whole numbers of a ;-separated text; other parts are passed over."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+$"))
    return F.transform(parts, lambda p: p.cast("int"))


def frame_text(frames: Column) -> Column:
    return F.array_join(F.transform(frames, lambda f: f.cast("string")), ";")


def window_of(components: Column, rule: Column, frames: Column) -> Column:
    """struct(first, last): from a JSON object's segment_start and segment_end, else from "frames a-b" in a text, else the ends of a frame list."""
    number = lambda path: F.get_json_object(components, path).try_cast("int")
    part = lambda k: F.nullif(F.regexp_extract(rule, r"frames\s+(\d+)-(\d+)", k), F.lit("")).try_cast("int")
    return F.struct(F.coalesce(number("$.segment_start"), part(1), F.array_min(frames)).alias("first"), F.coalesce(number("$.segment_end"), part(2), F.array_max(frames)).alias("last"))


def center_frame(frames: Column) -> Column:
    return F.get(frames, F.floor(F.size(frames) / 2).cast("int"))


def column_number(letters: Column) -> Column:
    """0-based number of a spreadsheet column from its letters; digits behind them are ignored."""
    codes = F.transform(F.split(F.regexp_replace(F.upper(letters), "[^A-Z]", ""), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(codes, F.lit(0), lambda t, c: F.when(c > 0, t * 26 + c).otherwise(t)) - 1


#: Columns of a long metric table, in order.
METRIC_ROW = (
    "trial_id", "sample_name", "athlete", "action_type", "source_file", "module", "metric_name_zh", "metric_key", "value", "unit", "aggregation", "event_name", "event_rule", "event_frame", "event_frames", "points_used", "formula",
    "components_json", "notes",
)


def metric_rows(values: DataFrame, trials: DataFrame, catalog: DataFrame) -> DataFrame:
    """The long metric table: a row for each trial and metric of the catalog, with availability and its reason.

    values: trial_id, metric_key, value, events (frames), components (a map of texts), notes. trials: trial_id, sample_name, athlete,
    action_type, source_file. catalog: metric_key, module, metric_name_zh, unit, aggregation, event_name, event_rule, points (names),
    formula, action_type (null: any). The event's frame is the median of its frames, rounded half to even; components are JSON with
    sorted names. Metrics of the trial's action without a value are unavailable, those without events of theirs say so too.
    """
    # The catalog by action is short: it is made from the few actions there are, so that trials meet it by an equal key.
    asked = catalog.withColumnRenamed("action_type", "_only")
    actions = trials.select(F.col("action_type").alias("_action")).distinct()
    by_action = actions.join(asked, F.col("_only").isNull() | (F.col("_only") == F.col("_action"))).drop("_only")
    plan = trials.join(by_action, F.col("action_type").eqNullSafe(F.col("_action"))).drop("_action")
    df = plan.join(values, ["trial_id", "metric_key"], "left")
    events = F.array_sort(F.coalesce("events", F.array().cast("array<bigint>")))
    n = F.size(events)
    middle = (F.get(events, F.floor((n - 1) / 2).cast("int")) + F.get(events, F.floor(n / 2).cast("int"))) / 2
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries("components")))
    df = df.withColumns({
        "event_frame": F.bround(middle).cast("long"), "event_frames": F.array_join(events.cast("array<string>"), ";"), "points_used": F.array_join("points", ";"),
        "components_json": F.coalesce(F.to_json(sorted_map), F.lit("{}")), "notes": F.coalesce("notes", F.lit("")),
    })
    reason = F.when(F.col("value").isNotNull(), "").when(F.col("event_frames") == "", "no_event").otherwise("missing_points")
    return df.select(*METRIC_ROW, availability(F.col("value")).alias("availability"), reason.alias("reason"))


def metric_inventory(categories: DataFrame, available: DataFrame, keys: Keys, *, name: str = "metric") -> DataFrame:
    """Every category with its examples and, for each key, those of them that are there, in the category's order. categories: a short list (category, examples) of the report's layout; it becomes a literal of the plan."""
    have = available.groupBy(*keys).agg(F.collect_set(name).alias("_have"))
    rows = [F.struct(F.lit(r["category"]).alias("category"), F.array(*map(F.lit, r["examples"])).alias("examples")) for r in categories.collect()]
    out = have.select(*keys, "_have", F.explode(F.array(*rows)).alias("c")).select(*keys, "_have", "c.*")
    return out.withColumn("available_examples", F.filter("examples", lambda x: F.array_contains("_have", x))).drop("_have")
