"""Bundles of metrics over wide frames: one row a frame with a struct (x, y, z) for each joint or marker.

Each bundle is windows and one aggregate over the series' keys, so it shuffles once; values at an event's frame are conditional
aggregates, not joins. Planar measures use x and z (y is up) unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import delta_degrees, distance, dot, elevation, folded, heading, joint_angle, midpoint, minus, norm, vector_angle
from . import series
from .body import mean_point
from .islands import around_peak
from .series import Keys, along

#: From millimetres a second.
KMH = 0.0036
UP = (0.0, 1.0, 0.0)
ORDER = "frame_index"


def at(joint: str) -> list[Column]:
    return [F.col(f"{joint}.{a}") for a in "xyz"]


def ground(joint: str) -> list[Column]:
    return [F.col(f"{joint}.x"), F.col(f"{joint}.z")]


def _whole(keys: Keys):
    return Window.partitionBy(*keys)


def _full(keys: Keys):
    return along(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def step_speed(keys: Keys, point: list[Column], rate: float) -> Column:
    """Distance from the row before, by a constant time step; null where either point is missing."""
    w = along(keys)
    return distance([F.lag(c).over(w) for c in point], point) * rate


def gradient_speed(df: DataFrame, keys: Keys, point: list[Column], name: str) -> DataFrame:
    """Length of the central-difference velocity of a point."""
    parts = [f"_{name}_{i}" for i in range(len(point))]
    for part, c in zip(parts, point, strict=True):
        df = series.gradient(df.withColumn(part, c), keys, part, name=part)
    return df.withColumn(name, norm([F.col(p) for p in parts])).drop(*parts)


def yaw(a: str, b: str) -> Column:
    """Direction from a to b on the ground."""
    d = minus(ground(b), ground(a))
    return heading(d[0], d[1])


def trunk_tilt(hip: list[Column], neck: list[Column]) -> Column:
    """Degrees from the vertical (z) to hip -> neck, in [0, 90]."""
    d = minus(neck, hip)
    return F.degrees(F.atan2(norm(d[:2]), F.abs(d[2])))


def angle_from_up(bottom: list[Column], top: list[Column]) -> Column:
    return vector_angle(minus(top, bottom), [F.lit(v) for v in UP], 1e-9)


def lean_2d(top: list[Column], bottom: list[Column]) -> Column:
    """Degrees of a planar line from the vertical, in [0, 90]."""
    d = minus(top, bottom)
    return F.degrees(F.atan2(F.abs(d[0]), F.greatest(F.abs(d[1]), F.lit(1e-6))))


# ---- one trial


def trial_metrics(frames: DataFrame, keys: Keys, rate: float, *, lead: str = "left") -> DataFrame:
    """One row a series: percentiles, medians and peaks of angles and speeds of a marker trial in millimetres, z up."""
    hips, shoulders = mean_point(["left_hip", "right_hip"]), mean_point(["left_shoulder", "right_shoulder"])
    speed = lambda p: step_speed(keys, p, rate) * KMH
    level = lambda a, b: F.degrees(F.atan2(F.col(f"{a}.y") - F.col(f"{b}.y"), F.col(f"{a}.x") - F.col(f"{b}.x")))
    bat = minus(at("bat1"), at("bat5"))
    df = frames.withColumns({
        "sep": F.abs(delta_degrees(level("left_hip", "right_hip"), level("left_shoulder", "right_shoulder"))),
        "knee": joint_angle(at(f"{lead}_hip"), at(f"{lead}_knee"), at(f"{lead}_ankle")),
        "tilt": trunk_tilt(hips, at("neck")), "bat_angle": elevation(bat),
        "r_elbow": joint_angle(at("right_shoulder"), at("right_elbow"), at("right_wrist")), "l_elbow": joint_angle(at("left_shoulder"), at("left_elbow"), at("left_wrist")),
        "r_hand": speed(at("right_wrist")), "l_hand": speed(at("left_wrist")), "trunk": speed(shoulders), "hip_v": speed(hips), "bat_v": speed(at("bat1")),
    })
    p95, median = lambda c: F.percentile(c, F.lit(0.95)), F.median
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / rate).alias("duration_sec"), (F.count("bat1") / F.count(F.lit(1)) * 100).alias("valid_point_pct"),
        p95("sep").alias("hip_shoulder_sep_deg"), median("knee").alias("lead_knee_angle_deg"), median("r_elbow").alias("right_elbow_angle_deg"),
        median("l_elbow").alias("left_elbow_angle_deg"), p95("tilt").alias("trunk_tilt_deg"), F.greatest(F.max("r_hand"), F.max("l_hand")).alias("hand_speed_kmh"),
        F.max("trunk").alias("trunk_speed_kmh"), F.max("hip_v").alias("hip_speed_kmh"), F.max("bat_v").alias("bat_speed_kmh"), median("bat_angle").alias("bat_angle_deg"),
    )
    swing = around_peak(df, keys, "bat_v", F.col("peak") * 0.3).filter("peak > 0")
    return out.join(swing.select(*keys, ((F.col("end_pos") - F.col("start_pos") + 1) / rate).alias("swing_time_sec")), keys, "left")


def key_action_frame(frames: DataFrame, keys: Keys, rate: float, *, batting: Column) -> DataFrame:
    """key_frame and key_rule: the bat's peak where batting, else the faster wrist's (right on ties), else the middle row."""
    df = frames.withColumns({"_b": step_speed(keys, at("bat1"), rate), "_r": step_speed(keys, at("right_wrist"), rate), "_l": step_speed(keys, at("left_wrist"), rate)})
    first = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(ORDER)), F.struct(F.col(c), -F.col(ORDER))).alias(f"{c}_at")
    rows = F.sort_array(F.collect_list(ORDER))
    g = df.groupBy(*keys).agg(*[first(c) for c in ("_b", "_r", "_l")], F.max("_r").alias("_r"), F.max("_l").alias("_l"), F.max(batting).alias("_bats"), rows.alias("_rows"))
    right = F.col("_r").isNotNull() & (F.col("_r") >= F.coalesce("_l", F.col("_r")))
    bats = F.col("_bats") & F.col("_b_at").isNotNull()
    middle = F.get("_rows", F.floor(F.size("_rows") / 2).cast("int"))
    return g.select(
        *keys, F.when(bats, F.col("_b_at")).when(right, F.col("_r_at")).otherwise(F.coalesce("_l_at", middle)).alias("key_frame"),
        F.when(bats, "bat_speed_peak").when(right, "right_hand_speed_peak").when(F.col("_l_at").isNotNull(), "left_hand_speed_peak").otherwise("mid_frame_fallback").alias("key_rule"),
    )


def point_summary(points: DataFrame, keys: Keys, events: DataFrame, rate: float, *, point: str = "point", seconds: float = 0.03) -> DataFrame:
    """Mean place of every point in the frames around its series' key_frame, and how often it is there at all; points missing there are left out."""
    radius = max(1, round(rate * seconds))
    near = F.abs(F.col(ORDER) - F.col("key_frame")) <= radius
    out = points.join(events, keys).groupBy(*keys, "key_frame", point).agg(
        (F.count("x") / F.count(F.lit(1)) * 100).alias("valid_pct"), *[F.avg(F.when(near, F.col(a))).alias(f"key_{a}_mm") for a in "xyz"]
    )
    return out.filter(F.col("key_x_mm").isNotNull())


def is_reconstruction_point(label: Column) -> Column:
    """Labels of places, not of derived angles and forces."""
    return ~label.rlike("(Angles|Angle|Power|Force|Moment)$") & ~label.contains("ProgressAngles")


def chain_peaks(frames: DataFrame, keys: Keys) -> DataFrame:
    """Largest size of five velocities and the first frame that has it: pelvis and trunk turn (degrees a second), shoulder, elbow and hand speed (metres a second)."""
    df = frames
    for name, a, b in (("pelvis", "left_hip", "right_hip"), ("trunk", "left_shoulder", "right_shoulder")):
        d = minus(at(b), at(a))
        df = series.unwrapped(df.withColumn("_yaw", heading(d[0], d[1])), keys, "_yaw", name="_turned")
        df = series.gradient(df, keys, "_turned", name=name).drop("_yaw", "_turned")
    for name, joint in (("shoulder", "right_shoulder"), ("elbow", "right_elbow"), ("hand", "right_wrist")):
        df = gradient_speed(df, keys, [c / 1000 for c in at(joint)], name)
    units = {"pelvis": "velocity_deg_s", "trunk": "velocity_deg_s", "shoulder": "speed_m_s", "elbow": "speed_m_s", "hand": "speed_m_s"}
    peaks = []
    for name, unit in units.items():
        place = F.max_by(F.struct(name, ORDER), F.when(F.col(name).isNotNull(), F.struct(F.abs(name), -F.col(ORDER))))
        peaks += [F.abs(place[name]).alias(f"{name}_{unit}"), place[ORDER].alias(f"{name}_peak_frame")]
    return df.groupBy(*keys).agg(*peaks)


# ---- phases


def normalised(value: Column, keys: Keys) -> Column:
    """Positive values by their 90th percentile (else their maximum), at most 1.5; 0 where a series has none."""
    w, positive = _whole(keys), F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
    p90, most = F.percentile(positive, F.lit(0.9)).over(w), F.max(positive).over(w)
    scale = F.when(p90 > 1e-9, p90).when(most > 1e-9, most)
    return F.when(positive.isNotNull(), F.coalesce(F.least(F.lit(1.5), positive / scale), F.lit(0.0)))


def body_motion(frames: DataFrame, keys: Keys, *, rate: float = 30.0) -> DataFrame:
    """Adds motion: normalised hand speed, 0.4 of the shoulders' and 0.25 of the hips' turn; null where none of them is known."""
    joints = ("left_hand", "right_hand", "left_wrist", "right_wrist")
    df = frames.withColumns({f"_v_{j}": step_speed(keys, at(j), rate) for j in joints})
    df = df.withColumns({"_hips": yaw("left_hip", "right_hip"), "_shoulders": yaw("left_shoulder", "right_shoulder"), "_hand": F.greatest(*[f"_v_{j}" for j in joints])})
    turn = lambda c: F.abs(delta_degrees(F.last(c, ignorenulls=True).over(along(keys).rowsBetween(Window.unboundedPreceding, -1)), F.col(c))) * rate
    df = df.withColumns({"_hip_turn": turn("_hips"), "_shoulder_turn": turn("_shoulders")})
    parts = {"_n1": ("_hand", 1.0), "_n2": ("_shoulder_turn", 0.4), "_n3": ("_hip_turn", 0.25)}
    df = df.withColumns({n: normalised(F.col(c), keys) for n, (c, _) in parts.items()})
    total = sum((F.coalesce(n, F.lit(0.0)) * share for n, (_, share) in parts.items()), F.lit(0.0))
    df = df.withColumn("motion", F.when(F.coalesce(*parts).isNotNull(), total))
    return df.drop(*parts, "_hips", "_shoulders", "_hand", "_hip_turn", "_shoulder_turn", *[f"_v_{j}" for j in joints])


def boundaries(df: DataFrame, keys: Keys, score: str, event: str, *, share: float = 0.25, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """phase_start and phase_end on every row: how far consecutive frame numbers around the event reach a share of its score, within first and last."""
    w = _whole(keys)
    frame, peak = F.col(ORDER), F.max(F.when(F.col(ORDER) == F.col(event), F.col(score))).over(w)
    gap = F.lag(ORDER).over(along(keys)).isNull() | (frame - F.lag(ORDER).over(along(keys)) > 1)
    df = df.withColumns({"_peak": peak, "_gap": gap})
    low = ~F.coalesce(F.col(score) >= F.col("_peak") * share, F.lit(False))
    out = lambda limit, beyond: F.lit(False) if limit is None else beyond(limit)
    stop_l = F.when((frame < F.col(event)) & (low | out(first, lambda x: frame < x)), frame).when((frame <= F.col(event)) & F.col("_gap"), frame - 1)
    stop_r = F.when((frame > F.col(event)) & (low | F.col("_gap") | out(last, lambda x: frame > x)), frame)
    df = df.withColumns({"_l": F.max(stop_l).over(w), "_r": F.min(stop_r).over(w), "_last": F.max(ORDER).over(w)})
    inside = (frame > F.col("_l")) & (frame < F.coalesce("_r", F.col("_last") + 1))
    df = df.withColumns({"phase_start": F.min(F.when(inside, frame)).over(w), "phase_end": F.max(F.when(inside, frame)).over(w)})
    return df.drop("_peak", "_gap", "_l", "_r", "_last")


def _first_max(keys: Keys, value: Column, on: Column) -> Column:
    """The first frame with the largest value among the rows that count."""
    return F.max_by(ORDER, F.when(on & value.isNotNull(), F.struct(value, -F.col(ORDER)))).over(_whole(keys))


def ankle_gap() -> Column:
    return distance(ground("left_ankle"), ground("right_ankle"))


def batting_phase(frames: DataFrame, keys: Keys) -> DataFrame:
    """event_frame: most motion between 35 and 75 % of the clip; its phase; landing_frame: first frame up to it with 90 % of the widest stride so far."""
    df = body_motion(frames, keys)
    w = _whole(keys)
    df = df.withColumns({"_i": F.row_number().over(along(keys, ORDER)) - 1, "_n": F.count(F.lit(1)).over(w)})
    place = lambda share: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * share), F.col(ORDER))).over(w)
    df = df.withColumns({"_from": place(0.35), "_to": place(0.75)}).drop("_i", "_n")
    df = df.withColumn("event_frame", _first_max(keys, F.col("motion"), F.col(ORDER).between(F.col("_from"), F.col("_to"))))
    df = boundaries(df, keys, "motion", "event_frame", first=F.col("_from"), last=F.col("_to"))
    df = df.withColumn("_gap", ankle_gap())
    widest = F.max(F.when(F.col(ORDER) <= F.col("event_frame"), F.col("_gap"))).over(w)
    landing = F.min(F.when((F.col(ORDER) <= F.col("event_frame")) & (F.col("_gap") >= 0.9 * F.col("_widest")), F.col(ORDER))).over(w)
    df = df.withColumn("_widest", widest).withColumn("landing_frame", landing)
    return df.drop("_from", "_to", "_gap", "_widest")


def pitching_phase(frames: DataFrame, keys: Keys, *, rate: float = 30.0) -> DataFrame:
    """event_frame: peak of the faster hand; landing_frame: widest stride up to it, where the phase starts; side: that hand's."""
    w = _whole(keys)
    df = frames.withColumns({f"_{s}": step_speed(keys, at(f"{s}_hand"), rate) for s in ("left", "right")})
    right = F.coalesce(F.max("_right").over(w), F.lit(0.0)) >= F.coalesce(F.max("_left").over(w), F.lit(0.0))
    df = df.withColumn("side", F.when(right, "right").otherwise("left")).withColumn("_v", F.when(F.col("side") == "right", F.col("_right")).otherwise(F.col("_left")))
    df = df.withColumn("event_frame", _first_max(keys, F.col("_v"), F.lit(True))).withColumn("_gap", ankle_gap())
    df = df.withColumn("landing_frame", _first_max(keys, F.col("_gap"), F.col(ORDER) <= F.col("event_frame")))
    df = df.withColumn("_norm", normalised(F.col("_v"), keys))
    return boundaries(df, keys, "_norm", "event_frame").withColumn("phase_start", F.col("landing_frame")).drop("_left", "_right", "_v", "_gap", "_norm")


def phases(df: DataFrame, keys: Keys) -> DataFrame:
    """The phase of each series, from rows that batting_phase or pitching_phase marked."""
    return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("phase_start", "event_frame", "phase_end", "landing_frame")])


# ---- metrics at an event of a phase


def value_at(frame: str, value: Column) -> Column:
    """An aggregate: the value in the row of an event's frame."""
    return F.max(F.when(F.col(ORDER) == F.col(frame), value))


def with_stride(df: DataFrame, keys: Keys) -> DataFrame:
    """Adds dir_x and dir_z: unit vector between the ankles at the widest stride, turned to where the hip goes, and stride: that width."""
    w = _whole(keys)
    d = minus(ground("right_ankle"), ground("left_ankle"))
    best = F.max_by(F.struct(d[0].alias("x"), d[1].alias("z")), F.struct(ankle_gap(), -F.col(ORDER))).over(w)
    df = df.withColumns({"_v": best, "stride": F.max(ankle_gap()).over(w), "_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(along(keys))})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    moved = [F.avg(F.when(F.col("_i") > F.col("_n") - k, c)).over(w) - F.avg(F.when(F.col("_i") <= k, c)).over(w) for c in ground("hip")]
    turn = F.when(moved[0] * F.col("_v.x") + moved[1] * F.col("_v.z") < 0, -1.0).otherwise(1.0)
    wide = F.col("stride") > 1e-9
    df = df.withColumns({"dir_x": F.when(wide, turn * F.col("_v.x") / F.col("stride")).otherwise(1.0), "dir_z": F.when(wide, turn * F.col("_v.z") / F.col("stride")).otherwise(0.0)})
    return df.drop("_v", "_n", "_i")


def side_pick(side: Column, of) -> Column:
    """of(side's name), for the side that a column names."""
    return F.when(side == "left", of("left")).otherwise(of("right"))


def with_lead(df: DataFrame, keys: Keys) -> DataFrame:
    """Adds lead: the side whose ankle is farther along the stride at the landing."""
    along_dir = lambda s: dot(ground(f"{s}_ankle"), [F.col("dir_x"), F.col("dir_z")])
    ahead = F.max(F.when(F.col(ORDER) == F.col("landing_frame"), (along_dir("left") >= along_dir("right")).cast("int"))).over(_whole(keys))
    return df.withColumn("lead", F.when(ahead == 1, "left").otherwise("right"))


def shared_metrics(marked: DataFrame, keys: Keys) -> DataFrame:
    """Both actions' metrics from rows with event_frame, landing_frame and phase_start: separation, knee, tilt, head stability, weight transfer, stride over height."""
    df = with_lead(with_stride(marked, keys), keys)
    lows = [distance(at("head"), at(f"{s}_{j}")) for j in ("foot", "ankle") for s in ("left", "right")]
    inside = F.col(ORDER).between(F.col("phase_start"), F.col("event_frame"))
    any_inside = F.max(inside.cast("int")).over(_whole(keys)) == 1
    df = df.withColumns({"_tall": F.greatest(*lows), "_on": inside | ~any_inside, "_i": F.row_number().over(along(keys)), "_n": F.count(F.lit(1)).over(_whole(keys))})
    # Across the stride of the phase's own frames.
    across = dot(minus(ground("head"), ground("hip")), [-F.col("dir_z"), F.col("dir_x")])
    drift = F.max(F.when(F.col("_on"), across)) - F.min(F.when(F.col("_on"), across))
    early = F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    sep = F.abs(delta_degrees(yaw("left_hip", "right_hip"), yaw("left_shoulder", "right_shoulder")))
    knee = side_pick(F.col("lead"), lambda s: joint_angle(at(f"{s}_hip"), at(f"{s}_knee"), at(f"{s}_ankle")))
    g = df.groupBy(*keys).agg(
        value_at("event_frame", sep).alias("hip_shoulder_sep"), value_at("landing_frame", knee).alias("lead_knee_angle"), value_at("event_frame", angle_from_up(at("hip"), at("neck"))).alias("trunk_tilt"),
        drift.alias("_drift"), F.max("stride").alias("_stride"), F.median("_tall").alias("_tall"), F.first("lead").alias("lead_side"), value_at("landing_frame", ankle_gap()).alias("_step"),
        *[(value_at("event_frame", c) - F.avg(F.when(early, c))).alias(f"_moved_{i}") for i, c in enumerate(ground("hip"))], F.max("dir_x").alias("_dx"), F.max("dir_z").alias("_dz"),
    )
    wide = F.when(F.col("_stride") > 1e-9, F.col("_stride"))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))
    shift = F.col("_moved_0") * F.col("_dx") + F.col("_moved_1") * F.col("_dz")
    return g.select(
        *keys, "hip_shoulder_sep", "lead_knee_angle", "trunk_tilt", clamp(100 * (1 - F.col("_drift") / wide)).alias("head_stability"),
        clamp(shift / wide * 100).alias("weight_transfer"), (F.col("_step") / F.when(F.col("_tall") > 0, F.col("_tall"))).alias("stride_length_ratio"), "lead_side",
    )


def pitching_metrics(marked: DataFrame, keys: Keys, *, rate: float = 30.0) -> DataFrame:
    """The throwing side's metrics at release and landing, from rows that pitching_phase marked."""
    df = with_lead(with_stride(marked, keys), keys)
    snap_angle = side_pick(F.col("side"), lambda s: joint_angle(at(f"{s}_elbow"), at(f"{s}_wrist"), at(f"{s}_hand")))
    df = df.withColumns({"_snap": snap_angle, **{f"_{j}_{s}": step_speed(keys, at(f"{s}_{j}"), rate) for s in ("left", "right") for j in ("wrist", "hand")}})
    w = along(keys)
    before = F.coalesce(F.lag("_snap", 2).over(w), F.first("_snap").over(_full(keys)))
    after = F.coalesce(F.lead("_snap", 2).over(w), F.last("_snap").over(_full(keys)))
    df = df.withColumn("_snapped", F.abs(after - before))
    side, torso = F.col("side"), minus(at("neck"), at("hip"))
    feet, hips = minus(ground("right_ankle"), ground("left_ankle")), minus(ground("right_hip"), ground("left_hip"))
    acute = lambda angle: F.least(angle, 180.0 - angle)
    toe = lambda s: acute(vector_angle(minus(ground(f"{s}_foot"), ground(f"{s}_ankle")), [F.col("dir_x"), F.col("dir_z")], 1e-9))
    return df.groupBy(*keys).agg(
        value_at("event_frame", side_pick(side, lambda s: joint_angle(at(f"{s}_shoulder"), at(f"{s}_elbow"), at(f"{s}_wrist")))).alias("elbow_bend"),
        value_at("event_frame", side_pick(side, lambda s: vector_angle(minus(at(f"{s}_elbow"), at(f"{s}_shoulder")), torso, 1e-9))).alias("arm_abduction"),
        value_at("landing_frame", acute(vector_angle(feet, hips, 1e-9))).alias("stride_angle"), value_at("landing_frame", side_pick(F.col("lead"), toe)).alias("foot_direction"),
        value_at("event_frame", F.col("_snapped")).alias("wrist_snap"), value_at("event_frame", side_pick(side, lambda s: F.col(f"_wrist_{s}"))).alias("arm_speed"),
        value_at("event_frame", side_pick(side, lambda s: F.col(f"_hand_{s}"))).alias("fingertip_speed"),
    )


def batting_metrics(marked: DataFrame, keys: Keys, *, rate: float = 30.0) -> DataFrame:
    """Hip rotation over the phase, bat speed and angle and wrist speed at the event, from rows that batting_phase marked."""
    df = marked.withColumns({"_bat": step_speed(keys, at("bat1"), rate), "_l": step_speed(keys, at("left_wrist"), rate), "_r": step_speed(keys, at("right_wrist"), rate), "_yaw": yaw("left_hip", "right_hip")})
    d = minus(at("bat1"), at("bat5"))
    out = df.groupBy(*keys).agg(
        value_at("event_frame", F.col("_bat")).alias("bat_speed"), value_at("event_frame", folded(heading(d[0], d[1]))).alias("attack_angle"),
        value_at("event_frame", F.greatest("_l", "_r")).alias("wrist_speed"),
    )
    phase = df.filter(F.col(ORDER).between(F.col("phase_start"), F.col("event_frame")))
    turned = series.rotation_range(phase.select(*keys, ORDER, F.col("_yaw").alias("angle")), keys, "angle")
    return out.join(turned.withColumnRenamed("rotation_range", "hip_rotation"), keys, "left")


# ---- the pitch at release


def with_axis(df: DataFrame, keys: Keys, joints: tuple[str, ...] = ("hip",)) -> DataFrame:
    """Adds ax, az: unit vector on the ground from the torso's first place to its last, (1, 0) where it stays; and torso_x, torso_z."""
    center = mean_point(list(joints), ("x", "z"))
    df = df.withColumns({"torso_x": center[0], "torso_z": center[1]})
    moved = [F.last(c).over(_full(keys)) - F.first(c).over(_full(keys)) for c in ("torso_x", "torso_z")]
    df = df.withColumns({"_mx": moved[0], "_mz": moved[1]})
    size = F.sqrt(F.col("_mx") ** 2 + F.col("_mz") ** 2)
    return df.withColumns({"ax": F.when(size >= 1e-6, F.col("_mx") / size).otherwise(1.0), "az": F.when(size >= 1e-6, F.col("_mz") / size).otherwise(0.0)}).drop("_mx", "_mz")


def _axis() -> list[Column]:
    return [F.col("ax"), F.col("az")]


def layback() -> Column:
    """How far the right wrist is behind the shoulder on the movement axis."""
    return dot(minus(ground("right_shoulder"), ground("right_wrist")), _axis())


def marked_pitch(frames: DataFrame, keys: Keys) -> DataFrame:
    """Adds speeds, the movement axis, release (fastest wrist), stride (first frame with 90 % of the widest step) and the lead side there."""
    df = gradient_speed(gradient_speed(with_axis(frames, keys), keys, at("right_wrist"), "wrist_speed"), keys, at("right_hand"), "hand_speed")
    w = _whole(keys)
    df = df.withColumns({"release": _first_max(keys, F.col("wrist_speed"), F.lit(True)), "_gap": ankle_gap()})
    df = df.withColumn("_widest", F.max("_gap").over(w))
    df = df.withColumn("stride_frame", F.min(F.when(F.col("_gap") >= 0.9 * F.col("_widest"), F.col(ORDER))).over(w))
    ahead = dot(ground("left_ankle"), _axis()) >= dot(ground("right_ankle"), _axis())
    df = df.withColumn("_ahead", F.max(F.when(F.col(ORDER) == F.col("stride_frame"), ahead.cast("int"))).over(w))
    return df.withColumn("lead", F.when(F.col("_ahead") == 1, "left").otherwise("right")).drop("_gap", "_widest", "_ahead")


def pitch_bundle(frames: DataFrame, keys: Keys, joints: list[str]) -> DataFrame:
    """Thirteen metrics of a pitch at its release and stride; places in metres. joints: all whose span makes the body's height."""
    df = marked_pitch(frames, keys)
    lead = F.col("lead")
    shoulders, hips = midpoint(at("left_shoulder"), at("right_shoulder")), midpoint(at("left_hip"), at("right_hip"))
    leg = lambda s: minus(at(f"{s}_hip"), at(f"{s}_ankle"))
    rise = lambda s: F.degrees(F.atan2(F.abs(leg(s)[1]), F.greatest(norm([leg(s)[0], leg(s)[2]]), F.lit(1e-9))))
    toe = lambda s: minus(ground(f"{s}_foot"), ground(f"{s}_ankle"))
    toed = lambda s: F.when(norm(toe(s)) >= 1e-9, F.degrees(F.atan2(F.col("ax") * toe(s)[1] - F.col("az") * toe(s)[0], dot(_axis(), toe(s)))))
    along_axis = F.col("torso_x") * F.col("ax") + F.col("torso_z") * F.col("az")
    across = F.col("head.z") * F.col("ax") - F.col("head.x") * F.col("az")
    ys = [F.col(f"{j}.y") for j in joints]
    p = lambda c, share: F.percentile(c, F.lit(share))
    g = df.withColumns({"_rise": side_pick(lead, rise), "_toe": side_pick(lead, toed)}).groupBy(*keys).agg(
        value_at("release", joint_angle(at("right_shoulder"), at("right_elbow"), at("right_wrist"))).alias("elbow_bend_deg"),
        value_at("release", vector_angle(minus(at("right_elbow"), at("right_shoulder")), minus(shoulders, hips), 1e-9)).alias("arm_abduction_deg"),
        value_at("release", angle_from_up(hips, shoulders)).alias("trunk_lean_deg"), value_at("stride_frame", F.col("_rise")).alias("stride_angle_deg"),
        value_at("release", side_pick(lead, lambda s: joint_angle(at(f"{s}_hip"), at(f"{s}_knee"), at(f"{s}_ankle")))).alias("lead_knee_deg"),
        value_at("release", delta_degrees(yaw("left_hip", "right_hip"), yaw("left_shoulder", "right_shoulder"))).alias("hip_shoulder_sep_deg"),
        p("wrist_speed", 0.95).alias("arm_speed_mps"), value_at("stride_frame", F.col("_toe")).alias("foot_direction_deg"),
        value_at("release", joint_angle(at("right_elbow"), at("right_wrist"), at("right_hand"))).alias("wrist_snap_deg"), p("hand_speed", 0.95).alias("fingertip_speed_mps"),
        (p(ankle_gap(), 0.9) * 100).alias("_stride"), (p(F.greatest(*ys) - F.least(*ys), 0.9) * 100).alias("_height"),
        ((F.max(along_axis) - F.min(along_axis)) * 100).alias("_shift"), ((F.max(across) - F.min(across)) * 100).alias("_sway"),
    )
    least = lambda c: F.greatest(c, F.lit(1e-6))
    steady = 100 * (1 - F.col("_sway") / least(F.col("_stride") * 0.35))
    return g.withColumns({
        "stride_length_pct_height": F.col("_stride") / least(F.col("_height")) * 100, "weight_transfer_pct": F.col("_shift") / least(F.col("_stride")) * 100,
        "head_stability_pct": F.greatest(F.lit(0.0), F.least(F.lit(100.0), steady)),
    }).drop("_stride", "_height", "_shift", "_sway")


def phase_events(frames: DataFrame, keys: Keys) -> DataFrame:
    """Four rows a series: stride (FC), most layback from there to release (MER), release (BR), follow-through an eighth of the clip later (FT), with their share of the clip."""
    w = _whole(keys)
    df = marked_pitch(frames, keys).withColumns({"_i": F.row_number().over(along(keys)) - 1, "_n": F.count(F.lit(1)).over(w)})
    place = lambda c: F.max(F.when(F.col(ORDER) == F.col(c), F.col("_i"))).over(w)
    df = df.withColumns({"_fc": place("stride_frame"), "_br": place("release")})
    before = (F.col("_i") >= F.col("_fc")) & (F.col("_i") < F.greatest(F.col("_br"), F.col("_fc") + 1))
    last = F.least(F.col("_br") + F.greatest(F.floor(F.col("_n") / 8), F.lit(3)), F.col("_n") - 1)
    g = df.groupBy(*keys).agg(
        F.first("stride_frame").alias("FC"), F.max_by(ORDER, F.when(before, F.struct(layback(), -F.col(ORDER)))).alias("MER"), F.first("release").alias("BR"),
        F.max(F.when(F.col("_i") == last, F.col(ORDER))).alias("FT"), F.min(ORDER).alias("_a"), F.max(ORDER).alias("_b"),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).alias("frame")) for e in ("FC", "MER", "BR", "FT")])).alias("e")
    span = F.greatest(F.col("_b") - F.col("_a"), F.lit(1))
    return g.select(*keys, "_a", "_b", rows).select(*keys, "e.event", "e.frame", ((F.col("e.frame") - F.col("_a")) / span).alias("phase"))


# ---- choice between two poses of a frame

CORE = tuple(f"{s}_{j}" for j in ("shoulder", "elbow", "wrist", "hip", "knee", "ankle") for s in ("left", "right"))


def limb_ratio(a: str, b: str, c: str) -> Column:
    """Longer over shorter of the limbs a-b and b-c; 1 where one is missing or has no length."""
    first, second = distance(at(a)[:2], at(b)[:2]), distance(at(b)[:2], at(c)[:2])
    return F.coalesce(F.when(F.least(first, second) > 1e-6, F.greatest(first, second) / F.least(first, second)), F.lit(1.0))


def pose_score(frames: DataFrame, score: Column) -> Column:
    """How good a pose is: mean score of the core joints, more for large and low ones; -1 for too few joints or odd proportions. frames: x and y in [0, 1]."""
    there = [F.when(F.col(f"{j}.x").isNotNull() & F.col(f"{j}.y").isNotNull(), F.col(j)) for j in CORE if j in frames.columns]
    xs, ys = [p["x"] for p in there], [p["y"] for p in there]
    n = sum((p.isNotNull().cast("int") for p in there), F.lit(0))
    width, height = F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
    aspect = height / F.greatest(width, F.lit(1e-6))
    bad = (n < 6) | (width < 0.055) | (height < 0.12) | (aspect > 6.5) | (aspect < 0.65)
    bad = bad | (limb_ratio("left_hip", "left_knee", "left_ankle") > 3.5) | (limb_ratio("right_hip", "right_knee", "right_ankle") > 3.5)
    low = 1 + F.greatest(F.lit(0.0), (F.greatest(*ys) + F.least(*ys)) / 2 - 0.35) * 1.2
    return F.when(F.coalesce(bad, F.lit(True)), -1.0).otherwise(score * (1 + 8 * F.least(height * width, F.lit(0.18))) * low)


def chosen_pose(crop: Column, whole: Column) -> Column:
    """The whole frame's pose has to be clearly better than the crop's."""
    return F.when(whole > crop * 1.08, "full_frame").otherwise("roi")


# ---- before and after an event


def event_changes(frames: DataFrame, keys: Keys, start: str, event: str) -> DataFrame:
    """From the rows at two frames (columns): height (head over feet), pelvis shift as a share of the stance, stride over height; z up."""
    feet = mean_point(["left_foot", "right_foot"])
    tall = F.abs(F.col("head.z") - feet[2])
    stance = distance(at("left_ankle")[:2], at("right_ankle")[:2])
    g = frames.groupBy(*keys).agg(
        value_at(event, tall).alias("height_mm"), value_at(start, stance).alias("_stance"), value_at(event, stance).alias("_stride"),
        *[(value_at(event, F.col(f"hip.{a}")) - value_at(start, F.col(f"hip.{a}"))).alias(f"_{a}") for a in "xy"],
    )
    shift = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2)
    return g.select(
        *keys, "height_mm", (shift / F.when(F.col("_stance") > 0, F.col("_stance")) * 100).alias("weight_transfer_pct"),
        (F.col("_stride") / F.when(F.col("height_mm") > 0, F.col("height_mm"))).alias("stride_length_ratio"),
    )


def local_median(points: DataFrame, keys: Keys, radius: int) -> DataFrame:
    """Median place among the complete points within so many frames."""
    near = along(keys).rangeBetween(-radius, radius)
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return points.withColumns({f"m_{a}": F.percentile(F.when(whole, F.col(a)), F.lit(0.5)).over(near) for a in "xyz"})


def sequence_summary(points: DataFrame, keys: Keys) -> DataFrame:
    """Frames, joints and seconds of each sequence, and the mean quality of its points."""
    return points.groupBy(*keys).agg(
        F.count_distinct(ORDER).alias("frames"), F.count_distinct("joint_name").alias("joints"), (F.max("timestamp_sec") - F.min("timestamp_sec")).alias("duration_sec"),
        F.avg("quality").alias("mean_quality"), F.avg(F.when(F.col("x").isNull(), 1.0).otherwise(0.0)).alias("missing_share"),
    )


def side_balance(frames: DataFrame, keys: Keys) -> DataFrame:
    """Heights of both shoulders and hips apart in the middle row, and the range of the ankles' distance."""
    df = frames.withColumns({"_i": F.row_number().over(along(keys)) - 1, "_n": F.count(F.lit(1)).over(_whole(keys))})
    middle = lambda a, b: F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.abs(F.col(f"{a}.y") - F.col(f"{b}.y"))))
    return df.groupBy(*keys).agg(
        middle("left_shoulder", "right_shoulder").alias("shoulder_gap"), middle("left_hip", "right_hip").alias("hip_gap"), (F.max(ankle_gap()) - F.min(ankle_gap())).alias("ankle_range")
    )
