"""Registered queries of the metric bundles, over the skeleton view, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundles as B
from . import adapters as A
from .queries import query

T = ["trial_id"]
RATE = 100.0
SK = A.skeleton_sql()
W = "w AS (PARTITION BY trial_id ORDER BY frame_index)"

Sql = tuple[str, ...]


def J(joint: str) -> Sql:
    return tuple(f"{joint}_{a}" for a in "xyz")


def ground(joint: str) -> Sql:
    return (f"{joint}_x", f"{joint}_z")


def sub(a: Sql, b: Sql) -> Sql:
    return tuple(f"({p} - {q})" for p, q in zip(a, b, strict=True))


def mid(a: str, b: str) -> Sql:
    return tuple(f"(({p} + {q}) / 2)" for p, q in zip(J(a), J(b), strict=True))


def dot(a: Sql, b: Sql) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def norm(a: Sql) -> str:
    return f"sqrt({dot(a, a)})"


def angle(a: Sql, b: Sql) -> str:
    return f"degrees(acos(greatest(-1, least(1, {dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0)))))"


def joint(a: str, b: str, c: str) -> str:
    return angle(sub(J(a), J(b)), sub(J(c), J(b)))


def yaw(a: str, b: str) -> str:
    d = sub(ground(b), ground(a))
    return f"degrees(atan2({d[1]}, {d[0]}))"


def turn(a: str, b: str) -> str:
    return f"(((({b}) - ({a}) + 180) % 360 + 360) % 360 - 180)"


def lagged(a: Sql) -> Sql:
    return tuple(f"lag({c}) OVER w" for c in a)


def step(a: Sql, rate: float) -> str:
    return f"{norm(sub(a, lagged(a)))} * {rate}"


def side(column: str, of) -> str:
    return f"CASE WHEN {column} = 'left' THEN {of('left')} ELSE {of('right')} END"


def rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


TRIAL = f"""{SK}, s AS (SELECT trial_id, frame_index, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY trial_id) AS n, bat1_x,
  abs({turn("degrees(atan2(left_hip_y - right_hip_y, left_hip_x - right_hip_x))", "degrees(atan2(left_shoulder_y - right_shoulder_y, left_shoulder_x - right_shoulder_x))")}) AS sep,
  {joint("left_hip", "left_knee", "left_ankle")} AS knee, {joint("right_shoulder", "right_elbow", "right_wrist")} AS relb, {joint("left_shoulder", "left_elbow", "left_wrist")} AS lelb,
  degrees(atan2({norm(sub(J("neck"), mid("left_hip", "right_hip"))[:2])}, abs({sub(J("neck"), mid("left_hip", "right_hip"))[2]}))) AS tilt,
  degrees(atan2({sub(J("bat1"), J("bat5"))[2]}, {norm(sub(J("bat1"), J("bat5"))[:2])})) AS bat,
  {step(J("right_wrist"), 0.36)} AS rh, {step(J("left_wrist"), 0.36)} AS lh, {step(mid("left_shoulder", "right_shoulder"), 0.36)} AS tv, {step(mid("left_hip", "right_hip"), 0.36)} AS hv, {step(J("bat1"), 0.36)} AS bv
  FROM frames WINDOW {W})"""


@query(f"""WITH {TRIAL}, pk AS (SELECT trial_id, max(bv) AS peak, arg_min(pos, (-bv, pos)) AS pp FROM s WHERE bv IS NOT NULL GROUP BY trial_id),
sw AS (SELECT trial_id, (coalesce(min(CASE WHEN NOT coalesce(bv >= 0.3 * peak, false) AND pos > pp THEN pos END), any_value(n)) - coalesce(max(CASE WHEN NOT coalesce(bv >= 0.3 * peak, false) AND pos < pp THEN pos END), -1) - 1) / 100 AS swing
  FROM s JOIN pk USING (trial_id) GROUP BY trial_id)
SELECT trial_id, count(*) AS frames, round(count(*) / 100, 6) AS duration_sec, round(count(bat1_x) / count(*) * 100, 6) AS valid_point_pct, round(quantile_cont(sep, 0.95), 6) AS hip_shoulder_sep_deg, round(median(knee), 6) AS lead_knee_angle_deg,
  round(median(relb), 6) AS right_elbow_angle_deg, round(median(lelb), 6) AS left_elbow_angle_deg, round(quantile_cont(tilt, 0.95), 6) AS trunk_tilt_deg, round(greatest(max(rh), max(lh)), 6) AS hand_speed_kmh, round(max(tv), 6) AS trunk_speed_kmh,
  round(max(hv), 6) AS hip_speed_kmh, round(max(bv), 6) AS bat_speed_kmh, round(median(bat), 6) AS bat_angle_deg, round(any_value(swing), 6) AS swing_time_sec FROM s LEFT JOIN sw USING (trial_id) GROUP BY trial_id""")
def trial_metrics(spark, sf_dir):
    return rounded(B.trial_metrics(A.skeleton(spark, sf_dir), T, RATE), ["trial_id", "frames"])


#: Every other trial is taken for batting.
BATS = "ascii(right(trial_id::VARCHAR, 1)) % 2 = 0"


def _bats():
    return F.ascii(F.right(F.col("trial_id").cast("string"), F.lit(1))) % 2 == 0


KEY = f"""{SK}, v AS (SELECT trial_id, frame_index, {step(J("bat1"), 100.0)} AS b, {step(J("right_wrist"), 100.0)} AS r, {step(J("left_wrist"), 100.0)} AS l FROM frames WINDOW {W}),
keyed AS (SELECT trial_id, CASE WHEN {BATS} AND max(b) IS NOT NULL THEN arg_min(frame_index, (-b, frame_index)) FILTER (b IS NOT NULL) WHEN max(r) >= coalesce(max(l), max(r)) THEN arg_min(frame_index, (-r, frame_index)) FILTER (r IS NOT NULL)
    ELSE coalesce(arg_min(frame_index, (-l, frame_index)) FILTER (l IS NOT NULL), list_sort(list(frame_index))[count(*) // 2 + 1]) END AS key_frame,
  CASE WHEN {BATS} AND max(b) IS NOT NULL THEN 'bat_speed_peak' WHEN max(r) >= coalesce(max(l), max(r)) THEN 'right_hand_speed_peak' WHEN max(l) IS NOT NULL THEN 'left_hand_speed_peak' ELSE 'mid_frame_fallback' END AS key_rule
  FROM v GROUP BY trial_id)"""


@query(f"WITH {KEY} SELECT * FROM keyed")
def key_action_frame(spark, sf_dir):
    return B.key_action_frame(A.skeleton(spark, sf_dir), T, RATE, batting=_bats())


@query(f"""WITH {KEY} SELECT m.trial_id, key_frame, 'P' || marker AS point, round(count(x) / count(*) * 100, 6) AS valid_pct, {", ".join(f"round(avg(CASE WHEN abs(frame_index - key_frame) <= 3 THEN {a} END), 6) AS key_{a}_mm" for a in "xyz")}
FROM markers m JOIN keyed USING (trial_id) GROUP BY ALL""")
def point_summary(spark, sf_dir):
    keyed = B.key_action_frame(A.skeleton(spark, sf_dir), T, RATE, batting=_bats()).select("trial_id", "key_frame")
    points = A.markers(spark, sf_dir).withColumn("point", F.concat(F.lit("P"), "marker")).filter(B.is_reconstruction_point(F.col("point")))
    return rounded(B.point_summary(points, T, keyed, RATE), ["trial_id", "key_frame", "point"])


def _gradient_sql(c: str) -> str:
    b, a, hb, ha = f"({c} - lag({c}) OVER w)", f"(lead({c}) OVER w - {c})", "(timestamp_sec - lag(timestamp_sec) OVER w)", "(lead(timestamp_sec) OVER w - timestamp_sec)"
    return f"coalesce(({hb} * {hb} * {a} + {ha} * {ha} * {b}) / ({ha} * {hb} * ({ha} + {hb})), {a} / {ha}, {b} / {hb})"


def _gradient_speed_sql(a: Sql) -> str:
    return "sqrt(" + " + ".join(f"{_gradient_sql(c)} ** 2" for c in a) + ")"


_LEVEL = {"pelvis": ("left_hip", "right_hip"), "trunk": ("left_shoulder", "right_shoulder")}
_SPEEDS = {"shoulder": "right_shoulder", "elbow": "right_elbow", "hand": "right_wrist"}


@query(f"""WITH {SK}, y AS (SELECT *, {", ".join(f"degrees(atan2({b}_y - {a}_y, {b}_x - {a}_x)) AS {n}_yaw" for n, (a, b) in _LEVEL.items())} FROM frames),
t AS (SELECT *, {", ".join(f"coalesce({turn(f'lag({n}_yaw) OVER w', f'{n}_yaw')}, 0) AS {n}_turn" for n in _LEVEL)} FROM y WINDOW {W}),
u AS (SELECT *, {", ".join(f"first_value({n}_yaw) OVER w + sum({n}_turn) OVER w AS {n}_u" for n in _LEVEL)} FROM t WINDOW {W}),
v AS (SELECT trial_id, frame_index, {", ".join(f"{_gradient_sql(f'{n}_u')} AS {n}" for n in _LEVEL)}, {", ".join(f"{_gradient_speed_sql(tuple(f'({c} / 1000)' for c in J(j)))} AS {n}" for n, j in _SPEEDS.items())} FROM u WINDOW {W})
SELECT trial_id, {", ".join(f"round(max(abs({n})), 4) AS {n}_{'velocity_deg_s' if n in _LEVEL else 'speed_m_s'}, arg_min(frame_index, (-abs({n}), frame_index)) FILTER ({n} IS NOT NULL) AS {n}_peak_frame" for n in (*_LEVEL, *_SPEEDS))} FROM v GROUP BY trial_id""")
def chain_peaks(spark, sf_dir):
    out = B.chain_peaks(A.skeleton(spark, sf_dir), T)
    return rounded(out, ["trial_id", *[c for c in out.columns if c.endswith("frame")]], 4)


def _norm_sql(c: str, name: str) -> str:
    p = f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, 0) END"
    scale = f"CASE WHEN quantile_cont({p}, 0.9) OVER t > 1e-9 THEN quantile_cont({p}, 0.9) OVER t WHEN max({p}) OVER t > 1e-9 THEN max({p}) OVER t END"
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(least(1.5, {p} / ({scale})), 0) END AS {name}"


_HANDS = ("left_hand", "right_hand", "left_wrist", "right_wrist")
MOTION = f"""{SK}, sp AS (SELECT *, greatest({", ".join(step(J(j), 30.0) for j in _HANDS)}) AS hand, abs({turn("lag(" + yaw("left_hip", "right_hip") + ") OVER w", yaw("left_hip", "right_hip"))}) * 30 AS ht,
    abs({turn("lag(" + yaw("left_shoulder", "right_shoulder") + ") OVER w", yaw("left_shoulder", "right_shoulder"))}) * 30 AS st FROM frames WINDOW {W}),
nm AS (SELECT *, {_norm_sql("hand", "n1")}, {_norm_sql("st", "n2")}, {_norm_sql("ht", "n3")} FROM sp WINDOW t AS (PARTITION BY trial_id)),
moving AS (SELECT *, CASE WHEN coalesce(n1, n2, n3) IS NOT NULL THEN coalesce(n1, 0) + 0.4 * coalesce(n2, 0) + 0.25 * coalesce(n3, 0) END AS motion FROM nm)"""


@query(f"WITH {MOTION} SELECT trial_id, frame_index, round(motion, 6) AS motion FROM moving")
def body_motion(spark, sf_dir):
    return B.body_motion(A.skeleton(spark, sf_dir), T).select("trial_id", "frame_index", F.round("motion", 6).alias("motion"))


GAP = norm(sub(ground("right_ankle"), ground("left_ankle")))


def _bounds_sql(source: str, score: str, first: str, last: str) -> str:
    """CTEs that end in `bounds`: the reach of consecutive frames with a quarter of the event's score."""
    low = f"(NOT coalesce(s.{score} >= 0.25 * pk, false))"
    return f"""pks AS (SELECT trial_id, max({score}) FILTER (frame_index = ev) AS pk FROM {source} GROUP BY trial_id),
gp AS (SELECT *, coalesce(frame_index - lag(frame_index) OVER w > 1, true) AS gap FROM {source} WINDOW {W}),
lim AS (SELECT s.trial_id, max(CASE WHEN frame_index < ev AND ({low} OR {first}) THEN frame_index WHEN frame_index <= ev AND gap THEN frame_index - 1 END) AS l,
  coalesce(min(CASE WHEN frame_index > ev AND ({low} OR gap OR {last}) THEN frame_index END), max(frame_index) + 1) AS r FROM gp s JOIN pks USING (trial_id) GROUP BY s.trial_id),
bounds AS (SELECT s.trial_id, min(frame_index) AS ps, max(frame_index) AS pe FROM gp s JOIN lim USING (trial_id) WHERE frame_index > l AND frame_index < r GROUP BY s.trial_id)"""


BAT_PHASE = f"""{MOTION}, rk AS (SELECT *, list_sort(list(frame_index) OVER (PARTITION BY trial_id)) AS fr FROM moving),
lm AS (SELECT * EXCLUDE fr, fr[CAST(floor(len(fr) * 0.35) AS INT) + 1] AS f0, fr[CAST(floor(len(fr) * 0.75) AS INT) + 1] AS f1 FROM rk),
evs AS (SELECT trial_id, arg_min(frame_index, (-motion, frame_index)) AS ev FROM lm WHERE frame_index BETWEEN f0 AND f1 AND motion IS NOT NULL GROUP BY trial_id),
ph AS (SELECT lm.*, ev FROM lm JOIN evs USING (trial_id)), {_bounds_sql("ph", "motion", "frame_index < f0", "frame_index > f1")},
wide AS (SELECT trial_id, max({GAP}) AS widest FROM ph WHERE frame_index <= ev GROUP BY trial_id),
land AS (SELECT trial_id, min(frame_index) AS lf FROM ph JOIN wide USING (trial_id) WHERE frame_index <= ev AND {GAP} >= 0.9 * widest GROUP BY trial_id),
marked AS (SELECT ph.*, ps, pe, lf FROM ph JOIN bounds USING (trial_id) JOIN land USING (trial_id))"""


@query(f"WITH {BAT_PHASE} SELECT DISTINCT trial_id, ps AS phase_start, ev AS event_frame, pe AS phase_end, lf AS landing_frame FROM marked")
def batting_phase(spark, sf_dir):
    return B.phases(B.batting_phase(A.skeleton(spark, sf_dir), T), T)


PITCH_PHASE = f"""{SK}, sp AS (SELECT *, {step(J("left_hand"), 30.0)} AS lv, {step(J("right_hand"), 30.0)} AS rv FROM frames WINDOW {W}),
sd AS (SELECT *, CASE WHEN coalesce(max(rv) OVER t, 0) >= coalesce(max(lv) OVER t, 0) THEN 'right' ELSE 'left' END AS side FROM sp WINDOW t AS (PARTITION BY trial_id)),
hv AS (SELECT *, CASE WHEN side = 'right' THEN rv ELSE lv END AS v FROM sd), nm AS (SELECT *, {_norm_sql("v", "vn")} FROM hv WINDOW t AS (PARTITION BY trial_id)),
evs AS (SELECT trial_id, arg_min(frame_index, (-v, frame_index)) AS ev FROM nm WHERE v IS NOT NULL GROUP BY trial_id),
ph AS (SELECT nm.*, ev FROM nm JOIN evs USING (trial_id)), {_bounds_sql("ph", "vn", "false", "false")},
land AS (SELECT trial_id, arg_min(frame_index, (-({GAP}), frame_index)) AS lf FROM ph WHERE frame_index <= ev GROUP BY trial_id),
marked AS (SELECT ph.*, lf AS ps, pe, lf FROM ph JOIN bounds USING (trial_id) JOIN land USING (trial_id))"""


@query(f"WITH {PITCH_PHASE} SELECT DISTINCT trial_id, ps AS phase_start, ev AS event_frame, pe AS phase_end, lf AS landing_frame FROM marked")
def pitching_phase(spark, sf_dir):
    return B.phases(B.pitching_phase(A.skeleton(spark, sf_dir), T), T)


_D = sub(ground("right_ankle"), ground("left_ankle"))
STRIDE = f"""nn AS (SELECT *, count(*) OVER (PARTITION BY trial_id) AS n, row_number() OVER w AS i FROM marked WINDOW {W}),
hp AS (SELECT trial_id, arg_min({_D[0]}, (-({GAP}), frame_index)) AS vx, arg_min({_D[1]}, (-({GAP}), frame_index)) AS vz, max({GAP}) AS stride,
  {", ".join(f"avg(hip_{a}) FILTER (i > n - greatest(1, n // 10)) - avg(hip_{a}) FILTER (i <= greatest(1, n // 10)) AS m{a}, avg(hip_{a}) FILTER (i <= greatest(1, n // 10)) AS e{a}" for a in "xz")} FROM nn GROUP BY trial_id),
dr AS (SELECT *, CASE WHEN mx * vx + mz * vz < 0 THEN -1 ELSE 1 END * vx / stride AS dx, CASE WHEN mx * vx + mz * vz < 0 THEN -1 ELSE 1 END * vz / stride AS dz FROM hp),
ld AS (SELECT trial_id, CASE WHEN max(left_ankle_x * dx + left_ankle_z * dz - right_ankle_x * dx - right_ankle_z * dz) FILTER (frame_index = lf) >= 0 THEN 'left' ELSE 'right' END AS lead FROM nn JOIN dr USING (trial_id) GROUP BY trial_id),
st AS (SELECT nn.*, dx, dz, stride, ex, ez, lead FROM nn JOIN dr USING (trial_id) JOIN ld USING (trial_id))"""
_TALL = f"greatest({', '.join(norm(sub(J('head'), J(f'{s}_{j}'))) for j in ('foot', 'ankle') for s in ('left', 'right'))})"
_ACROSS = "((head_z - hip_z) * dx - (head_x - hip_x) * dz)"
_UP = ("0.0", "1.0", "0.0")


@query(f"""WITH {PITCH_PHASE}, {STRIDE}, g AS (SELECT trial_id, any_value(lead) AS lead_side, max(abs({turn(yaw("left_hip", "right_hip"), yaw("left_shoulder", "right_shoulder"))})) FILTER (frame_index = ev) AS sep,
  max({side("lead", lambda s: joint(f"{s}_hip", f"{s}_knee", f"{s}_ankle"))}) FILTER (frame_index = lf) AS knee, max({angle(sub(J("neck"), J("hip")), _UP)}) FILTER (frame_index = ev) AS tilt,
  max({_ACROSS}) FILTER (frame_index BETWEEN ps AND ev) - min({_ACROSS}) FILTER (frame_index BETWEEN ps AND ev) AS drift, max(stride) AS stride, median({_TALL}) AS tall, max({GAP}) FILTER (frame_index = lf) AS step,
  max((hip_x - ex) * dx + (hip_z - ez) * dz) FILTER (frame_index = ev) AS shift FROM st GROUP BY trial_id)
SELECT trial_id, lead_side, round(sep, 6) AS hip_shoulder_sep, round(knee, 6) AS lead_knee_angle, round(tilt, 6) AS trunk_tilt, round(greatest(0, least(100, 100 * (1 - drift / stride))), 6) AS head_stability,
  round(greatest(0, least(100, shift / stride * 100)), 6) AS weight_transfer, round(step / tall, 6) AS stride_length_ratio FROM g""")
def shared_metrics(spark, sf_dir):
    return rounded(B.shared_metrics(B.pitching_phase(A.skeleton(spark, sf_dir), T), T), ["trial_id", "lead_side"])


def _acute(a: str) -> str:
    return f"least({a}, 180 - {a})"


_SNAP = side("side", lambda s: joint(f"{s}_elbow", f"{s}_wrist", f"{s}_hand"))


@query(f"""WITH {PITCH_PHASE}, {STRIDE}, sn AS (SELECT *, {_SNAP} AS snap FROM st),
k AS (SELECT *, abs(coalesce(lead(snap, 2) OVER w, last_value(snap) OVER f) - coalesce(lag(snap, 2) OVER w, first_value(snap) OVER f)) AS snapped, {", ".join(f"{step(J(f'{s}_wrist'), 30.0)} AS {s}_wv" for s in ("left", "right"))}
  FROM sn WINDOW {W}, f AS (PARTITION BY trial_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT trial_id, round(max({side("side", lambda s: joint(f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist"))}) FILTER (frame_index = ev), 6) AS elbow_bend,
  round(max({side("side", lambda s: angle(sub(J(f"{s}_elbow"), J(f"{s}_shoulder")), sub(J("neck"), J("hip"))))}) FILTER (frame_index = ev), 6) AS arm_abduction,
  round(max({_acute(angle(_D, sub(ground("right_hip"), ground("left_hip"))))}) FILTER (frame_index = lf), 6) AS stride_angle,
  round(max({side("lead", lambda s: _acute(angle(sub(ground(f"{s}_foot"), ground(f"{s}_ankle")), ("dx", "dz"))))}) FILTER (frame_index = lf), 5) AS foot_direction,
  round(max(snapped) FILTER (frame_index = ev), 6) AS wrist_snap, round(max({side("side", lambda s: f"{s}_wv")}) FILTER (frame_index = ev), 6) AS arm_speed, round(max(v) FILTER (frame_index = ev), 6) AS fingertip_speed FROM k GROUP BY trial_id""")
def pitching_metrics(spark, sf_dir):
    out = rounded(B.pitching_metrics(B.pitching_phase(A.skeleton(spark, sf_dir), T), T), ["trial_id", "foot_direction"])
    return out.withColumn("foot_direction", F.round("foot_direction", 5))


@query(f"""WITH {BAT_PHASE}, v AS (SELECT *, {step(J("bat1"), 30.0)} AS bv, {step(J("left_wrist"), 30.0)} AS lv, {step(J("right_wrist"), 30.0)} AS rv, {yaw("left_hip", "right_hip")} AS yw FROM marked WINDOW {W}),
g AS (SELECT trial_id, max(bv) FILTER (frame_index = ev) AS bs, max(abs({turn("0", yaw("bat5", "bat1").replace("_z", "_y"))})) FILTER (frame_index = ev) AS aa, max(greatest(lv, rv)) FILTER (frame_index = ev) AS ws FROM v GROUP BY trial_id),
inp AS (SELECT * FROM v WHERE frame_index BETWEEN ps AND ev), t AS (SELECT *, coalesce({turn("lag(yw) OVER w", "yw")}, 0) AS tn FROM inp WINDOW {W}), u AS (SELECT trial_id, first_value(yw) OVER w + sum(tn) OVER w AS un FROM t WINDOW {W}),
rot AS (SELECT trial_id, max(un) - min(un) AS hr FROM u GROUP BY trial_id)
SELECT trial_id, round(bs, 6) AS bat_speed, round(least(aa, 180 - aa), 6) AS attack_angle, round(ws, 6) AS wrist_speed, round(hr, 4) AS hip_rotation FROM g LEFT JOIN rot USING (trial_id)""")
def batting_metrics(spark, sf_dir):
    out = rounded(B.batting_metrics(B.batting_phase(A.skeleton(spark, sf_dir), T), T), ["trial_id", "hip_rotation"])
    return out.withColumn("hip_rotation", F.round("hip_rotation", 4))


_AHEAD = "(left_ankle_x * ax + left_ankle_z * az >= right_ankle_x * ax + right_ankle_z * az)"
RELEASE = f"""{SK}, mv AS (SELECT *, last_value(hip_x) OVER f - first_value(hip_x) OVER f AS mx, last_value(hip_z) OVER f - first_value(hip_z) OVER f AS mz FROM frames WINDOW f AS (PARTITION BY trial_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
axd AS (SELECT *, CASE WHEN sqrt(mx * mx + mz * mz) >= 1e-6 THEN mx / sqrt(mx * mx + mz * mz) ELSE 1 END AS ax, CASE WHEN sqrt(mx * mx + mz * mz) >= 1e-6 THEN mz / sqrt(mx * mx + mz * mz) ELSE 0 END AS az FROM mv),
gs AS (SELECT *, {_gradient_speed_sql(J("right_wrist"))} AS wv, {_gradient_speed_sql(J("right_hand"))} AS hv, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trial_id) AS n FROM axd WINDOW {W}),
rl AS (SELECT trial_id, arg_min(frame_index, (-wv, frame_index)) AS br, max({GAP}) AS widest FROM gs GROUP BY trial_id),
sf AS (SELECT trial_id, min(frame_index) AS fc FROM gs JOIN rl USING (trial_id) WHERE {GAP} >= 0.9 * widest GROUP BY trial_id),
le AS (SELECT trial_id, CASE WHEN bool_or({_AHEAD}) FILTER (frame_index = fc) THEN 'left' ELSE 'right' END AS lead FROM gs JOIN sf USING (trial_id) GROUP BY trial_id),
pit AS (SELECT gs.*, br, fc, lead FROM gs JOIN rl USING (trial_id) JOIN sf USING (trial_id) JOIN le USING (trial_id))"""
_SHO, _HIP = mid("left_shoulder", "right_shoulder"), mid("left_hip", "right_hip")


def _leg(s: str) -> Sql:
    return sub(J(f"{s}_hip"), J(f"{s}_ankle"))


def _toe(s: str) -> Sql:
    return sub(ground(f"{s}_foot"), ground(f"{s}_ankle"))


_YS = ", ".join(f"{j}_y" for j in A.SKELETON)


@query(f"""WITH {RELEASE}, g AS (SELECT trial_id, max({joint("right_shoulder", "right_elbow", "right_wrist")}) FILTER (frame_index = br) AS elbow_bend_deg, max({angle(sub(J("right_elbow"), J("right_shoulder")), sub(_SHO, _HIP))}) FILTER (frame_index = br) AS arm_abduction_deg,
  max({angle(sub(_SHO, _HIP), _UP)}) FILTER (frame_index = br) AS trunk_lean_deg, max({side("lead", lambda s: f"degrees(atan2(abs({_leg(s)[1]}), greatest({norm((_leg(s)[0], _leg(s)[2]))}, 1e-9)))")}) FILTER (frame_index = fc) AS stride_angle_deg,
  max({side("lead", lambda s: joint(f"{s}_hip", f"{s}_knee", f"{s}_ankle"))}) FILTER (frame_index = br) AS lead_knee_deg, max({turn(yaw("left_hip", "right_hip"), yaw("left_shoulder", "right_shoulder"))}) FILTER (frame_index = br) AS hip_shoulder_sep_deg,
  quantile_cont(wv, 0.95) AS arm_speed_mps, max({side("lead", lambda s: f"degrees(atan2(ax * {_toe(s)[1]} - az * {_toe(s)[0]}, {dot(('ax', 'az'), _toe(s))}))")}) FILTER (frame_index = fc) AS foot_direction_deg,
  max({joint("right_elbow", "right_wrist", "right_hand")}) FILTER (frame_index = br) AS wrist_snap_deg, quantile_cont(hv, 0.95) AS fingertip_speed_mps, quantile_cont({GAP}, 0.9) * 100 AS stride, quantile_cont(greatest({_YS}) - least({_YS}), 0.9) * 100 AS height,
  (max(hip_x * ax + hip_z * az) - min(hip_x * ax + hip_z * az)) * 100 AS shift, (max(head_z * ax - head_x * az) - min(head_z * ax - head_x * az)) * 100 AS sway FROM pit GROUP BY trial_id)
SELECT trial_id, {", ".join(f"round({c}, 4) AS {c}" for c in ("elbow_bend_deg", "arm_abduction_deg", "trunk_lean_deg", "stride_angle_deg", "lead_knee_deg", "hip_shoulder_sep_deg", "arm_speed_mps", "foot_direction_deg", "wrist_snap_deg", "fingertip_speed_mps"))},
  round(stride / greatest(height, 1e-6) * 100, 4) AS stride_length_pct_height, round(shift / greatest(stride, 1e-6) * 100, 4) AS weight_transfer_pct, round(greatest(0, least(100, 100 * (1 - sway / greatest(stride * 0.35, 1e-6)))), 4) AS head_stability_pct FROM g""")
def pitch_bundle(spark, sf_dir):
    return rounded(B.pitch_bundle(A.skeleton(spark, sf_dir), T, A.SKELETON), ["trial_id"], 4)


@query(f"""WITH {RELEASE}, pl AS (SELECT trial_id, max(i) FILTER (frame_index = fc) AS fi, max(i) FILTER (frame_index = br) AS bi FROM pit GROUP BY trial_id),
g AS (SELECT trial_id, any_value(fc) AS fc, any_value(br) AS br, min(frame_index) AS a, max(frame_index) AS b,
  arg_min(frame_index, (-((right_shoulder_x - right_wrist_x) * ax + (right_shoulder_z - right_wrist_z) * az), frame_index)) FILTER (i >= fi AND i < greatest(bi, fi + 1)) AS mer,
  max(frame_index) FILTER (i = least(bi + greatest(n // 8, 3), n - 1)) AS ft FROM pit JOIN pl USING (trial_id) GROUP BY trial_id),
e AS (SELECT trial_id, a, b, unnest([{{'event': 'FC', 'frame': fc}}, {{'event': 'MER', 'frame': mer}}, {{'event': 'BR', 'frame': br}}, {{'event': 'FT', 'frame': ft}}]) AS e FROM g)
SELECT trial_id, e.event AS event, e.frame AS frame, round((e.frame - a) / greatest(b - a, 1), 6) AS phase FROM e""")
def phase_events(spark, sf_dir):
    return B.phase_events(A.skeleton(spark, sf_dir), T).withColumn("phase", F.round("phase", 6))


_CORE = B.CORE
_XS, _CYS = ", ".join(f"{j}_x" for j in _CORE), ", ".join(f"{j}_y" for j in _CORE)


def _ratio_sql(s: str) -> str:
    a, b = (norm(sub(J(f"{s}_{p}")[:2], J(f"{s}_{q}")[:2])) for p, q in (("hip", "knee"), ("knee", "ankle")))
    return f"coalesce(CASE WHEN least({a}, {b}) > 1e-6 THEN greatest({a}, {b}) / least({a}, {b}) END, 1)"


@query(f"""WITH {SK}, n AS (SELECT trial_id, frame_index, abs(head_z) / 400 AS crop, abs(neck_z) / 400 AS whole, {", ".join(f"{j}_{a} / 1000 + 0.5 AS {j}_{a}" for j in _CORE for a in "xy")} FROM frames),
p AS (SELECT *, greatest({_XS}) - least({_XS}) AS w, greatest({_CYS}) - least({_CYS}) AS h, (greatest({_CYS}) + least({_CYS})) / 2 AS cy, {_ratio_sql("left")} AS lr, {_ratio_sql("right")} AS rr FROM n),
f AS (SELECT *, CASE WHEN w < 0.055 OR h < 0.12 OR h / greatest(w, 1e-6) > 6.5 OR h / greatest(w, 1e-6) < 0.65 OR lr > 3.5 OR rr > 3.5 THEN NULL ELSE (1 + 8 * least(h * w, 0.18)) * (1 + greatest(0, cy - 0.35) * 1.2) END AS k FROM p),
sc AS (SELECT *, coalesce(crop * k, -1) AS roi_score, coalesce(whole * k, -1) AS full_score FROM f)
SELECT trial_id, frame_index, round(roi_score, 6) AS roi_score, round(full_score, 6) AS full_score, CASE WHEN full_score > roi_score * 1.08 THEN 'full_frame' ELSE 'roi' END AS chosen FROM sc""")
def pose_candidates(spark, sf_dir):
    df = A.skeleton(spark, sf_dir).withColumns({"crop": F.abs("head.z") / 400, "whole": F.abs("neck.z") / 400})
    df = df.withColumns({j: F.struct((F.col(f"{j}.x") / 1000 + 0.5).alias("x"), (F.col(f"{j}.y") / 1000 + 0.5).alias("y"), F.col(f"{j}.z").alias("z")) for j in _CORE})
    df = df.withColumns({"roi_score": B.pose_score(df, F.col("crop")), "full_score": B.pose_score(df, F.col("whole"))})
    return df.select("trial_id", "frame_index", F.round("roi_score", 6).alias("roi_score"), F.round("full_score", 6).alias("full_score"), B.chosen_pose(F.col("roi_score"), F.col("full_score")).alias("chosen"))


@query(f"""WITH {KEY}, s AS (SELECT frames.*, key_frame, min(frame_index) OVER (PARTITION BY trial_id) AS f0 FROM frames JOIN keyed USING (trial_id)),
g AS (SELECT trial_id, max(abs(head_z - (left_foot_z + right_foot_z) / 2)) FILTER (frame_index = key_frame) AS height_mm, max({norm(sub(J("left_ankle")[:2], J("right_ankle")[:2]))}) FILTER (frame_index = f0) AS st, max({norm(sub(J("left_ankle")[:2], J("right_ankle")[:2]))}) FILTER (frame_index = key_frame) AS sr,
  {", ".join(f"max(hip_{a}) FILTER (frame_index = key_frame) - max(hip_{a}) FILTER (frame_index = f0) AS m{a}" for a in "xy")} FROM s GROUP BY trial_id)
SELECT trial_id, round(height_mm, 6) AS height_mm, round(sqrt(mx * mx + my * my) / st * 100, 6) AS weight_transfer_pct, round(sr / height_mm, 6) AS stride_length_ratio FROM g""")
def event_changes(spark, sf_dir):
    frames = A.skeleton(spark, sf_dir)
    keyed = B.key_action_frame(frames, T, RATE, batting=_bats()).select("trial_id", "key_frame")
    first = frames.groupBy("trial_id").agg(F.min("frame_index").alias("first_frame"))
    return rounded(B.event_changes(frames.join(keyed, T).join(first, T), T, "first_frame", "key_frame"), ["trial_id"])


@query(f"""WITH {A.MARKERS} SELECT trial_id, marker, frame_index, {", ".join(f"round(quantile_cont({a}, 0.5) OVER w, 6) AS m_{a}" for a in "xyz")} FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def local_median(spark, sf_dir):
    out = B.local_median(A.markers(spark, sf_dir), ["trial_id", "marker"], 2)
    return out.select("trial_id", "marker", "frame_index", *[F.round(f"m_{a}", 6).alias(f"m_{a}") for a in "xyz"])


@query(f"""WITH {SK}, m AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trial_id) AS n FROM frames WINDOW {W})
SELECT trial_id, round(max(abs(left_shoulder_y - right_shoulder_y)) FILTER (i = n // 2), 6) AS shoulder_gap, round(max(abs(left_hip_y - right_hip_y)) FILTER (i = n // 2), 6) AS hip_gap, round(max({GAP}) - min({GAP}), 6) AS ankle_range FROM m GROUP BY trial_id""")
def side_balance(spark, sf_dir):
    return rounded(B.side_balance(A.skeleton(spark, sf_dir), T), ["trial_id"])


@query(f"""WITH {A.TRAJ} SELECT clip_id, count(DISTINCT frame_index) AS frames, count(DISTINCT joint_name) AS joints, round(max(timestamp_sec) - min(timestamp_sec), 6) AS duration_sec, round(avg(confidence), 6) AS mean_quality,
  round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM traj GROUP BY clip_id""")
def sequence_summary(spark, sf_dir):
    points = A.traj(spark, sf_dir).withColumnRenamed("confidence", "quality")
    return rounded(B.sequence_summary(points, ["clip_id"]), ["clip_id", "frames", "joints"])
