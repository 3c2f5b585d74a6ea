"""Registered queries of whole drivers: several operators joined up, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import confidence as C
from .. import schemas
from ..operators import body, comparisons, completion, events, grids, poses, reports, settings, smoothing
from ..session import scratch_path
from ..sources import tables
from . import adapters as A
from .catalog_queries import RESCUE, SWING
from . import bundle_queries as BQ
from .queries import GAPPY, K, ORACLES, QUERIES, SCORE, TRUST, query, r6

# ---- a stick's whole track: two passes, the swing, the weights

TRACKS = smoothing.StickRule(
    window=5, least_rows=3, passes=2, contact_margin=1, contact_weight=0.9, fast=60.0, fast_margin=2, fast_weight=0.6, swing_margin=2, step=35.0, lengths=(0.45, 1.35)
)
_ENDS = ("x", "y", "x2", "y2")


def stick_tracks(spark, sf_dir):
    """Sticks between two markers, balls where a third is high; sticks with a low third one are missing, and every 37th has an open end."""
    f = A.marker_frames(spark, sf_dir, [0, 1, 2])
    ends = {"x": "m0.x", "y": "m0.y", "x2": "m1.x", "y2": "m1.y"}
    closed = F.col("frame_index") % 37 != 36
    sticks = f.filter("m2.z > -60").select(
        "trial_id", "frame_index", F.lit("bat").alias("object_name"), *[(F.when(closed, F.col(v)) if k.endswith("2") else F.col(v)).alias(k) for k, v in ends.items()], (F.abs("m2.x") / 500).alias("confidence")
    )
    none = F.lit(None).cast("double")
    balls = f.filter("m2.y > 250").select("trial_id", "frame_index", F.lit("ball").alias("object_name"), F.col("m2.x").alias("x"), F.col("m2.y").alias("y"), none.alias("x2"), none.alias("y2"), F.lit(0.8).alias("confidence"))
    return sticks.unionByName(balls)


def _lag(c: str, k: int) -> str:
    return c if k == 0 else f"lag({c}, {-k}) OVER r" if k < 0 else f"lead({c}, {k}) OVER r"


def _pass_sql(source: str, name: str) -> str:
    """CTEs that end in `name`: one smoothing pass over `source` with a window of five rows."""
    steps, weighed = range(-2, 3), "trust"
    trust = "greatest(0.05, coalesce(confidence, 0.5))"
    u = {k: f"coalesce({_lag('trust', k)} / {1 + abs(k)}, 0)" for k in steps}
    sums = [f"{' + '.join(f'(CASE WHEN {_lag(weighed, k)} IS NOT NULL THEN 1 ELSE 0 END)' for k in steps)} AS cnt", f"{' + '.join(u.values())} AS m"]
    sums += [f"{' + '.join(f'{u[k]} ** 2 * ({k**j})' for k in steps)} AS s{j}" for j in range(5)]
    for v in ("cx", "cy", "ang", "len"):
        sums.append(f"{' + '.join(f'{u[k]} * coalesce({_lag(v, k)}, 0)' for k in steps)} AS m_{v}")
        sums += [f"{' + '.join(f'{u[k]} ** 2 * ({k**j}) * coalesce({_lag(v, k)}, 0)' for k in steps)} AS t{j}_{v}" for j in range(3)]
    for c in _ENDS:
        share = {k: f"CASE WHEN {_lag(c, k)} IS NOT NULL THEN {_lag('trust', k)} / {1 + abs(k)} ELSE 0 END" for k in steps}
        sums.append(f"({' + '.join(f'coalesce({_lag(c, k)}, 0) * ({share[k]})' for k in steps)}) / nullif({' + '.join(f'({share[k]})' for k in steps)}, 0) AS p_{c}")
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    fit = lambda v: (
        f"CASE WHEN cnt >= 5 THEN (t0_{v} * (s2 * s4 - s3 * s3) - t1_{v} * (s1 * s4 - s2 * s3) + t2_{v} * (s1 * s3 - s2 * s2)) / {det} "
        f"WHEN cnt >= 3 THEN (s2 * t0_{v} - s1 * t1_{v}) / (s0 * s2 - s1 * s1) ELSE m_{v} / m END"
    )
    end = {"x": "f_cx + cos(f_ang) * f_len / 2", "y": "f_cy + sin(f_ang) * f_len / 2", "x2": "f_cx - cos(f_ang) * f_len / 2", "y2": "f_cy - sin(f_ang) * f_len / 2"}
    n = name
    return f"""{n}_a AS (SELECT *, sum(st) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM (SELECT *, coalesce((frame_index - lag(frame_index) OVER w > 1)::INT, 1) AS st FROM {source} WINDOW w AS (PARTITION BY trial_id ORDER BY frame_index))),
{n}_b AS (SELECT * EXCLUDE (st), {trust} AS trust, count(*) OVER q AS n_rows, bool_or(x2 IS NULL OR y2 IS NULL) OVER q AS open, atan2(y - y2, x - x2) AS raw, atan2(y - y2, x - x2) - lag(atan2(y - y2, x - x2)) OVER r AS turn
  FROM {n}_a WINDOW q AS (PARTITION BY trial_id, run), r AS (PARTITION BY trial_id, run ORDER BY frame_index)),
{n}_c AS (SELECT *, (x + x2) / 2 AS cx, (y + y2) / 2 AS cy, sqrt((x - x2) ** 2 + (y - y2) ** 2) AS len,
  sum(CASE WHEN turn > pi() THEN turn - 2 * pi() WHEN turn < -pi() THEN turn + 2 * pi() ELSE coalesce(turn, raw) END) OVER (PARTITION BY trial_id, run ORDER BY frame_index) AS ang FROM {n}_b),
{n}_d AS (SELECT *, {", ".join(sums)} FROM {n}_c WINDOW r AS (PARTITION BY trial_id, run ORDER BY frame_index)),
{n}_e AS (SELECT *, {", ".join(f"{fit(v)} AS f_{v}" for v in ("cx", "cy", "ang", "len"))} FROM {n}_d),
{n} AS (SELECT trial_id, frame_index, confidence, {", ".join(f"CASE WHEN n_rows < 3 THEN {c} WHEN open THEN p_{c} ELSE {end[c]} END AS {c}" for c in _ENDS)} FROM {n}_e)"""


_OPEN_STICKS = SWING.replace("m1x AS x2, m1y AS y2", "CASE WHEN frame_index % 37 <> 36 THEN m1x END AS x2, CASE WHEN frame_index % 37 <> 36 THEN m1y END AS y2").replace("m2y > 330", "m2y > 250")
STICK_TRACKS = f"""WITH RECURSIVE {_OPEN_STICKS}, {_pass_sql("sticks", "one")}, {_pass_sql("one", "two")},
sw AS (SELECT t.*, o.x AS ox, o.y AS oy, o.x2 AS ox2, o.y2 AS oy2, sqrt((o.x - o.x2) ** 2 + (o.y - o.y2) ** 2) AS olen, atan2(o.y - o.y2, o.x - o.x2) AS oang,
  count(*) OVER (PARTITION BY t.trial_id) AS n_swing, coalesce((t.frame_index - lag(t.frame_index) OVER w > 1)::INT, 1) AS st FROM two t JOIN swing USING (trial_id, frame_index) JOIN sticks o USING (trial_id, frame_index) WINDOW w AS (PARTITION BY t.trial_id ORDER BY t.frame_index)),
sr AS (SELECT *, sum(st) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM sw WHERE n_swing >= 3),
su AS (SELECT *, bool_and(ox2 IS NOT NULL AND oy2 IS NOT NULL) OVER q AS whole, median(olen) OVER q AS usual, oang - lag(oang) OVER r AS turn, row_number() OVER r AS i FROM sr WINDOW q AS (PARTITION BY trial_id, run), r AS (PARTITION BY trial_id, run ORDER BY frame_index)),
sv AS (SELECT *, sum(CASE WHEN turn > pi() THEN turn - 2 * pi() WHEN turn < -pi() THEN turn + 2 * pi() ELSE coalesce(turn, oang) END) OVER (PARTITION BY trial_id, run ORDER BY frame_index) AS angle,
  greatest(usual * 0.45, least(usual * 1.35, sqrt((x - x2) ** 2 + (y - y2) ** 2))) AS len FROM su WHERE whole),
fold(trial_id, run, i, frame_index, a) AS (SELECT trial_id, run, i, frame_index, angle FROM sv WHERE i = 1
  UNION ALL SELECT s.trial_id, s.run, s.i, s.frame_index, greatest(f.a - 1.0::DOUBLE, least(f.a + 1.0::DOUBLE, s.angle)) FROM fold f JOIN sv s ON s.trial_id = f.trial_id AND s.run = f.run AND s.i = f.i + 1),
tuned AS (SELECT s.trial_id, s.frame_index, (x + x2) / 2 + cos(a) * len / 2 AS x, (y + y2) / 2 + sin(a) * len / 2 AS y, (x + x2) / 2 - cos(a) * len / 2 AS x2, (y + y2) / 2 - sin(a) * len / 2 AS y2 FROM sv s JOIN fold f ON f.trial_id = s.trial_id AND f.frame_index = s.frame_index),
near AS (SELECT trial_id, frame_index + unnest(range(-1, 2)) AS frame_index, 0.9 * (1 - abs(unnest(range(-1, 2))) / 2) AS weight FROM balls
  UNION ALL SELECT trial_id, frame_index + unnest(range(-2, 3)), 0.6 * (1 - abs(unnest(range(-2, 3))) / 3) FROM fs WHERE trial_id NOT IN (SELECT trial_id FROM swing)),
wt AS (SELECT trial_id, frame_index, max(weight) AS w FROM near GROUP BY ALL),
mixed AS (SELECT p.trial_id, p.frame_index, least(coalesce(w, 0), 1) AS w, {", ".join(f"coalesce(t.{c}, p.{c}) AS {c}, o.{c} AS o_{c}" for c in _ENDS)} FROM two p JOIN sticks o USING (trial_id, frame_index) LEFT JOIN tuned t USING (trial_id, frame_index) LEFT JOIN wt USING (trial_id, frame_index))
SELECT trial_id, frame_index, 'bat' AS object_name, {", ".join(f"round(CASE WHEN w > 0 THEN coalesce({c} * (1 - w) + o_{c} * w, {c}, o_{c}) ELSE {c} END, 6) AS {c}" for c in _ENDS)} FROM mixed
UNION ALL SELECT trial_id, frame_index, 'ball', round(m2x, 6), round(m2y, 6), NULL, NULL FROM frames WHERE m2y > 250"""


@query(STICK_TRACKS)
def smoothed_stick_tracks(spark, sf_dir):
    out = smoothing.smooth_stick_tracks(stick_tracks(spark, sf_dir), ["trial_id"], TRACKS)
    return out.select("trial_id", "frame_index", "object_name", *[r6(c).alias(c) for c in _ENDS])


# ---- completion: bones, rescue, fills with limits by the end of a joint's name

COMPLETION = completion.CompletionRule(threshold=0.4, max_gap=4, gaps={"distal": 6, "mid_limb": 3}, least=0.05, least_alone=0.15, limb_tolerance=0.5, time_tolerance=0.2)
_D = "sqrt((p.x - d.x) ** 2 + (p.y - d.y) ** 2)"
_ALONG = "(ub ** 2 - lb ** 2 + dd ** 2) / (2 * CASE WHEN dd > 1e-9 THEN dd END)"
COMPLETED = f"""WITH {RESCUE},
r AS (SELECT clip_id, condition_id, frame_index, joint_name, CASE WHEN saved THEN greatest(0, least(1, x)) ELSE x END AS x, CASE WHEN saved THEN greatest(0, least(1, y)) ELSE y END AS y, CASE WHEN saved THEN 0.62 ELSE visibility END AS visibility,
  CASE WHEN saved THEN 0.62 ELSE confidence END AS confidence, CASE WHEN saved THEN backend || '+rescued' ELSE backend END AS backend, ok OR saved AS good FROM sv),
n AS (SELECT *, lead(frame_index) OVER w AS nxt, max(frame_index) FILTER (good) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fa, min(frame_index) FILTER (good) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fb FROM r WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
tg AS (SELECT n.clip_id, n.frame_index, n.joint_name, a.x + (b.x - a.x) * ((n.frame_index - fa) / (fb - fa)) AS tx, a.y + (b.y - a.y) * ((n.frame_index - fa) / (fb - fa)) AS ty
  FROM n JOIN (SELECT clip_id, joint_name, frame_index, x, y, nxt FROM n) a ON a.clip_id = n.clip_id AND a.joint_name = n.joint_name AND a.frame_index = fa JOIN r b ON b.clip_id = n.clip_id AND b.joint_name = n.joint_name AND b.frame_index = fb
  WHERE NOT n.good AND a.nxt = fa + 1 AND fb - fa - 1 <= CASE n.joint_name WHEN 'right_wrist' THEN 6 WHEN 'right_elbow' THEN 3 ELSE -1 END),
dirs AS (SELECT p.clip_id, p.frame_index, d.x - p.x AS dx, d.y - p.y AS dy FROM r p JOIN r d ON d.clip_id = p.clip_id AND d.frame_index = p.frame_index AND p.joint_name = 'right_elbow' AND d.joint_name = 'right_wrist' WHERE p.good AND d.good),
ends AS (SELECT t.clip_id, t.frame_index, any_value(p.x) AS px, any_value(p.y) AS py, any_value(bone) AS bone, any_value(tx) - any_value(p.x) AS vx, any_value(ty) - any_value(p.y) AS vy, arg_min(dx, (abs(q.frame_index - t.frame_index), q.frame_index)) AS dx, arg_min(dy, (abs(q.frame_index - t.frame_index), q.frame_index)) AS dy
  FROM tg t JOIN r p ON p.clip_id = t.clip_id AND p.frame_index = t.frame_index AND p.joint_name = 'right_elbow' AND p.good JOIN bone b ON b.clip_id = t.clip_id AND b.distal = 'right_wrist' AND bone > 0
  LEFT JOIN dirs q ON q.clip_id = t.clip_id AND q.frame_index <> t.frame_index AND abs(q.frame_index - t.frame_index) <= 5 WHERE t.joint_name = 'right_wrist' GROUP BY ALL),
vec AS (SELECT clip_id, frame_index, px, py, bone, CASE WHEN sqrt(vx ** 2 + vy ** 2) <= 1e-6 THEN coalesce(dx, 1) ELSE vx END AS vx, CASE WHEN sqrt(vx ** 2 + vy ** 2) <= 1e-6 THEN coalesce(dy, 0) ELSE vy END AS vy FROM ends),
mids AS (SELECT t.clip_id, t.frame_index, tx, ty, p.x AS px, p.y AS py, d.x AS ex, d.y AS ey, u.bone AS ub, l.bone AS lb, {_D} AS dd FROM tg t JOIN r p ON p.clip_id = t.clip_id AND p.frame_index = t.frame_index AND p.joint_name = 'right_shoulder' AND p.good
  JOIN r d ON d.clip_id = t.clip_id AND d.frame_index = t.frame_index AND d.joint_name = 'right_wrist' AND d.good JOIN bone u ON u.clip_id = t.clip_id AND u.distal = 'right_elbow' AND u.bone > 0 JOIN bone l ON l.clip_id = t.clip_id AND l.distal = 'right_wrist' AND l.bone > 0 WHERE t.joint_name = 'right_elbow'),
m2 AS (SELECT *, {_ALONG} AS al, CASE WHEN dd <= ub + lb AND dd >= abs(ub - lb) AND ub ** 2 >= ({_ALONG}) ** 2 THEN sqrt(greatest(ub ** 2 - ({_ALONG}) ** 2, 0)) END AS hi FROM mids),
m3 AS (SELECT *, px + (ex - px) / dd * al - (ey - py) / dd * hi AS ax, py + (ey - py) / dd * al + (ex - px) / dd * hi AS ay, px + (ex - px) / dd * al + (ey - py) / dd * hi AS bx, py + (ey - py) / dd * al - (ex - px) / dd * hi AS bw FROM m2),
fl AS (SELECT clip_id, frame_index, 'right_wrist' AS joint_name, CASE WHEN sqrt(vx ** 2 + vy ** 2) <= 1e-9 THEN px ELSE px + vx * bone / sqrt(vx ** 2 + vy ** 2) END AS x, CASE WHEN sqrt(vx ** 2 + vy ** 2) <= 1e-9 THEN py ELSE py + vy * bone / sqrt(vx ** 2 + vy ** 2) END AS y FROM vec
  UNION ALL SELECT clip_id, frame_index, 'right_elbow', CASE WHEN hi IS NULL THEN (px + ex) / 2 WHEN (ax - tx) ** 2 + (ay - ty) ** 2 <= (bx - tx) ** 2 + (bw - ty) ** 2 THEN ax ELSE bx END, CASE WHEN hi IS NULL THEN (py + ey) / 2 WHEN (ax - tx) ** 2 + (ay - ty) ** 2 <= (bx - tx) ** 2 + (bw - ty) ** 2 THEN ay ELSE bw END FROM m3)
SELECT r.clip_id, r.frame_index, r.joint_name, round(CASE WHEN f.clip_id IS NOT NULL THEN greatest(0, least(1, f.x)) ELSE r.x END, 6) AS x, round(CASE WHEN f.clip_id IS NOT NULL THEN greatest(0, least(1, f.y)) ELSE r.y END, 6) AS y,
  CASE WHEN f.clip_id IS NOT NULL THEN 0.62 ELSE r.confidence END AS confidence, CASE WHEN f.clip_id IS NOT NULL THEN r.backend || '+imputed' ELSE r.backend END AS backend FROM r LEFT JOIN fl f USING (clip_id, frame_index, joint_name)"""


@query(COMPLETED)
def completed_pose(spark, sf_dir):
    out = completion.complete_pose(A.traj_frame(spark, sf_dir), K, COMPLETION)
    return out.select("clip_id", "frame_index", "joint_name", r6("x").alias("x"), r6("y").alias("y"), "confidence", "backend")


# ---- grids without holes, unions of frames, samples, bounds

_JOINTS = list(A.JOINTS.values())


def _mended(source: str, key: str, columns: list[str], order: str = "frame_index") -> str:
    """CTEs that end in `grid`: columns of `source` on the line between their neighbours, ends held."""
    back, on = f"(PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)", f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    ends = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER {back} AS b_{c}, max(CASE WHEN {c} IS NOT NULL THEN pos END) OVER {back} AS p_{c}, first_value({c} IGNORE NULLS) OVER {on} AS a_{c}, min(CASE WHEN {c} IS NOT NULL THEN pos END) OVER {on} AS q_{c}" for c in columns
    )
    value = ", ".join(f"round(coalesce({c}, b_{c} + (a_{c} - b_{c}) * ((pos - p_{c}) / (q_{c} - p_{c})), b_{c}, a_{c}), 9) AS {c}" for c in columns)
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos FROM {source}), ended AS (SELECT *, {ends} FROM placed),
grid AS (SELECT {key}, {order}, {value} FROM ended)"""


_WIDE = [f"{j}_{a}" for j in _JOINTS for a in "xy"]


@query(f"""WITH {A.TRAJ_FRAME}, wide AS (SELECT clip_id, frame_index, {", ".join(f"avg({a}) FILTER (joint_name = '{j}') AS {j}_{a}" for j in _JOINTS for a in "xy")} FROM traj_frame WHERE {SCORE} >= {TRUST} GROUP BY ALL), {_mended("wide", "clip_id", _WIDE)} SELECT * FROM grid""")
def pivoted_grid(spark, sf_dir):
    out = grids.pivoted(A.traj_frame(spark, sf_dir).filter(C.trusted(C.pose_score(), TRUST)), ["clip_id"], _JOINTS, ["x", "y"])
    return out.select("clip_id", "frame_index", *[F.round(c, 9).alias(c) for c in _WIDE])


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT DISTINCT clip_id, frame_index FROM traj_frame), t AS (SELECT clip_id, frame_index, avg(timestamp_sec) AS timestamp_sec FROM traj_frame WHERE {SCORE} >= 0.6 GROUP BY ALL), wide AS (SELECT * FROM f LEFT JOIN t USING (clip_id, frame_index)),
{_mended("wide", "clip_id", ["timestamp_sec"])} SELECT * FROM grid""")
def mended_time_axis(spark, sf_dir):
    t = A.traj_frame(spark, sf_dir)
    return grids.time_axis(t.filter(C.pose_score() >= 0.6), ["clip_id"], frames=t).withColumn("timestamp_sec", F.round("timestamp_sec", 9))


@query(f"""WITH {A.TRAJ}, f AS (SELECT *, frame_index // 4 AS f FROM traj) SELECT clip_id, f AS frame_index, round(arg_min(timestamp_sec, frame_index), 6) AS timestamp_sec FROM f GROUP BY ALL""")
def first_frame_times(spark, sf_dir):
    t = A.traj(spark, sf_dir).withColumns({"row": F.col("frame_index"), "frame_index": F.floor(F.col("frame_index") / 4)})
    return grids.frame_times(t, ["clip_id"], ["row"]).withColumn("timestamp_sec", r6("timestamp_sec"))


_PARTS = {"right_wrist": 1.0, "left_hip": 0.4, "right_hip": 0.25}


@query(f"""WITH {GAPPY}, u AS (SELECT clip_id, frame_index, {", ".join(f"max(x) FILTER (joint_name = '{j}') AS {j}" for j in _PARTS)} FROM gappy WHERE joint_name IN {tuple(_PARTS)} GROUP BY ALL)
SELECT *, round({" + ".join(f"{w} * coalesce(abs({j}) / nullif(max(abs({j})) OVER (PARTITION BY clip_id), 0), 0)" for j, w in _PARTS.items())}, 9) AS score FROM u""")
def composite_scores(spark, sf_dir):
    ok = C.trusted(C.pose_score(), TRUST)
    t = A.traj(spark, sf_dir).withColumn("x", F.when(ok, F.col("x")))
    union = grids.frame_columns(t, list(_PARTS), ["clip_id"], "x")
    return grids.combined_score(union, ["clip_id"], _PARTS).withColumn("score", F.round("score", 9))


_MEDIANS = ", ".join(f"median({a}) FILTER (x IS NOT NULL) OVER w AS m{a}" for a in "xyz")


@query(f"""WITH {A.MARKERS}, g AS (SELECT * REPLACE (CASE WHEN y <= 80 THEN x END AS x), row_number() OVER (PARTITION BY trial_id, marker ORDER BY frame_index) - 1 AS pos, count(*) OVER (PARTITION BY trial_id, marker) AS n FROM markers),
m AS (SELECT *, {_MEDIANS} FROM g WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT trial_id, marker, frame_index, {", ".join(f"round(m{a}, 6) AS {a}" for a in "xyz")} FROM m WHERE mx IS NOT NULL AND (n <= 8 OR list_contains(list_transform(range(8), lambda k: (k * (n - 1)) // 7), pos))""")
def sampled_trajectories(spark, sf_dir):
    m = A.markers(spark, sf_dir).withColumn("x", F.when(F.col("y") <= 80, F.col("x")))
    out = grids.sampled_trajectory(m, ["trial_id", "marker"], ["x", "y", "z"], most=8, radius=1)
    return out.select("trial_id", "marker", "frame_index", *[r6(a).alias(a) for a in "xyz"])


_BODY = ["hip", "left_hip", "right_hip", "left_shoulder", "right_shoulder", "neck"]
_PLANES = {"Front": ("x", "y"), "Side": ("z", "y"), "Top": ("x", "z")}
_PAIRS = [("left_shoulder", "right_shoulder"), ("left_hip", "right_hip"), ("left_shoulder", "left_hip"), ("right_shoulder", "right_hip")]
_SEEN = {j: f"CASE WHEN (frame_index + {3 * k}) % 5 <> 0 THEN {{}} END" for k, j in enumerate(_BODY)}
_POSITIVE = lambda names: f"coalesce(list_median(list_filter([{', '.join(f'{n}_y' for n in names)}], lambda v: v > 0)), 0)"


def _context_sql() -> str:
    cols = ", ".join(f"{_SEEN[j].format(f'{j}_{a}')} AS {j}_{a}" for j in _BODY for a in "xyz")
    center = ", ".join(f"coalesce(hip_{a}, (left_hip_{a} + right_hip_{a}) / 2, left_hip_{a}, right_hip_{a}, {', '.join(f'{j}_{a}' for j in _BODY)}) AS c{a}" for a in "xyz")
    length = lambda a, b: "sqrt(" + " + ".join(f"({a}_{x} - {b}_{x}) ** 2" for x in "xyz") + ")"
    scale = f"coalesce(list_median(list_filter([{', '.join(length(a, b) for a, b in _PAIRS)}], lambda v: v IS NOT NULL)), 1)"
    upper, lower = ["neck", "left_shoulder", "right_shoulder"], ["hip", "left_hip", "right_hip"]
    none = lambda names: " AND ".join(f"{n}_y IS NULL" for n in names)
    sign = f"CASE WHEN ({none(upper)}) OR ({none(lower)}) OR {_POSITIVE(upper)} >= {_POSITIVE(lower)} THEN 1 ELSE -1 END"
    points = " UNION ALL ".join(f"SELECT trial_id, stable, {', '.join(f'({j}_{a} - c{a})' + (' * sign' if a == 'y' else '') + f' / stable AS {a}' for a in 'xyz')} FROM s WHERE {j}_x IS NOT NULL" for j in _BODY)
    bound = lambda a, n: ", ".join(f"round(quantile_cont({a}, {q}) {op} greatest((quantile_cont({a}, 0.95) - quantile_cont({a}, 0.05)) * 0.15, 1e-4), 6) AS {m}_{n}" for m, q, op in (("min", 0.05, "-"), ("max", 0.95, "+")))
    planes = " UNION ALL ".join(f"SELECT trial_id, round(stable, 6) AS body_scale, '{p}' AS projection, {bound(a, 'h')}, {bound(b, 'v')} FROM pts GROUP BY trial_id, stable" for p, (a, b) in _PLANES.items())
    return f"""WITH {A.skeleton_sql()}, seen AS (SELECT trial_id, frame_index, {cols} FROM frames), c AS (SELECT *, {center}, {scale} AS scale, {sign} AS sign FROM seen WHERE coalesce({", ".join(f"{j}_x" for j in _BODY)}) IS NOT NULL),
s AS (SELECT *, coalesce(median(CASE WHEN scale > 0 THEN scale END) OVER (PARTITION BY trial_id), 1) AS stable FROM c), pts AS ({points}) {planes}"""


@query(_context_sql())
def projection_contexts(spark, sf_dir):
    f = A.skeleton(spark, sf_dir).select("trial_id", "frame_index", *[F.when((F.col("frame_index") + 3 * k) % 5 != 0, F.col(j)).alias(j) for k, j in enumerate(_BODY)])
    scale = F.coalesce(body.body_scale(_PAIRS, ("x", "y", "z")), F.lit(1.0))
    ys = lambda names: [F.col(f"{n}.y") for n in names]
    upper, lower = ys(["neck", "left_shoulder", "right_shoulder"]), ys(["hip", "left_hip", "right_hip"])
    positive = lambda cols: F.coalesce(body.column_median([F.when(c > 0, c) for c in cols]), F.lit(0.0))
    sign = F.when(F.coalesce(*upper).isNull() | F.coalesce(*lower).isNull() | (positive(upper) >= positive(lower)), 1.0).otherwise(-1.0)
    out = grids.projection_context(f, ["trial_id"], _BODY, poses.pelvis_center(_BODY, ("x", "y", "z")), scale, sign, _PLANES)
    return out.withColumns({c: r6(c) for c in ("body_scale", "min_h", "max_h", "min_v", "max_v")})


# ---- swings and the ready stance, with all their fallbacks

_TM = ["trial_id", "marker"]
#: Markers whose number leaves a rest by 7 of 0 have no speed, of 1 no points, of 2 a late first valid row, of 3 heights on few rows, of 4 a swing near the start.
MOTION = f"""{A.MARKERS}, motion AS (SELECT trial_id, marker, frame_index, CASE WHEN marker % 7 <> 0 THEN abs(x) / 8 * CASE WHEN marker % 7 = 4 AND frame_index < 3 THEN 100 ELSE 1 END END AS speed,
  CASE WHEN marker % 7 <> 1 AND (marker % 7 <> 3 OR frame_index % 4 = 0) THEN z END AS height, CASE WHEN marker % 7 = 2 THEN 1000 END AS valid_from FROM markers)"""


def _motion(spark, sf_dir):
    m, kind = A.markers(spark, sf_dir), F.col("marker") % 7
    speed = F.abs("x") / 8 * F.when((kind == 4) & (F.col("frame_index") < 3), 100).otherwise(1)
    return m.select(*_TM, "frame_index", F.when(kind != 0, speed).alias("speed"), F.when((kind != 1) & ((kind != 3) | (F.col("frame_index") % 4 == 0)), F.col("z")).alias("height"), F.when(kind == 2, 1000).alias("valid_from"))


SWINGS = f"""{MOTION}, sm AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY trial_id, marker) AS n, avg(speed) OVER (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM motion WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index)),
pk AS (SELECT trial_id, marker, max(smooth) AS peak, arg_min(pos, (-smooth, pos)) AS pp FROM sm WHERE smooth IS NOT NULL GROUP BY ALL),
lr AS (SELECT trial_id, marker, max(pos) FILTER (pos < pp AND NOT coalesce(smooth >= greatest(8, peak * 0.2), false)) AS l, min(pos) FILTER (pos > pp AND NOT coalesce(smooth >= greatest(8, peak * 0.2), false)) AS r FROM sm JOIN pk USING (trial_id, marker) GROUP BY ALL),
nn AS (SELECT trial_id, marker, any_value(n) AS n FROM sm GROUP BY ALL),
swings AS (SELECT trial_id, marker, peak, CASE WHEN peak IS NOT NULL THEN greatest(8, peak * 0.2) END AS threshold, coalesce(pp, n // 2) AS peak_pos, CASE WHEN peak IS NULL THEN 0 ELSE coalesce(l, -1) + 1 END AS start_pos, CASE WHEN peak IS NULL THEN n - 1 ELSE coalesce(r, n) - 1 END AS end_pos, n
  FROM nn LEFT JOIN pk USING (trial_id, marker) LEFT JOIN lr USING (trial_id, marker))"""


@query(f"""WITH {SWINGS} SELECT trial_id, marker, round(peak, 6) AS peak, round(threshold, 6) AS threshold, peak_pos, start_pos, end_pos, CASE WHEN peak IS NULL THEN start_pos ELSE greatest(0, start_pos - 15) END AS from_pos, CASE WHEN peak IS NULL THEN end_pos ELSE least(n - 1, end_pos + 15) END AS to_pos, n FROM swings""")
def swing_segments(spark, sf_dir):
    return events.swing_segment(_motion(spark, sf_dir), _TM, "speed", 100.0).withColumns({c: r6(c) for c in ("peak", "threshold")})


@query(f"""WITH {SWINGS}, q AS (SELECT s.*, height IS NOT NULL AS full_, greatest(0, w.start_pos - 20, coalesce(valid_from, 0)) AS st, greatest(greatest(0, w.start_pos - 20, coalesce(valid_from, 0)), w.start_pos) AS sp, greatest(6, coalesce(w.peak * 0.12, 6)) AS lim FROM sm s JOIN swings w USING (trial_id, marker)),
v AS (SELECT *, full_ AND speed IS NOT NULL AND pos >= st AND pos < sp AS valid, coalesce(full_ AND speed IS NOT NULL AND pos >= st AND pos < sp AND speed <= lim, false) AS slow FROM q),
b AS (SELECT *, CASE WHEN sum(slow::INT) OVER k = 4 THEN avg(height) OVER k - 0.02 * avg(speed) OVER k END AS score, sum(slow::INT) OVER o AS si, sum(valid::INT) OVER o AS vi, sum(full_::INT) OVER o AS fi, sum(slow::INT) OVER (PARTITION BY trial_id, marker) AS ns
  FROM v WINDOW k AS (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), o AS (PARTITION BY trial_id, marker ORDER BY frame_index)),
a AS (SELECT trial_id, marker, arg_min(pos, (-score, pos)) AS at_ FROM b WHERE score IS NOT NULL GROUP BY ALL),
r AS (SELECT b.*, CASE WHEN pos BETWEEN at_ AND at_ + 3 THEN 1 END AS r1, CASE WHEN slow AND si <= 4 AND ns >= 4 THEN 2 END AS r2, CASE WHEN valid AND vi <= 4 THEN 3 END AS r3, CASE WHEN full_ AND fi <= 4 THEN 4 END AS r4, CASE WHEN pos < 4 THEN 5 END AS r5 FROM b LEFT JOIN a USING (trial_id, marker)),
f AS (SELECT *, min(least(r1, r2, r3, r4, r5)) OVER (PARTITION BY trial_id, marker) AS rule FROM r)
SELECT trial_id, marker, frame_index, rule FROM f WHERE rule IN (coalesce(r1, 0), coalesce(r2, 0), coalesce(r3, 0), coalesce(r4, 0), coalesce(r5, 0))""")
def ready_stances(spark, sf_dir):
    m = _motion(spark, sf_dir)
    swings = events.swing_segment(m, _TM, "speed", 100.0)
    out = events.ready_rows(m, _TM, swings, ["height"], "speed", "height", rate=100.0, size=4, lookback_sec=0.2, valid_from=F.col("valid_from"))
    return out.select(*_TM, "frame_index", "rule")


# ---- settings, switches, calibrations, owners

_ACTION = "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'batting' WHEN c_mktsegment = 'BUILDING' THEN 'pitching' WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'running' END"


def _clips(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("clip_id"), F.expr(_ACTION).alias("action_type"), "c_acctbal", "c_nationkey")


@query(f"""WITH c AS (SELECT c_custkey AS clip_id, {_ACTION} AS action_type FROM customer)
SELECT clip_id, coalesce(action_type <> 'pitching', true) AND clip_id % 7 <> 0 AS detect_stick, clip_id % 11 = 0 OR coalesce(action_type <> 'pitching', true) AS detect_ball FROM c""")
def clip_switches(spark, sf_dir):
    c = _clips(spark, sf_dir)
    out = settings.equipment_switches(c, c.filter("clip_id % 7 = 0"), c.filter("clip_id % 11 = 0"), ball_for_batting=True)
    return out.select("clip_id", "detect_stick", "detect_ball")


@query("""WITH c AS (SELECT c_custkey AS clip_id, c_nationkey AS k FROM customer)
SELECT clip_id, 'gap=' || CASE WHEN k % 3 = 0 THEN k::VARCHAR ELSE '5' END || CASE WHEN k % 4 = 1 THEN ';note=own' ELSE '' END || ';window=' || CASE WHEN k % 5 = 0 THEN '7' ELSE '9' END AS settings FROM c""")
def clip_settings(spark, sf_dir):
    c = _clips(spark, sf_dir)
    own = lambda cond, name, value: c.filter(cond).select("clip_id", F.lit(name).alias("setting"), value.cast("string").alias("value"))
    over = own("c_nationkey % 3 = 0", "gap", F.col("c_nationkey")).unionByName(own("c_nationkey % 5 = 0", "window", F.lit(7))).unionByName(own("c_nationkey % 4 = 1", "note", F.lit("own")))
    out = settings.clip_settings(c, over, F.create_map(F.lit("gap"), F.lit("5"), F.lit("window"), F.lit("9")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("clip_id", text.alias("settings"))


@query("""SELECT o_orderkey AS orderkey, round(o_totalprice * 1.8 / CASE WHEN c_acctbal > 0 THEN c_acctbal END * 3.6, 6) AS speed_kmh FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON c_custkey = o_custkey""")
def calibrated_speeds(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("clip_id"), "o_totalprice")
    known = _clips(spark, sf_dir).filter("clip_id % 5 <> 0").select("clip_id", F.col("c_acctbal").alias("body_height_px"))
    return settings.calibrated_speed(o, known, height_m=1.8, speed="o_totalprice").select("orderkey", r6("speed_kmh").alias("speed_kmh"))


@query("""WITH o AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL HAVING count(DISTINCT l_returnflag) = 3)
SELECT s.l_suppkey AS suppkey, min(o.l_linenumber::VARCHAR) AS line FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN o USING (l_suppkey) GROUP BY ALL""")
def owning_lines(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").cast("string").alias("line"), "l_returnflag")
    return settings.first_owner(li, ["suppkey"], "line", "l_returnflag", ["A", "N", "R"])


@query("""SELECT l_partkey AS partkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 WHEN 'A' THEN 3 END) FILTER (l_quantity > 45) WHEN 1 THEN 'R' WHEN 2 THEN 'N' WHEN 3 THEN 'A' END AS flag FROM lineitem GROUP BY ALL""")
def first_flags(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("partkey"), F.col("l_returnflag").alias("flag"), "l_quantity")
    return settings.first_existing(li, ["partkey"], "flag", ["R", "N", "A"], F.col("l_quantity") > 45)


# ---- the long metric table and its inventory

_CATALOG = [
    ("peak_speed", "swing", "峰值速度", "m/s", "max", "peak", "first maximum", ["m0"], "max |x|", "batting"),
    ("mean_height", "posture", "平均高度", "mm", "mean", "", "", ["m0", "m1"], "mean z", None),
    ("low_frames", "posture", "低位", "frames", "count", "low", "z below -280", ["m1"], "count", "pitching"),
]


def _trial_rows(spark, sf_dir):
    f = A.marker_frames(spark, sf_dir, [0, 1])
    trials = f.select("trial_id").distinct().withColumns({"action_type": F.when(F.col("trial_id") % 3 == 0, "batting").when(F.col("trial_id") % 3 == 1, "pitching").otherwise("running"), "sample_name": F.concat(F.lit("s"), "trial_id"), "athlete": F.lit("a"), "source_file": F.concat(F.col("trial_id").cast("string"), F.lit(".c3d"))})
    top, low = F.max(F.abs("m0.x")).over(Window.partitionBy("trial_id")), F.col("m1.z") < -280
    marked = f.withColumns({"_top": F.abs("m0.x") == top})
    kind = "struct<metric_key:string,value:double,events:array<bigint>,components:map<string,string>,notes:string>"
    none = F.lit(None)
    metric = lambda key, value, events=none, components=none, notes=none: F.struct(F.lit(key), value, events, components, notes).cast(kind)
    parts = F.create_map(F.lit("n"), F.count(F.lit(1)).cast("string"), F.lit("axis"), F.lit("x"))
    found = marked.groupBy("trial_id").agg(F.array(
        metric("peak_speed", F.max(F.abs("m0.x")), F.collect_list(F.when(F.col("_top"), F.col("frame_index"))), parts),
        metric("mean_height", F.avg((F.col("m0.z") + F.col("m1.z")) / 2), notes=F.lit("both ends")),
        metric("low_frames", F.when(F.count_if(low) > 0, F.count_if(low)), F.collect_list(F.when(low, F.col("frame_index")))),
    ).alias("m"))
    values = found.select("trial_id", F.explode("m").alias("m")).select("trial_id", "m.*")
    catalog = spark.createDataFrame(_CATALOG, "metric_key string, module string, metric_name_zh string, unit string, aggregation string, event_name string, event_rule string, points array<string>, formula string, action_type string")
    return values, trials, catalog


def _metric_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{';'.join(v)}'" if isinstance(v, list) else f"'{v}'" for v in r) + ")" for r in _CATALOG)
    return f"""WITH {A.marker_frames_sql([0, 1])}, cat(metric_key, module, metric_name_zh, unit, aggregation, event_name, event_rule, points_used, formula, only_) AS (VALUES {rows}),
t AS (SELECT DISTINCT trial_id, CASE trial_id % 3 WHEN 0 THEN 'batting' WHEN 1 THEN 'pitching' ELSE 'running' END AS action_type FROM frames),
g AS (SELECT *, abs(m0x) = max(abs(m0x)) OVER (PARTITION BY trial_id) AS top FROM frames),
v AS (SELECT trial_id, 'peak_speed' AS metric_key, max(abs(m0x)) AS value, list(frame_index ORDER BY frame_index) FILTER (top) AS ev, '{{"axis":"x","n":"' || count(*) || '"}}' AS components_json, '' AS notes FROM g GROUP BY trial_id
  UNION ALL SELECT trial_id, 'mean_height', avg((m0z + m1z) / 2), NULL, '{{}}', 'both ends' FROM g GROUP BY trial_id
  UNION ALL SELECT trial_id, 'low_frames', nullif(count(*) FILTER (m1z < -280), 0)::DOUBLE, list(frame_index ORDER BY frame_index) FILTER (m1z < -280), '{{}}', '' FROM g GROUP BY trial_id)
SELECT t.trial_id, 's' || t.trial_id AS sample_name, 'a' AS athlete, action_type, t.trial_id || '.c3d' AS source_file, module, metric_name_zh, metric_key, round(value, 6) AS value, unit, aggregation, event_name, event_rule,
  round_even(list_median(ev), 0)::BIGINT AS event_frame, coalesce(array_to_string(ev, ';'), '') AS event_frames, points_used, formula, components_json, notes, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS availability,
  CASE WHEN value IS NOT NULL THEN '' WHEN ev IS NULL THEN 'no_event' ELSE 'missing_points' END AS reason FROM t JOIN cat ON only_ IS NULL OR only_ = action_type LEFT JOIN v USING (trial_id, metric_key)"""


@query(_metric_sql())
def metric_table(spark, sf_dir):
    return reports.metric_rows(*_trial_rows(spark, sf_dir)).withColumn("value", r6("value"))


_CATEGORIES = [("urgent", ["1-URGENT", "2-HIGH"]), ("other", ["3-MEDIUM", "5-LOW", "6-NONE"])]


@query(f"""WITH {A.ENTITY_METRICS}, c(category, examples) AS (VALUES ('urgent', ['1-URGENT', '2-HIGH']), ('other', ['3-MEDIUM', '5-LOW', '6-NONE'])), h AS (SELECT entity, list(DISTINCT metric) AS have FROM entity_metrics GROUP BY ALL)
SELECT entity, category, array_to_string(examples, ';') AS examples, array_to_string(list_filter(examples, lambda x: list_contains(have, x)), ';') AS available_examples FROM h, c""")
def metric_inventory(spark, sf_dir):
    out = reports.metric_inventory(spark.createDataFrame(_CATEGORIES, "category string, examples array<string>"), A.entity_metrics(spark, sf_dir), ["entity"])
    return out.select("entity", "category", F.array_join("examples", ";").alias("examples"), F.array_join("available_examples", ";").alias("available_examples"))


# ---- bundles side by side

@query(f"""WITH f AS ({ORACLES["motion_features"]}) SELECT clip_id, NULL::DOUBLE AS trunk_rotation_velocity, round(quantile_cont(abs(pelvis_rotation_velocity_deg_s), 0.95), 3) AS pelvis_rotation_velocity, NULL::DOUBLE AS hip_shoulder_separation,
  round(quantile_cont(abs(hand_speed_proxy), 0.95), 3) AS hand_speed_proxy, NULL::DOUBLE AS left_knee_flexion, round(quantile_cont(180 - right_elbow_angle_deg, 0.95), 3) AS right_knee_flexion, NULL::DOUBLE AS left_wrist_speed, round(quantile_cont(hand_speed_proxy, 0.95), 3) AS right_wrist_speed FROM f GROUP BY clip_id""")
def public_values(spark, sf_dir):
    """The adapter has one arm and no knees: the arm's elbow stands in for the right knee, the rest has no values."""
    f = QUERIES["motion_features"](spark, sf_dir).withColumns({"right_knee_angle_deg": F.col("right_elbow_angle_deg"), "right_wrist_speed": F.col("hand_speed_proxy")})
    f = f.withColumns({c: F.lit(None).cast("double") for _, c, _ in comparisons.PUBLIC if c not in f.columns})
    out = comparisons.public_values(f, ["clip_id"])
    return out.select("clip_id", *[F.round(n, 3).alias(n) for n, *_ in comparisons.PUBLIC])


def _compared_sql() -> str:
    parts = []
    for i, (name, column, unit, how, low, high) in enumerate(comparisons.PITCH):
        value, ref = (f"b.{column} / CASE WHEN abs(c.{column}) >= 1e-9 THEN c.{column} END * 100", f"CASE WHEN c.{column} IS NOT NULL THEN 100 END") if how == "relative" else (f"b.{column}", f"c.{column}")
        x, pad = f"abs({value})" if how == "size" else f"({value})", (high - low) * 0.35
        band = f"CASE WHEN {x} IS NULL THEN 'warn' WHEN {x} BETWEEN {low} AND {high} THEN 'ok' WHEN {x} BETWEEN {low - pad} AND {high + pad} THEN 'warn' ELSE 'bad' END"
        share = f"CASE WHEN {x} IS NULL THEN 'warn' WHEN {x} >= {high} THEN 'ok' WHEN {x} >= {low} THEN 'warn' ELSE 'bad' END"
        status = "'warn'" if how == "none" else share if how in ("share", "relative") else band
        parts.append(f"SELECT b.trial_id, {i + 1} AS position, '{name}' AS metric, {value} AS value, {ref} AS coach_value, '{unit}' AS unit, {status} AS status FROM b LEFT JOIN c ON c.lane = b.trial_id % 4")
    return f"""WITH b AS ({ORACLES["pitch_bundle"]}), c AS (SELECT trial_id AS lane, * EXCLUDE (trial_id) FROM b WHERE trial_id < 3), r AS ({" UNION ALL ".join(parts)})
SELECT trial_id, "position", metric, round(value, 4) AS value, round(coach_value, 4) AS coach_value, unit, status, round(CASE WHEN coach_value IS NULL OR abs(coach_value) < 1e-6 THEN 50 ELSE greatest(0, least(140, abs(value - coach_value) / abs(coach_value) * 100)) END, 4) AS gap_score FROM r"""


@query(_compared_sql())
def compared_pitches(spark, sf_dir):
    b = QUERIES["pitch_bundle"](spark, sf_dir)
    coach = b.filter("trial_id < 3").withColumnRenamed("trial_id", "lane")
    out = comparisons.compared_pitch(b.withColumn("lane", F.col("trial_id") % 4), coach, ["trial_id"], ["lane"])
    return out.withColumns({c: F.round(c, 4) for c in ("value", "coach_value", "gap_score")})


def _angles_sql() -> str:
    pick = {
        "knee": f"CASE WHEN trial_id % 2 = 0 THEN {BQ.joint('left_hip', 'left_knee', 'left_ankle')} ELSE {BQ.joint('right_hip', 'right_knee', 'right_ankle')} END", "elbow": BQ.joint("right_shoulder", "right_elbow", "right_wrist"),
        "trunk_tilt": "degrees(atan2(abs(neck_x - hip_x), greatest(abs(neck_y - hip_y), 1e-6)))",
        "hip_shoulder_separation": f"abs({BQ.turn(BQ.yaw('right_hip', 'left_hip'), BQ.yaw('right_shoulder', 'left_shoulder'))})",
    }
    return f"WITH {A.skeleton_sql()} " + " UNION ALL ".join(f"SELECT trial_id, frame_index, '{n}' AS name, round({v}, 6) AS value FROM frames" for n, v in pick.items())


@query(_angles_sql())
def angles_by_kind(spark, sf_dir):
    return comparisons.angle_series(A.skeleton(spark, sf_dir), ["trial_id"], F.col("trial_id") % 2 == 0).withColumn("value", r6("value"))


@query("""SELECT o_custkey AS custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_totalprice > 150000) AS price FROM orders GROUP BY ALL""")
def first_prices(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("custkey"), F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")).otherwise(float("nan")).alias("price"), "o_orderdate", "o_orderkey")
    return comparisons.first_value(o, ["custkey"], "price", ["o_orderdate", "o_orderkey"])


# ---- tables through files: written, read back typed


def _through_csv(df, schema, read):
    path = scratch_path(df.sparkSession, "tables")
    tables.write_csv(df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]), path)
    return read(df.sparkSession, path)


_SOMETIMES = "CASE WHEN confidence >= 0.2 THEN {} END"


@query(f"""WITH {A.TRAJ_FRAME} SELECT clip_id, condition_id, frame_index, round(timestamp_sec, 9) AS timestamp_sec, joint_name, {_SOMETIMES.format("x")} AS x, y, visibility, confidence, backend, NULL::DOUBLE AS inference_time_ms FROM traj_frame""")
def pose2d_through_csv(spark, sf_dir):
    df = A.traj_frame(spark, sf_dir).withColumn("x", F.expr(_SOMETIMES.format("x")))
    return _through_csv(df, schemas.POSE2D, tables.read_pose2d).withColumn("timestamp_sec", F.round("timestamp_sec", 9))


@query(f"""WITH {A.MARKERS} SELECT trial_id::VARCHAR AS clip_id, 'raw' AS condition_id, frame_index, round(timestamp_sec, 9) AS timestamp_sec, 'm' || marker AS joint_name, CASE WHEN y <= 80 THEN x END AS x_3d, y AS y_3d, z AS z_3d, 'mm' AS scale_mode, NULL::VARCHAR AS lift_backend, 0.5::DOUBLE AS input_quality_score FROM markers""")
def pose3d_through_csv(spark, sf_dir):
    m = A.markers(spark, sf_dir)
    # A missing number is NaN in files of this kind.
    df = m.select(F.col("trial_id").cast("string").alias("clip_id"), F.lit("raw").alias("condition_id"), "frame_index", "timestamp_sec", F.concat(F.lit("m"), "marker").alias("joint_name"), F.when(F.col("y") <= 80, F.col("x")).otherwise(float("nan")).alias("x_3d"), F.col("y").alias("y_3d"), F.col("z").alias("z_3d"), F.lit("mm").alias("scale_mode"), F.lit(0.5).alias("input_quality_score"))
    return _through_csv(df, schemas.POSE3D, tables.read_pose3d).withColumn("timestamp_sec", F.round("timestamp_sec", 9))


@query("""SELECT o_orderkey::VARCHAR AS clip_id, 'a;b' || CASE WHEN o_custkey % 2 = 0 THEN '; ;' ELSE '' END AS raw_tags, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS action_type, 'root/' || o_orderkey || '.mp4' AS source_path, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'a|b' END AS tags FROM orders""")
def clips_through_csv(spark, sf_dir):
    """The clip dimension: empty tags drop out, paths lie below a root, empty cells are null."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = F.concat(F.lit("a;b"), F.when(F.col("o_custkey") % 2 == 0, "; ;").otherwise(""))
    written = o.select(F.col("o_orderkey").cast("string").alias("clip_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("source_path"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("action_type"), F.lit(30.0).alias("fps_target"), F.when(F.col("o_custkey") % 5 != 0, raw).alias("difficulty_tags"), raw.alias("notes"))
    path = scratch_path(spark, "clips")
    tables.write_csv(written, path)
    read = tables.read_clips(spark, path, "root")
    return read.select("clip_id", F.col("notes").alias("raw_tags"), "action_type", "source_path", F.array_join("difficulty_tags", "|").alias("tags"))


@query(f"""WITH {A.MARKERS}, k AS (SELECT * FROM markers WHERE y <= 60), f AS (SELECT trial_id, frame_index, row_number() OVER (PARTITION BY trial_id ORDER BY frame_index) - 1 AS dense_frame FROM (SELECT DISTINCT trial_id, frame_index FROM k)),
g AS (SELECT f.*, m.marker FROM f JOIN (SELECT DISTINCT trial_id, marker FROM k) m USING (trial_id)) SELECT g.trial_id, g.marker, g.frame_index, g.dense_frame, round(k.x, 6) AS x FROM g LEFT JOIN k USING (trial_id, marker, frame_index)""")
def dense_marker_points(spark, sf_dir):
    m = A.markers(spark, sf_dir).withColumn("valid", (F.col("y") <= 60).cast("int"))
    out = tables.dense_points(m, ["trial_id"], "marker")
    return out.select("trial_id", "marker", "frame_index", F.col("dense_frame").cast("long").alias("dense_frame"), r6("x").alias("x"))


@query(f"""WITH {A.TRAJ}, k AS (SELECT clip_id, frame_index, min(timestamp_sec) AS t FROM traj WHERE clip_id::INT % 2 = 0 AND frame_index % 2 = 0 GROUP BY ALL), s AS (SELECT clip_id, frame_index, min(timestamp_sec) AS t FROM traj GROUP BY ALL)
SELECT clip_id, frame_index, round(t, 6) AS timestamp_sec FROM k UNION ALL SELECT clip_id, frame_index, round(t, 6) FROM s WHERE clip_id NOT IN (SELECT clip_id FROM k)""")
def timelines(spark, sf_dir):
    t = A.traj(spark, sf_dir)
    known = t.filter("cast(clip_id as int) % 2 = 0 and frame_index % 2 = 0")
    return tables.timeline(known, t, ["clip_id"]).withColumn("timestamp_sec", r6("timestamp_sec"))
