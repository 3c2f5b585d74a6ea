"""Registered queries of poses, lookups, mappings, rescues and swings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence as C
from ..operators import bundles as B
from ..operators import catalog, completion, folds, poses, smoothing
from . import adapters as A
from . import bundle_queries as BQ
from . import twins
from .queries import GAPPY, K, KJ, SCORE, TRUST, gappy, query, r6

# ---- poses as arrays

#: Of a whole body's points those that the 26-point order uses: body and feet.
USED = 23


def _points_sql(name: str, first: int, n: int) -> str:
    return f"[{{'x': embedding[(({first} + 2 * i) % 64) + 1]::DOUBLE * 10, 'y': embedding[(({first} + 2 * i + 1) % 64) + 1]::DOUBLE * 10}} FOR i IN range({n})] AS {name}, [abs(embedding[(({first} + 3 * i) % 64) + 1]::DOUBLE) FOR i IN range({n})] AS {name}_s"


def _points(first: int, n: int):
    at = lambda k: F.get("embedding", F.lit(k % 64)).cast("double")
    points = F.array(*[F.struct((at(first + 2 * i) * 10).alias("x"), (at(first + 2 * i + 1) * 10).alias("y")) for i in range(n)])
    return points, F.array(*[F.abs(at(first + 3 * i)) for i in range(n)])


_ORDER = [k for pair in zip(poses.FEET["left"], poses.FEET["right"], strict=True) for k in pair]


def _mid_sql(p: str, a: int, b: int) -> str:
    return f"{{'x': ({p}[{a + 1}].x + {p}[{b + 1}].x) / 2, 'y': ({p}[{a + 1}].y + {p}[{b + 1}].y) / 2}}"


def _reindexed_sql(body: str, feet: str, feet_s: str) -> str:
    return f"""list_concat({body}[1:17], [{body}[1], {_mid_sql(body, 5, 6)}, {_mid_sql(body, 11, 12)}, {feet}]) AS points,
  list_concat({body}_s[1:17], [{body}_s[1], ({body}_s[6] + {body}_s[7]) / 2, ({body}_s[12] + {body}_s[13]) / 2, {feet_s}]) AS scores"""


_LONG = "SELECT vec_id, i AS place, round(points[i].x, 9) AS x, round(points[i].y, 9) AS y, round(scores[i], 9) AS score FROM p, range(1, 27) t(i)"


@query(f"""WITH e AS (SELECT vec_id, {_points_sql("w", 0, USED)} FROM embeddings),
p AS (SELECT vec_id, {_reindexed_sql("w", ", ".join(f"w[{k + 1}]" for k in _ORDER), ", ".join(f"w_s[{k + 1}]" for k in _ORDER))} FROM e) {_LONG}""")
def whole_body_points(spark, sf_dir):
    points, scores = poses.whole_body_to_26(*_points(0, USED))
    return _long_points(A._table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points"), scores.alias("scores")))


def _long_points(df):
    rows = F.posexplode(F.arrays_zip("points", "scores")).alias("i", "p")
    df = df.select("vec_id", rows)
    return df.select("vec_id", (F.col("i") + 1).cast("long").alias("place"), *[F.round(f"p.points.{a}", 9).alias(a) for a in "xy"], F.round("p.scores", 9).alias("score"))


def _gap_sql(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2)"


def _good_sql(side: int) -> str:
    knee, ankle = f"b[{poses.KNEES[side] + 1}]", f"b[{poses.ANKLES[side] + 1}]"
    foot = [f"w[{k + 1}]" for k in poses.FEET[("left", "right")[side]]]
    leg = f"greatest({_gap_sql(ankle, knee)}, 1)"
    far = f"greatest({', '.join(_gap_sql(ankle, p) for p in foot)})"
    wide = f"greatest({_gap_sql(foot[0], foot[1])}, {_gap_sql(foot[0], foot[2])}, {_gap_sql(foot[1], foot[2])})"
    return f"({far} <= {leg} * 0.75 AND {wide} <= {leg} * 0.55)"


_FUSED = [(k, side, poses.ANKLES[side]) for pair in zip(poses.FEET["left"], poses.FEET["right"], strict=True) for side, k in enumerate(pair)]


@query(f"""WITH e AS (SELECT vec_id, {_points_sql("b", 0, 17)}, {_points_sql("w", 26, USED)} FROM embeddings), g AS (SELECT *, {_good_sql(0)} AS g0, {_good_sql(1)} AS g1 FROM e),
p AS (SELECT vec_id, {_reindexed_sql("b", ", ".join(f"CASE WHEN g{s} THEN w[{k + 1}] ELSE b[{a + 1}] END" for k, s, a in _FUSED), ", ".join(f"CASE WHEN g{s} THEN w_s[{k + 1}] ELSE least(b_s[{a + 1}], 0.35) END" for k, s, a in _FUSED))} FROM g) {_LONG}""")
def fused_feet_points(spark, sf_dir):
    points, scores = poses.fused_body_and_feet(*_points(0, 17), *_points(26, USED))
    return _long_points(A._table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points"), scores.alias("scores")))


# ---- lookups and mappings


@query("""WITH m AS (SELECT *, count(*) OVER (PARTITION BY c_name) AS n FROM customer)
SELECT unnest(['empty_id', 'repeated_id', 'unknown_action', 'bad_rate']) AS problem, unnest([count(*) FILTER (coalesce(trim(c_name), '') = ''), count(*) FILTER (coalesce(trim(c_name), '') <> '' AND n > 1),
  count(*) FILTER (NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)), count(*) FILTER (NOT coalesce(c_acctbal > 0, false))]) AS n FROM m""")
def clip_checks(spark, sf_dir):
    return catalog.clip_checks(A._table(spark, sf_dir, "customer"), key="c_name", action="c_mktsegment", fps="c_acctbal", actions=["BUILDING", "MACHINERY"])


@query(f"""WITH {A.TRAJ} SELECT joint_name, count(*) AS n FROM traj WHERE joint_name NOT IN ('right_wrist', 'right_elbow') GROUP BY joint_name""")
def unknown_joint_names(spark, sf_dir):
    known = spark.createDataFrame([("right_wrist",), ("right_elbow",)], "joint_name string")
    return catalog.unknown_names(A.traj(spark, sf_dir), known)


@query("""SELECT o_custkey AS clip_id, o_orderpriority AS action_type, min(o_orderkey) AS trial_id FROM orders GROUP BY ALL""")
def first_trials(spark, sf_dir):
    o = A._table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderpriority").alias("action_type"), F.col("o_orderkey").alias("trial_id"))
    return catalog.first_trial(o, ["clip_id", "action_type"], "trial_id")


@query("""SELECT o_custkey AS athlete, o_orderpriority AS metric, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL""")
def last_peer_values(spark, sf_dir):
    o = A._table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return catalog.last_of_each(o, ["athlete", "metric"], "o_orderkey").select("athlete", "metric", "value")


WANTED = ["3-MEDIUM", "1-URGENT", "9-NONE"]


@query(f"""WITH {A.ENTITY_METRICS} SELECT entity, CASE metric WHEN '3-MEDIUM' THEN 1 ELSE 2 END AS position, metric, value FROM entity_metrics WHERE metric IN ('3-MEDIUM', '1-URGENT')""")
def metrics_in_order(spark, sf_dir):
    return catalog.metrics_in_order(A.entity_metrics(spark, sf_dir), ["entity"], WANTED)


@query(f"""WITH {A.ENTITY_METRICS} SELECT segment, round(avg(value), 4) AS mean_value, count(*) AS n FROM entity_metrics WHERE metric = '2-HIGH' GROUP BY segment""")
def metric_means(spark, sf_dir):
    return catalog.means_by(A.entity_metrics(spark, sf_dir), ["segment"], "2-HIGH").withColumn("mean_value", F.round("mean_value", 4))


@query(f"""WITH {A.ENTITY_METRICS} SELECT segment, metric, min(value) AS low, max(value) AS high, round(min(value) - (max(value) - min(value)) * 0.1, 6) AS axis_low, round(max(value) + (max(value) - min(value)) * 0.1, 6) AS axis_high FROM entity_metrics GROUP BY ALL""")
def axis_ranges(spark, sf_dir):
    return catalog.axis_ranges(A.entity_metrics(spark, sf_dir), ["segment", "metric"]).withColumns({c: r6(c) for c in ("axis_low", "axis_high")})


RULES = [("1-URGENT", "exact", "full clip"), ("2-HIGH", "exact", "full clip"), ("3-MEDIUM", "partial", "no event"), ("4-NOT SPECIFIED", "none", "not measured"), ("7-LOST", "exact", "full clip")]
#: Contexts: the first cohort, then the wanted group, then the metric's own.
CONTEXTS = [
    ("1-URGENT", "cohort_reference", "college", 0, 150000.0, 2000.0), ("1-URGENT", "cohort_reference", "youth", 1, 1.0, 1.0), ("1-URGENT", "athlete_group", "pro", 0, 2.0, 1.0),
    ("2-HIGH", "athlete_group", "pro", 0, 100.0, 10.0), ("2-HIGH", "own", None, 0, 7.0, 1.0), ("3-MEDIUM", "own", None, 0, 5.0, None),
]
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
MAPPED = f"""{A.ENTITY_METRICS}, rules(metric, match, note) AS (VALUES {_VALUES(RULES)}), refs(metric, kind, name, position, mean, sd) AS (VALUES {_VALUES(CONTEXTS)}),
ranked AS (SELECT *, CASE WHEN kind = 'cohort_reference' AND position = 0 THEN 0 WHEN kind = 'athlete_group' AND name = 'pro' THEN 1 WHEN kind = 'own' THEN 2 END AS rk FROM refs),
ctx AS (SELECT * FROM ranked WHERE rk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric ORDER BY rk) = 1), seen AS (SELECT metric, round(avg(value), 2) AS value FROM entity_metrics GROUP BY metric),
j AS (SELECT r.*, s.value, c.name, c.mean, c.sd, s.value IS NOT NULL AND match <> 'none' AS there, (s.value - c.mean) / CASE WHEN c.sd > 0 THEN c.sd END AS z FROM rules r LEFT JOIN seen s USING (metric) LEFT JOIN ctx c USING (metric)),
mapped AS (SELECT metric, CASE WHEN NOT there THEN 'unavailable' WHEN match = 'exact' THEN 'available' ELSE 'partial' END AS status, CASE WHEN match = 'partial' AND there THEN 'proxy' ELSE match END AS match_type, CASE WHEN there THEN value END AS value,
  name AS context, CASE WHEN match = 'exact' AND there THEN CASE WHEN z IS NULL THEN 'no_reference' WHEN z < -1 THEN 'below_1sd' WHEN z > 1 THEN 'above_1sd' ELSE 'within_1sd' END END AS comparison,
  CASE WHEN there OR match = 'none' THEN note ELSE metric || ' is missing' END AS reason FROM j)"""


def _mapped(spark, sf_dir):
    seen = A.entity_metrics(spark, sf_dir).groupBy("metric").agg(F.round(F.avg("value"), 2).alias("value"))
    refs = spark.createDataFrame(CONTEXTS, "metric string, kind string, name string, position int, mean double, sd double")
    rules = spark.createDataFrame(RULES, "metric string, match string, note string")
    return catalog.mapped_metrics(rules, seen, catalog.reference_context(refs, "pro"))


@query(f"WITH {MAPPED} SELECT * FROM mapped")
def mapped_metrics(spark, sf_dir):
    return _mapped(spark, sf_dir)


TITLES = [("1-URGENT", "Urgent"), ("3-MEDIUM", "Medium"), ("4-NOT SPECIFIED", "None"), ("7-LOST", "Lost")]


@query(f"""WITH {MAPPED}, titles(metric, title) AS (VALUES {_VALUES(TITLES)}) SELECT metric, title, status, value, printf('%s: %.2f (%s)', title, value, coalesce(comparison, 'partial')) AS text FROM titles JOIN mapped USING (metric) WHERE status <> 'unavailable'""")
def metric_cards(spark, sf_dir):
    return catalog.metric_cards(_mapped(spark, sf_dir), spark.createDataFrame(TITLES, "metric string, title string"))


@query(f"""WITH {A.ENTITY_METRICS}, n(metric) AS (VALUES ('5-LOW'), ('8-GONE')), s AS (SELECT metric, round(avg(value), 2) AS value FROM entity_metrics GROUP BY metric)
SELECT metric, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS status, 'observation_only' AS match_type, value FROM n LEFT JOIN s USING (metric)""")
def observed_only(spark, sf_dir):
    seen = A.entity_metrics(spark, sf_dir).groupBy("metric").agg(F.round(F.avg("value"), 2).alias("value"))
    return catalog.observation_only(seen, spark.createDataFrame([("5-LOW",), ("8-GONE",)], "metric string"))


NAMES = "CASE frame_index % 4 WHEN 0 THEN 'Weight Transfer' WHEN 1 THEN 'Stride Angle' WHEN 2 THEN 'Wrist/Hand Speed' ELSE 'Attack Angle' END"


@query(f"""WITH {A.TRAJ}, m AS (SELECT clip_id, frame_index, {NAMES} AS metric_name, CASE WHEN x > 0.3 THEN 100.0 ELSE y * 60 END AS value, frame_index % 3 AS event_frame FROM traj)
SELECT clip_id, frame_index, metric_name, CASE WHEN metric_name = 'Weight Transfer' THEN 'saturated' WHEN metric_name = 'Stride Angle' THEN 'landing_at_frame_0' WHEN metric_name = 'Wrist/Hand Speed' THEN 'event_mismatch' ELSE 'not_a_true_angle' END AS message
FROM m WHERE (metric_name = 'Weight Transfer' AND value IN (0, 100)) OR (metric_name = 'Stride Angle' AND event_frame = 0) OR (metric_name = 'Wrist/Hand Speed' AND value < 0.5) OR (metric_name = 'Attack Angle' AND abs(value) > 45)""")
def suspicious_rows(spark, sf_dir):
    rows = A.traj(spark, sf_dir).select(
        "clip_id", "frame_index", F.expr(NAMES).alias("metric_name"), F.when(F.col("x") > 0.3, 100.0).otherwise(F.col("y") * 60).alias("value"), (F.col("frame_index") % 3).alias("event_frame")
    )
    return catalog.suspicious(rows, ["clip_id", "frame_index"])


@query(f"""WITH {BQ.BAT_PHASE}, p AS (SELECT DISTINCT trial_id, ps, ev, pe FROM marked), l AS (SELECT trial_id, unnest(['Phase Start', 'Event', 'Phase End']) AS metric_name, unnest([ps, ev, pe]) AS frame_index FROM p)
SELECT l.trial_id, metric_name, l.frame_index, round(coalesce(timestamp_sec, l.frame_index / 30), 6) AS value FROM l LEFT JOIN frames f ON f.trial_id = l.trial_id AND f.frame_index = l.frame_index""")
def phase_rows(spark, sf_dir):
    frames = A.skeleton(spark, sf_dir)
    phases = B.phases(B.batting_phase(frames, BQ.T), BQ.T)
    return catalog.phase_rows(phases, BQ.T, frames).withColumn("value", r6("value"))


_W = "right_wrist"
GROUPS = {"torso": ["right_shoulder", "left_hip", "right_hip"], "arm": ["right_elbow", "right_wrist"]}


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT clip_id, condition_id, frame_index, {", ".join(f"count(DISTINCT joint_name) FILTER ({SCORE} >= {TRUST} AND joint_name IN ({', '.join(repr(j) for j in names)})) / {len(names)} AS {g}" for g, names in GROUPS.items())},
  arg_min(confidence, joint_name) AS c, arg_min_null(CASE WHEN y > 0.2 THEN x * 40 END, joint_name) AS took, max(x) FILTER ({SCORE} >= {TRUST} AND joint_name = '{_W}') AS x, max(y) FILTER ({SCORE} >= {TRUST} AND joint_name = '{_W}') AS y FROM traj_frame GROUP BY ALL),
w AS (SELECT clip_id, avg(sqrt((x - x1) ** 2 + (y - y1) ** 2)) AS jitter, avg(sqrt((x - 2 * x1 + x2) ** 2 + (y - 2 * y1 + y2) ** 2)) AS second FROM (SELECT *, lag(x) OVER v AS x1, lag(y) OVER v AS y1, lag(x, 2) OVER v AS x2, lag(y, 2) OVER v AS y2 FROM f WHERE x IS NOT NULL WINDOW v AS (PARTITION BY clip_id ORDER BY frame_index)) GROUP BY clip_id),
g AS (SELECT clip_id, condition_id, avg(torso) AS torso, avg(arm) AS arm, avg(c) AS c, avg(took) AS took, avg((x IS NULL)::INT) AS missing FROM f GROUP BY ALL)
SELECT clip_id, condition_id, unnest(['keypoint_completeness', 'keypoint_completeness', 'mean_confidence', 'runtime_ms_per_frame', 'missing_rate', 'temporal_jitter', 'second_difference']) AS metric_name, unnest(['torso', 'arm', 'all', 'all', '{_W}', '{_W}', '{_W}']) AS joint_group,
  round(unnest([torso, arm, c, took, missing, jitter, second]), 6) AS value FROM g LEFT JOIN w USING (clip_id)""")
def ablation_rows(spark, sf_dir):
    points = A.traj_frame(spark, sf_dir).withColumn("inference_time_ms", F.when(F.col("y") > 0.2, F.col("x") * 40))
    return catalog.ablation_rows(points, K, GROUPS, [_W], TRUST, runtime="inference_time_ms").withColumn("value", r6("value"))


# ---- rescues and directions

_ARM = "seg(joint_name, other, proximal, distal) AS (VALUES ('right_shoulder', 'right_elbow', 'right_shoulder', 'right_elbow'), ('right_elbow', 'right_shoulder', 'right_shoulder', 'right_elbow'), ('right_elbow', 'right_wrist', 'right_elbow', 'right_wrist'), ('right_wrist', 'right_elbow', 'right_elbow', 'right_wrist'))"
RESCUE = f"""{A.TRAJ_FRAME}, t AS (SELECT *, {SCORE} AS score, {SCORE} >= 0.4 AS ok FROM traj_frame), {_ARM},
bone AS (SELECT p.clip_id, s.proximal, s.distal, median(sqrt((d.x - p.x) ** 2 + (d.y - p.y) ** 2)) AS bone FROM t p JOIN (SELECT DISTINCT proximal, distal FROM seg) s ON p.joint_name = s.proximal JOIN t d ON d.joint_name = s.distal AND d.clip_id = p.clip_id AND d.frame_index = p.frame_index WHERE p.ok AND d.ok GROUP BY ALL),
fit AS (SELECT t.clip_id, t.frame_index, t.joint_name, bool_or(sqrt((o.x - t.x) ** 2 + (o.y - t.y) ** 2) / CASE WHEN bone > 0 THEN bone END BETWEEN 0.5 AND 1.5) AS fits FROM t JOIN seg s ON s.joint_name = t.joint_name JOIN t o ON o.clip_id = t.clip_id AND o.frame_index = t.frame_index AND o.joint_name = s.other AND o.ok
  JOIN bone b ON b.clip_id = t.clip_id AND b.proximal = s.proximal AND b.distal = s.distal GROUP BY ALL),
nb AS (SELECT *, max(frame_index) FILTER (ok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, min(frame_index) FILTER (ok) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM t WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
pl AS (SELECT n.*, CASE WHEN bf IS NOT NULL AND af IS NOT NULL THEN sqrt((b.x + (a.x - b.x) * ((n.frame_index - bf) / (af - bf)) - n.x) ** 2 + (b.y + (a.y - b.y) * ((n.frame_index - bf) / (af - bf)) - n.y) ** 2) <= 0.2
  WHEN bf IS NULL AND af IS NULL THEN true ELSE abs(n.frame_index - coalesce(bf, af)) <= 3 AND sqrt((coalesce(b.x, a.x) - n.x) ** 2 + (coalesce(b.y, a.y) - n.y) ** 2) <= 0.2 END AS plausible
  FROM nb n LEFT JOIN t b ON b.clip_id = n.clip_id AND b.joint_name = n.joint_name AND b.frame_index = bf LEFT JOIN t a ON a.clip_id = n.clip_id AND a.joint_name = n.joint_name AND a.frame_index = af),
sv AS (SELECT pl.*, NOT ok AND score >= 0.05 AND (coalesce(fits, false) OR (score >= 0.15 AND plausible)) AS saved FROM pl LEFT JOIN fit USING (clip_id, frame_index, joint_name))"""


@query(f"""WITH {RESCUE} SELECT clip_id, frame_index, joint_name, CASE WHEN saved THEN greatest(0, least(1, x)) ELSE x END AS x, CASE WHEN saved THEN greatest(0, least(1, y)) ELSE y END AS y, CASE WHEN saved THEN 0.62 ELSE confidence END AS confidence,
  CASE WHEN saved THEN backend || '+rescued' ELSE backend END AS backend FROM sv""")
def rescued_points(spark, sf_dir):
    out = completion.rescue(A.traj_frame(spark, sf_dir), K, threshold=0.4, least=0.05, least_alone=0.15, limb_tolerance=0.5, time_tolerance=0.2)
    return out.select("clip_id", "frame_index", "joint_name", "x", "y", "confidence", "backend")


@query(f"""WITH {A.TRAJ_FRAME}, b AS (SELECT p.clip_id, p.frame_index, d.x - p.x AS dx, d.y - p.y AS dy FROM traj_frame p JOIN traj_frame d ON d.clip_id = p.clip_id AND d.frame_index = p.frame_index AND p.joint_name = 'right_elbow' AND d.joint_name = 'right_wrist' WHERE least(p.visibility, p.confidence) >= 0.3 AND least(d.visibility, d.confidence) >= 0.3),
f AS (SELECT DISTINCT clip_id, frame_index FROM traj_frame), n AS (SELECT f.clip_id, f.frame_index, arg_min(dx, (abs(f.frame_index - b.frame_index), b.frame_index)) AS dx, arg_min(dy, (abs(f.frame_index - b.frame_index), b.frame_index)) AS dy FROM f JOIN b ON b.clip_id = f.clip_id AND b.frame_index <> f.frame_index AND abs(b.frame_index - f.frame_index) <= 5 GROUP BY ALL)
SELECT f.clip_id, f.frame_index, round(coalesce(dx, 1), 9) AS dx, round(coalesce(dy, 0), 9) AS dy FROM f LEFT JOIN n USING (clip_id, frame_index)""")
def nearest_directions(spark, sf_dir):
    out = completion.nearest_direction(A.traj_frame(spark, sf_dir), K, completion.usable(TRUST), "right_elbow", "right_wrist")
    return out.select("clip_id", "frame_index", F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"))


# ---- a stick's swing: two markers are its ends, those with a low third one are missing

STICKS = f"""{A.marker_frames_sql([0, 1, 2])}, sticks AS (SELECT trial_id, frame_index, m0x AS x, m0y AS y, m1x AS x2, m1y AS y2, abs(m2x) / 500 AS confidence FROM frames WHERE m2z > -60)"""


def _sticks(spark, sf_dir):
    f = A.marker_frames(spark, sf_dir, [0, 1, 2]).filter("m2.z > -60")
    ends = {"x": "m0.x", "y": "m0.y", "x2": "m1.x", "y2": "m1.y"}
    return f.select("trial_id", "frame_index", *[F.col(v).alias(k) for k, v in ends.items()], (F.abs("m2.x") / 500).alias("confidence"))


def _near_sql(c: str, k: int) -> str:
    return c if k == 0 else f"lag({c}, {k}) OVER r" if k > 0 else f"lead({c}, {-k}) OVER r"


def _weighted_sql(c: str) -> str:
    share = lambda k: f"CASE WHEN {_near_sql(c, k)} IS NOT NULL THEN {_near_sql('greatest(0.05, coalesce(confidence, 0.5))', k)} / {1 + abs(k)} END"
    total = " + ".join(f"coalesce({_near_sql(c, k)} * {share(k)}, 0)" for k in range(-2, 3))
    return f"round(({total}) / ({' + '.join(f'coalesce({share(k)}, 0)' for k in range(-2, 3))}), 6) AS {c}"


@query(f"""WITH {STICKS}, s AS (SELECT *, coalesce((frame_index - lag(frame_index) OVER w > 1)::INT, 1) AS st FROM sticks WINDOW w AS (PARTITION BY trial_id ORDER BY frame_index)), g AS (SELECT *, sum(st) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM s)
SELECT trial_id, frame_index, {", ".join(_weighted_sql(c) for c in ("x", "y", "x2", "y2"))} FROM g WINDOW r AS (PARTITION BY trial_id, run ORDER BY frame_index)""")
def smoothed_coordinates(spark, sf_dir):
    out = smoothing.smooth_coordinates(_sticks(spark, sf_dir), ["trial_id"], ["x", "y", "x2", "y2"], 5)
    return out.select("trial_id", "frame_index", *[r6(c).alias(c) for c in ("x", "y", "x2", "y2")])


_ANGLE = "coalesce(degrees(atan2(y - y2, x - x2)), 0)"
_TURN = f"abs((({_ANGLE} - lag({_ANGLE}) OVER w + 90) % 180 + 180) % 180 - 90)"
SWING = f"""{STICKS}, balls AS (SELECT trial_id, frame_index FROM frames WHERE m2y > 330), q AS (SELECT *, coalesce({_TURN} >= 60 AND frame_index - lag(frame_index) OVER w <= 1, false) AS fast FROM sticks WINDOW w AS (PARTITION BY trial_id ORDER BY frame_index)),
q2 AS (SELECT *, coalesce(lead(fast) OVER (PARTITION BY trial_id ORDER BY frame_index), false) AS nxt FROM q), fs AS (SELECT * FROM q2 WHERE fast OR nxt),
cs AS (SELECT *, sum(st) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM (SELECT *, coalesce((frame_index - lag(frame_index) OVER w > 3)::INT, 1) AS st FROM fs WINDOW w AS (PARTITION BY trial_id ORDER BY frame_index))),
cl AS (SELECT trial_id, run, count(*) AS n, min(frame_index) AS f0, max(frame_index) AS f1 FROM cs GROUP BY ALL), best AS (SELECT trial_id, arg_min(f0, (-n, run)) AS f0, arg_min(f1, (-n, run)) AS f1 FROM cl GROUP BY trial_id),
span AS (SELECT trial_id, min(frame_index) - 2 AS a, max(frame_index) + 2 AS b FROM balls GROUP BY trial_id),
swing AS (SELECT s.trial_id, s.frame_index FROM sticks s LEFT JOIN span USING (trial_id) LEFT JOIN best USING (trial_id) WHERE s.frame_index BETWEEN coalesce(a, f0 - 2) AND coalesce(b, f1 + 2))"""


def _balls(spark, sf_dir, above=330):
    return A.marker_frames(spark, sf_dir, [0, 1, 2]).filter(F.col("m2.y") > above).select("trial_id", "frame_index")


@query(f"WITH {SWING} SELECT * FROM swing")
def swing_frames(spark, sf_dir):
    return smoothing.swing_frames(_sticks(spark, sf_dir), _balls(spark, sf_dir), ["trial_id"], margin=2, fast=60.0)


@query(f"""WITH {SWING.replace('m2y > 330', 'm2y > 200')}, near AS (SELECT trial_id, frame_index + unnest(range(-1, 2)) AS frame_index, 0.9 * (1 - abs(unnest(range(-1, 2))) / 2) AS weight FROM balls
UNION ALL SELECT trial_id, frame_index + unnest(range(-2, 3)), 0.6 * (1 - abs(unnest(range(-2, 3))) / 3) FROM fs WHERE trial_id NOT IN (SELECT trial_id FROM swing))
SELECT trial_id, frame_index, round(max(weight), 9) AS weight FROM near GROUP BY ALL""")
def original_weights(spark, sf_dir):
    sticks, balls = _sticks(spark, sf_dir), _balls(spark, sf_dir, 200)
    swing = smoothing.swing_frames(sticks, balls, ["trial_id"], margin=2, fast=60.0)
    out = smoothing.original_weights(sticks, balls, swing, ["trial_id"], contact=(1, 0.9), fast=60.0, quick=(2, 0.6))
    return out.withColumn("weight", F.round("weight", 9))


@query(f"""{twins.OBJECT_SPEED.rsplit("SELECT clip_id", 1)[0]}, sp AS (SELECT clip_id, joint_name, frame_index, round(px, 6) AS px FROM fold WHERE joint_name IN ('right_elbow', 'right_wrist'))
SELECT t.clip_id, t.frame_index, max(t.x) FILTER (t.joint_name = 'right_elbow') AS bat_x, max(px) FILTER (t.joint_name = 'right_elbow') AS bat_speed_px_s, max(t.x) FILTER (t.joint_name = 'right_wrist') AS ball_x, max(px) FILTER (t.joint_name = 'right_wrist') AS ball_speed_px_s
FROM traj t LEFT JOIN sp USING (clip_id, joint_name, frame_index) WHERE t.joint_name IN ('right_elbow', 'right_wrist') GROUP BY t.clip_id, t.frame_index""")
def object_features(spark, sf_dir):
    names = {"bat": "right_elbow", "ball": "right_wrist"}
    found = A.traj(spark, sf_dir).filter(F.col("joint_name").isin(*names.values())).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    speeds = folds.object_speed(found, KJ, 8000.0)
    out = folds.object_features(speeds.withColumnRenamed("joint_name", "object_name"), ["clip_id"], names)
    return out.select("clip_id", "frame_index", "bat_x", r6("bat_speed_px_s").alias("bat_speed_px_s"), "ball_x", r6("ball_speed_px_s").alias("ball_speed_px_s"))


# ---- poses of a frame

_J = A.JOINTS.values()


@query(f"""WITH {GAPPY} SELECT clip_id, round(median(y) FILTER (joint_name IN ('right_shoulder', 'right_elbow')), 9) AS upper, CASE WHEN median(y) FILTER (joint_name IN ('right_shoulder', 'right_elbow')) < median(y) FILTER (joint_name IN ('left_hip', 'right_hip')) THEN -1 ELSE 1 END AS sign FROM gappy GROUP BY clip_id""")
def vertical_signs(spark, sf_dir):
    df = gappy(spark, sf_dir)
    signs = poses.vertical_sign(df, ["clip_id"], ["right_shoulder", "right_elbow"], ["left_hip", "right_hip"], "y")
    upper = df.filter(F.col("joint_name").isin("right_shoulder", "right_elbow")).groupBy("clip_id").agg(F.round(F.median("y"), 9).alias("upper"))
    return df.select("clip_id").distinct().join(signs, "clip_id").join(upper, "clip_id", "left")


@query(f"""WITH {A.TRAJ_FRAME}, w AS (SELECT clip_id, frame_index, {", ".join(f"max({a}) FILTER (joint_name = '{j}') AS {j}_{a}" for j in _J for a in "xy")} FROM traj_frame WHERE {SCORE} >= {TRUST} GROUP BY ALL)
SELECT clip_id, frame_index, {", ".join(f"round(coalesce((left_hip_{a} + right_hip_{a}) / 2, left_hip_{a}, right_hip_{a}, {', '.join(f'{j}_{a}' for j in _J)}), 9) AS p{a}" for a in "xy")} FROM w""")
def pelvis_centers(spark, sf_dir):
    from ..operators import features

    joints = list(_J)
    df = features.pivot_joints(A.traj_frame(spark, sf_dir).filter(C.trusted(C.pose_score(), TRUST)), ["clip_id"], joints, ["x", "y"])
    px, py = poses.pelvis_center(joints, ("x", "y"))
    return df.select("clip_id", "frame_index", F.round(px, 9).alias("px"), F.round(py, 9).alias("py"))
