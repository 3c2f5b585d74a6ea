"""Registered queries over the adapter views, each with its SQL twin.

Doubles that a different order of additions or a percentile's formula could change in the last bit are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions import geometry as G
from ..functions import scoring as S
from ..operators import body, completion, events, features, folds, gates, islands, kernels, metrics, reports, reshape, series, smoothing, windows
from ..schemas import LIMB_SEGMENTS
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K = A.KEYS
KJ = [*K, "joint_name"]
#: The segments that the adapter's joints can form.
SEGMENTS = (("right_shoulder", "right_elbow", "right_elbow"), ("right_elbow", "right_wrist", "right_wrist"))
SEGMENT_SQL = "segments(proximal, distal, reject_joint) AS (VALUES " + ", ".join(str(s) for s in SEGMENTS) + ")"
SCORE, TRUST = "least(visibility, confidence)", 0.3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def gappy(spark: SparkSession, sf_dir: str, threshold: float = TRUST) -> DataFrame:
    """traj whose points are missing where the score is low."""
    ok = C.trusted(C.pose_score(), threshold)
    return A.traj(spark, sf_dir).withColumns({"x": F.when(ok, F.col("x")), "y": F.when(ok, F.col("y"))})


GAPPY = f"{A.TRAJ}, gappy AS (SELECT * REPLACE (CASE WHEN {SCORE} >= {TRUST} THEN x END AS x, CASE WHEN {SCORE} >= {TRUST} THEN y END AS y) FROM traj)"


@query(f"""WITH {A.TRAJ}, s AS (
  SELECT clip_id, condition_id, joint_name, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step
  FROM traj WHERE {SCORE} >= {TRUST} WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index))
SELECT clip_id, condition_id, joint_name, round(avg(step), 6) AS jitter, count(step) AS n_steps FROM s GROUP BY ALL""")
def temporal_jitter(spark, sf_dir):
    df = A.traj(spark, sf_dir).filter(C.trusted(C.pose_score(), TRUST))
    return series.temporal_jitter(df, KJ, ["x", "y"]).withColumn("jitter", r6("jitter"))


@query(f"""WITH {A.TRAJ}, s AS (
  SELECT clip_id, condition_id, joint_name, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS dx, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS dy
  FROM traj WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index))
SELECT clip_id, condition_id, joint_name, round(avg(sqrt(dx * dx + dy * dy)), 6) AS smoothness, count(dx) AS n_triples FROM s GROUP BY ALL""")
def second_difference(spark, sf_dir):
    return series.second_difference(A.traj(spark, sf_dir), KJ, ["x", "y"]).withColumn("smoothness", r6("smoothness"))


THRESHOLDS = {"default": 0.5, "torso": 0.45, "mid_limb": 0.6, "distal": 0.65, "left_hip": 0.4}


@query(f"""WITH {A.TRAJ}, t AS (SELECT *, {SCORE} AS score,
  CASE WHEN joint_name = 'left_hip' THEN 0.4 WHEN joint_name IN ('right_shoulder', 'right_hip') THEN 0.45 WHEN joint_name = 'right_elbow' THEN 0.6 ELSE 0.65 END AS threshold,
  CASE WHEN joint_name IN ('left_hip', 'right_shoulder', 'right_hip') THEN 'torso' WHEN joint_name = 'right_elbow' THEN 'mid_limb' ELSE 'distal' END AS joint_group FROM traj)
SELECT joint_group, joint_name, threshold, count(*) AS n, count(*) FILTER (score >= threshold) AS n_trusted, round(avg(score), 6) AS mean_score FROM t GROUP BY ALL""")
def trust_by_joint(spark, sf_dir):
    df = A.traj(spark, sf_dir).withColumns({"score": C.pose_score(), "threshold": C.by_joint(THRESHOLDS, 0.5), "joint_group": C.joint_group()})
    return df.groupBy("joint_group", "joint_name", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.trusted(F.col("score"), F.col("threshold"))).alias("n_trusted"), r6(F.avg("score")).alias("mean_score"))


BODY_JOINTS = list(A.JOINTS.values())


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT clip_id, condition_id, frame_index, count(DISTINCT CASE WHEN {SCORE} >= {TRUST} THEN joint_name END) / 5 AS share FROM traj_frame GROUP BY ALL)
SELECT clip_id, condition_id, round(avg(share), 6) AS completeness, count(*) AS frames FROM f GROUP BY ALL""")
def frame_completeness(spark, sf_dir):
    return metrics.frame_completeness(A.traj_frame(spark, sf_dir), K, BODY_JOINTS, TRUST).withColumn("completeness", r6("completeness"))


@query(f"""WITH {A.TRAJ_FRAME} SELECT clip_id, condition_id, round(count(DISTINCT joint_name) / 5, 6) AS completeness FROM traj_frame GROUP BY ALL""")
def keypoint_completeness(spark, sf_dir):
    return metrics.completeness(A.traj_frame(spark, sf_dir), K, BODY_JOINTS).withColumn("completeness", r6("completeness"))


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT clip_id, condition_id, frame_index, max(CASE WHEN joint_name = 'right_wrist' AND {SCORE} >= {TRUST} THEN 1 ELSE 0 END) AS ok FROM traj_frame GROUP BY ALL)
SELECT clip_id, condition_id, round(1 - avg(ok), 6) AS missing_rate FROM f GROUP BY ALL""")
def wrist_missing_rate(spark, sf_dir):
    return metrics.missing_rate(A.traj_frame(spark, sf_dir), K, "right_wrist", TRUST).withColumn("missing_rate", r6("missing_rate"))


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT clip_id, condition_id, frame_index, arg_min(confidence, joint_name) AS v FROM traj_frame GROUP BY ALL)
SELECT clip_id, condition_id, round(avg(v), 6) AS mean_confidence FROM f GROUP BY ALL""")
def mean_runtime_per_frame(spark, sf_dir):
    return metrics.first_per_frame(A.traj_frame(spark, sf_dir), K, "confidence", "joint_name").withColumn("mean_confidence", r6("mean_confidence"))


@query(f"""WITH {A.TRAJ}, t AS (SELECT *, {SCORE} AS score FROM traj),
s AS (SELECT clip_id, condition_id, joint_name, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM t WHERE score >= 0.3 WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
l AS (SELECT clip_id, condition_id, joint_name, CASE WHEN count(*) >= 3 THEN greatest(coalesce(median(CASE WHEN step > 0 THEN step END), 0) * 1.2, 0.03) END AS lim, avg(step) AS mean_step, quantile_cont(step, 0.95) AS p95_step FROM s WHERE step IS NOT NULL GROUP BY ALL),
j AS (SELECT s.clip_id, s.condition_id, s.joint_name, count(*) FILTER (step > lim) AS jumps FROM s JOIN l USING (clip_id, condition_id, joint_name) GROUP BY ALL),
tot AS (SELECT clip_id, condition_id, joint_name, count(*) AS frames_total, count(*) FILTER (score >= 0.3) AS valid_frames, round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS valid_ratio, count(*) FILTER (score < 0.3) AS low_visibility_frames, round(median(score), 6) AS median_score FROM t GROUP BY ALL)
SELECT tot.*, round(mean_step, 6) AS mean_step, round(p95_step, 6) AS p95_step, coalesce(jumps, 0) AS jump_outlier_frames FROM tot LEFT JOIN l USING (clip_id, condition_id, joint_name) LEFT JOIN j USING (clip_id, condition_id, joint_name)""")
def joint_stability(spark, sf_dir):
    out = metrics.joint_stability(A.traj(spark, sf_dir), KJ, TRUST, multiplier=1.2)
    return out.withColumns({c: r6(c) for c in ("valid_ratio", "median_score", "mean_step", "p95_step")})


LENGTHS = f"""{A.TRAJ_FRAME}, {SEGMENT_SQL}, lengths AS (
  SELECT p.clip_id, p.condition_id, p.frame_index, s.proximal, s.distal, s.reject_joint, sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) AS length
  FROM traj_frame p JOIN segments s ON p.joint_name = s.proximal JOIN traj_frame d ON d.joint_name = s.distal AND d.clip_id = p.clip_id AND d.frame_index = p.frame_index)"""


@query(f"""WITH {LENGTHS}, m AS (SELECT clip_id, condition_id, proximal, distal, count(*) AS samples, median(length) AS median_length, stddev_pop(length) AS sd, avg(length) AS mean FROM lengths GROUP BY ALL)
SELECT m.clip_id, m.condition_id, m.proximal, m.distal, samples, round(median_length, 6) AS median_length, round(sd, 6) AS stdev_length, round(sd / CASE WHEN mean > 0 THEN mean END, 6) AS cv_length,
  count(*) FILTER (abs(length - median_length) / CASE WHEN median_length > 0 THEN median_length END > 0.28) AS outlier_samples
FROM m JOIN lengths l USING (clip_id, condition_id, proximal, distal) GROUP BY ALL""")
def limb_stability(spark, sf_dir):
    out = metrics.limb_stability(A.traj_frame(spark, sf_dir), K, ["x", "y"], 0.28)
    return out.withColumns({c: r6(c) for c in ("median_length", "stdev_length", "cv_length")})


@query(f"""WITH {LENGTHS}, m AS (SELECT clip_id, proximal, distal, median(length) AS median FROM lengths GROUP BY ALL),
bad AS (SELECT DISTINCT l.clip_id, l.frame_index, l.reject_joint FROM lengths l JOIN m USING (clip_id, proximal, distal) WHERE median > 0 AND abs(length - median) / median > 0.5)
SELECT t.clip_id, t.frame_index, t.joint_name, CASE WHEN bad.clip_id IS NULL THEN t.x END AS x, CASE WHEN bad.clip_id IS NULL THEN t.y END AS y
FROM traj_frame t LEFT JOIN bad ON bad.clip_id = t.clip_id AND bad.frame_index = t.frame_index AND bad.reject_joint = t.joint_name""")
def limb_length_gate(spark, sf_dir):
    return gates.limb_length_gate(A.traj_frame(spark, sf_dir), K, ["x", "y"], 0.5).select("clip_id", "frame_index", "joint_name", "x", "y")


@query(f"""WITH {GAPPY}, s AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf FROM gappy)
SELECT s.clip_id, s.joint_name, s.frame_index, round(sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) / CASE WHEN s.timestamp_sec > p.timestamp_sec THEN s.timestamp_sec - p.timestamp_sec END * 1e6, 3) AS speed
FROM s LEFT JOIN gappy p ON p.clip_id = s.clip_id AND p.joint_name = s.joint_name AND p.frame_index = s.pf""")
def point_speed(spark, sf_dir):
    out = series.speed(gappy(spark, sf_dir), KJ, ["x", "y"])
    return out.select("clip_id", "joint_name", "frame_index", F.round(F.col("speed") * 1e6, 3).alias("speed"))


@query(f"""WITH {A.TRAJ_FRAME}, w AS (SELECT clip_id, condition_id, frame_index, min(timestamp_sec) AS timestamp_sec,
    max(CASE WHEN joint_name = 'left_hip' THEN x END) AS lx, max(CASE WHEN joint_name = 'left_hip' THEN y END) AS ly, max(CASE WHEN joint_name = 'right_hip' THEN x END) AS hx, max(CASE WHEN joint_name = 'right_hip' THEN y END) AS hy,
    max(CASE WHEN joint_name = 'right_shoulder' THEN x END) AS sx, max(CASE WHEN joint_name = 'right_shoulder' THEN y END) AS sy, max(CASE WHEN joint_name = 'right_elbow' THEN x END) AS ex, max(CASE WHEN joint_name = 'right_elbow' THEN y END) AS ey,
    max(CASE WHEN joint_name = 'right_wrist' THEN x END) AS wx, max(CASE WHEN joint_name = 'right_wrist' THEN y END) AS wy FROM traj_frame GROUP BY ALL),
a AS (SELECT *, CASE WHEN hx <> lx OR hy <> ly THEN degrees(atan2(ly - hy + 0.0, hx - lx)) END AS rot,
    ((sx - ex) * (wx - ex) + (sy - ey) * (wy - ey)) / nullif(sqrt((sx - ex) * (sx - ex) + (sy - ey) * (sy - ey)) * sqrt((wx - ex) * (wx - ex) + (wy - ey) * (wy - ey)), 0) AS c FROM w),
p AS (SELECT *, max(CASE WHEN rot IS NOT NULL THEN frame_index END) OVER u AS rf, max(CASE WHEN wx IS NOT NULL THEN frame_index END) OVER u AS wf FROM a WINDOW u AS (PARTITION BY clip_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT p.clip_id, p.frame_index, round(CASE WHEN p.c IS NOT NULL THEN degrees(acos(greatest(-1, least(1, p.c)))) END, 6) AS right_elbow_angle_deg, round(p.rot, 6) AS pelvis_rotation_deg,
  round(((((p.rot - q.rot + 180) % 360) + 360) % 360 - 180) / (p.timestamp_sec - q.timestamp_sec), 4) AS pelvis_rotation_velocity_deg_s,
  round(sqrt((p.wx - v.wx) * (p.wx - v.wx) + (p.wy - v.wy) * (p.wy - v.wy)) / (p.timestamp_sec - v.timestamp_sec), 6) AS hand_speed_proxy,
  round((coalesce(p.sx, 0) + coalesce(p.lx, 0) + coalesce(p.hx, 0)) / nullif((p.sx IS NOT NULL)::INT + (p.lx IS NOT NULL)::INT + (p.hx IS NOT NULL)::INT, 0), 6) AS com_x
FROM p LEFT JOIN a q ON q.clip_id = p.clip_id AND q.frame_index = p.rf LEFT JOIN a v ON v.clip_id = p.clip_id AND v.frame_index = p.wf""")
def motion_features(spark, sf_dir):
    f = features.motion_features(A.traj_frame(spark, sf_dir), K)
    return f.select("clip_id", "frame_index", r6("right_elbow_angle_deg").alias("right_elbow_angle_deg"), r6("pelvis_rotation_deg").alias("pelvis_rotation_deg"), F.round("pelvis_rotation_velocity_deg_s", 4).alias("pelvis_rotation_velocity_deg_s"), r6("hand_speed_proxy").alias("hand_speed_proxy"), r6("com_x").alias("com_x"))


@query(f"""WITH {A.SCALARS} SELECT series, frame_index, round(avg(value) OVER (PARTITION BY series ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM scalars""")
def moving_average(spark, sf_dir):
    return series.moving_average(A.scalars(spark, sf_dir), ["series"], "value", 3).select("series", "frame_index", F.round("smooth", 4).alias("smooth"))


@query(f"""WITH {A.SCALARS} SELECT series, count(value) AS "count", round(avg(value), 7) AS mean, round(median(value), 7) AS median, min(value) AS min, max(value) AS max, round(max(value) - min(value), 7) AS "range", max(abs(value)) AS peak_abs,
  round(quantile_cont(value, 0.05), 7) AS p05, round(quantile_cont(value, 0.95), 7) AS p95, round(quantile_cont(abs(value), 0.95), 7) AS p95_abs FROM scalars GROUP BY series""")
def numeric_profile(spark, sf_dir):
    out = metrics.numeric_profile(A.scalars(spark, sf_dir), ["series"], "value")
    return out.withColumns({c: F.round(c, 7) for c in ("mean", "median", "range", "p05", "p95", "p95_abs")})


@query(f"""WITH {A.TRAJ}, u AS (SELECT joint_name, column_name, value FROM traj UNPIVOT (value FOR column_name IN (x, y, confidence)))
SELECT joint_name, column_name, count(value) AS "count", round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(abs(value), 0.95), 6) AS p95_abs FROM u GROUP BY ALL""")
def profile_columns(spark, sf_dir):
    out = metrics.profile_columns(A.traj(spark, sf_dir).select("joint_name", "x", "y", "confidence"), ["joint_name"], ["x", "y", "confidence"])
    return out.select("joint_name", "column_name", "count", r6("mean").alias("mean"), r6("median").alias("median"), r6("p95_abs").alias("p95_abs"))


FILL = """f AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY clip_id, joint_name) AS n FROM gappy WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
g AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY clip_id, joint_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bp,
  min(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY clip_id, joint_name ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap FROM f)"""


@query(f"""WITH {GAPPY}, {FILL}
SELECT g.clip_id, g.joint_name, g.frame_index, round(coalesce(g.x, CASE WHEN g.ap - g.bp - 1 <= 2 THEN b.x + (a.x - b.x) * ((g.pos - g.bp) / (g.ap - g.bp)) END, CASE WHEN g.bp IS NULL AND g.ap <= 2 THEN a.x END, CASE WHEN g.ap IS NULL AND g.n - g.bp - 1 <= 2 THEN b.x END), 9) AS x
FROM g LEFT JOIN f b ON b.clip_id = g.clip_id AND b.joint_name = g.joint_name AND b.pos = g.bp LEFT JOIN f a ON a.clip_id = g.clip_id AND a.joint_name = g.joint_name AND a.pos = g.ap""")
def fill_short_gaps(spark, sf_dir):
    return islands.fill_short_gaps(gappy(spark, sf_dir), KJ, ["x"], 2, edges=True).select("clip_id", "joint_name", "frame_index", F.round("x", 9).alias("x"))


@query(f"""WITH {GAPPY}, {FILL}, s AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, joint_name ORDER BY pos) AS seg FROM f)
SELECT clip_id, condition_id, joint_name, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS length FROM s WHERE x IS NOT NULL GROUP BY clip_id, condition_id, joint_name, seg""")
def valid_segments(spark, sf_dir):
    return islands.valid_segments(gappy(spark, sf_dir), KJ, "x").withColumns({c: F.col(c).cast("long") for c in ("start_pos", "end_pos")})


@query(f"""WITH {GAPPY}, m AS (SELECT *, min(CASE WHEN x IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, max(frame_index) OVER (PARTITION BY clip_id, joint_name) AS lf FROM gappy)
SELECT clip_id, condition_id, joint_name, min(frame_index) AS "start", coalesce(nx, lf + 1) AS "end", count(*) AS "rows" FROM m WHERE x IS NULL GROUP BY clip_id, condition_id, joint_name, coalesce(nx, lf + 1)""")
def missing_runs(spark, sf_dir):
    return islands.missing_runs(gappy(spark, sf_dir), KJ, F.col("x").isNotNull())


@query(f"""WITH {A.TRAJ}, s AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER w > 4 OR lag(frame_index) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM traj WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
c AS (SELECT *, sum(st) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index) AS run FROM s)
SELECT clip_id, condition_id, joint_name, CAST(run AS BIGINT) AS run, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS n FROM c GROUP BY clip_id, condition_id, joint_name, run""")
def frame_clusters(spark, sf_dir):
    out = islands.consecutive_runs(A.traj(spark, sf_dir), KJ, max_gap=3)
    return out.groupBy(*KJ, "run").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT DISTINCT clip_id, condition_id, frame_index FROM traj_frame WHERE {SCORE} >= 0.3),
i AS (SELECT *, frame_index - row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS isl FROM f), l AS (SELECT *, count(*) OVER (PARTITION BY clip_id, isl) AS n FROM i)
SELECT clip_id, condition_id, frame_index FROM l WHERE n >= 3""")
def drop_short_runs(spark, sf_dir):
    f = A.traj_frame(spark, sf_dir).filter(C.trusted(C.pose_score(), TRUST)).select(*K, "frame_index").distinct()
    return islands.drop_short_runs(f, K, 3)


@query(f"""WITH {GAPPY}, {FILL}, h AS (SELECT g.*, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY clip_id, joint_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp, min(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY clip_id, joint_name ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM g),
d AS (SELECT h.clip_id, h.joint_name, h.frame_index, h.pos, h.n, h.x, sqrt((h.x - p.x) * (h.x - p.x) + (h.y - p.y) * (h.y - p.y)) AS dp, sqrt((h.x - q.x) * (h.x - q.x) + (h.y - q.y) * (h.y - q.y)) AS dn, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dd
  FROM h LEFT JOIN f p ON p.clip_id = h.clip_id AND p.joint_name = h.joint_name AND p.pos = h.pp LEFT JOIN f q ON q.clip_id = h.clip_id AND q.joint_name = h.joint_name AND q.pos = h.np),
m AS (SELECT *, median(CASE WHEN dp > 0 THEN dp END) OVER (PARTITION BY clip_id, joint_name) AS med, count(x) OVER (PARTITION BY clip_id, joint_name) AS pts FROM d)
SELECT clip_id, joint_name, frame_index, coalesce(pts >= 5 AND med IS NOT NULL AND pos > 0 AND pos < n - 1 AND dp > greatest(med * 1.1, 0.03) AND dn > greatest(med * 1.1, 0.03) AND dd < greatest(med * 1.1, 0.03), false) AS jump FROM m""")
def isolated_jumps(spark, sf_dir):
    return gates.isolated_jumps(gappy(spark, sf_dir), KJ, 1.1).select("clip_id", "joint_name", "frame_index", "jump")


CENTERS = f"""{A.TRAJ_FRAME}, ok AS (SELECT * FROM traj_frame WHERE {SCORE} >= 0.3),
fr AS (SELECT DISTINCT clip_id, condition_id, frame_index FROM traj_frame),
w AS (SELECT fr.clip_id, fr.condition_id, fr.frame_index, max(CASE WHEN joint_name = 'left_hip' THEN x END) AS lx, max(CASE WHEN joint_name = 'left_hip' THEN y END) AS ly, max(CASE WHEN joint_name = 'right_hip' THEN x END) AS rx, max(CASE WHEN joint_name = 'right_hip' THEN y END) AS ry,
  avg(CASE WHEN joint_name IN ('left_hip', 'right_hip', 'right_shoulder') THEN x END) AS ax, avg(CASE WHEN joint_name IN ('left_hip', 'right_hip', 'right_shoulder') THEN y END) AS ay FROM fr LEFT JOIN ok USING (clip_id, condition_id, frame_index) GROUP BY ALL),
centers AS (SELECT clip_id, condition_id, frame_index, coalesce((lx + rx) / 2, ax) AS cx, coalesce((ly + ry) / 2, ay) AS cy FROM w)"""


@query(f"WITH {CENTERS} SELECT clip_id, condition_id, frame_index, round(cx, 9) AS cx, round(cy, 9) AS cy FROM centers")
def torso_centers(spark, sf_dir):
    return gates.torso_centers(A.traj_frame(spark, sf_dir), K, TRUST).withColumns({"cx": F.round("cx", 9), "cy": F.round("cy", 9)})


@query()
def torso_continuity(spark, sf_dir):
    out = folds.torso_continuity(gates.torso_centers(A.traj_frame(spark, sf_dir), K, TRUST), K, 1.5, 0.06)
    return out.withColumns({"cx": F.round("cx", 9), "cy": F.round("cy", 9)})


@query(f"""WITH {GAPPY}, o AS (SELECT clip_id, condition_id, frame_index, joint_name, x, y, confidence FROM gappy WHERE x IS NOT NULL),
p AS (SELECT *, lead(frame_index) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(confidence) OVER w AS nc FROM o WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
e AS (SELECT *, unnest(range(1, nf - frame_index)) AS step FROM p WHERE nf - frame_index - 1 BETWEEN 1 AND 4)
SELECT e.clip_id, e.condition_id, e.joint_name, e.frame_index + step AS frame_index, round(e.x + (nx - e.x) * (step / (nf - e.frame_index)), 9) AS x, round(e.y + (ny - e.y) * (step / (nf - e.frame_index)), 9) AS y, round(least(e.confidence, nc) * 0.75, 9) AS confidence, round(m.timestamp_sec, 6) AS timestamp_sec
FROM e JOIN (SELECT DISTINCT clip_id, frame_index, timestamp_sec FROM traj) m ON m.clip_id = e.clip_id AND m.frame_index = e.frame_index + step""")
def object_gap_rows(spark, sf_dir):
    found = gappy(spark, sf_dir).filter("x is not null").select(*KJ, "frame_index", "x", "y", "confidence")
    frames = A.traj(spark, sf_dir).select("clip_id", "frame_index", "timestamp_sec")
    out = islands.new_rows_in_gaps(found, KJ, frames, ["x", "y"], 4)
    return out.select(*KJ, "frame_index", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("confidence", 9).alias("confidence"), r6("timestamp_sec").alias("timestamp_sec"))


@query(f"""WITH {A.TRAJ}, s AS (SELECT *, CASE WHEN lag(frame_index) OVER w IS NULL OR frame_index - lag(frame_index) OVER w > 7 OR sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) > 0.4 * sqrt(2) THEN 1 ELSE 0 END AS st FROM traj WINDOW w AS (PARTITION BY clip_id, joint_name ORDER BY frame_index)),
c AS (SELECT *, sum(st) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index) AS run FROM s), l AS (SELECT *, count(*) OVER (PARTITION BY clip_id, joint_name, run) AS n FROM c)
SELECT clip_id, joint_name, frame_index, CAST(run AS BIGINT) AS run FROM l WHERE n >= 3""")
def long_tracks(spark, sf_dir):
    return islands.long_tracks(A.traj(spark, sf_dir), KJ, least=3, max_gap=6, max_jump=0.4).select("clip_id", "joint_name", "frame_index", "run")


@query()
def object_speed(spark, sf_dir):
    df = A.traj(spark, sf_dir).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    out = folds.object_speed(df, KJ, 8000.0)
    return out.select("clip_id", "joint_name", "frame_index", r6("speed_px_s").alias("speed_px_s"), F.round("speed_norm_s", 9).alias("speed_norm_s"))


@query(f"""WITH {GAPPY}, n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_frame,
  min(CASE WHEN x IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_frame FROM gappy)
SELECT n.clip_id, n.joint_name, n.frame_index, before_frame, after_frame, b.x AS before_x, a.x AS after_x FROM n LEFT JOIN gappy b ON b.clip_id = n.clip_id AND b.frame_index = before_frame LEFT JOIN gappy a ON a.clip_id = n.clip_id AND a.frame_index = after_frame""")
def nearest_usable(spark, sf_dir):
    out = series.neighbours(gappy(spark, sf_dir), KJ, F.col("x").isNotNull(), ["x"])
    return out.select("clip_id", "joint_name", "frame_index", F.col("before.frame_index").alias("before_frame"), F.col("after.frame_index").alias("after_frame"), F.col("before.x").alias("before_x"), F.col("after.x").alias("after_x"))


@query(f"""WITH {GAPPY}, n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
  min(CASE WHEN x IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM gappy),
t AS (SELECT n.clip_id, n.joint_name, n.frame_index, r.x, r.y, b.x AS bx, b.y AS by_, a.x AS ax, a.y AS ay, bf, af FROM n JOIN traj r ON r.clip_id = n.clip_id AND r.frame_index = n.frame_index LEFT JOIN gappy b ON b.clip_id = n.clip_id AND b.frame_index = bf LEFT JOIN gappy a ON a.clip_id = n.clip_id AND a.frame_index = af)
SELECT clip_id, joint_name, frame_index, CASE WHEN bf IS NOT NULL AND af IS NOT NULL THEN sqrt((bx + (ax - bx) * ((frame_index - bf) / (af - bf)) - x) ** 2 + (by_ + (ay - by_) * ((frame_index - bf) / (af - bf)) - y) ** 2) <= 0.3
  WHEN bf IS NULL AND af IS NULL THEN true ELSE abs(frame_index - coalesce(bf, af)) <= 3 AND sqrt((coalesce(bx, ax) - x) ** 2 + (coalesce(by_, ay) - y) ** 2) <= 0.3 END AS plausible FROM t""")
def temporally_plausible(spark, sf_dir):
    out = completion.temporally_plausible(A.traj(spark, sf_dir), K, C.trusted(C.pose_score(), TRUST), 0.3)
    return out.select("clip_id", "joint_name", "frame_index", "plausible")


@query()
def complete_limbs(spark, sf_dir):
    return completion.complete_limbs(A.traj_frame(spark, sf_dir), K, threshold=0.4, max_gap=3).select("clip_id", "frame_index", "joint_name", "x", "y", "confidence", "backend")


@query(f"""WITH {A.TRAJ} SELECT clip_id, condition_id, joint_name, max(x) AS peak, arg_min(frame_index, (-x, frame_index)) AS peak_frame, arg_min(y, (-x, frame_index)) AS y FROM traj GROUP BY ALL""")
def first_peak(spark, sf_dir):
    return series.first_peak(A.traj(spark, sf_dir), KJ, F.col("x"), carry=["y"])


@query(f"""WITH {A.TRAJ} SELECT clip_id, condition_id, joint_name, arg_min(frame_index, (abs(frame_index - 30), frame_index)) AS nearest_frame FROM traj GROUP BY ALL""")
def nearest_frame(spark, sf_dir):
    return series.nearest_frame(A.traj(spark, sf_dir), KJ, F.lit(30))


BOXES = f"""{A.TRAJ_FRAME}, boxes AS (SELECT clip_id, condition_id, frame_index, count(*) AS joints, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM traj_frame WHERE {SCORE} >= 0.1 GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"""WITH {BOXES}, e AS (SELECT clip_id, condition_id, quantile_cont(x0, 0.10) AS x0, quantile_cont(y0, 0.05) AS y0, quantile_cont(x1, 0.90) AS x1, quantile_cont(y1, 0.95) AS y1, count(*) AS frames FROM boxes GROUP BY ALL)
SELECT clip_id, condition_id, round(greatest(0, least(1, x0 - (x1 - x0) * 0.1)), 6) AS x0, round(greatest(0, least(1, y0 - (y1 - y0) * 0.1)), 6) AS y0, round(greatest(0, least(1, x1 + (x1 - x0) * 0.1)), 6) AS x1, round(greatest(0, least(1, y1 + (y1 - y0) * 0.1)), 6) AS y1, frames FROM e""")
def prior_region(spark, sf_dir):
    boxes = metrics.frame_boxes(A.traj_frame(spark, sf_dir), K, least_joints=2, threshold=0.1)
    return metrics.prior_region(boxes, K).withColumns({c: r6(c) for c in ("x0", "y0", "x1", "y1")})


@query(f"""WITH {BOXES} SELECT clip_id, condition_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY ALL""")
def union_box(spark, sf_dir):
    return metrics.union_box(metrics.frame_boxes(A.traj_frame(spark, sf_dir), K, least_joints=2, threshold=0.1), K)


@query(f"""WITH {BOXES}, u AS (SELECT clip_id, min(x0) AS bx, min(y0) AS by_, max(x1) - min(x0) AS bw, max(y1) - min(y0) AS bh FROM boxes GROUP BY ALL)
SELECT t.clip_id, t.frame_index, t.joint_name, round((bx + x * bw) / 2, 9) AS full_x, round((by_ + y * bh) / 2, 9) AS full_y FROM traj_frame t JOIN u USING (clip_id)""")
def remap_to_full_frame(spark, sf_dir):
    points = A.traj_frame(spark, sf_dir)
    u = metrics.union_box(metrics.frame_boxes(points, K, least_joints=2, threshold=0.1), K)
    box = [F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")]
    full = G.to_full_frame(F.col("x"), F.col("y"), box, F.lit(2), F.lit(2))
    return points.join(u, K).select("clip_id", "frame_index", "joint_name", F.round(full[0], 9).alias("full_x"), F.round(full[1], 9).alias("full_y"))


SCORED_SQL = f"""{A.TRAJ_FRAME}, w AS (SELECT clip_id, condition_id, frame_index, max(x) AS a, max(y) * 3 AS b, sum(x) AS c FROM traj_frame GROUP BY ALL),
sc AS (SELECT clip_id, greatest(coalesce(quantile_cont(CASE WHEN a > 0 THEN a END, 0.95), 1), 1) AS sa, greatest(coalesce(quantile_cont(CASE WHEN b > 0 THEN b END, 0.95), 1), 1) AS sb, greatest(coalesce(quantile_cont(CASE WHEN c > 0 THEN c END, 0.95), 1), 1) AS sc FROM w GROUP BY ALL),
raw AS (SELECT w.*, 0.55 * least(a / sa, 2) + 0.25 * least(b / sb, 2) + 0.20 * least(c / sc, 2) AS r FROM w JOIN sc USING (clip_id)),
scored AS (SELECT *, round(avg(r) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS score, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) - 1 AS pos, count(*) OVER (PARTITION BY clip_id) AS n FROM raw)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.traj_frame(spark, sf_dir).groupBy(*K, "frame_index").agg(F.max("x").alias("a"), (F.max("y") * 3).alias("b"), F.sum("x").alias("c"))
    return windows.motion_score(f, K, windows.BATTING, ("a", "b", "c")).withColumn("score", F.round("score", 9))


@query(f"WITH {SCORED_SQL} SELECT clip_id, frame_index, round(score, 6) AS score FROM scored")
def motion_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("clip_id", "frame_index", r6("score").alias("score"))


CORE_SQL = f"""{SCORED_SQL}, pk AS (SELECT clip_id, max(score) AS peak, arg_min(pos, (-score, pos)) AS pp FROM scored GROUP BY ALL),
lr AS (SELECT s.clip_id, any_value(peak) AS peak, any_value(pp) AS pp, any_value(n) AS n, coalesce(max(CASE WHEN score < greatest(peak * 0.42, 0.28) AND pos < pp THEN pos END), -1) + 1 AS sp, coalesce(min(CASE WHEN score < greatest(peak * 0.42, 0.28) AND pos > pp THEN pos END), any_value(n)) - 1 AS ep FROM scored s JOIN pk USING (clip_id) GROUP BY s.clip_id)"""


ACTION_SQL = f"""{CORE_SQL}, p AS (SELECT *, greatest(0, sp - 8) AS a, least(n - 1, ep + 8) AS b FROM lr), q AS (SELECT *, greatest(0, 24 - (b - a + 1)) AS d FROM p),
q2 AS (SELECT *, greatest(0, a - d // 2) AS a2, least(n - 1, b + (d - d // 2)) AS b2 FROM q), z AS (SELECT *, greatest(0, pp - 27) AS f, least(n - 1, greatest(0, pp - 27) + 53) AS l FROM q2),
o AS (SELECT clip_id, CASE WHEN b2 - a2 + 1 > 54 THEN (CASE WHEN l - f + 1 < 54 THEN greatest(0, l - 53) ELSE f END) ELSE a2 END AS start_index, CASE WHEN b2 - a2 + 1 > 54 THEN l ELSE b2 END AS end_index, pp AS peak_index FROM z),
placed AS (SELECT o.clip_id, start_index, end_index, peak_index, s.frame_index AS start_frame, e.frame_index AS end_frame, end_index - start_index + 1 AS frame_count FROM o JOIN scored s ON s.clip_id = o.clip_id AND s.pos = start_index JOIN scored e ON e.clip_id = o.clip_id AND e.pos = end_index)"""


@query(f"WITH {ACTION_SQL} SELECT * FROM placed")
def action_window(spark, sf_dir):
    out = windows.action_window(_scored(spark, sf_dir), K)
    return out.select("clip_id", *[F.col(c).cast("long").alias(c) for c in ("start_index", "end_index", "peak_index", "start_frame", "end_frame", "frame_count")])


@query()
def video_window(spark, sf_dir):
    out = windows.video_window(_scored(spark, sf_dir), K).withColumn("peak_score", r6("peak_score"))
    return out.select("clip_id", "peak_score", *[F.col(c).cast("long").alias(c) for c in out.columns if c.endswith(("index", "frame", "count"))])


@query()
def rows_in_action_window(spark, sf_dir):
    return windows.action_rows(_scored(spark, sf_dir), K).select("clip_id", "frame_index", "score")


def _m(k: int) -> list[Column]:
    return [F.col(f"m{k}.{a}") for a in "xyz"]


def _dist_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({b}{c} - {a}{c}) * ({b}{c} - {a}{c})" for c in "xyz") + ")"


@query(f"""WITH {A.MARKERS} SELECT trial_id, marker, frame_index, round({'sqrt(' + ' + '.join(f'({a} - lag({a}) OVER w) * ({a} - lag({a}) OVER w)' for a in 'xyz') + ')'} * 100 * 0.0036, 6) AS speed_kmh FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index)""")
def marker_speed_kmh(spark, sf_dir):
    out = series.steps(A.markers(spark, sf_dir), ["trial_id", "marker"], ["x", "y", "z"])
    return out.select("trial_id", "marker", "frame_index", r6(F.col("step") * 100 * 0.0036).alias("speed_kmh"))


@query(f"""WITH {A.MARKERS}, d AS (SELECT *, x - lag(x) OVER w AS b, lead(x) OVER w - x AS a, timestamp_sec - lag(timestamp_sec) OVER w AS hb, lead(timestamp_sec) OVER w - timestamp_sec AS ha FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index))
SELECT trial_id, marker, frame_index, round(coalesce((hb * hb * a + ha * ha * b) / (ha * hb * (ha + hb)), a / ha, b / hb), 3) AS velocity FROM d""")
def central_gradient(spark, sf_dir):
    return series.gradient(A.markers(spark, sf_dir), ["trial_id", "marker"], "x", name="velocity").select("trial_id", "marker", "frame_index", F.round("velocity", 3).alias("velocity"))


@query(f"""WITH {A.MARKERS}, d AS (SELECT trial_id, marker, timestamp_sec - lag(timestamp_sec) OVER (PARTITION BY trial_id, marker ORDER BY frame_index) AS dt FROM markers)
SELECT trial_id, marker, round(1 / median(CASE WHEN dt > 0 THEN dt END), 4) AS rate_hz FROM d GROUP BY ALL""")
def sampling_rate(spark, sf_dir):
    return series.sampling_rate(A.markers(spark, sf_dir), ["trial_id", "marker"]).withColumn("rate_hz", F.round("rate_hz", 4))


def _angle_sql(a: str, b: str, c: str) -> str:
    d = " + ".join(f"({a}{x} - {b}{x}) * ({c}{x} - {b}{x})" for x in "xyz")
    return f"degrees(acos(greatest(-1, least(1, ({d}) / nullif({_dist_sql(b, a)} * {_dist_sql(b, c)}, 0)))))"


@query(f"""WITH {A.marker_frames_sql([0, 1, 2, 3])} SELECT trial_id, frame_index, round({_angle_sql('m0', 'm1', 'm2')}, 6) AS angle_deg, round(180 - {_angle_sql('m0', 'm1', 'm2')}, 6) AS flexion_deg,
  round(degrees(atan2(m3y - m0y, m3x - m0x)), 6) AS heading_deg, round(degrees(atan2(m3z - m0z, sqrt((m3x - m0x) * (m3x - m0x) + (m3y - m0y) * (m3y - m0y)))), 6) AS elevation_deg FROM frames""")
def marker_angles(spark, sf_dir):
    f, d = A.marker_frames(spark, sf_dir, [0, 1, 2, 3]), G.minus(_m(3), _m(0))
    return f.select("trial_id", "frame_index", r6(G.joint_angle(_m(0), _m(1), _m(2))).alias("angle_deg"), r6(G.flexion(_m(0), _m(1), _m(2))).alias("flexion_deg"), r6(G.heading(d[0], d[1])).alias("heading_deg"), r6(G.elevation(d)).alias("elevation_deg"))


HEADING_SQL = f"""{A.marker_frames_sql([0, 3])}, h AS (SELECT trial_id, frame_index, degrees(atan2(m3y - m0y, m3x - m0x)) AS a FROM frames), t AS (SELECT *, coalesce((((a - lag(a) OVER w + 180) % 360) + 360) % 360 - 180, 0) AS turn FROM h WINDOW w AS (PARTITION BY trial_id ORDER BY frame_index)),
u AS (SELECT trial_id, frame_index, first_value(a) OVER w + sum(turn) OVER w AS unwrapped FROM t WINDOW w AS (PARTITION BY trial_id ORDER BY frame_index))"""


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.minus(_m(3), _m(0))
    return A.marker_frames(spark, sf_dir, [0, 3]).select("trial_id", "frame_index", G.heading(d[0], d[1]).alias("angle"))


@query(f"WITH {HEADING_SQL} SELECT trial_id, frame_index, round(unwrapped, 4) AS unwrapped FROM u")
def unwrapped_heading(spark, sf_dir):
    return series.unwrapped(_headings(spark, sf_dir), ["trial_id"], "angle").select("trial_id", "frame_index", F.round("unwrapped", 4).alias("unwrapped"))


@query(f"WITH {HEADING_SQL} SELECT trial_id, round(max(unwrapped) - min(unwrapped), 4) AS rotation_range FROM u GROUP BY ALL")
def rotation_range(spark, sf_dir):
    return series.rotation_range(_headings(spark, sf_dir), ["trial_id"], "angle").withColumn("rotation_range", F.round("rotation_range", 4))


@query(f"""WITH {A.MARKERS}, p AS (SELECT *, {', '.join(f'lag({a}) OVER w AS p{a}, lead({a}) OVER w AS r{a}' for a in 'xyz')} FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index)),
s AS (SELECT trial_id, marker, frame_index, {_dist_sql('', 'r').replace('- x', '- x')} AS a, {_dist_sql('p', 'r')} AS b, {_dist_sql('p', '')} AS c FROM p), h AS (SELECT *, (a + b + c) / 2 AS s FROM s)
SELECT trial_id, marker, frame_index, round(CASE WHEN a * b * c IS NOT NULL THEN 4 * sqrt(greatest(s * (s - a) * (s - b) * (s - c), 0)) / nullif(a * b * c, 0) END, 6) AS curvature FROM h""")
def path_curvature(spark, sf_dir):
    return series.curvature(A.markers(spark, sf_dir), ["trial_id", "marker"], ["x", "y", "z"]).select("trial_id", "marker", "frame_index", r6("curvature").alias("curvature"))


@query(f"""WITH {A.MARKERS}, r AS (SELECT *, row_number() OVER (PARTITION BY trial_id, marker ORDER BY z, frame_index) AS rk FROM markers) SELECT trial_id, marker, frame_index, rk AS "rank", round(z, 6) AS z FROM r WHERE rk <= 5""")
def lowest_contact_frames(spark, sf_dir):
    out = reshape.lowest(A.markers(spark, sf_dir), ["trial_id", "marker"], "z", 5)
    return out.select("trial_id", "marker", "frame_index", F.col("rank").cast("long").alias("rank"), r6("z").alias("z"))


SWING_SQL = f"""{A.MARKERS}, sp AS (SELECT trial_id, marker, frame_index, {'sqrt(' + ' + '.join(f'({a} - lag({a}) OVER w) * ({a} - lag({a}) OVER w)' for a in 'xyz') + ')'} * 100 * 0.0036 AS v FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index)),
sm AS (SELECT trial_id, marker, frame_index, row_number() OVER (PARTITION BY trial_id, marker ORDER BY frame_index) - 1 AS pos, count(*) OVER (PARTITION BY trial_id, marker) AS n, round(avg(v) OVER (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS s FROM sp),
pk AS (SELECT trial_id, marker, max(s) AS peak, arg_min(pos, (-s, pos)) AS pp FROM sm WHERE s IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {SWING_SQL} SELECT sm.trial_id, sm.marker, round(any_value(peak), 6) AS peak, CAST(any_value(pp) AS BIGINT) AS peak_pos, CAST(coalesce(max(CASE WHEN NOT coalesce(s >= greatest(8, 0.8 * peak), false) AND pos < pp THEN pos END), -1) + 1 AS BIGINT) AS start_pos,
  CAST(coalesce(min(CASE WHEN NOT coalesce(s >= greatest(8, 0.8 * peak), false) AND pos > pp THEN pos END), any_value(n)) - 1 AS BIGINT) AS end_pos FROM sm JOIN pk USING (trial_id, marker) GROUP BY sm.trial_id, sm.marker""")
def swing_segment(spark, sf_dir):
    keys = ["trial_id", "marker"]
    v = series.steps(A.markers(spark, sf_dir), keys, ["x", "y", "z"]).withColumn("v", F.col("step") * 100 * 0.0036)
    s = series.moving_average(v, keys, "v", 2, name="s").withColumn("s", F.round("s", 9))
    out = islands.around_peak(s, keys, "s", F.greatest(F.lit(8.0), 0.8 * F.col("peak")))
    return out.select(*keys, r6("peak").alias("peak"), *[F.col(c).cast("long").alias(c) for c in ("peak_pos", "start_pos", "end_pos")])


@query(f"""WITH {A.MARKERS}, n AS (SELECT *, row_number() OVER (PARTITION BY trial_id, marker ORDER BY frame_index) AS i, count(*) OVER (PARTITION BY trial_id, marker) AS n FROM markers)
SELECT trial_id, marker, round(avg(CASE WHEN i > n - greatest(1, floor(n * 0.1)) THEN x END) - avg(CASE WHEN i <= greatest(1, floor(n * 0.1)) THEN x END), 6) AS d_x, round(avg(CASE WHEN i > n - greatest(1, floor(n * 0.1)) THEN y END) - avg(CASE WHEN i <= greatest(1, floor(n * 0.1)) THEN y END), 6) AS d_y FROM n GROUP BY ALL""")
def end_displacement(spark, sf_dir):
    return series.end_displacement(A.markers(spark, sf_dir), ["trial_id", "marker"], ["x", "y"]).withColumns({"d_x": r6("d_x"), "d_y": r6("d_y")})


@query(f"""WITH {A.MARKERS}, e AS (SELECT *, {', '.join(f'first_value({a}) OVER w AS f{a}, last_value({a}) OVER w AS l{a}' for a in 'xyz')} FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT trial_id, marker, frame_index, round(({' + '.join(f'({a} - f{a}) * (l{a} - f{a})' for a in 'xyz')}) / nullif({_dist_sql('f', 'l')}, 0), 6) + 0.0 AS along_axis FROM e""")
def along_movement_axis(spark, sf_dir):
    return series.along_movement_axis(A.markers(spark, sf_dir), ["trial_id", "marker"], ["x", "y", "z"]).select("trial_id", "marker", "frame_index", r6("along_axis").alias("along_axis"))


@query()
def jumps_3d(spark, sf_dir):
    return folds.jumps_3d(A.markers(spark, sf_dir), ["trial_id", "marker"], ["x", "y", "z"], 1.2)


@query()
def savitzky_golay(spark, sf_dir):
    """All rows, the ends and short series too; tests hold it against polynomials fitted window by window."""
    s = kernels.savitzky_golay(A.scalars(spark, sf_dir), ["series"], ["value"], 5, 2)
    return s.select("series", "frame_index", F.round("value", 3).alias("smooth"))


@query(f"""WITH {A.SCALARS}, w AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, coalesce(lag(value) OVER w, value) AS b, coalesce(lead(value) OVER w, value) AS a FROM scalars WINDOW w AS (PARTITION BY series ORDER BY frame_index))
SELECT series, frame_index, CASE WHEN n < 3 THEN value ELSE value + a + b - greatest(value, a, b) - least(value, a, b) END AS raw, round(CASE WHEN n < 3 THEN value ELSE value + a + b - greatest(value, a, b) - least(value, a, b) END, 2) AS median3 FROM w""".replace("CASE WHEN n < 3 THEN value ELSE value + a + b - greatest(value, a, b) - least(value, a, b) END AS raw, ", ""))
def median_filter(spark, sf_dir):
    s = kernels.median_filter(A.scalars(spark, sf_dir), ["series"], ["value"], 3)
    return s.select("series", "frame_index", F.round("value", 2).alias("median3"))


@query(f"""WITH {A.SCALARS}, w AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, coalesce(lag(value) OVER w, value) AS b, coalesce(lead(value) OVER w, value) AS a FROM scalars WINDOW w AS (PARTITION BY series ORDER BY frame_index))
SELECT series, frame_index, round(CASE WHEN n < 3 THEN value ELSE (b + value + a) / 3 END, 4) AS mean3 FROM w""")
def mean_filter(spark, sf_dir):
    s = kernels.mean_filter(A.scalars(spark, sf_dir), ["series"], ["value"], 3, "skip")
    return s.select("series", "frame_index", F.round("value", 4).alias("mean3"))


@query(f"""WITH {A.ENTITY_METRICS} SELECT entity, segment, {', '.join(f'''max(CASE WHEN metric = '{p}' THEN value END) AS "{p}"''' for p in A.PRIORITIES)} FROM entity_metrics GROUP BY entity, segment""")
def metrics_to_wide(spark, sf_dir):
    return reshape.to_wide(A.entity_metrics(spark, sf_dir), ["entity", "segment"], "metric", "value", A.PRIORITIES)


@query(f"""WITH {A.ENTITY_METRICS} SELECT entity, metric AS metric_name, value FROM entity_metrics WHERE metric IN ('1-URGENT', '2-HIGH')""")
def metrics_to_long(spark, sf_dir):
    wide = reshape.to_wide(A.entity_metrics(spark, sf_dir), ["entity"], "metric", "value", A.PRIORITIES[:2])
    return reshape.to_long(wide, ["entity"], A.PRIORITIES[:2]).filter("value is not null")


PEER_SQL = f"""{A.ENTITY_METRICS}, peer AS (SELECT segment, metric, round(avg(value), 4) AS peer FROM entity_metrics GROUP BY ALL)"""


def _with_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.entity_metrics(spark, sf_dir)
    peer = m.groupBy("segment", "metric").agg(F.round(F.avg("value"), 4).alias("peer"))
    return m.join(peer, ["segment", "metric"])


@query(f"""WITH {PEER_SQL}, j AS (SELECT entity, metric, value, peer, abs(value - peer) / greatest(abs(peer), 1) AS gap FROM entity_metrics JOIN peer USING (segment, metric)), s AS (SELECT *, CASE WHEN gap <= 0.12 THEN 100 - gap / 0.12 * 8 WHEN gap <= 0.3 THEN 92 - (gap - 0.12) / 0.18 * 22 WHEN gap <= 0.6 THEN 70 - (gap - 0.3) / 0.3 * 30 ELSE greatest(20, 40 - (gap - 0.6) / 0.4 * 20) END AS sc FROM j)
SELECT entity, metric, round(sc, 4) AS score, CASE WHEN sc >= 85 THEN 'good' WHEN sc >= 65 THEN 'review' ELSE 'risk' END AS verdict, round((value - peer) / peer * 100, 4) AS diff_pct FROM s""")
def standard_scores(spark, sf_dir):
    j = _with_peer(spark, sf_dir).withColumn("s", S.standard_score(F.col("value"), F.col("peer"), F.lit(False)))
    return j.select("entity", "metric", F.round("s", 4).alias("score"), S.verdict(F.col("s")).alias("verdict"), F.round(S.difference_percent(F.col("value"), F.col("peer")), 4).alias("diff_pct"))


@query(f"""WITH {PEER_SQL} SELECT entity, metric, CAST(greatest(5, least(100, round_even(value / peer * 100, 0))) AS INTEGER) AS ratio, CAST(greatest(10, least(100, round_even(100 - abs(value - peer) / 100000 * 100, 0))) AS INTEGER) AS close,
  round(greatest(0, least(100, 100 - abs(value - peer) / abs(peer) * 100)), 4) AS gap, CASE WHEN value BETWEEN 80000 AND 200000 THEN 'ok' WHEN value BETWEEN 80000 - 120000 * 0.35 AND 200000 + 120000 * 0.35 THEN 'warn' ELSE 'bad' END AS band,
  round(greatest(0, least(100, (value - 1000) / 400000 * 100)), 9) AS linear FROM entity_metrics JOIN peer USING (segment, metric)""")
def peer_scores(spark, sf_dir):
    v, p = F.col("value"), F.col("peer")
    low, high = F.lit(80000.0), F.lit(200000.0)
    return _with_peer(spark, sf_dir).select("entity", "metric", S.ratio_score(v, p).alias("ratio"), S.close_score(v, p, 100000.0).alias("close"), F.round(S.gap_score(v, p, low, high), 4).alias("gap"), S.band_status(v, low, high).alias("band"), F.round(S.linear_score(v, F.lit(1000.0), F.lit(401000.0)), 9).alias("linear"))


@query(f"""WITH {PEER_SQL}, s AS (SELECT entity, metric, greatest(0, least(100, 100 - abs(value - peer) / 150000 * 100)) AS score FROM entity_metrics JOIN peer USING (segment, metric)), wt(metric, weight) AS (VALUES ('1-URGENT', 0.5), ('2-HIGH', 0.3), ('5-LOW', 0.2))
SELECT entity, round(sum(score * weight) / sum(weight), 4) AS score, count(*) AS components FROM s JOIN wt USING (metric) GROUP BY entity""")
def weighted_scores(spark, sf_dir):
    s = _with_peer(spark, sf_dir).select("entity", "metric", S.target_score(F.col("value"), F.col("peer"), F.lit(150000.0)).alias("score"))
    weights = spark.createDataFrame([("1-URGENT", 0.5), ("2-HIGH", 0.3), ("5-LOW", 0.2)], "metric string, weight double")
    return metrics.weighted_score(s, ["entity"], weights, "metric").withColumn("score", F.round("score", 4))


@query(f"""WITH {A.ENTITY_METRICS}, a AS (SELECT * FROM entity_metrics WHERE metric < '3'), b AS (SELECT entity, metric, value * 2 AS value FROM entity_metrics WHERE metric > '2')
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.metric, b.metric) AS metric, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NULL THEN 'supplement' ELSE 'main' END AS origin FROM a FULL JOIN b ON a.entity = b.entity AND a.metric = b.metric""")
def supplemented_metrics(spark, sf_dir):
    m = A.entity_metrics(spark, sf_dir)
    more = m.filter("metric > '2'").withColumn("value", F.col("value") * 2)
    return metrics.supplement(m.filter("metric < '3'"), more, ["entity", "metric"], "value")


@query(f"""WITH {A.ENTITY_METRICS}, s AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS d FROM entity_metrics GROUP BY ALL)
SELECT entity, metric, CASE WHEN value < m - d THEN 'below_1sd' WHEN value > m + d THEN 'above_1sd' ELSE 'within_1sd' END AS band FROM entity_metrics JOIN s USING (metric)""")
def deviation_bands(spark, sf_dir):
    m = A.entity_metrics(spark, sf_dir)
    stats = m.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return m.join(stats, "metric").select("entity", "metric", S.deviation_band(F.col("value"), F.col("m"), F.col("d")).alias("band"))


@query(f"""WITH {A.TRAJ_FRAME}, {SEGMENT_SQL} SELECT a.clip_id, a.frame_index, s.proximal AS "first", s.distal AS "second" FROM traj_frame a JOIN segments s ON a.joint_name = s.proximal SEMI JOIN traj_frame b ON b.clip_id = a.clip_id AND b.frame_index = a.frame_index AND b.joint_name = s.distal""")
def skeleton_edges(spark, sf_dir):
    edges = spark.createDataFrame([s[:2] for s in LIMB_SEGMENTS], "first string, second string")
    return reshape.edges_present(A.traj_frame(spark, sf_dir), edges, ["clip_id", "frame_index"])


@query(f"""WITH {A.TRAJ_FRAME}, p AS (SELECT clip_id, frame_index, joint_name, {SCORE} AS prior FROM traj_frame WHERE joint_name <> 'left_hip')
SELECT t.clip_id, t.frame_index, t.joint_name, CASE WHEN NOT coalesce(prior < 0.3, false) THEN x END AS x_3d, CASE WHEN coalesce(prior < 0.3, false) THEN prior ELSE least(t.confidence, prior) END AS input_quality_score FROM traj_frame t LEFT JOIN p USING (clip_id, frame_index, joint_name)""")
def prior_gate(spark, sf_dir):
    f = A.traj_frame(spark, sf_dir)
    points = f.select(*KJ, "frame_index", F.col("x").alias("x_3d"), F.col("y").alias("y_3d"), F.lit(0.0).alias("z_3d"), F.col("confidence").alias("input_quality_score"))
    out = gates.prior_gate(points, f.filter("joint_name <> 'left_hip'"), K, TRUST)
    return out.select("clip_id", "frame_index", "joint_name", "x_3d", "input_quality_score")


@query(f"""WITH {A.TRAJ}, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index) AS i FROM traj) SELECT clip_id, joint_name, frame_index, x FROM r WHERE i = 1""")
def first_of_series(spark, sf_dir):
    return reshape.first_of(A.traj(spark, sf_dir), ["clip_id", "joint_name"], "frame_index").select("clip_id", "joint_name", "frame_index", "x")


@query(f"""WITH {A.MARKERS} SELECT trial_id, marker, arg_min(frame_index, (abs(degrees(atan2(y, x)) - 30), frame_index)) AS event_frame FROM markers GROUP BY ALL""")
def event_by_angle(spark, sf_dir):
    return events.frame_nearest_value(A.markers(spark, sf_dir), ["trial_id", "marker"], F.degrees(F.atan2("y", "x")), 30.0)


@query(f"""WITH {A.MARKERS}, r AS (SELECT *, row_number() OVER (PARTITION BY trial_id, marker ORDER BY z, frame_index) AS rk FROM markers)
SELECT trial_id, marker, CAST(round_even(median(frame_index), 0) AS BIGINT) AS event_frame FROM r WHERE rk <= 4 GROUP BY ALL""")
def contact_event_frame(spark, sf_dir):
    low = reshape.lowest(A.markers(spark, sf_dir), ["trial_id", "marker"], "z", 4)
    return low.groupBy("trial_id", "marker").agg(events.event_frame(F.col("frame_index")).alias("event_frame"))


@query(f"""WITH {A.MARKERS}, m AS (SELECT *, max(abs(x)) OVER (PARTITION BY trial_id, marker) AS mx FROM markers) SELECT trial_id, marker, min(frame_index) AS landing_frame FROM m WHERE abs(x) >= 0.9 * mx GROUP BY ALL""")
def stride_landing_frame(spark, sf_dir):
    return events.first_reaching(A.markers(spark, sf_dir), ["trial_id", "marker"], F.abs("x"), 0.9)


@query(f"""WITH {A.MARKERS} SELECT trial_id, CASE WHEN max(CASE WHEN marker = 0 THEN x END) > max(CASE WHEN marker = 1 THEN x END) THEN 'left' ELSE 'right' END AS side FROM markers GROUP BY ALL""")
def dominant_side(spark, sf_dir):
    f = A.marker_frames(spark, sf_dir, [0, 1]).select("trial_id", F.col("m0.x").alias("l"), F.col("m1.x").alias("r"))
    return events.larger_side(f, ["trial_id"], "l", "r")


@query(f"""WITH {A.MARKERS} SELECT trial_id, marker, frame_index, round(abs(coalesce(lead(x, 2) OVER w, last_value(x) OVER f) - coalesce(lag(x, 2) OVER w, first_value(x) OVER f)), 6) AS snap FROM markers
WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index), f AS (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def snap_change(spark, sf_dir):
    return events.snap(A.markers(spark, sf_dir), ["trial_id", "marker"], "x").select("trial_id", "marker", "frame_index", r6("snap").alias("snap"))


@query(f"""WITH {A.TRAJ_FRAME}, f AS (SELECT clip_id, condition_id, frame_index, 10 * count(*) + 3 * count(*) FILTER (joint_name IN ('right_shoulder', 'right_hip')) + sum({SCORE}) AS s FROM traj_frame GROUP BY ALL)
SELECT clip_id, condition_id, arg_min(frame_index, (-round(s, 9), frame_index)) AS best_frame, round(max(s), 6) AS frame_score FROM f GROUP BY ALL""")
def best_stable_frame(spark, sf_dir):
    out = events.best_frame(A.traj_frame(spark, sf_dir), K, ["right_shoulder", "right_hip"], F.round(C.pose_score(), 9))
    return out.withColumn("frame_score", r6("frame_score"))


@query(f"""WITH {A.SCALARS}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY frame_index) - 1 AS pos FROM scalars) SELECT series, frame_index, value, CAST(pos // 3 AS BIGINT) AS new_frame FROM p WHERE pos % 3 = 0 AND pos // 3 < 8""")
def thinned_frames(spark, sf_dir):
    return events.thin_out(A.scalars(spark, sf_dir), ["series"], 30.0, 10.0, most=8)


@query()
def ready_event(spark, sf_dir):
    out = events.ready_block(A.markers(spark, sf_dir), ["trial_id", "marker"], "x", "z", size=3, most_speed=200.0, before=F.lit(30))
    return out.withColumn("ready_score", r6("ready_score"))


@query()
def motion_phase(spark, sf_dir):
    return events.phase_around(A.markers(spark, sf_dir), ["trial_id", "marker"], "x", share=0.25, middle=(0.35, 0.75)).withColumn("peak", r6("peak"))


@query(f"""WITH {A.MARKERS}, s AS (SELECT trial_id, frame_index, max(y) - min(y) AS span FROM markers GROUP BY ALL) SELECT trial_id, round(quantile_cont(span, 0.9), 6) AS height FROM s GROUP BY ALL""")
def body_height(spark, sf_dir):
    return body.height_span(A.markers(spark, sf_dir), ["trial_id"], "y").withColumn("height", r6("height"))


@query(f"""WITH {A.MARKERS}, o AS (SELECT *, sqrt((x - avg(x) OVER w) ** 2 + (y - avg(y) OVER w) ** 2 + (z - avg(z) OVER w) ** 2) AS off FROM markers WINDOW w AS (PARTITION BY trial_id, marker))
SELECT trial_id, marker, round(greatest(0, least(100, 100 * (1 - max(off) / sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2)))), 6) AS stability FROM o GROUP BY ALL""")
def head_stability(spark, sf_dir):
    return body.stability(A.markers(spark, sf_dir), ["trial_id", "marker"], ["x", "y", "z"]).withColumn("stability", r6("stability"))


@query(f"""WITH {A.MARKERS} SELECT trial_id, marker, frame_index, round((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 9) AS px, round(1 - (z - min(z) OVER w) / nullif(max(z) OVER w - min(z) OVER w, 0), 9) AS py FROM markers WINDOW w AS (PARTITION BY trial_id)""")
def plane_projection(spark, sf_dir):
    out = body.unit_square(A.markers(spark, sf_dir), ["trial_id"], "x", "z")
    return out.select("trial_id", "marker", "frame_index", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))


@query(f"""WITH {A.marker_frames_sql([0, 1, 2])} SELECT trial_id, frame_index, round(median(d), 6) AS scale FROM (SELECT trial_id, frame_index, unnest([{_dist_sql('m0', 'm1')}, {_dist_sql('m1', 'm2')}, {_dist_sql('m0', 'm2')}]) AS d FROM frames) GROUP BY ALL""")
def body_scale(spark, sf_dir):
    f = A.marker_frames(spark, sf_dir, [0, 1, 2])
    return f.select("trial_id", "frame_index", r6(body.body_scale([("m0", "m1"), ("m1", "m2"), ("m0", "m2")], ("x", "y", "z"))).alias("scale"))


@query()
def stride_direction(spark, sf_dir):
    out = body.stride_direction(A.marker_frames(spark, sf_dir, [0, 1, 2]), ["trial_id"], "m0", "m1", "m2", ("x", "z"))
    return out.withColumns({c: F.round(c, 9) for c in ("dir_x", "dir_z")})


#: Loose gates: the adapter's points are not those of a body.
POSE_RULE = smoothing.Pose2dRule(threshold=TRUST, max_gap=12, window=5, median=3, refine=3, jump=1.5, torso_jump=1.5, least_torso_jump=0.06, least_torso_frames=2, limb_tolerance=0.8)


@query()
def smoothed_pose2d(spark, sf_dir):
    return smoothing.smooth_pose2d(A.traj_frame(spark, sf_dir), K, POSE_RULE).select("clip_id", "frame_index", "joint_name", "x", "y")


@query()
def smoothed_pose3d(spark, sf_dir):
    m = A.markers(spark, sf_dir).select(F.col("trial_id").cast("string").alias("clip_id"), F.lit("raw").alias("condition_id"), "frame_index", F.col("marker").cast("string").alias("joint_name"), F.col("x").alias("x_3d"), F.col("y").alias("y_3d"), F.col("z").alias("z_3d"), F.lit(1.0).alias("input_quality_score"))
    return smoothing.smooth_pose3d(m, K)


@query()
def smoothed_sticks(spark, sf_dir):
    f = A.marker_frames(spark, sf_dir, [0, 1])
    sticks = f.select("trial_id", "frame_index", F.col("m0.x").alias("x"), F.col("m0.y").alias("y"), F.col("m1.x").alias("x2"), F.col("m1.y").alias("y2"), F.lit(0.9).alias("confidence"))
    return smoothing.smooth_sticks(sticks, ["trial_id"])


@query(f"""WITH {A.TRAJ}, e AS (SELECT clip_id, condition_id, joint_name, frame_index + unnest(range(-2, 3)) AS frame_index, unnest(range(-2, 3)) AS d FROM traj WHERE y > 0.9) SELECT clip_id, condition_id, joint_name, frame_index, round(max(0.8 * (1 - abs(d) / 3)), 9) AS weight FROM e GROUP BY ALL""")
def protected_frame_weights(spark, sf_dir):
    return smoothing.protected_frames(A.traj(spark, sf_dir).filter("y > 0.9"), KJ, margin=2, weight=0.8).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {A.ENTITY_METRICS}, s AS (SELECT segment, metric, avg(value) AS mean, stddev_pop(value) AS sd FROM entity_metrics WHERE metric < '4' GROUP BY ALL)
SELECT entity, metric, CASE WHEN mean IS NULL THEN CASE WHEN metric LIKE '4%' THEN 'target' ELSE 'no_reference' END WHEN value < mean - sd THEN 'below_1sd' WHEN value > mean + sd THEN 'above_1sd' ELSE 'within_1sd' END AS assessment FROM entity_metrics LEFT JOIN s USING (segment, metric)""")
def against_reference(spark, sf_dir):
    m = A.entity_metrics(spark, sf_dir)
    known = m.filter("metric < '4'").groupBy("segment", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).withColumn("target", F.lit(None).cast("double"))
    targets = m.select("segment", "metric").distinct().filter("metric like '4%'").withColumns({"mean": F.lit(None).cast("double"), "sd": F.lit(None).cast("double"), "target": F.lit(1e5)})
    return reports.against_reference(m, known.unionByName(targets), ["segment", "metric"]).select("entity", "metric", "assessment")


@query(f"""WITH {A.ENTITY_METRICS}, a AS (SELECT * FROM entity_metrics WHERE metric = '1-URGENT'), b AS (SELECT * FROM entity_metrics WHERE metric = '5-LOW')
SELECT coalesce(a.entity, b.entity) AS entity, a.value AS left_value, b.value AS right_value, round(a.value - b.value, 4) AS difference, round((a.value - b.value) / b.value * 100, 6) AS difference_pct FROM a FULL JOIN b ON a.entity = b.entity""")
def compared_metrics(spark, sf_dir):
    m = A.entity_metrics(spark, sf_dir)
    out = reports.comparison(m.filter("metric = '1-URGENT'"), m.filter("metric = '5-LOW'"), ["entity"])
    return out.select("entity", "left_value", "right_value", F.round("difference", 4).alias("difference"), r6("difference_pct").alias("difference_pct"))


@query(f"""WITH {A.TRAJ}, s AS (SELECT clip_id, CASE WHEN {SCORE} >= 0.6 THEN 'available' WHEN {SCORE} >= 0.2 THEN 'partial' ELSE 'unavailable' END AS st FROM traj)
SELECT clip_id, count(*) AS total, count(*) FILTER (st = 'available') AS available, count(*) FILTER (st = 'partial') AS "partial", count(*) FILTER (st = 'unavailable') AS unavailable FROM s GROUP BY ALL""")
def availability_coverage(spark, sf_dir):
    score = C.pose_score()
    df = A.traj(spark, sf_dir).withColumn("status", reports.availability(F.when(score >= 0.2, score), score >= 0.6))
    return reports.coverage(df, ["clip_id"], "status", ["available", "partial", "unavailable"])


@query(f"""WITH {A.TRAJ}, l AS (SELECT clip_id, joint_name, min(frame_index) AS first_at FROM traj GROUP BY ALL) SELECT clip_id, joint_name AS item, row_number() OVER (PARTITION BY clip_id ORDER BY first_at) AS "position" FROM l""")
def joints_in_order(spark, sf_dir):
    df = A.traj(spark, sf_dir).select("clip_id", "frame_index", F.array("joint_name").alias("items"))
    return reports.distinct_in_order(df, ["clip_id"], "items", "frame_index").withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {A.TRAJ}, p AS (SELECT c.clip_id, j.joint_name FROM (SELECT DISTINCT clip_id FROM traj) c, (SELECT DISTINCT joint_name FROM traj) j), f AS (SELECT DISTINCT clip_id, joint_name FROM traj WHERE y > 0.95)
SELECT p.clip_id, p.joint_name, CASE WHEN f.clip_id IS NULL THEN 'missing_pose_file' END AS notes FROM p LEFT JOIN f USING (clip_id, joint_name)""")
def planned_runs(spark, sf_dir):
    t = A.traj(spark, sf_dir)
    joints = spark.createDataFrame([(j,) for j in A.JOINTS.values()], "joint_name string")
    return reports.planned(t.select("clip_id").distinct(), joints, t.filter("y > 0.95"), ["clip_id", "joint_name"])


@query(f"""WITH {A.TRAJ}, n AS (SELECT DISTINCT clip_id, joint_name FROM traj), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN joint_name LIKE '%_wrist' THEN 0 WHEN joint_name LIKE '%_hip' THEN 1 ELSE 2 END, joint_name) AS i FROM n) SELECT clip_id, joint_name FROM r WHERE i = 1""")
def preferred_source(spark, sf_dir):
    return reports.preferred(A.traj(spark, sf_dir).select("clip_id", "joint_name").distinct(), ["clip_id"], "joint_name", ["_wrist", "_hip"])


from . import bundle_queries, catalog_queries, driver_queries, twins  # noqa: E402, F401

ORACLES |= twins.TWINS
