"""Sources, gates of whole trajectories, poses, lookups and streams on small closed cases."""

import pytest
from pyspark.sql import functions as F

from strideframe import schemas
from strideframe.operators import bundles, catalog, completion, gates, poses, smoothing
from strideframe.sources import markers, tables

K = ["clip_id", "condition_id"]
POINT = "clip_id string, condition_id string, frame_index long, timestamp_sec double, joint_name string, x double, y double, visibility double, confidence double, backend string"


def points(spark, rows):
    return spark.createDataFrame([("c", "r", f, f / 30, j, x, y, s, s, "b") for f, j, x, y, s in rows], POINT)


def body(frame, dx=0.0, score=0.9):
    return [(frame, j, x + dx, y, score) for j, x, y in (("left_hip", 0.4, 0.6), ("right_hip", 0.6, 0.6), ("left_shoulder", 0.4, 0.3), ("right_shoulder", 0.6, 0.3), ("left_elbow", 0.3, 0.4), ("left_wrist", 0.3, 0.5))]


def test_frames_with_a_jumping_torso_lose_their_points(spark):
    rows = [r for f in range(12) for r in body(f, 0.3 if f == 6 else 0.005 * f)]
    rule = smoothing.Pose2dRule(torso_jump=8.0, least_torso_jump=0.08)
    out = smoothing.gate_pose2d(points(spark, rows), K, rule)
    assert {r["frame_index"] for r in out.filter("x is null").collect()} == {6} and out.count() == len(rows)
    off = smoothing.gate_pose2d(points(spark, rows), K, smoothing.Pose2dRule(torso_gate=False))
    assert off.filter("x is null").count() == 0


def test_short_torso_runs_lose_their_points(spark):
    rows = [r for f in (0, 1, 2, 3, 10, 20, 21, 22) for r in body(f)] + [(10, "nose", 0.5, 0.1, 0.9)]
    out = smoothing.gate_pose2d(points(spark, rows), K, smoothing.Pose2dRule(least_torso_frames=3))
    assert {r["frame_index"] for r in out.filter("x is null").collect()} == {10}
    few = points(spark, body(0))
    assert smoothing.gate_pose2d(few, K, smoothing.Pose2dRule(least_torso_frames=3)).filter("x is null").count() == 0


def test_limb_and_foot_gates(spark):
    rows = []
    for f in range(9):
        rows += [(f, "left_elbow", 0.3, 0.4, 0.9), (f, "left_wrist", 0.3, 0.8 if f == 4 else 0.5, 0.9), (f, "left_ankle", 0.3, 0.9, 0.9), (f, "left_heel", 0.3 + (0.3 if f == 5 else 0.02), 0.9, 0.9)]
    out = smoothing.gate_pose2d(points(spark, rows), K, smoothing.Pose2dRule())
    assert {(r["frame_index"], r["joint_name"]) for r in out.filter("x is null").collect()} == {(4, "left_wrist"), (5, "left_heel")}


def test_smoothing_by_joint(spark):
    rows = [(f, j, None if f in (5, 6) else 0.01 * f, 0.5, 0.9) for f in range(20) for j in ("left_wrist", "nose")]
    rule = smoothing.Pose2dRule(gaps={"distal": 2, "default": 1}, torso_gate=False)
    got = {(r["frame_index"], r["joint_name"]): r["x"] for r in smoothing.smooth_pose2d(points(spark, rows), K, rule).collect()}
    assert got[5, "left_wrist"] == pytest.approx(0.05) and got[5, "nose"] is None


def test_reconstructed_skeletons_are_not_gated(spark):
    names = ["left_elbow", "left_wrist", *schemas.MARKER_JOINTS[:4]]
    rows = [("c", "r", f, n, 0.1 * f + (9.0 if f == 7 and n == "left_wrist" else 0.0), 0.0, float(k), 0.9) for f in range(15) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "clip_id string, condition_id string, frame_index long, joint_name string, x_3d double, y_3d double, z_3d double, input_quality_score double")
    kept = {"window": 1, "median": 1, "refine": 1, "order": 0, "max_gap": 0}
    assert smoothing.smooth_pose3d(df, K, **kept).filter("x_3d is null").count() == 0
    fewer = smoothing.smooth_pose3d(df.filter(~F.col("joint_name").isin(*schemas.MARKER_JOINTS)), K, **kept).filter("x_3d is null").collect()
    assert [(r["frame_index"], r["joint_name"], r["input_quality_score"]) for r in fewer] == [(7, "left_wrist", None)]


def test_rescue(spark):
    rows = [(f, "left_elbow", 0.3, 0.4, 0.9) for f in range(7)] + [(f, "left_wrist", 0.3, 0.5, 0.9) for f in (0, 1, 2, 5, 6)] + [(3, "left_wrist", 0.3, 0.51, 0.2), (4, "left_wrist", 0.9, 0.9, 0.2)]
    out = completion.rescue(points(spark, rows), K, threshold=0.5, least=0.1, least_alone=0.15, limb_tolerance=0.3, time_tolerance=0.05)
    got = {r["frame_index"]: r for r in out.filter("joint_name = 'left_wrist'").collect()}
    assert got[3]["backend"] == "b+rescued" and got[3]["confidence"] == pytest.approx(0.62) and got[4]["backend"] == "b"
    low = completion.rescue(points(spark, rows), K, threshold=0.5, least=0.3, least_alone=0.3, limb_tolerance=0.3, time_tolerance=0.05)
    assert low.filter("backend != 'b'").count() == 0
    gap = spark.createDataFrame([("left_wrist",), ("left_knee",), ("nose",)], "joint_name string").select("joint_name", completion.gap_by_suffix({"distal": 7, "left_knee": 2}, 3).alias("g"))
    assert {r["joint_name"]: r["g"] for r in gap.collect()} == {"left_wrist": 7, "left_knee": 2, "nose": 3}


def test_swing_is_tuned(spark):
    import math

    rows = [(1, f, math.cos(a), math.sin(a), -math.cos(a), -math.sin(a), 0.9) for f, a in enumerate([0.0, 0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "k int, frame_index long, x double, y double, x2 double, y2 double, confidence double")
    wide = df.withColumns({c: F.col(c) * 3 for c in ("x", "y", "x2", "y2")})
    out = smoothing.tune_swing(wide, df, df.select("k", "frame_index").filter("frame_index > 0"), ["k"], step=20, lengths=(0.8, 1.2)).orderBy("frame_index").collect()
    assert out[0]["x"] == pytest.approx(3.0) and math.hypot(out[2]["x"] - out[2]["x2"], out[2]["y"] - out[2]["y2"]) == pytest.approx(2.4)


def test_poses(spark):
    one = spark.createDataFrame([((0.0, 0.0), None, (4.0, 0.0), (9.0, 9.0))], "left_hip struct<x:double,y:double>, hip struct<x:double,y:double>, right_hip struct<x:double,y:double>, nose struct<x:double,y:double>")
    got = one.select(*[c.alias(a) for c, a in zip(poses.pelvis_center(["left_hip", "right_hip", "nose"], ("x", "y")), "xy", strict=True)]).first()
    assert (got["x"], got["y"]) == (2.0, 0.0)
    assert one.select(poses.pelvis_center(["hip", "nose"], ("x", "y"))[0].alias("x")).first()["x"] == 9.0
    part = spark.createDataFrame([((1.0, 2.0, 3.0), (5.0, None, 1.0))], "a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>")
    assert part.select(*[c.alias(a) for c, a in zip(poses.complete_mean(["a", "b"]), "xyz", strict=True)]).first()[:] == (1.0, 2.0, 3.0)
    box = spark.range(1).select(*[c.alias(n) for c, n in zip(poses.prior_box(F.lit(100.0), F.lit(50.0), center=(0.9, 0.5)), "xywh", strict=True)]).first()
    assert box[:] == (50.0, 5.0, 50.0, 40.0)
    lean = spark.range(1).select(bundles.lean_2d([F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0)]).alias("v")).first()["v"]
    assert lean == pytest.approx(45)


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(catalog.action_of(F.lit("x/My_BAT_01.c3d"))) == "batting" and one(catalog.action_of(F.lit("p.c3d"))) == "pitching"
    assert one(catalog.relative_path(F.lit("/a/b/c.csv"), "/a")) == "b/c.csv" and one(catalog.relative_path(F.lit("/x/c.csv"), "/a")) == "/x/c.csv"
    assert one(catalog.athlete_of(F.lit("Report: Ann B"), F.lit("/x/y_z.xlsx"))) == "Ann B" and one(catalog.athlete_of(F.lit("Report"), F.lit("/x/y_z.xlsx"))) == "y"
    assert one(catalog.metric_key(F.lit(" Hip-Shoulder  Sep (deg) "))) == "hip_shoulder_sep_deg"
    assert one(catalog.as_ratio(F.lit(45.0), F.lit("% height"))) == pytest.approx(0.45) and one(catalog.as_ratio(F.lit(45.0), F.lit("deg"))) == 45.0
    assert [one(bundles.is_reconstruction_point(F.lit(x))) for x in ("LASI", "LKneeAngles", "XProgressAnglesY", "RForce")] == [True, False, False, False]
    assert [markers.clean_label(x) for x in ("s:LASI", "a:b:c", "RASI", ": x ")] == ["LASI", "b:c", "RASI", "x"]


def test_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("frame_index,timestamp_sec,a\n1,0.5,x\nbad,,\n")
    got = tables.read_untyped(spark, str(tmp_path / "f.csv")).collect()
    assert [tuple(r) for r in got] == [(1, 0.5, "x"), (None, None, None)]
    assert tables.read_optional(spark, str(tmp_path / "none.csv"), schemas.OBJECT_TRACK).count() == 0
    rows = [("t", 3, "A", 1.0, "1"), ("t", 3, "B", 2.0, "1"), ("t", 5, "A", 3.0, "0"), ("t", 5, "B", 4.0, "0"), ("t", 9, "A", 5.0, "1"), ("t", 9, "B", 6.0, "0")]
    df = spark.createDataFrame(rows, "trial_id string, frame_index long, point string, x double, valid string")
    dense = {(r["dense_frame"], r["point"]): r["x"] for r in tables.dense_points(df, ["trial_id"], "point").collect()}
    assert dense == {(0, "A"): 1.0, (0, "B"): 2.0, (1, "A"): 5.0, (1, "B"): None}
    p3 = spark.createDataFrame([("c", 0, 1.0, None, 2.0, 0.5), ("c", 0, 1.0, 1.0, 2.0, 1.0)], "clip_id string, frame_index long, x_3d double, y_3d double, z_3d double, input_quality_score double")
    assert [(r["y_3d"], r["frame_quality"]) for r in tables.plot_sequence(p3, ["clip_id"]).orderBy("y_3d").collect()] == [(0.0, 0.75), (1.0, 0.75)]
    seen = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), ("b", 2, 0.3)], "clip_id string, frame_index long, timestamp_sec double")
    manifest = spark.createDataFrame([("a", 7, 0.7)], "clip_id string, frame_index long, timestamp_sec double")
    assert sorted(map(tuple, tables.timeline(manifest, seen, ["clip_id"]).collect())) == [("a", 7, 0.7), ("b", 2, 0.3)]
    assert sorted(map(tuple, tables.timeline(None, seen, ["clip_id"]).collect())) == [("a", 1, 0.1), ("b", 2, 0.3)]
    m = spark.createDataFrame([("t", 0, 0.0, "LASI", 1.0, 2.0, 3.0, 0.0, 1), ("t", 0, 0.0, "XX", 1.0, 2.0, 3.0, 0.0, 1)], schemas.MARKERS)
    assert [(r["joint_name"], r["x_3d"]) for r in markers.named_joints(m, {"LASI": "left_hip"}).collect()] == [("left_hip", 1.0)]


def test_late_rows_of_a_stream(spark, tmp_path):
    from strideframe.streaming import speeds

    schema = "clip_id string, joint_name string, frame_index long, timestamp_sec double, x double, y double"
    batches = [[("c", "j", 0, 0.0, 0.0, 0.0), ("c", "j", 2, 2.0, 2.0, 0.0)], [("c", "j", 1, 1.0, 50.0, 0.0)], [("c", "j", 3, 3.0, 4.0, 0.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = speeds.stream_speeds(stream).writeStream.format("memory").queryName("late_speeds").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["frame_index"]: r["speed"] for r in spark.table("late_speeds").collect()}
    assert got[0] is None and got[2] == pytest.approx(1.0) and got[1] is None and got[3] == pytest.approx(2.0)


def test_empty_inputs(spark):
    empty = points(spark, []).limit(0)
    assert smoothing.smooth_pose2d(empty, K).count() == 0 and gates.segment_lengths(empty, [*K, "frame_index"], ["x", "y"]).count() == 0
    assert completion.rescue(empty, K, threshold=0.5, least=0.1, least_alone=0.1, limb_tolerance=0.3, time_tolerance=0.1).count() == 0
    assert catalog.ablation_rows(empty, K, {"all": ["nose"]}, ["left_wrist"], 0.3).count() == 0


def test_series_of_one_group_keep_their_own_torso(spark, monkeypatch):
    """Series share the groups of the torso's fold: a jump in one takes nothing from the others."""
    monkeypatch.setattr(smoothing, "TORSO_GROUPS", 1)
    rows = points(spark, [r for f in range(12) for r in body(f, 0.3 if f == 6 else 0.005 * f)])
    still = points(spark, [r for f in range(12) for r in body(f, 0.25 + 0.005 * f)]).withColumn("clip_id", F.lit("d"))
    rule = smoothing.Pose2dRule(torso_jump=8.0, least_torso_jump=0.08)
    both = smoothing.gate_pose2d(rows.unionByName(still), K, rule)
    assert "_group" in both._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["clip_id"], r["frame_index"]) for r in both.filter("x is null").collect()} == {("c", 6)}
