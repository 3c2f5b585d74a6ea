"""Closed forms and edge cases of the operators."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import confidence as C
from strideframe.functions import geometry as G
from strideframe.functions import scoring as S
from strideframe.operators import completion, features, folds, gates, islands, kernels, metrics, reshape, series, windows
from strideframe.sources import markers, tables

K = ["clip_id", "condition_id"]
POINT = "clip_id string, condition_id string, frame_index long, timestamp_sec double, joint_name string, x double, y double, visibility double, confidence double, backend string"


def points(spark, rows):
    """rows: (frame, joint, x, y[, score])"""
    full = [("c", "raw", r[0], r[0] * 0.5, r[1], r[2], r[3], r[4] if len(r) > 4 else 0.9, 0.95, "net") for r in rows]
    return spark.createDataFrame(full, POINT)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*xs):
    return [F.lit(None).cast("double") if x is None else F.lit(float(x)) for x in xs]


def test_geometry(spark):
    assert one(spark, G.joint_angle(lits(1, 0), lits(0, 0), lits(0, 1))) == pytest.approx(90)
    assert one(spark, G.joint_angle(lits(0, 0), lits(0, 0), lits(0, 1))) is None
    assert one(spark, G.joint_angle(lits(None, 0), lits(0, 0), lits(0, 1))) is None
    assert one(spark, G.delta_degrees(*lits(170, -170))) == pytest.approx(20)
    assert one(spark, G.delta_degrees(*lits(-170, 170))) == pytest.approx(-20)
    assert one(spark, G.heading(*lits(0, 0))) is None
    assert one(spark, G.image_heading(lits(0, 0), lits(0, -1))) == pytest.approx(90)
    assert one(spark, G.folded(*lits(170))) == pytest.approx(10)
    assert one(spark, G.signed_angle_about(lits(0, 1, 0), lits(0, 0, 2), lits(1, 0, 0))) == pytest.approx(90)
    assert one(spark, G.elevation(lits(1, 0, 1))) == pytest.approx(45)
    p, q = G.circle_points(lits(0, 0), *lits(5), lits(6, 0), *lits(5))
    assert {round(one(spark, p[1])), round(one(spark, q[1]))} == {4, -4}
    p, _ = G.circle_points(lits(0, 0), *lits(1), lits(6, 0), *lits(1))
    assert one(spark, p[0]) is None
    assert [one(spark, c) for c in G.clamp_box(lits(-1, 2, 4, 9), *lits(10, 8))] == [0, 2, 3, 6]
    assert [one(spark, c) for c in G.expand_box(lits(0, 0, 2, 2), 2)] == [-1, -1, 4, 4]


def test_confidence(spark):
    df = spark.createDataFrame([(0.9, 0.4, "left_wrist"), (None, 0.7, "nose"), (None, None, "tail")], "visibility double, confidence double, joint_name string")
    got = df.select(C.pose_score().alias("s"), C.joint_group().alias("g"), C.by_joint({"default": 0.5, "distal": 0.6, "nose": 0.1}, 0.9).alias("t"), C.trusted(C.pose_score(), 0.5).alias("a"), C.not_distrusted(C.pose_score(), 0.5).alias("b")).collect()
    assert [tuple(r) for r in got] == [(0.4, "distal", 0.6, False, False), (0.7, "torso", 0.1, True, True), (None, "default", 0.5, False, True)]
    assert [one(spark, C.odd_window(F.lit(w))) for w in (1, 4, 5)] == [1, 3, 5]


def test_scores(spark):
    standard = lambda v: one(spark, S.standard_score(*lits(v, 100), F.lit(False)))
    assert [standard(v) for v in (100, 112, 130, 160, 300)] == pytest.approx([100, 92, 70, 40, 20])
    assert one(spark, S.standard_score(*lits(50, 100), F.lit(True))) == 100
    assert one(spark, S.linear_score(*lits(5, 0, 10))) == 50 and one(spark, S.linear_score(*lits(5, 5, 5))) == 50
    assert one(spark, S.target_score(*lits(8, 10, 4))) == 50
    assert one(spark, S.gap_score(*lits(8, 10, None, None))) == pytest.approx(80) and one(spark, S.gap_score(*lits(8, None, 6, 10))) == 100 and one(spark, S.gap_score(*lits(8, None, None, None))) == 60
    assert one(spark, S.ratio_score(*lits(5, 0))) == 45 and one(spark, S.ratio_score(*lits(3, 2))) == 100
    assert [one(spark, S.nice_step(F.lit(float(x)))) for x in (0, 10, 12, 40)] == [1, 2, 5, 10]
    assert one(spark, S.difference_percent(*lits(3, 0))) is None


def test_speed_and_jitter(spark):
    df = points(spark, [(0, "w", 0.0, 0.0), (1, "w", 3.0, 4.0), (2, "w", None, None), (3, "w", 6.0, 8.0)])
    got = [r["speed"] for r in series.speed(df, [*K, "joint_name"], ["x", "y"]).orderBy("frame_index").collect()]
    assert got == [None, 10.0, None, 5.0]
    assert series.temporal_jitter(df, K, ["x", "y"]).first()["jitter"] == 5.0
    assert series.second_difference(df, K, ["x", "y"]).first()["smoothness"] == 0.0
    assert series.steps(df, K, ["x", "y"]).filter("step is not null").count() == 1


def test_angular_series(spark):
    df = spark.createDataFrame([(1, i, float(i), a) for i, a in enumerate([170.0, None, -170.0, -150.0])], "k int, frame_index int, timestamp_sec double, a double")
    v = [r["velocity"] for r in series.angular_velocity(df, ["k"], "a").orderBy("frame_index").collect()]
    assert v == [None, None, 10.0, 20.0]
    u = [r["unwrapped"] for r in series.unwrapped(df.dropna(), ["k"], "a").orderBy("frame_index").collect()]
    assert u == [170.0, 190.0, 210.0]
    assert series.rotation_range(df, ["k"], "a").first()["rotation_range"] == 40.0
    assert [r["change"] for r in series.change_from_start(df, ["k"], "a").orderBy("frame_index").collect()] == [0.0, None, -340.0, -320.0]


def test_gradient_matches_numpy(spark):
    t, x = np.array([0, 0.1, 0.4, 0.5, 0.9]), np.array([1.0, 2, 0, 5, 3])
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "k int, frame_index int, timestamp_sec double, x double")
    got = [r["gradient"] for r in series.gradient(df, ["k"], "x").orderBy("frame_index").collect()]
    assert got == pytest.approx(list(np.gradient(x, t)))


def test_curvature_of_circle(spark):
    rows = [(1, i, 2 * math.cos(i / 5), 2 * math.sin(i / 5), 0.0) for i in range(6)]
    df = series.curvature(spark.createDataFrame(rows, "k int, frame_index int, x double, y double, z double"), ["k"], ["x", "y", "z"])
    assert [r["curvature"] for r in df.orderBy("frame_index").collect()][1:-1] == pytest.approx([0.5] * 4)


def values(spark, xs):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, frame_index int, v double")


def test_gap_filling(spark):
    xs = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    fill = lambda g, e: [r["v"] for r in islands.fill_short_gaps(values(spark, xs), ["k"], ["v"], g, edges=e).orderBy("frame_index").collect()]
    assert fill(2, False) == [None, 1, 2, 3, 4, None, None, None, 8, None]
    assert fill(3, True) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    seg = islands.valid_segments(values(spark, xs), ["k"], "v").orderBy("start_pos").collect()
    assert [(r["start_pos"], r["length"]) for r in seg] == [(1, 1), (4, 1), (8, 1)]
    runs = islands.missing_runs(values(spark, xs), ["k"], F.col("v").isNotNull()).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in runs] == [(0, 1), (2, 4), (5, 8), (9, 10)]


def test_isolated_jump(spark):
    xs = [0.0, 0.1, 0.2, 5.0, 0.4, 0.5, 0.6]
    df = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate(xs)], "k int, frame_index int, x double, y double")
    assert [r["frame_index"] for r in gates.isolated_jumps(df, ["k"], 3.0).filter("jump").collect()] == [3]
    assert gates.isolated_jumps(df.limit(4), ["k"], 3.0).filter("jump").count() == 0


def test_tracks_and_gap_rows(spark):
    df = spark.createDataFrame([("b", 0, 0.0, 0.0, 0.8), ("b", 1, 0.1, 0.0, 0.6), ("b", 4, 0.4, 0.3, 0.4), ("b", 20, 0.9, 0.9, None)], "o string, frame_index long, x double, y double, confidence double")
    kept = islands.long_tracks(df, ["o"], least=2, max_gap=2, max_jump=0.0)
    assert sorted(r["frame_index"] for r in kept.collect()) == [0, 1, 4]
    frames = spark.createDataFrame([(i, i / 10) for i in (2, 5, 6)], "frame_index long, timestamp_sec double")
    new = islands.new_rows_in_gaps(df, ["o"], frames, ["x", "y"], 3).collect()
    assert [(r["frame_index"], round(r["x"], 9), round(r["confidence"], 9)) for r in new] == [(2, 0.2, 0.3)]


def test_limb_gate_and_stability(spark):
    rows = [(f, "left_elbow", 0.0, 0.0) for f in range(5)] + [(f, "left_wrist", 0.1 if f < 4 else 0.5, 0.0) for f in range(5)]
    out = gates.limb_length_gate(points(spark, rows), K, ["x", "y"], 0.28)
    assert [(r["frame_index"], r["joint_name"]) for r in out.filter("x is null").collect()] == [(4, "left_wrist")]
    s = metrics.limb_stability(points(spark, rows), K, ["x", "y"], 0.28).first()
    assert (s["samples"], s["outlier_samples"]) == (5, 1) and s["median_length"] == pytest.approx(0.1)


def test_completeness_and_missing(spark):
    df = points(spark, [(0, "a", 0.1, 0.1), (1, "a", 0.1, 0.1, 0.1), (1, "b", None, None)])
    assert metrics.completeness(df, K, ["a", "b"]).first()["completeness"] == 0.5
    assert metrics.frame_completeness(df, K, ["a", "b"], 0.5).first()["completeness"] == 0.25
    assert metrics.missing_rate(df, K, "a", 0.5).first()["missing_rate"] == 0.5


def test_profile_percentile(spark):
    p = metrics.numeric_profile(spark.createDataFrame([(1, -900.0), (1, 980.0)], "k int, v double"), ["k"], "v").first()
    assert p["p95_abs"] == pytest.approx(976) and p["range"] == 1880 and p["peak_abs"] == 980


def test_motion_features(spark):
    rows = [(0, "left_shoulder", 0.0, 0.0), (0, "right_shoulder", 1.0, 0.0), (0, "left_hip", 0.0, 1.0), (0, "right_hip", 1.0, 1.0), (0, "left_wrist", 0.0, 0.0)]
    rows += [(1, "left_shoulder", 0.0, 1.0), (1, "right_shoulder", 1.0, 0.0), (1, "left_hip", 0.0, 1.0), (1, "right_hip", 1.0, 1.0), (1, "left_wrist", 3.0, 4.0)]
    f = features.motion_features(points(spark, rows), K).orderBy("frame_index").collect()
    assert f[1]["hip_shoulder_separation_deg"] == pytest.approx(45) and f[1]["trunk_rotation_velocity_deg_s"] == pytest.approx(90)
    assert f[1]["hand_speed_proxy"] == pytest.approx(10) and f[0]["hand_speed_proxy"] is None and f[0]["com_x"] == pytest.approx(0.5)


def test_action_window_bounds(spark):
    rows = [(1, i, 5.0 if 40 <= i < 50 else 0.0, None, None) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, frame_index int, hand_speed_proxy double, trunk_rotation_velocity_deg_s double, pelvis_rotation_velocity_deg_s double")
    w = windows.action_window(windows.motion_score(df, ["k"]), ["k"]).first()
    assert w["start_frame"] < 40 and w["end_frame"] >= 50 and 24 <= w["frame_count"] <= 54
    still = windows.action_window(windows.motion_score(df.withColumn("hand_speed_proxy", F.lit(0.0)), ["k"]), ["k"]).first()
    assert (still["start_index"], still["end_index"], still["peak_score"]) == (0, 99, 0.0)
    wide = windows.video_window(windows.motion_score(df, ["k"]), ["k"]).first()
    assert wide["frame_count"] >= w["frame_count"] and wide["frame_count"] <= 90


def test_folds(spark):
    c = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate([0.0, 0.1, 0.2, 9.0, 9.1, 0.3, None])], "k int, frame_index int, cx double, cy double")
    out = folds.torso_continuity(c, ["k"], 2.0, 0.05).orderBy("frame_index").collect()
    assert [r["frame_index"] for r in out if r["rejected"]] == [3, 4]
    o = spark.createDataFrame([(1, i, x, 0.0, i * 1.0, w, 100) for i, (x, w) in enumerate([(0.0, 100), (0.1, 100), (0.9, 100), (0.2, 100), (0.3, None)])], "k int, frame_index int, x double, y double, timestamp_sec double, width int, height int")
    got = [(r["speed_px_s"], r["speed_norm_s"]) for r in folds.object_speed(o, ["k"], 50.0).orderBy("frame_index").collect()]
    assert got[0] == (None, None) and got[1][0] == pytest.approx(10) and got[2] == (None, None) and got[3][0] == pytest.approx(5) and got[4][0] is None and got[4][1] == pytest.approx(0.1)
    t = folds.bounded_tracker(o.withColumn("area", F.lit(1.0)), ["k"], most=0.01).orderBy("frame_index").collect()
    assert t[0]["tracked"] == 0.0 and t[1]["tracked"] == pytest.approx(0.01)


def test_completion(spark):
    rows = [(f, "left_elbow", 0.5, 0.5) for f in range(4)] + [(0, "left_wrist", 0.6, 0.5), (1, "left_wrist", None, None), (2, "left_wrist", 0.5, 0.6), (3, "left_wrist", None, None)]
    out = completion.complete_limbs(points(spark, rows), K, threshold=0.5, max_gap=2)
    r = {(x["frame_index"], x["joint_name"]): x for x in out.collect()}
    w = r[1, "left_wrist"]
    assert math.hypot(w["x"] - 0.5, w["y"] - 0.5) == pytest.approx(0.1) and w["backend"] == "net+imputed" and w["confidence"] == 0.62
    assert r[3, "left_wrist"]["x"] is None and r[0, "left_wrist"]["backend"] == "net"


def test_reshape(spark):
    long = spark.createDataFrame([(1, "a", 2.0, 0), (1, "a", 1.0, 1), (1, "b", 5.0, 2)], "k int, m string, v double, i int")
    assert tuple(reshape.to_wide(long, ["k"], "m", "v", ["a", "b", "c"], order="i").first()) == (1, 1.0, 5.0, None)
    assert reshape.first_of(long, ["k", "m"], "i").count() == 2
    arrays = spark.createDataFrame([(1, ["p", "q"], [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)])], "k int, names array<string>, pts array<struct<x:double,y:double,z:double>>")
    assert [tuple(r) for r in reshape.explode_points(arrays, ["k"], "pts", "names").collect()] == [(1, 0, "p", 1.0, 2.0, 3.0), (1, 1, "q", 4.0, 5.0, 6.0)]


def c3d(frames, labels):
    """A small C3D file with floating point values."""
    def parameter(group, name, kind, dims, data):
        body = struct.pack("<bB", kind, len(dims)) + bytes(dims) + data + b"\0"
        return struct.pack("<bb", len(name), group) + name.encode() + struct.pack("<H", 2 + len(body)) + body

    width = max(map(len, labels))
    params = b"\x01\x50\x02\x54" + struct.pack("<bb", 5, -1) + b"POINT" + struct.pack("<H", 3) + b"\0"
    params += parameter(1, "LABELS", -1, [width, len(labels)], "".join(x.ljust(width) for x in labels).encode())
    params += parameter(1, "UNITS", -1, [2], b"mm") + b"\0\0"
    params = params.ljust(1024, b"\0")
    head = struct.pack("<BBHHHHHfHHf", 2, 0x50, len(labels), 0, 1, len(frames), 0, -1.0, 4, 0, 100.0).ljust(512, b"\0")
    return head + params + np.array(frames, dtype="<f4").tobytes()


def test_markers(spark, tmp_path):
    folder = tmp_path / "Trial A"
    folder.mkdir()
    data = [[[1, 2, 3, 0.5], [4, 5, 6, -1]], [[7, 8, 9, 0], [0, 0, 0, 0]]]
    (folder / "Bat 1.c3d").write_bytes(c3d(data, ["Joe:LWRA", "Joe:RWRA"]))
    (folder / "swing.csv").write_text("Trajectories\n100\n,,Joe:A,,,Joe:B,,\n\n\n1,0,1,2,3,4,5,6\n2,0,1,2,3,,5,6\n")
    got = markers.read_markers(spark, str(tmp_path)).orderBy("frame_index", "point").collect()
    assert [(r["trial_id"], r["point"], r["x_mm"], r["valid"]) for r in got] == [("trial_a_bat_1", "LWRA", 1.0, 1), ("trial_a_bat_1", "RWRA", None, 0), ("trial_a_bat_1", "LWRA", 7.0, 1), ("trial_a_bat_1", "RWRA", None, 0)]
    assert got[2]["timestamp_sec"] == pytest.approx(0.01)
    wide = markers.read_markers(spark, str(tmp_path), "csv").orderBy("frame_index", "point").collect()
    assert [(r["frame_index"], r["point"], r["y_mm"]) for r in wide] == [(0, "A", 2.0), (0, "B", 5.0), (1, "A", 2.0), (1, "B", None)]


def test_tables(spark, tmp_path):
    df = points(spark, [(0, "a", 0.25, None)]).drop("backend").withColumns({"backend": F.lit("net"), "inference_time_ms": F.lit(1.5)})
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_pose2d(spark, str(tmp_path / "csv")).first()["y"] is None
    (tmp_path / "p3.csv").write_text("clip_id,condition_id,frame_index,timestamp_sec,joint_name,x_3d,y_3d,z_3d,scale_mode,lift_backend,input_quality_score\nc,r,0,0.0,hip,nan,1.0,2.0,m,n,\n")
    r = tables.read_pose3d(spark, str(tmp_path / "p3.csv")).first()
    assert r["x_3d"] is None and r["y_3d"] == 1.0
    (tmp_path / "ext.csv").write_text("frame_index,joint_name,x,y,z,score\n3,L_Hip,1,2,bad,0.5\n")
    e = tables.read_external_3d(spark, str(tmp_path / "ext.csv"), {"L_Hip": "left_hip"}, clip_id="c", condition_id="r").first()
    assert (e["joint_name"], e["timestamp_sec"], e["z_3d"], e["input_quality_score"]) == ("left_hip", 3.0, None, 0.5)
    (tmp_path / "bad.csv").write_text("frame_index,x\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_external_3d(spark, str(tmp_path / "bad.csv"), {}, clip_id="c", condition_id="r")
    tables.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_stream_matches_batch(spark, tmp_path):
    from strideframe.streaming.speeds import stream_speeds

    rows = [("c", "w", i, i * 0.5, float(i * i), 0.0) for i in range(6)]
    schema = "clip_id string, joint_name string, frame_index long, timestamp_sec double, x double, y double"
    whole = spark.createDataFrame(rows, schema)
    for k in (0, 1):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_speeds(src).writeStream.format("memory").queryName("speeds").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["frame_index"], r["speed"]) for r in spark.sql("select * from speeds").collect()}
    want = {(r["frame_index"], r["speed"]) for r in series.speed(whole, ["clip_id", "joint_name"], ["x", "y"]).collect()}
    assert got == want


def test_empty_tables(spark):
    empty = points(spark, []).limit(0)
    assert features.motion_features(empty, K).count() == 0
    assert metrics.joint_stability(empty, [*K, "joint_name"], 0.5).count() == 0
    assert islands.fill_short_gaps(empty, K, ["x"], 3).count() == 0
    assert completion.complete_limbs(empty, K, threshold=0.5, max_gap=3).count() == 0


def ahead(df):
    """Window frames in the plan that reach from a row to the end of its series: they are read anew for every row."""
    return df._jdf.queryExecution().optimizedPlan().toString().replace("unboundedpreceding$(), unboundedfollowing$()", "").count("unboundedfollowing")


def test_no_window_reads_the_rest_of_a_series_for_each_row(spark):
    df = values(spark, [None, 1.0, None, 3.0, None])
    assert ahead(islands.fill_short_gaps(df, ["k"], ["v"], 2)) == 0 and ahead(islands.missing_runs(df, ["k"], F.col("v").isNotNull())) == 0
    got = series.neighbours(df, ["k"], F.col("v").isNotNull(), ["v"])
    assert ahead(got) == 0 and [r["after"] and r["after"]["v"] for r in got.orderBy("frame_index").collect()] == [1.0, 3.0, 3.0, None, None]
    xy = df.withColumns({"x": F.col("v"), "y": F.col("v")})
    assert ahead(gates.isolated_jumps(xy, ["k"], 3.0)) == 0


def test_filters_sort_a_series_once(spark):
    from strideframe.operators import kernels

    df = spark.createDataFrame([(1, i, None if i in (7, 8) else float(i), float(i * i)) for i in range(20)], "k int, frame_index int, v double, u double")
    out = kernels.mean_filter(kernels.savitzky_golay(kernels.median_filter(df, ["k"], ["v", "u"], 3), ["k"], ["v", "u"], 7, 2), ["k"], ["v", "u"], 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got = [r["v"] for r in out.orderBy("frame_index").collect()]
    assert got[7] is got[8] is None and got[9] == pytest.approx(28 / 3) and got[12] == pytest.approx(12)


def test_folds_stream_short_and_long_series(spark):
    """No group for each series; a fold begins anew with each one, also one that runs over batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, float(i) * k, 0.0, float(i), 100, 100) for k in range(20) for i in range(1 if k % 2 else 30)]
        df = spark.createDataFrame(rows, "k int, frame_index int, x double, y double, timestamp_sec double, width int, height int")
        out = folds.object_speed(df, ["k"], None)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["k"], r["frame_index"], r["speed_norm_s"]) for r in out.collect()} == {(r[0], r[1], float(r[0]) if r[1] else None) for r in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
