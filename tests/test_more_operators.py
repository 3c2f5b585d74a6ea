"""Events, body measures, smoothing, reports, archives, spreadsheets and settings."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import params
from strideframe.operators import body, events, reports, smoothing
from strideframe.sources import arrays

K = ["k"]


def series(spark, xs, name="v"):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], f"k int, frame_index long, {name} double")


def test_event_rules(spark):
    df = series(spark, [0.0, 5.0, 7.0, 5.0, 1.0])
    assert events.frame_nearest_value(df, K, F.col("v"), 5.2).first()["event_frame"] == 1
    assert events.first_reaching(df, K, F.col("v"), 0.7).first()["landing_frame"] == 1
    assert df.groupBy("k").agg(events.event_frame(F.col("frame_index")).alias("e")).first()["e"] == 2
    assert [r["snap"] for r in events.snap(df, K, "v").orderBy("frame_index").collect()] == [7.0, 5.0, 1.0, 4.0, 6.0]
    assert events.active_duration(df, K, "v", 10.0, share=0.6).first()["active_sec"] == pytest.approx(0.3)
    assert events.larger_side(series(spark, [1.0, 3.0], "a").withColumn("b", F.lit(3.0)), K, "a", "b").first()["side"] == "right"


def test_phase_stops_at_missing_frames(spark):
    df = spark.createDataFrame([(1, f, v) for f, v in [(0, 0.9), (2, 0.8), (3, 1.0), (4, 0.7), (6, 0.9), (7, 0.1)]], "k int, frame_index long, v double")
    p = events.phase_around(df, K, "v", share=0.5).first()
    assert (p["event_frame"], p["start_frame"], p["end_frame"]) == (3, 2, 4)


def test_ready_block_and_first_rows(spark):
    df = spark.createDataFrame([(1, i, s, h) for i, (s, h) in enumerate([(1.0, 1.0), (1.0, 5.0), (1.0, 6.0), (9.0, 9.0), (1.0, 9.0)])], "k int, frame_index long, s double, h double")
    assert events.ready_block(df, K, "s", "h", size=2, most_speed=2.0, before=F.lit(5)).first()["ready_frame"] == 1
    gaps = series(spark, [None, 1.0, None, 2.0])
    assert [r["frame_index"] for r in events.first_complete_rows(gaps, K, ["v"], 2).collect()] == [1, 3]
    assert [r["frame_index"] for r in events.first_complete_rows(series(spark, [None, None]), K, ["v"], 1).collect()] == [0]


def test_samples(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(events.even_samples(F.lit(10), F.lit(20), 3)) == [10, 15, 20] and one(events.even_samples(F.lit(4), F.lit(4), 5)) == [4]
    out = events.thin_out(series(spark, [float(i) for i in range(10)]), K, 30, 10).orderBy("frame_index").collect()
    assert [(r["frame_index"], r["new_frame"]) for r in out] == [(0, 0), (3, 1), (6, 2), (9, 3)]


def test_body(spark):
    p = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([(1, 0, (0.0, 0.0, 0.0), (2.0, 0.0, 0.0), None), (1, 1, (0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (1.0, 1.0, 1.0))], f"k int, frame_index long, a {p}, b {p}, c {p}")
    r = df.select(body.mean_point(["a", "b", "c"])[0].alias("m"), body.body_scale([("a", "b"), ("a", "c")], ("x", "y", "z")).alias("s"), body.first_pair([("a", "c"), ("a", "b")])["b"]["x"].alias("f")).collect()
    assert r[0]["m"] == 1.0 and r[0]["s"] == 2.0 and r[0]["f"] == 2.0 and r[1]["f"] == 1.0
    d = body.stride_direction(df.withColumn("c", F.col("b")), K, "b", "a", "c", ("x", "z")).first()
    assert (d["dir_x"], d["dir_z"]) == (1.0, 0.0)
    flat = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate([0.0, 2.0])], "k int, frame_index long, x double, y double")
    assert body.stability(flat, K, ["x", "y"]).first()["stability"] == pytest.approx(50)
    assert body.stability(flat.filter("frame_index = 0"), K, ["x", "y"]).first()["stability"] is None
    assert [r["px"] for r in body.unit_square(flat, K, "x", "y").orderBy("frame_index").collect()] == [0.0, 1.0]


def test_smoothing_keeps_a_straight_line(spark):
    rows = [("c", "r", i, i / 30, "left_wrist", 0.01 * i, 0.5, 0.9, 0.9) for i in range(40) if i not in (10, 11)] + [("c", "r", i, i / 30, "left_wrist", None, None, 0.9, 0.9) for i in (10, 11)]
    df = spark.createDataFrame(rows, "clip_id string, condition_id string, frame_index long, timestamp_sec double, joint_name string, x double, y double, visibility double, confidence double")
    got = smoothing.smooth_pose2d(df, ["clip_id", "condition_id"]).orderBy("frame_index").collect()
    assert [r["x"] for r in got][6:-6] == pytest.approx([0.01 * i for i in range(40)][6:-6]) and got[10]["y"] == pytest.approx(0.5)
    p3 = df.select("clip_id", "condition_id", "frame_index", "joint_name", F.col("x").alias("x_3d"), F.col("y").alias("y_3d"), F.lit(1.0).alias("z_3d"), F.lit(0.8).alias("input_quality_score"))
    out = smoothing.smooth_pose3d(p3, ["clip_id", "condition_id"], max_gap=1).orderBy("frame_index").collect()
    assert out[10]["z_3d"] is None and out[10]["input_quality_score"] is None and out[9]["x_3d"] is not None
    assert smoothing.has_marker_skeleton(df, ["clip_id"], ["left_wrist"], 1).first()["marker_skeleton"]


def test_sticks_and_blend(spark):
    rows = [(1, i, 1.0 + 0.1 * i, 1.0, 0.1 * i, 1.0, 0.9) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, frame_index long, x double, y double, x2 double, y2 double, confidence double")
    got = smoothing.smooth_sticks(df, K).orderBy("frame_index").collect()
    assert [r["x"] for r in got] == pytest.approx([1.0 + 0.1 * i for i in range(7)]) and [r["y2"] for r in got] == pytest.approx([1.0] * 7)
    w = smoothing.protected_frames(df.filter("frame_index = 3").select("k", "frame_index"), K, margin=1, weight=0.5)
    mixed = {r["frame_index"]: r["x"] for r in smoothing.blend(df.withColumn("x", F.lit(0.0)), df, w, K, ["x"]).collect()}
    assert mixed[3] == pytest.approx(0.65) and mixed[2] == pytest.approx(0.3) and mixed[0] == 0.0


def test_reports(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(reports.frame_list(F.lit("3; x;12;"))) == [3, 12] and one(reports.frame_text(F.array(F.lit(3), F.lit(12)))) == "3;12"
    frames = F.array(F.lit(5), F.lit(9))
    assert tuple(one(reports.window_of(F.lit('{"segment_start": 2, "segment_end": 8}'), F.lit(""), frames))) == (2, 8)
    assert tuple(one(reports.window_of(F.lit("bad"), F.lit("expanded frames 4-7"), frames))) == (4, 7) and tuple(one(reports.window_of(F.lit(None), F.lit(None), frames))) == (5, 9)
    assert one(reports.center_frame(frames)) == 9 and [one(reports.column_number(F.lit(x))) for x in ("A1", "Z9", "AA", "AB12")] == [0, 25, 26, 27]
    assert one(reports.value_text(F.lit(1.23456))) == "1.235" and one(reports.value_text(F.lit(None).cast("double"))) == ""
    ref = spark.createDataFrame([("a", 10.0, 1.0, None), ("b", None, None, 5.0)], "m string, mean double, sd double, target double")
    df = spark.createDataFrame([("a", 12.0), ("b", 4.0), ("c", 1.0), ("a", None)], "m string, value double")
    assert sorted(r["assessment"] for r in reports.against_reference(df, ref, ["m"]).collect()) == ["above_1sd", "no_reference", "target", "unavailable"]


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", joints=np.arange(12.0).reshape(2, 2, 3), joint_names=np.array(["p", "q"]), scores=np.array([0.5, np.nan]))
    got = arrays.read_npz(spark, str(tmp_path)).orderBy("frame_index", "joint_name").collect()
    assert [(r["joint_name"], r["y_3d"], r["input_quality_score"]) for r in got] == [("p", 1.0, 0.5), ("q", 4.0, 0.5), ("p", 7.0, None), ("q", 10.0, None)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Peers"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c r="A2"><v>2.5</v></c><c r="B2"/></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(data.getvalue())
    cells = [(r["sheet"], r["row"], r["column"], r["value"]) for r in arrays.read_cells(spark, str(tmp_path)).orderBy("row", "column").collect()]
    assert cells == [("Peers", 0, 0, "name"), ("Peers", 0, 27, "value"), ("Peers", 1, 0, "2.5")]


def test_params(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nclip_overrides: {c1: {a: {y: 9}}}\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\na: {x: 5}\n")
    settings = params.load(tmp_path / "own.yaml")
    assert settings["a"] == {"x": 5, "y": 2}
    assert params.for_clip(settings, "c1")["a"] == {"x": 5, "y": 9} and params.for_clip(settings, "c2")["a"]["y"] == 2


def test_clips(spark, tmp_path):
    from strideframe.sources import tables

    (tmp_path / "clips.csv").write_text("clip_id,source_path,action_type,fps_target,difficulty_tags,notes\nc1,a.mp4,batting,30,dark; blur;;x1,\nc2,b.mp4,pitching,,,n\n")
    got = tables.read_clips(spark, str(tmp_path / "clips.csv"), "/data").orderBy("clip_id").collect()
    assert [(r["source_path"], r["difficulty_tags"], r["fps_target"]) for r in got] == [("/data/a.mp4", ["dark", "blur", "x1"], 30.0), ("/data/b.mp4", [], None)]
