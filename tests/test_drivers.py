"""Whole drivers in closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from strideframe.operators import smoothing

TRACK = "clip_id string, frame_index long, object_name string, x double, y double, x2 double, y2 double, confidence double"
K = ["clip_id"]


def tracks(spark, rows):
    return spark.createDataFrame([("c", f, name, *map(float, ends[:2]), *(float(e) if e is not None else None for e in [*ends[2:], None, None][:2]), 0.8) for f, name, *ends in rows], TRACK)


def stick_at(df, frame):
    r = df.filter((F.col("object_name") == "bat") & (F.col("frame_index") == frame)).first()
    return r["x"], r["y"], r["x2"], r["y2"]


LINE = [(0, "bat", 0.1, 0.2, 0.0, 0.2), (1, "bat", 0.2, 0.2, 0.1, 0.2), (2, "bat", 0.3, 0.2, 0.2, 0.2)]


def test_passes_keep_a_stick_that_moves_in_a_line(spark):
    out = smoothing.smooth_stick_tracks(tracks(spark, LINE), K, smoothing.StickRule(window=3))
    assert stick_at(out, 1) == pytest.approx((0.2, 0.2, 0.1, 0.2))
    # At the ends two rows are averaged: the own one weighs twice as much as the neighbour.
    assert stick_at(out, 0)[0] == pytest.approx((2 * 0.1 + 0.2) / 3)
    assert smoothing.smooth_stick_tracks(tracks(spark, LINE), K, smoothing.StickRule(window=2)).count() == 3


def test_frames_near_the_ball_are_drawn_back(spark):
    bent = [(0, "bat", 0.1, 0.2, 0.0, 0.2), (1, "bat", 0.5, 0.2, 0.4, 0.2), (2, "bat", 0.1, 0.2, 0.0, 0.2), (1, "ball", 0.6, 0.2)]
    rule = smoothing.StickRule(window=3, contact_margin=0, contact_weight=0.35)
    out = smoothing.smooth_stick_tracks(tracks(spark, bent), K, rule)
    # The line's value in the middle of weights 1/2, 1, 1/2 (squared).
    line = (0.1 * 0.25 + 0.5 + 0.1 * 0.25) / 1.5
    assert stick_at(out, 1)[0] == pytest.approx(0.65 * line + 0.35 * 0.5)
    ball = out.filter("object_name = 'ball'").first()
    assert (ball["x"], ball["y"]) == (0.6, 0.2)


def test_fast_turns_keep_their_angle(spark):
    turn = [(0, "bat", 0.3, 0.2, 0.1, 0.2), (1, "bat", 0.2, 0.3, 0.2, 0.1), (2, "bat", 0.1, 0.2, 0.3, 0.2)]
    out = smoothing.smooth_stick_tracks(tracks(spark, turn), K, smoothing.StickRule(window=3, passes=2, fast=20.0, fast_weight=0.85))
    x, y, x2, y2 = stick_at(out, 1)
    assert y - y2 > 0.12 and abs(x - x2) < 0.2
    # The second frame turns by one radian at most.
    assert math.atan2(y - y2, x - x2) == pytest.approx(1.0)


def test_swings_start_anew_behind_a_gap(spark):
    flat = lambda f, a: (f, "bat", 1 + 0.5 * math.cos(a), 1 + 0.5 * math.sin(a), 1 - 0.5 * math.cos(a), 1 - 0.5 * math.sin(a))
    df = tracks(spark, [flat(1, 0.1), flat(40, 1.5), flat(41, 3.0)])
    swing = df.select("clip_id", "frame_index")
    out = smoothing.tune_swing(df, df, swing, K, step=35.0, lengths=(0.45, 1.35))
    angle = {f: math.atan2(*(a - b for a, b in zip(stick_at(out, f)[1::-1], stick_at(out, f)[:1:-1], strict=True))) for f in (1, 40, 41)}
    assert angle[1] == pytest.approx(0.1) and angle[40] == pytest.approx(1.5) and angle[41] == pytest.approx(2.5)
    assert stick_at(smoothing.tune_swing(df, df, swing, K, step=35.0, lengths=(0.45, 1.35), least=4), 41) == pytest.approx(stick_at(df, 41))


def test_a_run_with_an_open_end(spark):
    """Its coordinates are averaged, and its swing is left alone."""
    rows = [*LINE, (3, "bat", 0.4, 0.2, None, None)]
    df = tracks(spark, rows)
    out = smoothing.smooth_stick_tracks(df, K, smoothing.StickRule(window=3, fast=20.0, swing_margin=5))
    assert stick_at(out, 3)[2:] == pytest.approx((0.2, 0.2)) and stick_at(out, 1)[0] == pytest.approx((0.5 * 0.1 + 0.2 + 0.5 * 0.3) / 2)
    tuned = smoothing.tune_swing(out.filter("object_name = 'bat'"), df, df.select("clip_id", "frame_index"), K, step=35.0, lengths=(0.45, 1.35))
    assert stick_at(tuned, 1) == pytest.approx(stick_at(out, 1))
    short = smoothing.smooth_stick_tracks(tracks(spark, LINE[:2]), K, smoothing.StickRule(window=3))
    assert stick_at(short, 0) == pytest.approx((0.1, 0.2, 0.0, 0.2))
    empty = tracks(spark, LINE).limit(0)
    assert smoothing.smooth_stick_tracks(empty, K, smoothing.StickRule(window=3, fast=20.0)).count() == 0


# ---- completion

from strideframe.operators import completion  # noqa: E402

POSE = "clip_id string, frame_index long, joint_name string, x double, y double, visibility double, confidence double, backend string, extra int"


def pose(spark, rows):
    return spark.createDataFrame([("c", f, j, x, y, score, score, "test", 7) for f, j, x, y, score in rows], POSE)


def point_of(df, frame, joint):
    return df.filter((F.col("frame_index") == frame) & (F.col("joint_name") == joint)).first()


def arm(frames, wrist=None, score=None):
    """An elbow and a wrist that move to the right, 0.1 apart; wrist and score by frame replace what is there."""
    for f in frames:
        yield f, "right_elbow", 0.5 + f * 0.01, 0.5, 1.0
        x, y = (wrist or {}).get(f, (0.6 + f * 0.01, 0.5))
        yield f, "right_wrist", x, y, (score or {}).get(f, 1.0)


STRICT = completion.CompletionRule(max_gap=0, limb_tolerance=0.25, time_tolerance=0.03)


def test_a_doubted_point_that_fits_is_rescued(spark):
    out = completion.complete_pose(pose(spark, arm(range(5), score={2: 0.08})), K, STRICT)
    got = point_of(out, 2, "right_wrist")
    assert (got["x"], got["confidence"], got["visibility"], got["backend"], got["extra"]) == (pytest.approx(0.62), 0.62, 0.62, "test+rescued", 7)
    assert out.count() == 10 and out.filter("backend = 'test'").count() == 9


def test_a_doubted_point_that_does_not_fit_stays(spark):
    out = completion.complete_pose(pose(spark, arm(range(5), wrist={2: (0.9, 0.9)}, score={2: 0.08})), K, STRICT)
    assert (point_of(out, 2, "right_wrist")["confidence"], point_of(out, 2, "right_wrist")["backend"]) == (0.08, "test")
    # Under the least score nothing is rescued; without the step neither.
    assert point_of(completion.complete_pose(pose(spark, arm(range(5), score={2: 0.01})), K, STRICT), 2, "right_wrist")["backend"] == "test"
    off = completion.CompletionRule(max_gap=0, rescue=False)
    assert point_of(completion.complete_pose(pose(spark, arm(range(5), score={2: 0.4})), K, off), 2, "right_wrist")["backend"] == "test"


def test_a_shoulder_is_rescued_in_time(spark):
    rows = [(f, "left_shoulder", 0.2, 0.3, 0.35 if f == 1 else 1.0) for f in range(3)]
    assert point_of(completion.complete_pose(pose(spark, rows), K, STRICT), 1, "left_shoulder")["backend"] == "test+rescued"


def test_short_gaps_of_an_end_are_filled_at_the_bone(spark):
    missing = {f: (None, None) for f in (2, 3)}
    out = completion.complete_pose(pose(spark, arm(range(6), wrist=missing)), K, completion.CompletionRule(max_gap=2))
    for f in (2, 3):
        got = point_of(out, f, "right_wrist")
        assert (got["x"], got["y"], got["backend"]) == (pytest.approx(0.6 + f * 0.01), pytest.approx(0.5), "test+imputed")
    for rule in (completion.CompletionRule(max_gap=1), completion.CompletionRule(gaps={"distal": 1}), completion.CompletionRule(gaps={"right_wrist": 1, "distal": 9})):
        assert point_of(completion.complete_pose(pose(spark, arm(range(6), wrist=missing)), K, rule), 2, "right_wrist")["x"] is None
    # Both sides have to be there, right before the gap and behind it.
    assert point_of(completion.complete_pose(pose(spark, arm(range(4), wrist={3: (None, None)})), K), 3, "right_wrist")["x"] is None
    holey = [r for r in arm(range(6), wrist=missing) if r[:2] != (2, "right_wrist")]
    assert point_of(completion.complete_pose(pose(spark, holey), K), 3, "right_wrist")["x"] is None


def test_the_direction_of_the_nearest_frame(spark):
    """The target falls on the elbow: the arm takes the direction that it has in the nearest frame, the earlier of two."""
    rows = [r for f, up in ((0, 0.6), (2, 0.4)) for r in ((f, "right_elbow", 0.5, 0.5, 1.0), (f, "right_wrist", 0.5, up, 1.0))]
    rows += [(1, "right_elbow", 0.5, 0.5, 1.0), (1, "right_wrist", None, None, 1.0)]
    got = point_of(completion.complete_pose(pose(spark, rows), K), 1, "right_wrist")
    assert (got["x"], got["y"]) == (pytest.approx(0.5), pytest.approx(0.6))


def test_a_middle_joint_goes_where_its_bones_meet(spark):
    rows = []
    for f in range(3):
        rows += [(f, "left_hip", 0.5, 0.2, 1.0), (f, "left_knee", 0.6, 0.3, 1.0 if f != 1 else 0.0), (f, "left_ankle", 0.5, 0.4, 1.0)]
    rows[4] = (1, "left_knee", None, None, 1.0)
    got = point_of(completion.complete_pose(pose(spark, rows), K), 1, "left_knee")
    assert (got["x"], got["y"], got["backend"]) == (pytest.approx(0.6), pytest.approx(0.3), "test+imputed")
    # Too far apart for the bones: half way.
    rows[5] = (1, "left_ankle", 0.5, 0.9, 1.0)
    got = point_of(completion.complete_pose(pose(spark, rows), K), 1, "left_knee")
    assert (got["x"], got["y"]) == (pytest.approx(0.5), pytest.approx(0.55))


def test_a_limb_whose_ends_meet(spark):
    """Hip and ankle in one place have no direction between them: the knee goes half way, and no division by zero ends the job."""
    rows = []
    for f in range(3):
        rows += [(f, "left_hip", 0.5, 0.2, 1.0), (f, "left_knee", 0.6, 0.3, 1.0), (f, "left_ankle", 0.5, 0.4, 1.0)]
    rows[4:6] = [(1, "left_knee", None, None, 1.0), (1, "left_ankle", 0.5, 0.2, 1.0)]
    got = point_of(completion.complete_pose(pose(spark, rows), K), 1, "left_knee")
    assert (got["x"], got["y"], got["backend"]) == (pytest.approx(0.5), pytest.approx(0.2), "test+imputed")


def test_completion_reads_a_clip_once(spark):
    """No window reaches from a row to the end of its clip: such a frame is read anew for every row."""
    out = completion.complete_pose(pose(spark, arm(range(4))), K)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().replace("unboundedpreceding$(), unboundedfollowing$()", "")


def test_completion_settings_and_one_shuffle(spark):
    for bad in ({"max_gap": -1}, {"confidence": 0.0}):
        with pytest.raises(ValueError):
            completion.CompletionRule(**bad)
    out = completion.complete_pose(pose(spark, arm(range(3))), K)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert completion.complete_pose(pose(spark, []), K).count() == 0


# ---- grids, samples, events, settings

from strideframe.operators import events, grids, reports, settings  # noqa: E402


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_key(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_a_grid_has_no_holes(spark):
    rows = [("c", 2, "a", 1.0), ("c", 2, "a", 3.0), ("c", 9, "b", 5.0), ("c", 40, "a", 8.0), ("c", 50, "b", 6.0), ("c", 51, "b", None), ("d", 1, "b", 7.0)]
    out = grids.pivoted(frame(spark, rows, "clip_id string, frame_index long, joint_name string, x double"), K, ["a", "b"], ["x"])
    # By rows, not by frame numbers; ends held; a name without a value stays null.
    assert by_key(out, "clip_id", "frame_index", "a_x", "b_x") == [("c", 2, 2.0, 5.0), ("c", 9, 5.0, 5.0), ("c", 40, 8.0, 5.5), ("c", 50, 8.0, 6.0), ("c", 51, 8.0, 6.0), ("d", 1, None, 7.0)]
    half = grids.pivoted(frame(spark, rows[:1], "clip_id string, frame_index long, joint_name string, x double"), K, ["a"], ["x"], scale=0.001)
    assert half.first()["a_x"] == 0.001


def test_a_time_axis(spark):
    rows = [("c", 1, 0.1), ("c", 1, 0.3), ("c", 3, None), ("c", 4, 0.8)]
    t = frame(spark, rows, "clip_id string, frame_index long, timestamp_sec double")
    assert by_key(grids.time_axis(t, K), "frame_index", "timestamp_sec") == [(1, pytest.approx(0.2)), (3, pytest.approx(0.5)), (4, 0.8)]
    wanted = frame(spark, [("c", f) for f in (0, 1, 2, 4, 9)], "clip_id string, frame_index long")
    assert [v for _, v in by_key(grids.time_axis(t, K, frames=wanted), "frame_index", "timestamp_sec")] == pytest.approx([0.2, 0.2, 0.5, 0.8, 0.8])


def test_frames_that_only_one_table_has(spark):
    make = lambda rows: frame(spark, rows, "clip_id string, frame_index long, v double")
    union = grids.frame_union({"a": make([("c", 1, 4.0), ("c", 2, -8.0)]), "b": make([("c", 2, 3.0), ("c", 7, None)]), "e": make([])}, K, "v")
    assert by_key(union.na.fill(-1), "frame_index", "a", "b", "e") == [(1, 4.0, -1.0, -1.0), (2, -8.0, 3.0, -1.0), (7, -1.0, -1.0, -1.0)]
    score = grids.combined_score(union, K, {"a": 1.0, "b": 0.4, "e": 0.25})
    assert by_key(score, "frame_index", "score") == [(1, 0.5), (2, 1.4), (7, 0.0)]
    seen = frame(spark, [("c", 1, 5, 0.9), ("c", 1, 2, 0.4), ("c", 2, 1, None)], "clip_id string, frame_index long, row long, timestamp_sec double")
    assert by_key(grids.frame_times(seen, K, ["row"]), "frame_index", "timestamp_sec") == [(1, 0.4), (2, None)]


def test_sampled_trajectories(spark):
    make = lambda values: frame(spark, [("c", i, v, v) for i, v in enumerate(values)], "clip_id string, frame_index long, x double, y double")
    pick = lambda df, **o: [r["frame_index"] for r in grids.sampled_trajectory(df, K, ["x", "y"], **o).orderBy("frame_index").collect()]
    for n in (1, 5, 24, 25, 47, 100, 231):
        import numpy as np

        want = list(range(n)) if n <= 24 else np.linspace(0, n - 1, 24, dtype=int).tolist()
        assert pick(make([float(i) for i in range(n)])) == want
    gap = make([0.0, None, None, None, 9.0, 2.0, 7.0])
    assert pick(gap) == [0, 4, 5, 6] and pick(gap, radius=1) == [0, 1, 3, 4, 5, 6]
    near = {r["frame_index"]: r["x"] for r in grids.sampled_trajectory(gap, K, ["x", "y"], radius=1).collect()}
    assert near == {0: 0.0, 1: 0.0, 3: 9.0, 4: 5.5, 5: 7.0, 6: 4.5}
    assert pick(make([])) == []


MOVES = "clip_id string, frame_index long, speed double, height double"


def stance(spark, rows, swing, peak, **options):
    df = frame(spark, [("c", i, s, h) for i, (s, h) in enumerate(rows)], MOVES)
    swings = frame(spark, [("c", swing, peak)], "clip_id string, start_pos long, peak double")
    out = events.ready_rows(df, K, swings, ["height"], "speed", "height", rate=10.0, size=2, lookback_sec=1.0, **options)
    return [(r["rule"], r["frame_index"]) for r in out.orderBy("frame_index").collect()]


def test_every_rule_of_the_ready_stance(spark):
    slow, fast, blind = (1.0, 5.0), (50.0, 5.0), (1.0, None)
    # 1: of the blocks that are slow throughout the highest, the earliest of equals.
    assert stance(spark, [slow, slow, (1.0, 7.0), (1.0, 7.0), (1.0, 7.0), fast, slow, slow], 6, 100.0) == [(1, 2), (1, 3)]
    # 2: no block, but two slow rows.
    assert stance(spark, [slow, fast, slow, fast, slow, fast], 6, 100.0) == [(2, 0), (2, 2)]
    # 3: too few slow rows.
    assert stance(spark, [slow, fast, fast, fast, fast], 5, 100.0) == [(3, 0), (3, 1)]
    assert stance(spark, [fast, slow], 1, 100.0) == [(3, 0)]
    # 4: nothing before the swing, or nothing valid there.
    assert stance(spark, [slow, blind, slow, slow], 0, 100.0) == [(4, 0), (4, 2)]
    assert stance(spark, [blind, blind, slow, fast, slow], 2, 100.0) == [(4, 2), (4, 3)]
    assert stance(spark, [slow, slow, slow], 2, 100.0, valid_from=F.lit(9)) == [(4, 0), (4, 1)]
    # 5: no point at all.
    assert stance(spark, [blind, blind, blind], 2, None) == [(5, 0), (5, 1)]
    # The lookback ends ten rows before the swing.
    assert stance(spark, [slow] * 5 + [(1.0, 1.0)] * 11, 15, 100.0) == [(1, 5), (1, 6)]


def test_swing_segments(spark):
    df = frame(spark, [("c", i, s, 0.0) for i, s in enumerate([0.0] * 10 + [100.0] * 5 + [0.0] * 10)] + [("d", i, None, 0.0) for i in range(5)], MOVES)
    got = {r["clip_id"]: r.asDict() for r in events.swing_segment(df, K, "speed", 10.0).collect()}
    # Means of five rows reach 20 % of the peak from two rows before the first fast one.
    assert {k: got["c"][k] for k in ("peak", "threshold", "peak_pos", "start_pos", "end_pos", "from_pos", "to_pos")} == {"peak": 100.0, "threshold": 20.0, "peak_pos": 12, "start_pos": 8, "end_pos": 16, "from_pos": 6, "to_pos": 18}
    assert {k: got["d"][k] for k in ("peak", "threshold", "peak_pos", "start_pos", "end_pos", "from_pos", "to_pos")} == {"peak": None, "threshold": None, "peak_pos": 2, "start_pos": 0, "end_pos": 4, "from_pos": 0, "to_pos": 4}


def test_switches_and_settings(spark):
    clips = frame(spark, [("p", "pitching"), ("b", "batting"), ("r", "running"), ("n", None), ("q", "pitching")], "clip_id string, action_type string")
    one = lambda c: clips.filter(F.col("clip_id") == c)
    got = by_key(settings.equipment_switches(clips, one("b"), one("q")), "clip_id", "detect_stick", "detect_ball")
    assert got == [("b", False, False), ("n", True, True), ("p", False, False), ("q", False, True), ("r", True, True)]
    got = by_key(settings.equipment_switches(clips, one("x"), one("x"), ball_for_pitching=True, ball_for_batting=True, stick=False), "clip_id", "detect_stick", "detect_ball")
    assert got == [(c, False, True) for c in "bnpqr"]
    over = frame(spark, [("p", "gap", "9"), ("p", "more", "1"), ("zz", "gap", "0")], "clip_id string, setting string, value string")
    found = {r["clip_id"]: r["settings"] for r in settings.clip_settings(clips, over, F.create_map(F.lit("gap"), F.lit("5"), F.lit("window"), F.lit("3"))).collect()}
    assert found["p"] == {"gap": "9", "window": "3", "more": "1"} and found["b"] == {"gap": "5", "window": "3"}
    speeds = frame(spark, [("p", 100.0), ("b", 100.0), ("r", None)], "clip_id string, px double")
    known = frame(spark, [("p", 180.0), ("p", -1.0), ("b", 0.0), ("r", 90.0)], "clip_id string, body_height_px double")
    assert by_key(settings.calibrated_speed(speeds, known, height_m=1.8, speed="px").filter("clip_id != 'r'").na.fill(-1), "clip_id", "speed_kmh") == [("b", -1.0), ("p", pytest.approx(3.6))]
    names = frame(spark, [("raw_smooth",), ("roi_complete_smooth",), ("roi_complete",), ("smooth_x",)], "c string").select(settings.source_condition(F.col("c")).alias("s"))
    assert sorted(r["s"] for r in names.collect()) == ["raw", "roi", "roi", "smooth_x"]


def test_owners_and_candidates(spark):
    df = frame(spark, [("t", "B", "m1"), ("t", "B", "m2"), ("t", "A", "m1"), ("t", "C", "m1"), ("t", "C", "m2"), ("u", "A", "m1")], "trial_id string, prefix string, marker string")
    assert by_key(settings.first_owner(df, ["trial_id"], "prefix", "marker", ["m1", "m2"]).na.fill("-"), "trial_id", "prefix") == [("t", "B"), ("u", "-")]
    with pytest.raises(Exception, match="no prefix has all of m1, m2"):
        settings.first_owner(df, ["trial_id"], "prefix", "marker", ["m1", "m2"], required=True).collect()
    there = F.col("prefix") != "A"
    assert by_key(settings.first_existing(df, ["trial_id"], "marker", ["m9", "m2", "m1"], there).na.fill("-"), "trial_id", "marker") == [("t", "m2"), ("u", "-")]
    with pytest.raises(Exception, match="none of m9, m2"):
        settings.first_existing(df, ["trial_id"], "marker", ["m9", "m2"], there, required=True).collect()


def test_projection_bounds(spark):
    rows = [("c", float(i), 2.0 * i, 5.0) for i in range(21)]
    out = {r["projection"]: r for r in grids.projection_bounds(frame(spark, rows, "clip_id string, x double, y double, z double"), K, {"Front": ("x", "y"), "Top": ("x", "z")}).collect()}
    assert (out["Front"]["min_h"], out["Front"]["max_h"]) == (pytest.approx(1 - 2.7), pytest.approx(19 + 2.7))
    assert (out["Top"]["min_v"], out["Top"]["max_v"]) == (pytest.approx(5 - 1e-4), pytest.approx(5 + 1e-4))


def test_metric_rows(spark):
    catalog = frame(spark, [("k", "m", "n", "u", "max", "e", "r", ["a", "b"], "f", "batting"), ("w", "m", "n", "u", "max", "", "", [], "f", None)], "metric_key string, module string, metric_name_zh string, unit string, aggregation string, event_name string, event_rule string, points array<string>, formula string, action_type string")
    trials = frame(spark, [("1", "s", "a", "batting", "x"), ("2", "s", "a", None, "x")], "trial_id string, sample_name string, athlete string, action_type string, source_file string")
    values = frame(spark, [("1", "k", 2.5, [7, 3, 4, 8], {"z": "1", "b": "2"}, None), ("1", "w", None, [1], None, "why")], "trial_id string, metric_key string, value double, events array<bigint>, components map<string,string>, notes string")
    got = {(r["trial_id"], r["metric_key"]): r for r in reports.metric_rows(values, trials, catalog).collect()}
    assert set(got) == {("1", "k"), ("1", "w"), ("2", "w")} and len(got["1", "k"]) == 21
    k = got["1", "k"]
    assert (k["event_frame"], k["event_frames"], k["points_used"], k["components_json"], k["availability"], k["reason"]) == (6, "3;4;7;8", "a;b", '{"b":"2","z":"1"}', "available", "")
    assert (got["1", "w"]["reason"], got["1", "w"]["notes"], got["2", "w"]["reason"], got["2", "w"]["components_json"]) == ("missing_points", "why", "no_event", "{}")


# ---- sheets and comparisons

import io  # noqa: E402
import zipfile  # noqa: E402

from strideframe.functions.scoring import percent_gap  # noqa: E402
from strideframe.operators import comparisons  # noqa: E402
from strideframe.sources import arrays, sheets  # noqa: E402


def workbook(**pages):
    """A workbook of sheets, each a list of rows of cells; texts are inline."""
    data = io.BytesIO()
    letter = lambda k: chr(65 + k)
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets>" + "".join(f'<sheet name="{n}"/>' for n in pages) + "</sheets></workbook>")
        for i, rows in enumerate(pages.values()):
            body = "".join("<row>" + "".join(cell(f"{letter(k)}{r + 1}", v) for k, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return data.getvalue()


def test_a_marker_workbook(spark, tmp_path):
    head = [["Trajectories"], [120], [None, None, "S:head", None, None, "hip"], ["Frame", "Sub", "X", "Y", "Z", "X", "Y", "Z"], [None, None, "mm", "mm", "mm", "mm", "mm", "mm"]]
    rows = [[1, 0, 1.5, 2, 3, 4, 5, 6], [2, 0, None, 2.5, None, "n/a", None, 7], [None, 0, 9, 9, 9, 9, 9, 9]]
    (tmp_path / "t.xlsx").write_bytes(workbook(First=head + rows, Second=[["x"], [1], [None, None, "other"]]))
    (tmp_path / "u.xlsx").write_bytes(workbook(Only=[["t"], [None, 1], [None, None, "m"], [], [], [7, 0, 1, 2, 3]]))
    got = by_key(sheets.marker_rows(arrays.read_cells(spark, str(tmp_path))).na.fill(-1), "rate_hz", "frame_index", "joint_name", "x", "y", "z")
    assert got == sorted([(120.0, 0, "head", 1.5, 2.0, 3.0), (120.0, 0, "hip", 4.0, 5.0, 6.0), (120.0, 1, "head", -1.0, 2.5, -1.0), (120.0, 1, "hip", -1.0, -1.0, 7.0), (100.0, 6, "m", 1.0, 2.0, 3.0)])


def test_a_peer_workbook(spark, tmp_path):
    report = [["no", "shown", "name", "value", "unit"], [1, "a", "Stride ", 85, "%H"], [2, "b", "Stride", 90, "%H"], [3, "c", "Speed", "fast", "km"], [4, "d", "Speed", 31.5, "km"], [5, "e", "Unknown", 3, "x"], [6, "f", "Tilt", None, "deg"]]
    (tmp_path / "a_report.xlsx").write_bytes(workbook(Report=report, About=[["title", "x"], ["source", "data/Ann B/run"]]))
    (tmp_path / "b_report.xlsx").write_bytes(workbook(Report=report[:3], About=[["source", "nowhere"]]))
    names = spark.createDataFrame([("Stride", "stride_ratio"), ("Speed", "speed"), ("Tilt", "tilt")], "name string, metric_key string")
    out = sheets.peer_metrics(arrays.read_cells(spark, str(tmp_path)), names, {"km": "kmh", "%H": "ratio"}, sheet="Report", about="About", source="source", of_height="%H", ending="_report.xlsx")
    assert by_key(out, "athlete", "metric_key", "metric_name", "value", "unit") == [("Ann B", "speed", "Speed", 31.5, "kmh"), ("Ann B", "stride_ratio", "Stride", 0.9, "ratio"), ("b", "stride_ratio", "Stride", 0.9, "ratio")]


def test_compared_pitch_and_gap(spark):
    names = [c for _, c, *_ in comparisons.PITCH]
    own = spark.createDataFrame([("t", "c", *[50.0] * 13), ("u", "none", *[150.0] * 13)], "trial_id string, coach string, " + ", ".join(f"{c} double" for c in names))
    coach = spark.createDataFrame([("c", *[40.0] * 13)], "coach string, " + ", ".join(f"{c} double" for c in names))
    got = {(r["trial_id"], r["metric"]): r for r in comparisons.compared_pitch(own, coach, ["trial_id"], ["coach"]).collect()}
    assert len(got) == 26
    speed, lean = got["t", "arm_speed"], got["t", "trunk_lean"]
    assert (speed["value"], speed["coach_value"], speed["status"], speed["gap_score"]) == (125.0, 100.0, "ok", 25.0) and (lean["value"], lean["status"], lean["gap_score"]) == (50.0, "bad", 25.0)
    alone = got["u", "arm_speed"]
    assert (alone["value"], alone["coach_value"], alone["status"], alone["gap_score"]) == (None, None, "warn", 50.0) and got["u", "elbow_bend"]["status"] == "ok" and got["u", "weight_transfer"]["status"] == "warn"
    far = spark.range(1).select(percent_gap(F.lit(9.0), F.lit(1.0)).alias("a"), percent_gap(F.lit(9.0), F.lit(0.0)).alias("b")).first()
    assert (far["a"], far["b"]) == (140.0, 50.0)


def test_chosen_trials_and_first_values(spark):
    trials = spark.createDataFrame([(1, "t2", "Batting"), (2, "t1", "batting"), (3, None, "pitching")], "row long, trial_id string, action_type string")
    pick = lambda **o: comparisons.selected_trial(trials, ["row"], **o).first()["trial_id"]
    assert pick(action_type="batting") == "t2" and pick(trial_id="t1") == "t1"
    for bad in ({"trial_id": "t9"}, {"action_type": "pitching"}, {"action_type": "running"}):
        with pytest.raises(Exception, match="no trial"):
            pick(**bad)
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, float("nan")), ("a", 3, 5.0), ("a", 4, 6.0), ("b", 1, float("inf"))], "k string, row long, v double")
    assert by_key(comparisons.first_value(rows, ["k"], "v", ["row"]).na.fill(-1), "k", "v") == [("a", 5.0), ("b", -1.0)]


def test_the_pose_driver_folds_once(spark):
    """One fold of the torso and one partitioning by series, however many gates and filters follow."""
    rows = [(f, j, 0.5 + 0.01 * f, 0.4, 1.0) for f in range(6) for j in ("left_hip", "right_hip", "left_knee")]
    out = smoothing.smooth_pose2d(pose(spark, rows), K, smoothing.Pose2dRule(least_torso_frames=2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Exchange hashpartitioning") <= 7
    assert out.count() == len(rows)
