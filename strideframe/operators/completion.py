"""Completion of short limb gaps from neighbouring frames and joints."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import by_joint, not_distrusted, pose_score
from ..functions.geometry import distance, lerp, project_from
from ..schemas import LIMB_CHAINS
from .gates import segment_lengths
from .series import Keys, along, neighbours, next_present

#: The joints of limbs, each with the segments that hold it: (joint, other end, proximal, distal).
COMPLETABLE = tuple(sorted({j for chain in LIMB_CHAINS for j in chain}))
ADJACENT = tuple((j, b if j == a else a, a, b) for p, m, d in LIMB_CHAINS for a, b in ((p, m), (m, d)) for j in (a, b) if j in COMPLETABLE)


def usable(threshold: float) -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & not_distrusted(pose_score(), threshold)


def gap_by_suffix(settings: Mapping[str, int] | None, fallback: int) -> Column:
    """A gap limit for each row by the end of the joint's name: wrists and ankles are "distal", elbows and knees "mid_limb", others "default"."""
    settings, name = settings or {}, F.col("joint_name")
    of = lambda k: F.lit(int(settings.get(k, settings.get("default", fallback))))
    own = F.coalesce(*[F.when(name == k, F.lit(int(v))) for k, v in settings.items()], F.lit(None).cast("int"))
    group = F.when(name.endswith("wrist") | name.endswith("ankle"), of("distal")).when(name.endswith("elbow") | name.endswith("knee"), of("mid_limb")).otherwise(of("default"))
    return F.coalesce(own, group)


def bones(df: DataFrame, keys: Keys, ok: Column) -> DataFrame:
    """Median length of every limb segment over the frames in which both ends are usable."""
    lengths = segment_lengths(df.filter(ok), [*keys, "frame_index"], ["x", "y"])
    return lengths.groupBy(*keys, "proximal", "distal").agg(F.median("length").alias("bone"))


def biomechanically_plausible(df: DataFrame, keys: Keys, ok: Column, tolerance: float) -> DataFrame:
    """Adds fits: at least one segment to a usable neighbour in the frame is within a share of its median length."""
    dim = F.broadcast(df.sparkSession.createDataFrame(list(ADJACENT), "joint_name string, _other string, proximal string, distal string"))
    others = df.filter(ok).select(*keys, "frame_index", F.col("joint_name").alias("_other"), F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    pairs = df.select(*keys, "frame_index", "joint_name", "x", "y").dropna(subset=["x", "y"]).join(dim, "joint_name")
    pairs = pairs.join(others, [*keys, "frame_index", "_other"]).join(bones(df, keys, ok), [*keys, "proximal", "distal"])
    off = distance([F.col("_ox"), F.col("_oy")], [F.col("x"), F.col("y")]) / F.when(F.col("bone") > 0, F.col("bone"))
    fits = pairs.groupBy(*keys, "frame_index", "joint_name").agg(F.max(off.between(max(0.0, 1 - tolerance), 1 + tolerance)).alias("fits"))
    return df.join(fits, [*keys, "frame_index", "joint_name"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def rescue(df: DataFrame, keys: Keys, *, threshold: float, least: float, least_alone: float, limb_tolerance: float, time_tolerance: float, confidence: float = 0.62) -> DataFrame:
    """Distrusted points of limbs that fit after all get the confidence and "+rescued" behind their backend.

    A point with a score of at least `least` is rescued where a limb has its usual length, or where it lies near the line between
    its neighbours in time and its score is at least `least_alone`. Where there is no score neither is asked for.
    """
    ok, score = usable(threshold), pose_score()
    marked = temporally_plausible(biomechanically_plausible(df, keys, ok, limb_tolerance), keys, ok, time_tolerance)
    enough = lambda least: F.coalesce(score >= least, F.lit(True))
    can = F.col("joint_name").isin(*COMPLETABLE) & F.col("x").isNotNull() & F.col("y").isNotNull() & ~ok & enough(least)
    saved = can & (F.col("fits") | (enough(least_alone) & F.coalesce("plausible", F.lit(False))))
    marked = marked.withColumn("_saved", saved)
    tag = F.when(F.col("backend").endswith("+rescued"), F.col("backend")).otherwise(F.concat("backend", F.lit("+rescued")))
    sure = F.lit(min(confidence, 1.0))
    new = {"backend": tag, "visibility": sure, "confidence": sure, "x": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x"))), "y": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("y")))}
    return marked.withColumns({c: F.when(F.col("_saved"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_saved", "fits", "plausible")


def nearest_direction(df: DataFrame, keys: Keys, ok: Column, proximal: str, distal: str, *, reach: int = 5) -> DataFrame:
    """(dx, dy) from proximal to distal for every frame of the series: of the nearest other frame within reach that has both (the earlier of two), else (1, 0)."""
    points = df.filter(ok & F.col("joint_name").isin(proximal, distal))
    pick = lambda j: F.max(F.when(F.col("joint_name") == j, F.struct("x", "y")))
    both = points.groupBy(*keys, "frame_index").agg(pick(proximal).alias("p"), pick(distal).alias("d")).filter("p is not null and d is not null")
    near = both.select(*keys, F.explode(F.sequence(F.col("frame_index") - reach, F.col("frame_index") + reach)).alias("_to"), F.col("frame_index").alias("_from"), (F.col("d.x") - F.col("p.x")).alias("dx"), (F.col("d.y") - F.col("p.y")).alias("dy"))
    near = near.filter("_to != _from").groupBy(*keys, F.col("_to").alias("frame_index")).agg(F.min_by(F.struct("dx", "dy"), F.struct(F.abs(F.col("_to") - F.col("_from")), F.col("_from"))).alias("v"))
    frames = df.select(*keys, "frame_index").distinct()
    return frames.join(near, [*keys, "frame_index"], "left").select(*keys, "frame_index", F.coalesce("v.dx", F.lit(1.0)).alias("dx"), F.coalesce("v.dy", F.lit(0.0)).alias("dy"))


def gap_targets(df: DataFrame, keys: Keys, ok: Column, max_gap: int | Column) -> DataFrame:
    """Unusable rows of gaps of at most max_gap frame numbers between usable rows right before and behind: target (tx, ty) on the line between those."""
    w = along([*keys, "joint_name"])
    df = df.withColumn("_ok", ok)
    df = df.withColumn("_here", F.when(F.col("_ok"), F.struct("frame_index", "x", "y")))
    before = F.last("_here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({"_a": before, "_b": next_present("_here", [*keys, "joint_name"]), "_before": F.lag("frame_index").over(w)}).drop("_here")
    run_start = F.min(F.when(~F.col("_ok"), F.col("frame_index"))).over(Window.partitionBy(*keys, "joint_name", "_a", "_b"))
    df = df.filter(~F.col("_ok") & F.col("_a").isNotNull() & F.col("_b").isNotNull()).withColumn("_start", run_start)
    gap = F.col("_b.frame_index") - F.col("_start")
    df = df.filter((gap > 0) & (gap <= max_gap) & (F.col("_a.frame_index") == F.col("_start") - 1))
    share = (F.col("frame_index") - F.col("_start") + 1) / (gap + 1)
    return df.withColumns({"tx": lerp(F.col("_a.x"), F.col("_b.x"), share), "ty": lerp(F.col("_a.y"), F.col("_b.y"), share)}).drop("_a", "_b", "_before", "_start", "_ok")


def complete_limbs(df: DataFrame, keys: Keys, *, threshold: float, max_gap: int | Column, confidence: float = 0.62) -> DataFrame:
    """Fill short gaps: limb ends at the median bone length from the joint before them towards the target, middle joints where both bones meet, nearest to it.

    All fills read the rows as they came in. Filled rows get the confidence and "+imputed" behind their backend; all others stay.
    """
    ok = usable(threshold)
    spark = df.sparkSession
    chains = [(a, m, b) for a, m, b in LIMB_CHAINS]
    dim = F.broadcast(spark.createDataFrame([("end", b, m, None, m, b) for _, m, b in chains] + [("middle", m, a, b, a, m) for a, m, b in chains], "role string, joint_name string, near string, far string, seg_a string, seg_b string"))
    far_dim = F.broadcast(spark.createDataFrame([(m, m, b) for _, m, b in chains], "joint_name string, far_a string, far_b string"))
    frame = [*keys, "frame_index"]
    points = df.filter(ok)
    lengths = bones(df, keys, ok)
    bone = lambda a, b, name: lengths.select(*keys, F.col("proximal").alias(a), F.col("distal").alias(b), F.col("bone").alias(name))
    place = lambda joint, p: points.select(*frame, F.col("joint_name").alias(joint), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    todo = gap_targets(df, keys, ok, max_gap).select(*frame, "joint_name", "tx", "ty").join(dim, "joint_name").join(far_dim, "joint_name", "left")
    todo = todo.join(place("near", "n"), [*frame, "near"]).join(place("far", "f"), [*frame, "far"], "left")
    todo = todo.join(bone("seg_a", "seg_b", "bone"), [*keys, "seg_a", "seg_b"], "left").join(bone("far_a", "far_b", "far_bone"), [*keys, "far_a", "far_b"], "left")
    near, far, target = [F.col("nx"), F.col("ny")], [F.col("fx"), F.col("fy")], [F.col("tx"), F.col("ty")]
    end = project_from(near, [t - n for t, n in zip(target, near, strict=True)], F.col("bone"))
    # Steps of their own: as one expression the middle joint's two candidates would not fit into a compiled method.
    todo = todo.withColumns({"_cx": end[0], "_cy": end[1], "_d": distance(near, far)})
    todo = todo.withColumn("_along", (F.col("bone") ** 2 - F.col("far_bone") ** 2 + F.col("_d") ** 2) / (2 * F.when(F.col("_d") > 1e-9, F.col("_d"))))
    meets = (F.col("_d") <= F.col("bone") + F.col("far_bone")) & (F.col("_d") >= F.abs(F.col("bone") - F.col("far_bone")))
    todo = todo.withColumns({
        "_high": F.sqrt(F.when(meets, F.greatest(F.col("bone") ** 2 - F.col("_along") ** 2, F.lit(0.0)))),
        "_ux": (F.col("fx") - F.col("nx")) / F.when(F.col("_d") > 1e-9, F.col("_d")), "_uy": (F.col("fy") - F.col("ny")) / F.when(F.col("_d") > 1e-9, F.col("_d")),
    })
    foot = [F.col("nx") + F.col("_ux") * F.col("_along"), F.col("ny") + F.col("_uy") * F.col("_along")]
    side = [-F.col("_uy") * F.col("_high"), F.col("_ux") * F.col("_high")]
    todo = todo.withColumns({f"_{n}{a}": f + sign * s for n, sign in (("p", 1), ("q", -1)) for a, f, s in zip("xy", foot, side, strict=True)})
    first = distance([F.col("_px"), F.col("_py")], target) <= distance([F.col("_qx"), F.col("_qy")], target)
    middle = [F.coalesce(F.when(first, F.col(f"_p{a}")).otherwise(F.col(f"_q{a}")), (n + f) / 2) for a, n, f in zip("xy", near, far, strict=True)]
    end = [F.col("_cx"), F.col("_cy")]
    is_end = F.col("role") == "end"
    can = (F.col("bone") > 0) & (is_end | (F.col("far_bone") > 0) & F.col("fx").isNotNull())
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    filled = todo.filter(can).select(*frame, "joint_name", *[unit(F.when(is_end, e).otherwise(m)).alias(f"_{a}") for a, e, m in zip("xy", end, middle, strict=True)])
    out = df.join(filled, [*frame, "joint_name"], "left")
    got = F.col("_x").isNotNull()
    tag = F.when(F.col("backend").endswith("+imputed"), F.col("backend")).otherwise(F.concat("backend", F.lit("+imputed")))
    return out.withColumns({
        "x": F.when(got, F.col("_x")).otherwise(F.col("x")), "y": F.when(got, F.col("_y")).otherwise(F.col("y")), "backend": F.when(got, tag).otherwise(F.col("backend")),
        "visibility": F.when(got, F.lit(min(confidence, 1.0))).otherwise(F.col("visibility")), "confidence": F.when(got, F.lit(min(confidence, 1.0))).otherwise(F.col("confidence")),
    }).drop("_x", "_y")


def temporally_plausible(df: DataFrame, keys: Keys, ok: Column, tolerance: float, *, reach: int = 3) -> DataFrame:
    """plausible: within tolerance of the line between the nearest usable neighbours; with one neighbour, at most `reach` frames off; without any, yes."""
    df = neighbours(df, [*keys, "joint_name"], ok, ["x", "y"])
    share = (F.col("frame_index") - F.col("before.frame_index")) / F.nullif(F.col("after.frame_index") - F.col("before.frame_index"), F.lit(0))
    here = [F.col("x"), F.col("y")]
    line = [lerp(F.col(f"before.{a}"), F.col(f"after.{a}"), share) for a in "xy"]
    one = F.coalesce("before", "after")
    alone = (F.abs(F.col("frame_index") - one["frame_index"]) <= reach) & (distance(here, [one["x"], one["y"]]) <= tolerance)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    return df.withColumn("plausible", F.when(both, distance(here, line) <= tolerance).when(one.isNull(), F.lit(True)).otherwise(alone)).drop("before", "after")


# ---- the whole completion of a clip


@dataclass(frozen=True)
class CompletionRule:
    """Settings of complete_pose; thresholds go by joint, joint group or "default", gaps by joint or by the end of its name."""

    threshold: float = 0.5
    thresholds: Mapping[str, float] | None = None
    max_gap: int = 5
    gaps: Mapping[str, int] | None = None
    confidence: float = 0.62
    rescue: bool = True
    least: float = 0.03
    least_alone: float = 0.30
    limb_tolerance: float = 0.75
    time_tolerance: float = 0.12
    reach: int = 5

    def __post_init__(self) -> None:
        if self.max_gap < 0:
            raise ValueError("max_gap is negative")
        if self.confidence <= 0:
            raise ValueError("confidence must be positive")

    def gap_of(self, joint: str) -> int:
        gaps = self.gaps or {}
        group = "distal" if joint.endswith(("_wrist", "_ankle")) else "mid_limb" if joint.endswith(("_elbow", "_knee")) else "default"
        return int(gaps.get(joint, gaps.get(group, self.max_gap)))


def _inside(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def _plausible_in_time(j: str, tolerance: float) -> Column:
    """Whether a joint's point lies near the line between its usable neighbours, or near the only one at most three frames off; yes without any."""
    a, b, here = F.col(f"_a_{j}"), F.col(f"_b_{j}"), [F.col(f"{j}.x"), F.col(f"{j}.y")]
    share = (F.col("frame_index") - a["f"]) / (b["f"] - a["f"])
    one = F.coalesce(a, b)
    alone = (F.abs(F.col("frame_index") - one["f"]) <= 3) & (distance(here, [one["x"], one["y"]]) <= tolerance)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, distance(here, [lerp(a[c], b[c], share) for c in "xy"]) <= tolerance).when(one.isNull(), F.lit(True)).otherwise(alone)


def _between_usable(frames: DataFrame, keys: Keys, here: dict[str, Column]) -> DataFrame:
    """_a_<joint> and _b_<joint>: what `here` holds in the nearest frames before and behind in which it holds anything."""
    upto = along(keys).rowsBetween(Window.unboundedPreceding, -1)
    frames = frames.withColumns({f"_here_{j}": v for j, v in here.items()})
    frames = frames.withColumns({f"_a_{j}": F.last(f"_here_{j}", ignorenulls=True).over(upto) for j in here} | {f"_b_{j}": next_present(f"_here_{j}", keys) for j in here})
    return frames.drop(*[f"_here_{j}" for j in here])


def _rescued(frames: DataFrame, keys: Keys, rule: CompletionRule) -> DataFrame:
    """Each joint's struct with the rescued point in place of the distrusted one, and _saved_<joint>."""
    usable_here = lambda j: F.when(F.col(f"{j}.ok"), F.struct(F.col("frame_index").alias("f"), F.col(f"{j}.x").alias("x"), F.col(f"{j}.y").alias("y")))
    frames = _between_usable(frames, keys, {j: usable_here(j) for j in COMPLETABLE})
    saved = {}
    for j in COMPLETABLE:
        fits = F.lit(False)
        for joint, other, near, far in ADJACENT:
            if joint == j:
                bone, off = F.col(f"_bone_{near}_{far}"), distance([F.col(f"{other}.x"), F.col(f"{other}.y")], [F.col(f"{j}.x"), F.col(f"{j}.y")])
                fits = fits | F.coalesce(F.col(f"{other}.ok") & (bone > 0) & off.between(bone * max(0.0, 1 - rule.limb_tolerance), bone * (1 + rule.limb_tolerance)), F.lit(False))
        score = F.col(f"{j}.score")
        can = F.col(f"{j}.x").isNotNull() & F.col(f"{j}.y").isNotNull() & ~F.col(f"{j}.ok") & (score >= rule.least)
        saved[f"_saved_{j}"] = F.coalesce(can & (fits | ((score >= rule.least_alone) & _plausible_in_time(j, rule.time_tolerance))), F.lit(False))
    frames = frames.withColumns(saved).drop(*[f"_{side}_{j}" for side in "ab" for j in COMPLETABLE])
    sure = F.lit(min(rule.confidence, 1.0))
    new = lambda j: F.struct(_inside(F.col(f"{j}.x")).alias("x"), _inside(F.col(f"{j}.y")).alias("y"), sure.alias("score"), F.col(f"{j}.need").alias("need"), (sure >= F.col(f"{j}.need")).alias("ok"))
    return frames.withColumns({j: F.when(F.col(f"_saved_{j}"), new(j)).otherwise(F.col(j)) for j in COMPLETABLE})


def _directions(frames: DataFrame, keys: Keys, segments: list[tuple[str, str]], reach: int) -> DataFrame:
    """_dir_<far>: from near to far in the nearest other frame within reach that has both (the earlier of two), null without one."""
    both = lambda near, far: F.col(f"{near}.ok") & F.col(f"{far}.ok")
    here = lambda near, far: F.when(both(near, far), F.struct(F.col("frame_index").alias("f"), *[(F.col(f"{far}.{c}") - F.col(f"{near}.{c}")).alias(c) for c in "xy"]))
    w = along(keys)
    frames = frames.withColumns({f"_v_{far}": here(near, far) for near, far in segments})
    frames = frames.withColumns({f"_before_{far}": F.last(f"_v_{far}", ignorenulls=True).over(w.rangeBetween(-reach, -1)) for _, far in segments} | {f"_after_{far}": F.first(f"_v_{far}", ignorenulls=True).over(w.rangeBetween(1, reach)) for _, far in segments})
    nearest = {}
    for _, far in segments:
        before, after = F.col(f"_before_{far}"), F.col(f"_after_{far}")
        earlier = after.isNull() | (F.col("frame_index") - before["f"] <= after["f"] - F.col("frame_index"))
        nearest[f"_dir_{far}"] = F.when(before.isNotNull() & earlier, before).otherwise(after)
    return frames.withColumns(nearest).drop(*[f"_{k}_{far}" for k in ("v", "before", "after") for _, far in segments])


def _filled(frames: DataFrame, keys: Keys, rule: CompletionRule) -> DataFrame:
    """_fill_<joint>: the point that fills a short gap of a limb's middle or end, null elsewhere."""
    frame = F.col("frame_index")
    parts = sorted({j for _, m, d in LIMB_CHAINS for j in (m, d)})
    frames = frames.withColumns({f"_at_{j}": F.when(F.col(j).isNotNull(), frame) for j in parts})
    frames = frames.withColumns({f"_next_{j}": next_present(f"_at_{j}", keys) for j in parts}).drop(*[f"_at_{j}" for j in parts])
    usable_here = lambda j: F.when(F.col(f"{j}.ok"), F.struct(frame.alias("f"), F.col(f"{j}.x").alias("x"), F.col(f"{j}.y").alias("y"), F.col(f"_next_{j}").alias("next")))
    frames = _between_usable(frames, keys, {j: usable_here(j) for j in parts})
    frames = _directions(frames, keys, [(m, d) for _, m, d in LIMB_CHAINS], rule.reach)
    targets = {}
    for j in parts:
        a, b = F.col(f"_a_{j}"), F.col(f"_b_{j}")
        gap = b["f"] - a["f"] - 1
        # The row behind the last usable one begins the gap, right after it; a row of the joint has to be there.
        open_ = F.col(j).isNotNull() & ~F.col(f"{j}.ok") & (a["next"] == a["f"] + 1) & (gap > 0) & (gap <= rule.gap_of(j))
        share = (frame - a["f"]) / (gap + 1)
        targets[f"_to_{j}"] = F.when(open_, F.struct(lerp(a["x"], b["x"], share).alias("x"), lerp(a["y"], b["y"], share).alias("y")))
    frames = frames.withColumns(targets).drop(*[f"_{k}_{j}" for k in ("a", "b", "next") for j in parts])
    at = lambda c: [F.col(f"{c}.x"), F.col(f"{c}.y")]
    point = lambda p: F.struct(_inside(p[0]).alias("x"), _inside(p[1]).alias("y"))
    for p, m, d in LIMB_CHAINS:
        bone, upper = F.col(f"_bone_{m}_{d}"), F.col(f"_bone_{p}_{m}")
        # The end: from the middle joint towards the target.
        frames = frames.withColumns({"_vx": F.col(f"_to_{d}.x") - F.col(f"{m}.x"), "_vy": F.col(f"_to_{d}.y") - F.col(f"{m}.y")})
        still = F.sqrt(F.col("_vx") ** 2 + F.col("_vy") ** 2) <= 1e-6
        known = F.col(f"_dir_{d}").isNotNull()
        frames = frames.withColumns({"_vx": F.when(still, F.when(known, F.col(f"_dir_{d}.x")).otherwise(1.0)).otherwise(F.col("_vx")), "_vy": F.when(still, F.when(known, F.col(f"_dir_{d}.y")).otherwise(0.0)).otherwise(F.col("_vy"))})
        end = F.when(F.col(f"_to_{d}").isNotNull() & F.col(f"{m}.ok") & (bone > 0), point(project_from(at(m), [F.col("_vx"), F.col("_vy")], bone)))
        # The middle: where both bones meet, nearest to the target; half way where they do not.
        frames = frames.withColumns({f"_fill_{d}": end, "_d": distance(at(p), at(d))})
        frames = frames.withColumn("_along", (upper**2 - bone**2 + F.col("_d") ** 2) / (2 * F.when(F.col("_d") > 1e-9, F.col("_d"))))
        meets = (F.col("_d") <= upper + bone) & (F.col("_d") >= F.abs(upper - bone)) & (upper**2 >= F.col("_along") ** 2)
        frames = frames.withColumns({"_high": F.when(meets, F.sqrt(upper**2 - F.col("_along") ** 2)), **{f"_u{c}": (F.col(f"{d}.{c}") - F.col(f"{p}.{c}")) / F.when(F.col("_d") > 1e-9, F.col("_d")) for c in "xy"}})
        foot = [F.col(f"{p}.{c}") + F.col(f"_u{c}") * F.col("_along") for c in "xy"]
        side = [-F.col("_uy") * F.col("_high"), F.col("_ux") * F.col("_high")]
        frames = frames.withColumns({f"_{n}{c}": f + sign * s for n, sign in (("p", 1), ("q", -1)) for c, f, s in zip("xy", foot, side, strict=True)})
        first = distance([F.col("_px"), F.col("_py")], at(f"_to_{m}")) <= distance([F.col("_qx"), F.col("_qy")], at(f"_to_{m}"))
        middle = [F.coalesce(F.when(first, F.col(f"_p{c}")).otherwise(F.col(f"_q{c}")), (F.col(f"{p}.{c}") + F.col(f"{d}.{c}")) / 2) for c in "xy"]
        can = F.col(f"_to_{m}").isNotNull() & F.col(f"{p}.ok") & F.col(f"{d}.ok") & (bone > 0) & (upper > 0)
        frames = frames.withColumn(f"_fill_{m}", F.when(can, point(middle))).drop("_vx", "_vy", "_d", "_along", "_high", "_ux", "_uy", "_px", "_py", "_qx", "_qy")
    return frames.drop(*[f"_to_{j}" for j in parts], *[f"_dir_{d}" for *_, d in LIMB_CHAINS])


def complete_pose(df: DataFrame, keys: Keys, rule: CompletionRule = CompletionRule()) -> DataFrame:
    """Points of clips with distrusted limb points rescued and short gaps of limb joints filled; all other rows stay, none is added.

    Bones are median lengths of the rows as they come in; fills read the rows behind the rescue, never one another. Filled and
    rescued rows have the rule's confidence and "+imputed" or "+rescued" behind their backend. One shuffle: a row for each frame
    holds all its joints (of rows that repeat a joint of a frame, the greatest), all windows run along the series.
    """
    columns = df.columns
    need = by_joint(rule.thresholds, rule.threshold)
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & not_distrusted(pose_score(), need)
    seen = F.struct("x", "y", pose_score().alias("score"), need.cast("double").alias("need"), ok.alias("ok"))
    rows = df.repartition(*keys).withColumn("_seen", seen)
    frames = rows.groupBy(*keys, "frame_index").agg(F.collect_list(F.struct(*columns)).alias("_rows"), *[F.max(F.when(F.col("joint_name") == j, F.col("_seen"))).alias(j) for j in COMPLETABLE])
    segments = sorted({(a, b) for p, m, d in LIMB_CHAINS for a, b in ((p, m), (m, d))})
    length = lambda a, b: F.when(F.col(f"{a}.ok") & F.col(f"{b}.ok"), distance([F.col(f"{a}.x"), F.col(f"{a}.y")], [F.col(f"{b}.x"), F.col(f"{b}.y")]))
    frames = frames.withColumns({f"_bone_{a}_{b}": F.median(length(a, b)).over(Window.partitionBy(*keys)) for a, b in segments})
    frames = _rescued(frames, keys, rule) if rule.rescue else frames.withColumns({f"_saved_{j}": F.lit(False) for j in COMPLETABLE})
    frames = _filled(frames, keys, rule)
    spot = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    fill = lambda j: F.col(f"_fill_{j}") if f"_fill_{j}" in frames.columns else F.when(F.lit(False), spot)
    change = lambda j: F.struct(F.col(f"_saved_{j}").alias("saved"), F.col(f"{j}.x").alias("x"), F.col(f"{j}.y").alias("y"), fill(j).alias("fill"))
    changes = F.map_from_arrays(F.array(*map(F.lit, COMPLETABLE)), F.array(*[change(j) for j in COMPLETABLE]))
    out = frames.select(changes.alias("_all"), F.explode("_rows").alias("_row")).select("_row.*", F.element_at("_all", F.col("_row.joint_name")).alias("_c"))
    saved, filled = F.coalesce(F.col("_c.saved"), F.lit(False)), F.col("_c.fill").isNotNull()
    tagged = lambda backend, tag: F.when(backend.endswith(tag), backend).otherwise(F.concat(backend, F.lit(tag)))
    rescued = F.when(saved, tagged(F.col("backend"), "+rescued")).otherwise(F.col("backend"))
    sure = F.lit(min(rule.confidence, 1.0))
    new = {c: F.when(filled, F.col(f"_c.fill.{c}")).when(saved, F.col(f"_c.{c}")).otherwise(F.col(c)) for c in "xy"}
    new |= {c: F.when(filled | saved, sure).otherwise(F.col(c)) for c in ("visibility", "confidence")}
    return out.withColumns(new | {"backend": F.when(filled, tagged(rescued, "+imputed")).otherwise(rescued)}).select(*columns)
