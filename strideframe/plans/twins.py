"""SQL twins of the order-dependent operators: folds as recursive queries over the rows of a series, one row further each round."""

from __future__ import annotations

from . import adapters as A
from . import queries as Q

SMOOTH_ENDS = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5)}  # over 35: a quadratic's value at a window's first two places


def accepted_sql(source: str, key: str, point: tuple[str, ...], limit: str, by_gap: bool) -> str:
    """CTEs that end in `fold`: rows of `source` (with i from 1, and limit's columns) and whether each is near enough to the last accepted one."""
    far = "sqrt(" + " + ".join(f"(s.{c} - f.k{c}) * (s.{c} - f.k{c})" for c in point) + ")"
    reach = f"{limit} * sqrt(greatest(1, s.frame_index - f.kf))" if by_gap else limit
    kept = f"{far} <= {reach}"
    state = ", ".join(f"CASE WHEN {kept} THEN s.{c} ELSE f.k{c} END" for c in point)
    return f"""fold({key}, frame_index, i, {", ".join(f"k{c}" for c in point)}, kf, accepted) AS (
  SELECT {key}, frame_index, i, {", ".join(point)}, frame_index, true FROM {source} WHERE i = 1
  UNION ALL
  SELECT {", ".join(f"s.{k.strip()}" for k in key.split(","))}, s.frame_index, s.i, {state}, CASE WHEN {kept} THEN s.frame_index ELSE f.kf END, {kept}
  FROM fold f JOIN {source} s ON {" AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in key.split(","))} AND s.i = f.i + 1)"""


TORSO = f"""WITH RECURSIVE {Q.CENTERS}, there AS (SELECT *, row_number() OVER w AS i, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS step FROM centers WHERE cx IS NOT NULL AND cy IS NOT NULL WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)),
lim AS (SELECT clip_id, count(*) AS n, greatest(median(step) FILTER (step > 0) * 1.5, 0.06) AS most, count(*) FILTER (step > 0) AS moves FROM there GROUP BY clip_id),
seen AS (SELECT there.*, most FROM there JOIN lim USING (clip_id) WHERE n >= 5 AND moves > 0), {accepted_sql("seen", "clip_id", ("cx", "cy"), "s.most", True)}
SELECT c.clip_id, c.condition_id, c.frame_index, round(c.cx, 9) AS cx, round(c.cy, 9) AS cy, coalesce(NOT accepted, false) AS rejected FROM centers c LEFT JOIN fold f ON f.clip_id = c.clip_id AND f.frame_index = c.frame_index"""

JUMPS = f"""WITH RECURSIVE {A.MARKERS}, there AS (SELECT *, row_number() OVER w AS i, sqrt({" + ".join(f"({a} - lag({a}) OVER w) ** 2" for a in "xyz")}) AS step FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index)),
lim AS (SELECT trial_id, marker, median(step) FILTER (step > 0) * 1.2 AS most FROM there GROUP BY ALL), seen AS (SELECT there.*, most FROM there JOIN lim USING (trial_id, marker) WHERE most IS NOT NULL), {accepted_sql("seen", "trial_id, marker", ("x", "y", "z"), "s.most", False)}
SELECT m.*, coalesce(NOT accepted, false) AS jump FROM markers m LEFT JOIN fold f ON f.trial_id = m.trial_id AND f.marker = m.marker AND f.frame_index = m.frame_index"""

_PX = "sqrt(((s.x - f.kx) * 1920) ** 2 + ((s.y - f.ky) * 1080) ** 2) / (s.timestamp_sec - f.kt)"
_UNIT = "sqrt((s.x - f.kx) ** 2 + (s.y - f.ky) ** 2) / (s.timestamp_sec - f.kt)"
_KEPT = f"s.timestamp_sec > f.kt AND {_PX} <= 8000"

OBJECT_SPEED = f"""WITH RECURSIVE {A.TRAJ}, seen AS (SELECT *, row_number() OVER (PARTITION BY clip_id, joint_name ORDER BY frame_index) AS i FROM traj),
fold(clip_id, joint_name, frame_index, i, kx, ky, kt, px, unit) AS (
  SELECT clip_id, joint_name, frame_index, i, x, y, timestamp_sec, NULL::DOUBLE, NULL::DOUBLE FROM seen WHERE i = 1
  UNION ALL
  SELECT s.clip_id, s.joint_name, s.frame_index, s.i, CASE WHEN {_KEPT} THEN s.x ELSE f.kx END, CASE WHEN {_KEPT} THEN s.y ELSE f.ky END, CASE WHEN {_KEPT} THEN s.timestamp_sec ELSE f.kt END,
    CASE WHEN {_KEPT} THEN {_PX} END, CASE WHEN {_KEPT} THEN {_UNIT} END FROM fold f JOIN seen s ON s.clip_id = f.clip_id AND s.joint_name = f.joint_name AND s.i = f.i + 1)
SELECT clip_id, joint_name, frame_index, round(px, 6) AS speed_px_s, round(unit, 9) AS speed_norm_s FROM fold"""

VIDEO = f"""WITH {Q.CORE_SQL}, sl AS (SELECT s.clip_id, s.pos, s.score, sp, ep, lr.n, pp, peak, s.pos BETWEEN greatest(0, sp - 45) AND sp AS lft, s.pos BETWEEN ep AND least(lr.n - 1, ep + 35) AS rgt FROM scored s JOIN lr USING (clip_id)),
lo AS (SELECT clip_id, min(score) FILTER (lft) AS ll, min(score) FILTER (rgt) AS rl FROM sl GROUP BY clip_id),
va AS (SELECT sl.clip_id, any_value(sl.n) AS n, any_value(pp) AS pp, any_value(peak) AS peak, max(pos) FILTER (lft AND score <= ll + greatest(0.02, ll * 0.1)) AS lv, max(pos) FILTER (rgt AND score <= rl + greatest(0.02, rl * 0.1)) AS rv FROM sl JOIN lo USING (clip_id) GROUP BY sl.clip_id),
p AS (SELECT *, greatest(0, lv - 18) AS a, least(n - 1, rv + 4) AS b FROM va), q AS (SELECT *, greatest(0, 48 - (b - a + 1)) AS d FROM p),
q2 AS (SELECT *, greatest(0, a - d // 2) AS a2, least(n - 1, b + (d - d // 2)) AS b2 FROM q), z AS (SELECT *, greatest(0, pp - 45) AS f, least(n - 1, greatest(0, pp - 45) + 89) AS l FROM q2),
o AS (SELECT clip_id, CASE WHEN b2 - a2 + 1 > 90 THEN (CASE WHEN l - f + 1 < 90 THEN greatest(0, l - 89) ELSE f END) ELSE a2 END AS start_index, CASE WHEN b2 - a2 + 1 > 90 THEN l ELSE b2 END AS end_index, pp AS peak_index, peak FROM z)
SELECT o.clip_id, start_index, end_index, peak_index, round(peak, 6) AS peak_score, s.frame_index AS start_frame, e.frame_index AS end_frame, k.frame_index AS peak_frame, end_index - start_index + 1 AS frame_count
FROM o JOIN scored s ON s.clip_id = o.clip_id AND s.pos = start_index JOIN scored e ON e.clip_id = o.clip_id AND e.pos = end_index JOIN scored k ON k.clip_id = o.clip_id AND k.pos = peak_index"""

READY = f"""WITH {A.MARKERS}, b AS (SELECT *, row_number() OVER w - 1 AS pos, sum((x <= 200 AND z IS NOT NULL)::INT) OVER k AS good, avg(z) OVER k - 0.02 * avg(x) OVER k AS score FROM markers
  WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index), k AS (PARTITION BY trial_id, marker ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT trial_id, marker, arg_min(frame_index, (-score, pos)) AS ready_frame, round(max(score), 6) AS ready_score FROM b WHERE good = 3 AND pos + 3 <= 30 GROUP BY ALL"""

PHASE = f"""WITH {A.MARKERS}, p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY trial_id, marker) AS n, coalesce(frame_index - lag(frame_index) OVER w > 1, false) AS gap FROM markers WINDOW w AS (PARTITION BY trial_id, marker ORDER BY frame_index)),
pk AS (SELECT trial_id, marker, max(x) AS peak, arg_min(frame_index, (-x, frame_index)) AS ev FROM p WHERE pos >= floor(n * 0.35) AND pos <= floor(n * 0.75) GROUP BY ALL),
lr AS (SELECT trial_id, marker, max(CASE WHEN frame_index < ev AND NOT x >= peak * 0.25 THEN frame_index WHEN gap AND frame_index <= ev THEN frame_index - 1 END) AS l, min(CASE WHEN frame_index > ev AND (gap OR NOT x >= peak * 0.25) THEN frame_index END) AS r FROM p JOIN pk USING (trial_id, marker) GROUP BY ALL)
SELECT trial_id, marker, any_value(ev) AS event_frame, round(any_value(peak), 6) AS peak, min(frame_index) AS start_frame, max(frame_index) AS end_frame FROM p JOIN pk USING (trial_id, marker) JOIN lr USING (trial_id, marker)
WHERE frame_index > coalesce(l, -1) AND frame_index < coalesce(r, n + 1) GROUP BY ALL"""

_SEP = "sqrt((m0x - m1x) ** 2 + (m0z - m1z) ** 2)"

STRIDE = f"""WITH {A.marker_frames_sql([0, 1, 2])}, g AS (SELECT trial_id, arg_min(m0x - m1x, (-{_SEP}, frame_index)) AS vx, arg_min(m0z - m1z, (-{_SEP}, frame_index)) AS vz, max({_SEP}) AS d,
  arg_max(m2x, frame_index) - arg_min(m2x, frame_index) AS hx, arg_max(m2z, frame_index) - arg_min(m2z, frame_index) AS hz FROM frames GROUP BY trial_id)
SELECT trial_id, round(CASE WHEN hx * vx + hz * vz < 0 THEN -1 ELSE 1 END * vx / d, 9) AS dir_x, round(CASE WHEN hx * vx + hz * vz < 0 THEN -1 ELSE 1 END * vz / d, 9) AS dir_z FROM g"""


def _ends(place: int, of: str) -> str:
    return "(" + " + ".join(f"{w} * {of}[{k + 1}]" for k, w in enumerate(SMOOTH_ENDS[place])) + ") / 35"


SAVITZKY = f"""WITH {A.SCALARS}, w AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n, {", ".join(f"lag(value, {k}) OVER w AS b{k}, lead(value, {k}) OVER w AS a{k}" for k in (1, 2))} FROM scalars WINDOW w AS (PARTITION BY series ORDER BY frame_index)),
e AS (SELECT series, list(value ORDER BY frame_index) FILTER (i < 5) AS h, list(value ORDER BY frame_index DESC) FILTER (i >= n - 5) AS t FROM w GROUP BY series)
SELECT series, frame_index, round(CASE WHEN n < 5 THEN value WHEN i = 0 THEN {_ends(0, "h")} WHEN i = 1 THEN {_ends(1, "h")} WHEN i = n - 1 THEN {_ends(0, "t")} WHEN i = n - 2 THEN {_ends(1, "t")}
  ELSE (-3 * b2 + 12 * b1 + 17 * value + 12 * a1 - 3 * a2) / 35 END, 3) AS smooth FROM w JOIN e USING (series)"""

TWINS = {
    "torso_continuity": TORSO, "jumps_3d": JUMPS, "object_speed": OBJECT_SPEED, "video_window": VIDEO, "ready_event": READY, "motion_phase": PHASE, "stride_direction": STRIDE, "savitzky_golay": SAVITZKY,
    "rows_in_action_window": f"WITH {Q.ACTION_SQL} SELECT s.clip_id, s.frame_index, s.score FROM scored s JOIN placed p ON p.clip_id = s.clip_id AND s.frame_index BETWEEN p.start_frame AND p.end_frame",
}
