"""Trust in an observation: scores, joint groups and thresholds by joint, group or default."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DISTAL, MID_LIMB, TORSO


def pose_score(visibility: Column | str = "visibility", confidence: Column | str = "confidence") -> Column:
    """The smaller of visibility and confidence, or the one that is there."""
    return F.least(visibility, confidence)


def joint_group(joint: Column | str = "joint_name") -> Column:
    joint = F.col(joint) if isinstance(joint, str) else joint
    return F.when(joint.isin(*TORSO), "torso").when(joint.isin(*DISTAL), "distal").when(joint.isin(*MID_LIMB), "mid_limb").otherwise("default")


def by_joint(settings: Mapping[str, float] | None, fallback: float, joint: Column | str = "joint_name") -> Column:
    """A setting for each row: the joint's own, else its group's, else "default", else the fallback."""
    joint = F.col(joint) if isinstance(joint, str) else joint
    if not settings:
        return F.lit(fallback)
    table = F.create_map(*[F.lit(x) for k, v in settings.items() for x in (k, float(v))])
    get = lambda k: F.try_element_at(table, k)
    return F.coalesce(get(joint), get(joint_group(joint)), F.lit(float(settings.get("default", fallback))))


def odd_window(size: Column) -> Column:
    """An even window gives up one sample."""
    return F.when(size > 1, size - (1 - size % 2)).otherwise(size)


def trusted(score: Column, threshold: Column | float) -> Column:
    """Strict rule: without a score there is no trust."""
    return F.coalesce(score >= threshold, F.lit(False))


def not_distrusted(score: Column, threshold: Column | float) -> Column:
    """Lenient rule: without a score there is no objection."""
    return F.coalesce(score >= threshold, F.lit(True))
