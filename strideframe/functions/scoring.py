"""Scores and verdicts for a value against a target, a band, a peer or a standard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def linear_score(x: Column, low: Column, high: Column, higher_is_better: bool = True) -> Column:
    ratio = (x - low) / F.nullif(high - low, F.lit(0.0))
    score = clamp((ratio if higher_is_better else 1.0 - ratio) * 100.0)
    return F.when(high == low, 50.0).otherwise(score)


def target_score(x: Column, target: Column, tolerance: Column) -> Column:
    return F.when(tolerance <= 0, 50.0).otherwise(clamp(100.0 - F.abs(x - target) / F.when(tolerance > 0, tolerance) * 100.0))


def standard_score(x: Column, standard: Column, lower_is_better: Column) -> Column:
    """Falls from 100 in straight pieces: to 92, 70 and 40 at relative gaps of .12, .30 and .60, and on to 20 at least."""
    scale = F.greatest(F.abs(standard), F.lit(1.0))
    gap = F.when(lower_is_better, F.greatest(F.lit(0.0), (x - standard) / scale)).otherwise(F.abs(x - standard) / scale)
    piece = lambda top, start, width, drop: top - (gap - start) / width * drop
    return (
        F.when(gap <= 0.12, piece(100.0, 0.0, 0.12, 8.0)).when(gap <= 0.30, piece(92.0, 0.12, 0.18, 22.0))
        .when(gap <= 0.60, piece(70.0, 0.30, 0.30, 30.0)).when(gap > 0.60, F.greatest(F.lit(20.0), piece(40.0, 0.60, 0.40, 20.0)))
    )


def verdict(score: Column, good: float = 85.0, review: float = 65.0) -> Column:
    return F.when(score >= good, "good").when(score >= review, "review").when(score.isNotNull(), "risk").otherwise("review")


def gap_score(x: Column, peer: Column, low: Column, high: Column) -> Column:
    """By relative gap to a peer; else by distance from the middle of a band; else 60."""
    has_peer = F.coalesce(F.abs(peer) > 1e-6, F.lit(False))
    band = 100 - F.abs(x - (low + high) / 2) / F.greatest((high - low) / 2, F.lit(1e-6)) * 45
    by_peer = 100 - F.abs(x - peer) / F.when(has_peer, F.abs(peer)) * 100
    return F.when(has_peer, clamp(by_peer)).when(low.isNotNull() & high.isNotNull(), clamp(band)).otherwise(60.0)


def ratio_score(x: Column, peer: Column) -> Column:
    """Percent of a peer, rounded half to even, within 5 and 100; 45 without a usable pair."""
    return F.when(x.isNull() | peer.isNull() | (peer == 0), 45).otherwise(F.greatest(F.lit(5), F.least(F.lit(100), F.bround(x / F.nullif(peer, F.lit(0.0)) * 100).cast("int"))))


def close_score(x: Column, peer: Column, tolerance: float) -> Column:
    return F.when(x.isNull() | peer.isNull(), 45).otherwise(F.greatest(F.lit(10), F.least(F.lit(100), F.bround(100 - F.abs(x - peer) / tolerance * 100).cast("int"))))


def band_status(x: Column, low: Column, high: Column, pad: float = 0.35) -> Column:
    more = (high - low) * pad
    return F.when(x.isNull(), "warn").when(x.between(low, high), "ok").when(x.between(low - more, high + more), "warn").otherwise("bad")


def percent_status(x: Column, warn: float, ok: float) -> Column:
    return F.when(x.isNull(), "warn").when(x >= ok, "ok").when(x >= warn, "warn").otherwise("bad")


def deviation_band(x: Column, mean: Column, deviation: Column) -> Column:
    """Where a value lies in mean plus or minus one standard deviation."""
    return F.when(x < mean - deviation, "below_1sd").when(x > mean + deviation, "above_1sd").when(x.isNotNull() & mean.isNotNull() & deviation.isNotNull(), "within_1sd")


def percent_of(x: Column, reference: Column) -> Column:
    return x / F.when(F.abs(reference) >= 1e-9, reference) * 100.0


def difference_percent(x: Column, peer: Column) -> Column:
    return (x - peer) / F.when(peer != 0, peer) * 100


def symmetry_score(left: Column, right: Column) -> Column:
    top = F.greatest(F.abs(left), F.abs(right))
    return F.when(top > 0, clamp(100.0 - F.abs(left - right) / F.when(top > 0, top) * 100.0))


def nice_step(span: Column) -> Column:
    """A round axis step for about five ticks: 1, 2, 5 or 10 times a power of ten."""
    raw = F.when(span > 0, span) / 5.0
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / magnitude
    return F.coalesce(F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10) * magnitude, F.lit(1.0))


def percent_gap(x: Column, reference: Column) -> Column:
    """How far a value is from its reference in percent of it, 0 to 140; 50 without a usable reference."""
    off = F.abs(x - reference) / F.abs(reference) * 100
    return F.when(reference.isNull() | (F.abs(reference) < 1e-6), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(140.0), off)))
