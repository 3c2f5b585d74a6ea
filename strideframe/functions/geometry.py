"""Angles, distances and boxes as Column expressions; a missing operand gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def distance(a: Vec, b: Vec) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        total = total + (q - p) * (q - p)
    return F.sqrt(total)


def minus(a: Vec, b: Vec) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for p, q in zip(a[1:], b[1:], strict=True):
        total = total + p * q
    return total


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def vector_angle(a: Vec, b: Vec, least: float = 0.0) -> Column:
    """Degrees between two vectors; null where a length product is not above `least`."""
    size = norm(a) * norm(b)
    cosine = dot(a, b) / F.when(size > least, size)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) * F.when(cosine.isNotNull(), 1.0)


def joint_angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Degrees at b between a and c."""
    return vector_angle(minus(a, b), minus(c, b))


def flexion(a: Vec, b: Vec, c: Vec) -> Column:
    return 180.0 - joint_angle(a, b, c)


def heading(dx: Column, dy: Column) -> Column:
    """Degrees of a planar direction; null for the zero vector."""
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy, dx)))


def image_heading(a: Vec, b: Vec) -> Column:
    """Direction from a to b in image coordinates, where y points down."""
    return heading(b[0] - a[0], -(b[1] - a[1]))


def tilt(top: Vec, bottom: Vec) -> Column:
    """Degrees from the vertical of bottom -> top in image coordinates."""
    dx, up = top[0] - bottom[0], -(top[1] - bottom[1])
    return F.when((dx != 0) | (up != 0), F.degrees(F.atan2(dx, up)))


def delta_degrees(start: Column, end: Column) -> Column:
    """Shortest signed turn from start to end, in [-180, 180)."""
    return F.pmod(end - start + 180.0, F.lit(360.0)) - 180.0


def folded(angle: Column) -> Column:
    """An undirected axis angle in [0, 90]."""
    turned = F.abs(delta_degrees(F.lit(0.0), angle))
    return F.least(turned, 180.0 - turned)


def signed_angle_about(radial: Vec, axis: Vec, reference: Vec) -> Column:
    """Degrees by which radial is turned from reference about axis, both projected on the axis' normal plane."""
    length = norm(axis)
    unit = [x / F.when(length > 0, length) for x in axis]
    flat = lambda v: [p - dot(v, unit) * u for p, u in zip(v, unit, strict=True)]
    r, ref = flat(radial), flat(reference)
    return F.degrees(F.atan2(dot(cross(ref, r), unit), dot(ref, r)))


def elevation(d: Vec) -> Column:
    return F.degrees(F.atan2(d[2], F.sqrt(d[0] * d[0] + d[1] * d[1])))


def midpoint(a: Vec, b: Vec) -> list[Column]:
    return [(p + q) / 2 for p, q in zip(a, b, strict=True)]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def project_from(origin: Vec, direction: Vec, length: Column) -> list[Column]:
    """The point at a length from the origin in a direction; along x where the direction is zero."""
    size = norm(direction)
    return [o + F.when(size > 1e-6, d / size).otherwise(1.0 if i == 0 else 0.0) * length for i, (o, d) in enumerate(zip(origin, direction, strict=True))]


def circle_points(a: Vec, ra: Column, b: Vec, rb: Column) -> tuple[list[Column], list[Column]]:
    """Both intersections of two circles in the plane; null where they do not meet."""
    d = distance(a, b)
    along = (ra * ra - rb * rb + d * d) / (2 * F.when(d > 1e-9, d))
    high2 = ra * ra - along * along
    high = F.sqrt(F.when((d <= ra + rb) & (d >= F.abs(ra - rb)), F.greatest(high2, F.lit(0.0))))
    apart = F.when(d > 1e-9, d)
    ux, uy = (b[0] - a[0]) / apart, (b[1] - a[1]) / apart
    foot = [a[0] + ux * along, a[1] + uy * along]
    return [foot[0] - uy * high, foot[1] + ux * high], [foot[0] + uy * high, foot[1] - ux * high]


def expand_box(box: Sequence[Column], factor: float) -> list[Column]:
    """(x, y, width, height) grown about its centre."""
    x, y, w, h = box
    return [x - w * (factor - 1) / 2, y - h * (factor - 1) / 2, w * factor, h * factor]


def clamp_box(box: Sequence[Column], width: Column, height: Column) -> list[Column]:
    """The part of (x, y, width, height) inside an image."""
    x, y, w, h = box
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    return [left, top, F.least(x + w, width) - left, F.least(y + h, height) - top]


def to_full_frame(x: Column, y: Column, box: Sequence[Column], width: Column, height: Column) -> list[Column]:
    """Coordinates relative to a crop, as coordinates relative to its image."""
    return [(box[0] + x * box[2]) / width, (box[1] + y * box[3]) / height]
