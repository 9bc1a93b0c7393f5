"""Angles, planes and projections, as column expressions. A vector is a triple of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    """The columns prefix + x, y, z."""
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def minus(u: Vector, v: Vector) -> Vector:
    return tuple(a - b for a, b in zip(u, v, strict=True))


def scaled(u: Vector, s: Column | float) -> Vector:
    return tuple(a * s for a in u)


def dot(u: Vector, v: Vector) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Vector, v: Vector) -> Vector:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def norm(u: Vector) -> Column:
    return F.sqrt(dot(u, u))


def angle(u: Vector, v: Vector) -> Column:
    """In radians, from 0 to pi; 0 where a vector vanishes."""
    lengths = norm(u) * norm(v)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / lengths))
    return F.when(lengths > 0, F.acos(cosine)).otherwise(0.0)


def oriented_angle(u: Vector, v: Vector, n: Vector) -> Column:
    """The angle, negative where u, v turn the way that n points."""
    a = angle(u, v)
    return F.when(dot(n, cross(u, v)) > 0, -a).otherwise(a)


def onto_plane(p: Vector, at: Vector, n: Vector) -> Vector:
    """The foot of p on the plane through `at` with normal n; null where n vanishes."""
    length = dot(n, n)
    s = F.when(length > 0, dot(minus(p, at), n) / length)
    return minus(p, scaled(n, s))


def plane(a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column, Column]:
    """Coefficients of the plane through three points: n . p + d = 0."""
    n = cross(minus(b, a), minus(c, a))
    return (*n, -dot(n, a))


def turned(p: Vector, axis: Vector, by: Column) -> Vector:
    """p, turned about an axis through the origin; p itself where the axis vanishes."""
    length = norm(axis)
    k = tuple(F.when(length > 0, a / length).otherwise(0.0) for a in axis)
    along, side = dot(k, p), cross(k, p)
    moved = tuple(a * F.cos(by) + s * F.sin(by) + x * along * (1 - F.cos(by)) for a, s, x in zip(p, side, k, strict=True))
    return tuple(F.when(length > 0, m).otherwise(a) for m, a in zip(moved, p, strict=True))
