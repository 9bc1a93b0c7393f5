"""Rotations as quaternions, vectors and matrices, and directions as angles, as column expressions.

A quaternion is (w, x, y, z) of length 1; a rotation vector has the axis as direction and the angle as length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]


def direction(theta: Column, phi: Column) -> Vector:
    """The unit vector of azimuth theta and inclination phi."""
    return F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)


def azimuth_inclination(v: Vector) -> tuple[Column, Column]:
    """theta and phi of a vector; 0 and 0 where it vanishes."""
    r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.atan2(v[1], v[0]), F.when(r > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2] / r)))).otherwise(0.0)


def of_vector(v: Vector) -> Quaternion:
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    s = F.when(angle > 0, F.sin(angle / 2) / angle).otherwise(0.5)
    return (F.cos(angle / 2), *(c * s for c in v))


def to_vector(q: Quaternion) -> Vector:
    """The rotation vector, of angle pi at most."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    s = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    scale = F.when(s > 1e-15, 2 * F.atan2(s, F.abs(q[0])) / s).otherwise(2.0) * sign
    return tuple(c * scale for c in q[1:])


def to_matrix(q: Quaternion) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def of_matrix(m: list[list[Column]]) -> Quaternion:
    """The quaternion of a rotation matrix with w >= 0. Lengths come from the diagonal, signs from the skew part; of a half
    turn, whose skew part vanishes, the largest component is positive and the others' signs come from products with it."""
    half = lambda e: F.sqrt(F.greatest(F.lit(0.0), 1 + e)) / 2
    w, x, y, z = half(m[0][0] + m[1][1] + m[2][2]), half(m[0][0] - m[1][1] - m[2][2]), half(m[1][1] - m[0][0] - m[2][2]), half(m[2][2] - m[0][0] - m[1][1])
    sign = lambda e: F.when(e < 0, -1.0).otherwise(1.0)
    xy, xz, yz = sign(m[0][1] + m[1][0]), sign(m[0][2] + m[2][0]), sign(m[1][2] + m[2][1])
    led = lambda by_x, by_y, by_z: F.when((x >= y) & (x >= z), by_x).when(y >= z, by_y).otherwise(by_z)
    one = F.lit(1.0)
    turn = (led(one, xy, xz), led(xy, one, yz), led(xz, yz, one))
    skew = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    return (w, *(c * F.when(w > 1e-9, sign(s)).otherwise(t) for c, s, t in zip((x, y, z), skew, turn, strict=True)))


def times(p: Quaternion, q: Quaternion) -> Quaternion:
    """First q, then p."""
    return (
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )


def turned(p: Vector, q: Quaternion) -> Vector:
    return tuple(sum((a * b for a, b in zip(row[1:], p[1:], strict=True)), row[0] * p[0]) for row in to_matrix(q))
