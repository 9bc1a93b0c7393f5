"""A known plane and known turns are found again; knots, their ends and what has none."""

import math

import numpy as np
from pyspark.sql import functions as F
from test_catalog import spark  # noqa: F401

from chronovox.operators import symmetry

POINT = "t long, name string, place double, x double, y double, z double"


def turned(p, axis, a):
    axis = axis / np.linalg.norm(axis)
    return p * math.cos(a) + np.cross(axis, p) * math.sin(a) + axis * (axis @ p) * (1 - math.cos(a))


def test_line_and_plane(spark):  # noqa: F811
    rng = np.random.default_rng(1)
    u = np.array([1.0, -2, 0.5]) / np.linalg.norm([1, -2, 0.5])
    rows = []
    for t in range(3):
        for k in range(20):
            p = np.array([5.0, t, 2]) + u * (k if t else -k) + rng.normal(size=3) * 0.01
            rows.append((t, "a", float(k), *map(float, p)))
    rows += [(7, "a", 0.0, 1.0, 2.0, 3.0), (8, "a", 0.0, None, 2.0, 3.0)]
    line = symmetry.fitted_line(spark.createDataFrame(rows, POINT), ["t"])
    got = {r.t: np.array([r.ux, r.uy, r.uz]) for r in line.collect()}
    assert sorted(got) == [0, 1, 2, 7]
    for t in range(3):
        own = np.array([r[3:] for r in rows if r[0] == t])
        want = np.linalg.svd(own - own.mean(0))[2][0]
        assert np.allclose(np.abs(got[t]), np.abs(want), atol=1e-9) and got[t] @ u * (1 if t else -1) > 0.99
    centres = spark.createDataFrame([(1, 5.0, 9.0, 2.0), (7, 1.0, 2.0, 3.0)], "t long, bx double, by_ double, bz double")
    plane = {r.t: r for r in symmetry.symmetry_plane(centres, line, ["t"]).collect()}
    n = np.array([plane[1].nx, plane[1].ny, plane[1].nz])
    assert abs(n @ got[1]) < 1e-9 and abs(np.linalg.norm(n) - 1) < 1e-12 and plane[7].nx is None
    assert symmetry.fitted_line(spark.createDataFrame([], POINT), ["t"]).count() == 0


def test_known_turns_are_recovered(spark):  # noqa: F811
    b, n, origin = np.array([1.0, 2, 3]), np.array([1.0, 1, 2]) / math.sqrt(6), (40.0, 30.0, 25.0)
    foot = lambda p: p - b - n * (n @ (p - b))
    o = foot(np.array(origin))
    o /= np.linalg.norm(o)
    at = lambda a, r, h: b + turned(o, n, -a) * r + n * h  # noqa: E731  (angles grow against the normal)
    turns = {0.5: 0.2, 1.5: -0.1, 3.0: 0.4, 5.5: 0.0}
    marks = [(0, f"m{a}", *at(a, 10, 1), *(turned(at(a, 10, 1) - b, n, x) + b)) for a, x in turns.items()]
    marks += [(0, "near", *(b + o * 0.5 + n), *b), (0, "z later", *at(0.5, 20, 0), *at(2.0, 20, 0))]  # too near; a second one of an angle
    marks = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in marks], "t long, name string, x double, y double, z double, rx double, ry double, rz double")
    plane = spark.createDataFrame([(0, *map(float, b), *map(float, n)), (2, *map(float, b), None, None, None)], "t long, bx double, by_ double, bz double, nx double, ny double, nz double")
    knots = symmetry.knots(marks, plane, ["t"], origin)
    (row,) = knots.collect()
    assert [(round(k["at"], 3), round(k["turn"], 6)) for k in row.knots] == [(a, x) for a, x in turns.items()]
    want = {0.2: 0.2, 0.5: 0.2, 1.0: 0.05, 2.25: 0.15, 5.0: 0.08, 6.0: 0.0}
    points = [(0, k, *map(float, at(a, 7, -2))) for k, a in enumerate(want)] + [(1, 50, 1.0, 2.0, 3.0), (2, 51, 4.0, 5.0, 6.0), (0, 52, None, 1.0, 1.0)]
    points = spark.createDataFrame(points, "t long, id long, x double, y double, z double")
    got = {r.id: r for r in symmetry.piecewise_turned(points, plane, knots, ["t"], origin).collect()}
    for k, (a, x) in enumerate(want.items()):
        p = turned(at(a, 7, -2) - b, n, x) + b
        assert abs(got[k].turn - x) < 1e-6 and np.allclose([got[k].x, got[k].y, got[k].z], p, atol=1e-6)
    assert (got[50].x, got[50].turn, got[51].z, got[51].turn, got[52].x) == (1.0, 0.0, 6.0, 0.0, None)
    round_ = {r.id: r.turn for r in symmetry.piecewise_turned(points, plane, knots, ["t"], origin, circular=True).collect()}
    gap = 0.5 + 2 * math.pi - 5.5
    assert abs(round_[0] - 0.2 * (0.2 + 2 * math.pi - 5.5) / gap) < 1e-6 and abs(round_[5] - 0.2 * 0.5 / gap) < 1e-6 and abs(round_[2] - 0.05) < 1e-6
    assert symmetry.piecewise_turned(points.where(F.lit(False)), plane, knots, ["t"], origin).count() == 0
