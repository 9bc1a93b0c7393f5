"""Fitted curves against plain double loops, and splines against sums of all B-splines and polynomials."""

import itertools
import math
import random

import numpy as np
import pytest
from test_catalog import spark  # noqa: F401

from chronovox.operators import curves, splines

PLAIN = {
    "gaussian": lambda x, p: p[0] * math.exp(-(((x - p[1]) / p[2]) ** 2) / 2),
    "two_sided": lambda x, p: p[0] * math.exp(-(((x - p[1]) / (p[2] if x < p[1] else p[3])) ** 2) / 2),
    "rayleigh": lambda x, p: p[0] * (x - p[1]) * math.exp(-(((x - p[1]) / p[2]) ** 2) / 2) if x >= p[1] else 0.0,
    "saturation": lambda x, p: p[0] * x / (p[1] + x),
}
TRUE = {"gaussian": [5.0, 3.0, 1.5], "two_sided": [4.0, 6.0, 1.0, 3.0], "rayleigh": [2.0, 0.7, 2.5], "saturation": [7.0, 3.0]}


@pytest.mark.parametrize("kind", sorted(PLAIN))
def test_slopes_and_fit(spark, kind):  # noqa: F811
    true = TRUE[kind]
    points = spark.createDataFrame([(i / 4, PLAIN[kind](i / 4, true)) for i in range(60)], "x double, y double")
    from pyspark.sql import functions as F

    value, slopes = curves.curve([kind], true, F.col("x"))
    step = 1e-6
    for r in points.select("x", value.alias("v"), F.array(*slopes).alias("d")).where("abs(x - 6) > 1e-3").collect():
        assert r.v == pytest.approx(PLAIN[kind](r.x, true), abs=1e-12)
        for k, d in enumerate(r.d):
            up, down = ([p + s * (i == k) for i, p in enumerate(true)] for s in (step, -step))
            assert d == pytest.approx((PLAIN[kind](r.x, up) - PLAIN[kind](r.x, down)) / (2 * step), abs=1e-5)
    got, error, settled = curves.fitted(points, [kind], [1.15 * p for p in true])
    assert settled and got == pytest.approx(true, rel=1e-4) and error < 1e-8


def test_mixture_of_a_histogram(spark):  # noqa: F811
    """The noisy sum of two Gaussians: the fit's gradient vanishes, and no near point is better (numpy sums)."""
    rng = random.Random(3)
    x = [i / 2 for i in range(80)]
    y = [PLAIN["gaussian"](u, [50, 10, 3]) + PLAIN["gaussian"](u, [30, 25, 5]) + rng.gauss(0, 1) for u in x]
    rows = [(a, b, 1.0 + i % 3, "extra") for i, (a, b) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, ""), (1.0, float("nan"), 1.0, ""), (1.0, float("inf"), 1.0, "")]
    got, error, settled = curves.fitted(spark.createDataFrame(rows, "x double, y double, w double, label string"), ["gaussian", "gaussian"], [40, 8, 2, 20, 28, 4])
    w = np.array([1.0 + i % 3 for i in range(80)])
    total = lambda p: float((w * (np.array(y) - [PLAIN["gaussian"](u, p[:3]) + PLAIN["gaussian"](u, p[3:]) for u in x]) ** 2).sum())
    assert settled and error == pytest.approx(total(got), rel=1e-9) and got[1] == pytest.approx(10, abs=0.5) and got[4] == pytest.approx(25, abs=1)
    for k, s in itertools.product(range(6), (-1e-2, 1e-2)):
        assert total([p + s * (i == k) for i, p in enumerate(got)]) > error


def test_odd_points(spark):  # noqa: F811
    none = spark.createDataFrame([], "x double, y double")
    assert curves.fitted(none, ["gaussian"], [1, 2, 3]) == ([1.0, 2.0, 3.0], 0.0, True)
    with pytest.raises(ValueError):
        curves.fitted(none, ["cosine"], [1])
    with pytest.raises(ValueError):
        curves.fitted(none, ["gaussian"], [1])


def bump(u):
    u = abs(u)
    return 2 / 3 - u * u + u**3 / 2 if u < 1 else (2 - u) ** 3 / 6 if u < 2 else 0.0


@pytest.mark.parametrize("width", [4, 32])
def test_spline_passes_and_sums(spark, width):  # noqa: F811
    rng = random.Random(1)
    image = {p: rng.uniform(-5, 5) for p in itertools.product(range(-2, 7), range(5), range(4)) if rng.random() < 0.8}
    df = spark.createDataFrame([(*p, v) for p, v in image.items()], "x long, y long, z long, v double")
    onto = spark.createDataFrame(list(itertools.product(range(-3, 9), range(-1, 6), range(-1, 5))), "x long, y long, z long")
    same = {(r.x, r.y, r.z): r.v for r in splines.by_matrix(df, np.eye(4), onto, width).collect()}
    low, high = [min(p[k] for p in image) for k in range(3)], [max(p[k] for p in image) for k in range(3)]
    assert set(same) == set(itertools.product(*[range(a, b + 1) for a, b in zip(low, high)]))
    assert all(v == pytest.approx(image.get(p, 0.0), abs=1e-9) for p, v in same.items())
    c = {(r.x, r.y, r.z): r.v for r in splines.weights(df).collect()}
    m = np.array([[0.9, -0.3, 0.1, 0.4], [0.25, 1.1, 0.0, -0.3], [0, 0.1, 0.95, 0.2], [0, 0, 0, 1.0]])
    moved = {(r.x, r.y, r.z): r.v for r in splines.by_matrix(df, m, onto, width).collect()}
    back = np.linalg.inv(m)
    asked = {p: (back @ [*p, 1])[:3] for p in itertools.product(range(-3, 9), range(-1, 6), range(-1, 5))}
    asked = {p: f for p, f in asked.items() if all(a <= round(u, 9) <= b for a, b, u in zip(low, high, f))}
    assert set(moved) == set(asked) and len(moved) > 20
    for p, f in asked.items():
        near = itertools.product(*[range(math.floor(u) - 1, math.floor(u) + 3) for u in f])
        assert moved[p] == pytest.approx(sum(c.get(q, 0.0) * math.prod(bump(u - k) for u, k in zip(f, q)) for q in near), abs=1e-7)
    field = spark.createDataFrame([(*p, *(float(b - a) for a, b in zip(p, f))) for p, f in asked.items()], "x long, y long, z long, dx double, dy double, dz double")
    assert {(r.x, r.y, r.z): r.v for r in splines.by_field(df, field, width).collect()} == pytest.approx(moved, abs=1e-7)


def test_polynomials_stay(spark):  # noqa: F811
    form = lambda x, y, z: 0.01 * x**3 - 0.2 * x * y + 0.03 * y * y * z + z - 2
    n = 36
    df = spark.createDataFrame([(x, y, z, form(x, y, z)) for x in range(n) for y in range(n) for z in range(n)], "x long, y long, z long, v double")
    field = spark.createDataFrame([(17, 18, 17, 0.37, -0.2, 0.71), (18, 17, 18, -0.5, 0.5, 0.25)], "x long, y long, z long, dx double, dy double, dz double")
    for r in splines.by_field(df, field).collect():
        d = (0.37, -0.2, 0.71) if r.x == 17 else (-0.5, 0.5, 0.25)
        assert r.v == pytest.approx(form(r.x + d[0], r.y + d[1], r.z + d[2]), abs=1e-5)


def test_no_image(spark):  # noqa: F811
    none = spark.createDataFrame([], "x long, y long, z long, v double")
    onto = spark.createDataFrame([(0, 0, 0)], "x long, y long, z long")
    assert splines.by_matrix(none, np.eye(4), onto).isEmpty()
