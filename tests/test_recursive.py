"""Recursive filters against plain loops over whole lines, and what their responses must sum to."""

import math

import numpy as np
import pytest
from test_catalog import spark  # noqa: F401

from chronovox.operators import recursive


def plain_pair(x, top, bottom, mirrored):
    """y+ and y- by the recurrences as they are published, from rest."""
    n, y, z = len(x), np.zeros(len(x)), np.zeros(len(x))
    for i in range(n):
        y[i] = sum(top.get(k, 0) * x[i - k] for k in range(5) if i >= k) + sum(b * y[i - k - 1] for k, b in enumerate(bottom) if i > k)
    for i in reversed(range(n)):
        z[i] = sum(mirrored.get(k, 0) * x[i + k] for k in range(1, 5) if i + k < n) + sum(b * z[i + k + 1] for k, b in enumerate(bottom) if i + k + 1 < n)
    return y + z


def plain_young(x, sigma):
    """To and fro over a line that goes on at both ends, far enough to come to rest."""
    (to,), (fro,) = recursive.young(sigma)
    x = np.r_[[x[0]] * 3, x[3:]]
    gain, back, far = to.ahead[0], to.back, int(60 * sigma) + 20
    w = [x[0]] * 3
    for a in [*x, *[x[-1]] * far]:
        w.append(gain * a + sum(b * w[-k - 1] for k, b in enumerate(back)))
    y = [x[-1]] * 3
    for a in reversed(w[3:]):
        y.append(gain * a + sum(b * y[-k - 1] for k, b in enumerate(back)))
    return np.array(y[3:][::-1][: len(x)])


def plain(x, stages):
    for passes in stages:
        if len(passes) == 2:
            x = plain_pair(x, passes[0].ahead, passes[0].back, passes[1].ahead)
        else:
            (p,) = passes
            y, line = [0.0] * len(p.back), np.r_[0, x[::-1] if p.reverse else x, 0]
            for i in range(1, len(line) - 1):
                y.append(sum(c * line[i - k] for k, c in p.ahead.items()) + sum(b * y[-k - 1] for k, b in enumerate(p.back)))
            x = np.array(y[len(p.back) :])
            x = x[::-1] if p.reverse else x
    return x


def test_responses():
    n = np.arange(-400, 401)
    delta = (n == 0).astype(float)
    for how, width in ((recursive.deriche, 3.0), (recursive.exponential, 0.5)):
        smooth, first, second = (plain(delta, how(width, k)) for k in (0, 1, 2))
        assert smooth.sum() == pytest.approx(1, abs=1e-9) and (first * n).sum() == pytest.approx(-1, abs=1e-6) and (second * n * n).sum() == pytest.approx(2, abs=1e-6)
        assert np.allclose(smooth, smooth[::-1], atol=1e-12) and np.allclose(second, second[::-1], atol=1e-12) and np.allclose(first[n != 0], -first[::-1][n != 0], atol=1e-12)
    gauss = np.exp(-(n**2) / 18) / (3 * math.sqrt(2 * math.pi))
    assert np.abs(plain(delta, recursive.deriche(3.0)) - gauss).max() < 1e-3
    # the published closed form of the first filter
    a, e = 0.5, math.exp(-0.5)
    s = (1 - e) ** 2 / (1 + 2 * a * e - e * e)
    assert np.allclose(plain(delta, recursive.exponential(a)), s * (1 + a * np.abs(n)) * np.exp(-a * np.abs(n)), atol=1e-12)
    k = (1 - e * e) / (2 * e)
    k1 = -2 * (1 - e) ** 3 / (1 + e) ** 3
    assert np.allclose(plain(delta, recursive.exponential(a, 2)), k1 * (1 - k * np.abs(n)) * np.exp(-a * np.abs(n)), atol=1e-12)
    assert np.allclose(plain_young(np.full(50, 7.0), 2.0), 7.0)


def image(shape, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 50, shape) * (rng.random(shape) < 0.4)
    v[0, 0, 0] = v[-1, -1, -1] = 3
    return v.astype(float)


def run(spark, v, low, along):  # noqa: F811
    rows = [tuple(int(a + b) for a, b in zip(p, low)) + (float(v[tuple(p)]),) for p in np.argwhere(v)]
    got = recursive.filtered(spark.createDataFrame(rows, "x long, y long, z long, v double"), along)
    out = np.zeros(v.shape)
    n = 0
    for r in got.collect():
        out[r.x - low[0], r.y - low[1], r.z - low[2]] = r.v
        n += 1
    return out, n


@pytest.mark.parametrize(("axis", "stages", "reference"), [
    ("x", recursive.deriche(4.0), None), ("x", recursive.deriche(2.0, 1), None), ("z", recursive.deriche(1.0, 2), None), ("y", recursive.exponential(0.7, 1), None),
    ("x", recursive.young(3.0), 3.0), ("y", recursive.young(0.8), 0.8), ("x", recursive.young(2.0, 1), None), ("x", recursive.young(2.0, 2), None)])
def test_blocks_of_lines_equal_whole_lines(spark, axis, stages, reference):  # noqa: F811
    v = image((150, 19, 5))
    got, _ = run(spark, v, (-70, 30, -2), {axis: stages})
    k = "xyz".index(axis)
    there = (v != 0).any(k, keepdims=True)
    want = np.apply_along_axis(lambda x: plain_young(x, reference) if reference else plain(x, stages), k, v) * there
    assert np.allclose(got, want, atol=1e-9)


def test_three_axes(spark, monkeypatch):  # noqa: F811
    v = image((20, 18, 9), 2)
    got, n = run(spark, v, (5, 0, 0), {c: recursive.deriche(1.5) for c in "xyz"})
    want = v
    for k in range(3):
        want = np.apply_along_axis(lambda x: plain(x, recursive.deriche(1.5)), k, want)
    assert n == v.size and np.allclose(got, want, atol=1e-9)


def test_defined_results(spark):  # noqa: F811
    make = lambda rows: spark.createDataFrame(rows, "x long, y long, z long, v double")
    assert recursive.smoothed(make([]), (1.0, 1.0, 1.0)).count() == 0
    one = recursive.smoothed(make([(3, 4, 5, 2.0), (3, 4, 5, 1.0)]), (0.0, 0.0, 2.0), recursive.young).collect()
    assert len(one) == 1 and one[0].v == pytest.approx(2.0)
    short = recursive.smoothed(make([(0, 0, 0, 5.0), (0, 0, 1, 5.0), (0, 0, 2, None)]), (0.0, 0.0, 1.0)).count()
    assert short == 3
    with pytest.raises(ValueError):
        recursive.young(0.2)
