"""Assignment against all permutations, and geometry against worked values."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F
from test_catalog import spark  # noqa: F401

from chronovox.functions import angles
from chronovox.operators import motion


def test_least_assignment_against_all_permutations():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        cost = rng.integers(0, 6, (n, m)).astype(float) if rng.random() < 0.5 else rng.normal(size=(n, m))
        to = motion._least_assignment(cost)
        assert len(set(to.tolist())) == n
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert math.isclose(cost[np.arange(n), to].sum(), best, abs_tol=1e-9)


def test_assignment_of_groups(spark):  # noqa: F811
    rows = [(g, a, b, float((a * 7 + b * 5 + g) % 11)) for g in (1, 2) for a in range(2 + g) for b in range(3)]
    got = motion.assigned(spark.createDataFrame(rows, "g long, a long, b long, cost double")).collect()
    for g in (1, 2):
        cost = {(a, b): c for k, a, b, c in rows if k == g}
        best = min(sum(cost[a, b] for a, b in zip(p, range(3))) for p in itertools.permutations(range(2 + g), 3))
        own = [r for r in got if r["g"] == g]
        assert len(own) == 3 and len({r["a"] for r in own}) == 3 and math.isclose(sum(r["cost"] for r in own), best)


def test_angles(spark):  # noqa: F811
    v = lambda *x: tuple(F.lit(float(a)) for a in x)
    x, y, z = v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)
    cases = [angles.angle(x, y), angles.angle(x, x), angles.angle(x, v(-1, 0, 0)), angles.angle(x, v(0, 0, 0)), angles.oriented_angle(x, y, z), *angles.onto_plane(v(1, 2, 3), v(0, 0, 1), z), *angles.turned(x, z, F.lit(math.pi / 2)), *angles.plane(v(0, 0, 2), v(1, 0, 2), v(0, 1, 2))]
    got = list(spark.range(1).select(*[c.alias(str(k)) for k, c in enumerate(cases)]).collect()[0])
    assert np.allclose(got, [math.pi / 2, 0, math.pi, 0, -math.pi / 2, 1, 2, 1, 0, 1, 0, 0, 0, 1, -2])
