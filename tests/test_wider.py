"""Fits, block matching, distances, basins, hysteresis and flow against plain versions."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalog import spark  # noqa: F401

from chronovox.operators import filters, flow, registration, voxels

RNG = np.random.Generator(np.random.PCG64(5))


def rotation(axis, angle):
    k = np.array(axis) / np.linalg.norm(axis)
    s = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * s + (1 - np.cos(angle)) * s @ s


def pairings(spark, linear, shift, noise=0.0, wild=0):  # noqa: F811
    a = RNG.normal(size=(60, 3)) * 5
    b = a @ np.asarray(linear).T + shift + RNG.normal(size=a.shape) * noise
    b[:wild] += 40
    rows = [(1, i, *p.tolist(), *q.tolist(), float(i % 4 + 1)) for i, (p, q) in enumerate(zip(a, b))]
    return a, b, spark.createDataFrame(rows, "g int, i int, ax double, ay double, az double, bx double, by double, bz double, w double")


def test_exact_fits(spark):  # noqa: F811
    r = rotation((1, 2, 3), 0.7)
    for kind, linear in (("translation", np.eye(3)), ("scaling", np.diag([2.0, 0.5, 3.0])), ("rigid", r), ("similitude", 1.7 * r), ("affine", r @ np.diag([1, 2, 3.0]) + 0.1)):
        _, _, p = pairings(spark, linear, [1.0, -2.0, 3.0])
        m = np.array(registration.fitted(p, kind, weighted=True).collect()[0].m).reshape(4, 4)
        assert np.allclose(m[:3, :3], linear) and np.allclose(m[:3, 3], [1, -2, 3])


def test_noisy_affine_and_trimming(spark):  # noqa: F811
    a, b, p = pairings(spark, rotation((0, 0, 1), 0.3), [5.0, 0, 0], 0.1)
    want = np.linalg.lstsq(np.c_[a, np.ones(60)], b, rcond=None)[0].T
    got = np.array(registration.fitted(p, "affine").collect()[0].m).reshape(4, 4)
    assert np.allclose(got[:3], want)
    _, _, p = pairings(spark, rotation((0, 0, 1), 0.3), [5.0, 0, 0], 0.0, wild=12)
    got = np.array(registration.trimmed_fit(p, "rigid", 0.6, 30).collect()[0].m).reshape(4, 4)
    assert np.allclose(got[:3, :3], rotation((0, 0, 1), 0.3), atol=1e-6) and np.allclose(got[:3, 3], [5, 0, 0], atol=1e-5)


def test_matrix_algebra(spark):  # noqa: F811
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation((1, 0, 2), 0.8), [1, 2, 3]
    lit = F.array(*[F.lit(float(x)) for x in m.ravel()])
    inv, half, real = (np.array(x).reshape(4, 4) for x in spark.range(1).select(registration.inverted(lit), registration.part_way(lit, 0.5), registration.rescaled(lit, (1, 2, 4), (2, 2, 2))).collect()[0])
    assert np.allclose(inv, np.linalg.inv(m)) and np.allclose((half[:3, :3]) @ half[:3, :3], m[:3, :3]) and np.allclose(half[:3, 3], [0.5, 1, 1.5])
    assert np.allclose(real, np.diag([2, 2, 2, 1]) @ m @ np.diag([1, 1 / 2, 1 / 4, 1]))


@pytest.fixture(scope="module")
def cube():
    return {(int(x), int(y), int(z)): float(RNG.integers(0, 6)) for x in range(6) for y in range(5) for z in range(4) if RNG.random() < 0.85}


def frame(spark, image):  # noqa: F811
    return spark.createDataFrame([(*p, v) for p, v in image.items()], "x long, y long, z long, v double")


def near(p, image):
    return [q for o in voxels.CROSS[1:] if (q := tuple(a + b for a, b in zip(p, o))) in image]


def groups(image):
    out, seen = [], set()
    for p in image:
        if p not in seen:
            todo, own = [p], set()
            while todo:
                q = todo.pop()
                if q not in own:
                    own.add(q)
                    todo += near(q, image)
            seen |= own
            out.append(own)
    return out


def test_hysteresis_and_sizes(spark, cube):  # noqa: F811
    got = {(r.x, r.y, r.z) for r in filters.hysteresis(frame(spark, cube), 3, 5, 3).collect()}
    want = [g for g in groups({p: v for p, v in cube.items() if v >= 3}) if len(g) >= 3 and max(cube[p] for p in g) >= 5]
    assert got == set().union(*want)


def test_distance_map(spark, cube):  # noqa: F811
    image = frame(spark, cube)
    got = {(r.x, r.y, r.z): r.d for r in filters.distance_map(image, image.where("v = 0")).collect()}
    best, heap = {}, [(0, p) for p, v in cube.items() if v == 0]
    while heap:
        d, p = heapq.heappop(heap)
        if p not in best:
            best[p] = d
            for o, w in filters.CHAMFER.items():
                q = tuple(a + b for a, b in zip(p, o))
                if q in cube and q not in best:
                    heapq.heappush(heap, (d + w, q))
    assert got == best


def test_basins_and_maxima(spark, cube):  # noqa: F811
    image = frame(spark, cube)
    number = lambda p: p[0] * 10**12 + p[1] * 10**6 + p[2]

    def foot(p):
        q = min([p, *near(p, cube)], key=lambda s: (cube[s], number(s)))
        return number(p) if q == p else foot(q)

    assert {(r.x, r.y, r.z): r.basin for r in filters.basins(image).collect()} == {p: foot(p) for p in cube}
    want = set()
    for level in set(cube.values()):
        for g in groups({p: v for p, v in cube.items() if v == level}):
            if all(cube[q] <= level for p in g for q in near(p, cube)):
                want |= g
    assert {(r.x, r.y, r.z) for r in filters.regional_maxima(image).collect()} == want


def test_blocks_find_a_shift(spark):  # noqa: F811
    v = RNG.random((12, 12, 8))
    image = frame(spark, {(int(x), int(y), int(z)): float(v[x, y, z]) for x, y, z in np.ndindex(v.shape)})
    moved = image.withColumns({"x": F.col("x") + 1, "y": F.col("y") - 1})
    got = registration.matched_blocks(image, moved, 4, 1, 1.0).collect()
    assert len(got) == 18 and all((r.bx - r.ax, r.by - r.ay, r.bz - r.az) == (1, -1, 0) and abs(r.w - 1) < 1e-6 for r in got)


def test_flow_follows_a_common_motion(spark):  # noqa: F811
    at = RNG.random((15, 3)) * 10
    nodes = spark.createDataFrame([(t * 100 + i, t, *(p + t * np.array([0.1, -0.05, 0.02])).tolist()) for t in range(3) for i, p in enumerate(at)], "id long, t long, x double, y double, z double")
    edges = spark.createDataFrame([(t * 100 + i, t * 100 + 100 + i) for t in range(2) for i in range(15)], "src long, dst long")
    got = {(r.track, r.t): (r.x, r.y, r.z) for r in flow.propagated(nodes, edges, 2, 0, n=5).collect()}
    assert len(got) == 45
    for (track, t), p in got.items():
        assert np.allclose(p, at[track - 200] + t * np.array([0.1, -0.05, 0.02]))
