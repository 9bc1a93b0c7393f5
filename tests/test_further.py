"""Edits of lineages, vector fields, quaternions and measures against plain versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalog import spark  # noqa: F401
from test_wider import rotation

from chronovox.functions import quaternions
from chronovox.operators import edits, fields, measures

NODES = [(k, t, float(k), float(t), 0.0) for t in range(5) for k in range(10 * t, 10 * t + 3)]
EDGES = [(10 * t + k, 10 * t + 10 + k) for t in range(4) for k in range(3) if (t, k) != (2, 1)]


def forest(spark):  # noqa: F811
    return spark.createDataFrame(NODES, "id long, t long, x double, y double, z double"), spark.createDataFrame(EDGES, "src long, dst long")


def test_added_removed_merged(spark):  # noqa: F811
    nodes, edges = forest(spark)
    new = spark.createDataFrame([(k, 1, 0.0, 0.0, 0.0, 0 if k else None) for k in range(4)], "k long, t long, x double, y double, z double, of long")
    n, e = edits.added(nodes, edges, new)
    assert n.count() == 19 and sorted(r.id for r in n.where("id > 42").collect()) == [43, 44, 45, 46]
    assert {(r.src, r.dst) for r in e.where("dst > 42").collect()} == {(0, 44), (0, 45), (0, 46)}
    n, e = edits.removed(nodes, edges, spark.createDataFrame([(10,), (21,), (21,)], "id long"))
    assert {r.id for r in n.collect()} == {r[0] for r in NODES} - {10, 21}
    assert {(r.src, r.dst) for r in e.collect()} == {x for x in EDGES if not {10, 21} & set(x)}
    n, e = edits.merged(nodes, edges, spark.createDataFrame([(11, 10), (21, 20)], "id long, new long"))
    at = {r.id: (r.t, r.x, r.n) for r in n.collect()}
    assert at[10] == (1, 10.5, 2) and at[20] == (2, 20.5, 2) and 11 not in at and at[12] == (1, 12.0, 1)
    assert {(r.src, r.dst) for r in e.collect()} == {({11: 10, 21: 20}.get(a, a), {11: 10, 21: 20}.get(b, b)) for a, b in EDGES}


def test_close_pairs(spark):  # noqa: F811
    near = spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.1), (3, 2, 0.3), (4, 5, 0.9), (5, 4, 0.9)], "a long, b long, d double")
    density = spark.createDataFrame([(k, 1.0) for k in range(1, 6)], "id long, density double")
    assert [tuple(r) for r in edits.close_pairs(near, density).collect()] == [(2, 1)]


@pytest.mark.parametrize("frame", [0, 2, 4])
def test_ways_to_a_frame(spark, frame):  # noqa: F811
    nodes, edges = forest(spark)
    t = {r[0]: r[1] for r in NODES}
    down, up = dict(EDGES), {b: a for a, b in EDGES}
    want = set()
    for k in t:
        c = k
        while c is not None and t[c] != frame:
            c = (down if t[c] < frame else up).get(c)
        if c is not None:
            want.add((k, c))
    assert {(r.id, r.ref) for r in edits.at_frame(nodes, edges, frame).collect()} == want


def test_stabilised(spark):  # noqa: F811
    nodes, edges = forest(spark)
    density = nodes.select("id", (F.col("id") % 10 + 1).cast("double").alias("density"))
    got = {r.id: (r.x, r.y) for r in edits.stabilised(nodes, edges, density).collect()}
    assert got[20] == (20.0, 2.0) and got[0] == pytest.approx((20.0, 2.0)) and got[40] == pytest.approx((20.0, 2.0))


def test_carried_labels(spark):  # noqa: F811
    edges = [(0, 1), (1, 2), (1, 3), (3, 4), (5, 3)]
    seeds = [(1, 0), (3, 1), (9, 2)]
    reach = collections.defaultdict(set)
    for c, label in seeds:
        for way in ({a: [y for x, y in edges if x == a] for a, _ in edges}, {b: [x for x, y in edges if y == b] for _, b in edges}):
            todo = [c]
            while todo:
                reach[p := todo.pop()].add(label)
                todo += way.get(p, [])
    got = {r.id: r.label for r in edits.carried_labels(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "id long, label long")).collect()}
    assert got == {c: next(iter(x)) for c, x in reach.items() if len(x) == 1}


def grid(spark, n):  # noqa: F811
    return measures.box(spark, (0, 0, 0), (n - 1, n - 1, n - 1)).select("x", "y", "z")


def test_fields(spark):  # noqa: F811
    g = grid(spark, 8)
    shift = np.eye(4)
    shift[:3, 3] = (1.0, 0.5, 0.0)
    f = fields.from_matrix(g, shift)
    two = {(r.x, r.y, r.z): (r.dx, r.dy, r.dz) for r in fields.composed(f, f).collect()}
    assert set(two.values()) == {(2.0, 1.0, 0.0)} and max(k[0] for k in two) == 6
    back = fields.inverted(f).where("error < 0.06").collect()
    assert back and all(abs(r.dx + 1) < 0.06 and abs(r.dy + 0.5) < 0.06 for r in back)
    points = spark.createDataFrame([(1, 2.5, 3.0, 4.0), (2, 7.5, 0.0, 0.0)], "id long, x double, y double, z double")
    assert [(r.id, r.x, r.y, r.z) for r in fields.moved(points, f).collect()] == [(1, 3.5, 3.5, 4.0)]
    s = fields.statistics(f).collect()[0]
    assert s.n == 512 and s.mean_dx == 1 and s.deviation_dy == 0 and s.most_length == pytest.approx(1.25**0.5)
    wave = fields.sinus(g, (0.5, 0.0, 0.0), (8.0, 1.0, 1.0))
    image = g.withColumn("v", F.col("x").cast("double"))
    got = {(r.x, r.y, r.z): r.v for r in fields.resampled(image, wave).collect()}
    assert got and all(v == pytest.approx(x + 0.5 * np.sin(2 * np.pi * x / 8)) for (x, _, _), v in got.items())


def test_estimated_field(spark):  # noqa: F811
    g = grid(spark, 5)
    rng = np.random.Generator(np.random.PCG64(2))
    at = rng.integers(0, 5, (30, 3)).astype(float)
    rows = [(k, *p.tolist(), *(p + (0.5, 0.0, -0.25)).tolist(), 1.0) for k, p in enumerate(at)] + [(99, 2.0, 2.0, 2.0, 30.0, 2.0, 2.0, 0.05)]
    f = fields.estimated(g, spark.createDataFrame(rows, "i long, ax double, ay double, az double, bx double, by double, bz double, w double"), reach=4, sigma=3.0)
    got = f.collect()
    assert len(got) == 125 and all(np.allclose((r.dx, r.dy, r.dz), (0.5, 0, -0.25), atol=1e-9) for r in got)


def test_random_matrices():
    for kind in ("identity", "translation", "rigid", "similitude", "affine"):
        m = fields.random_matrix(kind, 7)
        assert np.array_equal(m, fields.random_matrix(kind, 7)) and np.allclose(m[3], (0, 0, 0, 1))
        if kind in ("identity", "translation", "rigid"):
            assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3)) and np.linalg.det(m[:3, :3]) > 0


def test_quaternions(spark):  # noqa: F811
    vectors = [(0.3, -0.2, 0.5), (0.0, 0.0, 0.0), (np.pi, 0.0, 0.0), (0.0, -np.pi, 0.0), (2.0, 2.0, -1.0), tuple(np.pi * np.array([0.6, -0.8, 0.0]))]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(vectors)], "k int, x double, y double, z double")
    q = quaternions.of_vector((F.col("x"), F.col("y"), F.col("z")))
    m = quaternions.to_matrix(q)
    back = quaternions.of_matrix(m)
    rows = df.select("k", F.array(*q).alias("q"), F.array(*[e for r in m for e in r]).alias("m"), F.array(*quaternions.to_vector(q)).alias("v"), F.array(*[e for r in quaternions.to_matrix(back) for e in r]).alias("n"),
                     F.array(*[e for r in quaternions.to_matrix(quaternions.times(q, q)) for e in r]).alias("two"), F.array(*quaternions.turned((F.lit(1.0), F.lit(2.0), F.lit(3.0)), q)).alias("p")).orderBy("k").collect()
    for v, r in zip(vectors, rows, strict=True):
        want = rotation(v, np.linalg.norm(v)) if np.any(v) else np.eye(3)
        got = np.array(r.m).reshape(3, 3)
        assert np.allclose(got, want) and np.allclose(np.array(r.n).reshape(3, 3), want, atol=1e-7) and np.allclose(np.array(r.two).reshape(3, 3), want @ want) and np.allclose(r.p, want @ (1, 2, 3))
        assert np.allclose(r.v, v, atol=1e-6) or abs(np.linalg.norm(v) - np.pi) < 1e-9 or np.linalg.norm(v) > np.pi
    t, p = quaternions.azimuth_inclination(quaternions.direction(F.lit(0.7), F.lit(1.1)))
    assert np.allclose(spark.range(1).select(t, p).collect()[0], (0.7, 1.1))


def test_measures(spark):  # noqa: F811
    rng = np.random.Generator(np.random.PCG64(6))
    v = rng.random((9, 7, 5)) * 10
    image = spark.createDataFrame([(*map(int, p), float(v[p])) for p in np.ndindex(v.shape)], "x long, y long, z long, v double")
    d = measures.described(image).collect()[0]
    assert np.allclose((d.n, d.least, d.mean, d.most, d.deviation), (v.size, v.min(), v.mean(), v.max(), v.std()))
    assert [r.v for r in measures.converted(spark.createDataFrame([(0, 0, 0, x) for x in (-3.0, 2.5, 300.0)], "x int, y int, z int, v double"), "u8").collect()] == [0, 3, 255]
    moved = {(r.x, r.y, r.z): r.v for r in measures.cubic(image, (0.25, 0.0, 2.0)).collect()}
    assert set(moved) == {(x, y, z + 2) for x in range(2, 8) for y in range(7) for z in range(5)}
    line = spark.createDataFrame([(x, 0, 0, float(x * x)) for x in range(9)], "x long, y long, z long, v double")
    assert all(r.v == pytest.approx((r.x - 0.25) ** 2) for r in measures.cubic(line, (0.25, 0.0, 0.0)).collect())
    robust = {(r.x, r.y, r.z): r.v for r in measures.neighbourhood(image, "robust").collect()}
    near = [v[4, 3, 2], v[3, 3, 2], v[5, 3, 2], v[4, 2, 2], v[4, 4, 2], v[4, 3, 1], v[4, 3, 3]]
    m, s = np.mean(near), np.std(near)
    assert robust[4, 3, 2] == pytest.approx(np.mean([x for x in near if abs(x - m) <= 2 * s]))
    blocks = {(r.bx, r.by, r.bz): r for r in measures.windowed_blocks(image, 3, 2.0, 8.0, 0.5).collect()}
    own = v[:3, :3, :3]
    inside = own[(own > 2) & (own < 8)]
    assert ((0, 0, 0) in blocks) == (len(inside) >= 0.5 * own.size) and ((0, 0, 0) not in blocks or blocks[0, 0, 0].variance == pytest.approx(inside.var()))


def test_shapes(spark):  # noqa: F811
    b = measures.box(spark, (-3, -3, -3), (3, 3, 3), 0.0)
    assert b.count() == 343 and measures.box(spark, (0, 0, 0), (-1, 0, 0)).count() == 0
    ball = measures.drawn(b, measures.sphere((0, 0, 0), 2.0), 5.0).where("v = 5").count()
    assert ball == sum(x * x + y * y + z * z <= 4 for x in range(-3, 4) for y in range(-3, 4) for z in range(-3, 4))
    assert b.where(measures.cylinder((0, 0, -2), (0, 0, 2), 1.0)).count() == 25 and b.where(measures.slab((0, 0, 0), (0, 0, 2), 1.0)).count() == 49
    assert b.where(measures.checkerboard(1)).count() in (171, 172) and b.where(measures.grid_lines(3)).count() == 343 - 4**3


def test_phase_translation_and_stack(spark):  # noqa: F811
    rng = np.random.Generator(np.random.PCG64(3))
    base = {tuple(map(int, p)): float(w) for p, w in zip(rng.integers(4, 12, (40, 3)), rng.random(40) + 0.5, strict=True)}
    rows = [(0, *p, w) for p, w in base.items()] + [(1, p[0] + 2, p[1] - 1, p[2] + 3, w) for p, w in base.items()] + [(1, 0, 0, 0, 0.01), (0, 15, 15, 15, 0.01), (1, 15, 15, 15, 0.01)]
    images = spark.createDataFrame(rows, "t long, x long, y long, z long, v double")
    got = measures.phase_translation(images).collect()
    assert [(r.t, r.dx, r.dy, r.dz) for r in got] == [(0, 2.0, -1.0, 3.0)]
    stack = measures.stacked(images).collect()
    assert {r.z for r in stack} == {0, 1} and len(stack) == len({(t, x, y) for t, x, y, *_ in rows})


def test_relabelled(spark):  # noqa: F811
    got = {(r.side, r.label): r.new for r in measures.relabelled(spark.createDataFrame([(5, 7), (2, 3), (2, 4), (8, 9), (6, 9)], "l long, r long")).collect()}
    assert got == {("l", 5): 2, ("r", 7): 2, ("l", 2): 3, ("r", 3): 3, ("r", 4): 4, ("l", 6): 4, ("l", 8): 5, ("r", 9): 5}
