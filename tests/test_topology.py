"""Simple points, thinning and growing against plain loops and counts of components, cavities and holes; trees of curves."""

import itertools
import math
import random

import numpy as np
import pytest
from test_catalog import spark  # noqa: F401

from chronovox.operators import topology

NEAR = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
FACES = [o for o in NEAR if sum(map(abs, o)) == 1]


def parts(places, steps):
    left, n = set(places), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            p = todo.pop()
            for o in steps:
                q = tuple(a + b for a, b in zip(p, o))
                if q in left:
                    left.remove(q)
                    todo.append(q)
    return n


def counts(places):
    """Components, cavities, and the Euler number of the union of closed cubes."""
    places = set(places)
    if not places:
        return 0, 0, 0
    low = [min(p[k] for p in places) - 1 for k in range(3)]
    high = [max(p[k] for p in places) + 2 for k in range(3)]
    outside = [p for p in itertools.product(*[range(a, b) for a, b in zip(low, high)]) if p not in places]
    cells = {tuple(2 * a + 1 + b for a, b in zip(p, o)) for p in places for o in [*NEAR, (0, 0, 0)]}
    euler = sum((-1) ** sum(c % 2 for c in cell) for cell in cells)
    return parts(places, NEAR), parts(outside, FACES) - 1, euler


def plain_kinds(p, places, flat=False):
    steps = [o for o in NEAR if not flat or o[2] == 0]
    front = [o for o in steps if tuple(a + b for a, b in zip(p, o)) in places]
    back = [o for o in steps if tuple(a + b for a, b in zip(p, o)) not in places and sum(map(abs, o)) <= 2]
    left, n = set(back), 0
    for f in back:
        if f in left and sum(map(abs, f)) == 1:
            n, todo = n + 1, [f]
            left.discard(f)
            while todo:
                q = todo.pop()
                for o in FACES:
                    r = tuple(a + b for a, b in zip(q, o))
                    if r in left:
                        left.remove(r)
                        todo.append(r)
    return parts(front, NEAR), n, len(front)


def plain_thinned(places, anchors=(), end="curve", levels=None, step=None, flat=False):
    """Voxel by voxel, in the order of the classes."""
    places, fixed = set(places), set(anchors)
    reached, quiet = min(levels.values()) if levels else 0, False
    while not quiet or (levels and reached - step < max(levels.values())):
        faces = [o for o in FACES if not flat or o[2] == 0]
        ready = {p for p in places if (levels[p] <= reached if levels else any(tuple(a + b for a, b in zip(p, o)) not in places for o in faces))}
        before = len(places)
        for odd in range(4 if flat else 8):
            gone = []
            for p in [p for p in places & ready if p not in fixed and all(p[k] % 2 == odd >> k & 1 for k in range(2 if flat else 3))]:
                front, back, n = plain_kinds(p, places, flat)
                if front == 1 and back == 1:
                    if end == "curve" and n == 1:
                        fixed.add(p)
                    else:
                        gone.append(p)
                elif (end == "curve" and front >= 2) or (end == "surface" and back >= 2):
                    fixed.add(p)
            places -= set(gone)
        quiet = len(places) == before
        reached += step or 0
    return places


def shapes():
    rng = random.Random(7)
    box = list(itertools.product(range(7), range(5), range(4)))
    ring = [p for p in itertools.product(range(9), range(9), range(3)) if not (3 <= p[0] <= 5 and 3 <= p[1] <= 5)]
    shell = [p for p in itertools.product(range(6), repeat=3) if not all(2 <= c <= 3 for c in p)]
    noise = [p for p in itertools.product(range(9), range(8), range(7)) if rng.random() < 0.6]
    return {"box": box, "ring": ring, "shell": shell, "noise": noise, "two": box + [(x + 20, y - 9, z) for x, y, z in ring], "one": [(5, -3, 2)]}


@pytest.mark.parametrize("flat", [False, True])
def test_kinds_of_random_neighbourhoods(flat):
    rng = random.Random(1)
    steps = topology._around(flat)[0]
    codes = [0, (1 << len(steps)) - 1] + [sum((rng.random() < s) << n for n in range(len(steps))) for s in (0.1, 0.3, 0.5, 0.7, 0.9) for _ in range(200)]
    first, second = topology.kinds(np.array(codes), flat)
    for c, a, b in zip(codes, first, second):
        front, back, _ = plain_kinds((0, 0, 0), {o for n, o in enumerate(steps) if c >> n & 1}, flat)
        assert (a, b) == (min(front, 2), min(back, 2))


def table(spark, rows):  # noqa: F811
    return spark.createDataFrame(rows, "x long, y long, z long")


@pytest.mark.parametrize(("name", "end", "widths"), [("noise", "curve", (11, 64)), ("two", "curve", (16,)), ("shell", "surface", (64,)), ("ring", "none", (64,)), ("one", "curve", (64,))])
def test_thinning_keeps_topology(spark, name, end, widths):  # noqa: F811
    places = shapes()[name]
    want = plain_thinned(places, end=end)
    assert counts(want) == counts(places)
    for width in widths:
        assert {tuple(r) for r in topology.thinned(table(spark, places), end=end, width=width).collect()} == want


def test_levels_anchors_and_planes(spark):  # noqa: F811
    places = shapes()["noise"]
    levels = {p: float((p[0] * 7 + p[1]) % 5) for p in places}
    rows = [(*p, levels[p], p == (4, 4, 3)) for p in places] + [(*places[0], 99.0, False)]  # a repeated voxel
    df = spark.createDataFrame(rows, "x long, y long, z long, level double, anchor boolean")
    got = {tuple(r) for r in topology.thinned(df, end="none", step=1.0, width=16).collect()}
    assert got == plain_thinned(places, {(4, 4, 3)} & set(places), "none", levels, 1.0)
    flat = {tuple(r) for r in topology.thinned(table(spark, places), flat=True, width=16).collect()}
    assert flat == {q for z in range(7) for q in plain_thinned([p for p in places if p[2] == z], flat=True)}
    assert topology.thinned(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="end condition"):
        topology.thinned(df, end="other")


def test_growing_keeps_topology(spark):  # noqa: F811
    whole = set(itertools.product(range(8), range(8), range(3)))
    ring = [p for p in itertools.product(range(2, 6), range(2, 6), (1,)) if not (3 <= p[0] <= 4 and 3 <= p[1] <= 4)]
    got = {width: {tuple(r) for r in topology.grown(table(spark, ring), table(spark, sorted(whole)), width=width).collect()} for width in (6, 64)}
    assert got[6] == got[64] and set(ring) < got[6] <= whole and counts(got[6]) == counts(ring)
    for p in whole - got[6]:
        assert plain_kinds(p, got[6])[:2] != (1, 1)


def plain_branches(places):
    places = set(places)
    near = {p: [q for o in NEAR if (q := tuple(a + b for a, b in zip(p, o))) in places] for p in places}
    group = {}

    def label(own):
        for p in sorted(own):
            if p not in group:
                todo, group[p] = [p], p
                while todo:
                    for q in near[todo.pop()]:
                        if q in own and q not in group:
                            group[q] = p
                            todo.append(q)

    junctions = {p for p in places if len(near[p]) >= 3}
    label(junctions)
    label(places - junctions)
    centre = {g: np.mean([p for p in junctions if group[p] == g], axis=0) for g in {group[p] for p in junctions}}
    out = {}
    for g in {group[p] for p in places - junctions}:
        own = [p for p in places - junctions if group[p] == g]
        length = sum(math.dist(p, q) for p in own for q in near[p] if q not in junctions and p < q)
        ends = sorted((p, j) for p in own for j in {group[q] for q in near[p] if q in junctions})
        out[g] = (len(own), round(length + sum(math.dist(p, centre[j]) for p, j in ends), 6), [j for _, j in ends])
    return out


def curves():
    star = [(k, 0, 0) for k in range(1, 9)] + [(-k, 0, 0) for k in range(1, 4)] + [(0, k, 0) for k in range(1, 6)] + [(0, 0, 0)]
    comb = [(k, 0, 0) for k in range(30)] + [(5 * j, k, 0) for j in range(1, 6) for k in range(1, 2 + j)] + [(12, -k, -k) for k in range(1, 4)]
    ring = [(50 + p[0], p[1], 0) for p in [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]]
    return star + [(x, y + 40, z) for x, y, z in comb] + ring + [(70, 0, 0), (72, 5, 5), (73, 6, 5)]


def test_branches(spark):  # noqa: F811
    places = curves()
    voxels, branches = topology.voxel_tree(table(spark, places))
    at = {(r.x, r.y, r.z): r for r in voxels.collect()}
    name = {r.part: p for p, r in sorted(at.items(), reverse=True)}
    got = {name[r.branch]: (r.n, round(r.length, 6), [name[j] for j in (r.first, r.last) if j is not None]) for r in branches.collect()}
    want = plain_branches(places)
    assert {k: (v[0], v[1], sorted(v[2])) for k, v in got.items()} == {k: (v[0], v[1], sorted(v[2])) for k, v in want.items()}
    kinds = [r.kind for r in branches.collect()]
    assert kinds.count("ring") == 1 and kinds.count("alone") == 2 and "inner" in kinds and "end" in kinds
    wide = topology.voxel_tree(table(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 1)]), (2.0, 1.0, 3.0))[1].collect()
    assert len(wide) == 1 and wide[0].length == pytest.approx(2 + math.sqrt(4 + 9))
    assert topology.voxel_tree(table(spark, []))[1].count() == 0
    lines = [r.line for r in topology.length_lines(branches).collect()]
    assert len(lines) == len(want) + 1 and "# label length" in lines


def plain_pruned(rows, shortest):
    """One end at a time. rows: branch -> (length, ends, anchor)."""
    rows = {b: (length, list(ends), anchor, {b}) for b, (length, ends, anchor) in rows.items()}
    while True:
        ends = sorted((length, b) for b, (length, e, anchor, _) in rows.items() if len(e) == 1 and not anchor and length < shortest)
        if not ends:
            return {b: (round(length, 6), len(e), members) for b, (length, e, _, members) in rows.items()}
        j = rows.pop(ends[0][1])[1][0]
        there = [b for b, r in rows.items() for e in r[1] if e == j]
        if len(there) == 1:
            rows[there[0]][1].remove(j)
        if len(there) == 2 and there[0] == there[1]:
            rows[there[0]][1].clear()
        elif len(there) == 2:
            a, b = sorted(there)
            (la, ea, aa, ma), (lb, eb, ab, mb) = rows.pop(a), rows.pop(b)
            ea.remove(j)
            eb.remove(j)
            rows[a] = (la + lb, ea + eb, aa or ab, ma | mb)


def test_pruning_equals_one_end_at_a_time(spark):  # noqa: F811
    rng = random.Random(11)
    for trial in range(2):
        n, rows = 15, {}
        for j in range(1, n):  # a random tree of junctions with ends, and a few loops
            rows[1000 + j] = (rng.choice((1.0, 2.0, 3.5, 0.5)), [j, rng.randrange(j)], rng.random() < 0.05)
        for j in range(n):
            degree = sum(e.count(j) for _, e, _ in rows.values())
            for k in range(max(0, 3 - degree) + (rng.random() < 0.2)):
                rows[2000 + 10 * j + k] = (rng.choice((0.5, 1.0, 2.0, 3.0, 6.0)), [j], rng.random() < 0.1)
        rows[9000], rows[9001] = (1.0, [], False), (2.0, [3, 3], False)
        df = spark.createDataFrame([(b, length, *(e + [None, None])[:2], a) for b, (length, e, a) in rows.items()], "branch long, length double, first long, last long, anchor boolean")
        for shortest in (5.0,):
            got = {}
            for r in topology.pruned(df, shortest).collect():
                got.setdefault((r.into, round(r.length, 6), (r.first is not None) + (r.last is not None)), set()).add(r.branch)
            assert {k[0]: (k[1], k[2], v) for k, v in got.items()} == plain_pruned(rows, shortest), (trial, shortest)


def test_the_queries(spark):  # noqa: F811
    from chronovox import catalog
    from chronovox.sources import tables

    sf = "/root/testdata/sf0.001"
    image = {(r.x, r.y, r.z) for r in tables.voxels(spark, sf).where("v >= 46").collect()}
    want = plain_thinned(image)
    assert counts(want)[:2] == counts(image)[:2]
    assert {tuple(r) for r in catalog.QUERIES["thinned_image"](spark, sf).select("x", "y", "z").collect()} == want
    number = lambda p: p[0] * 10**12 + p[1] * 10**6 + p[2]
    rows = {number(b): (length, [number(j) for j in ends], False) for b, (_, length, ends) in plain_branches(want).items()}
    got = {r.branch: r for r in catalog.QUERIES["skeleton_branches"](spark, sf).collect()}
    assert {b: round(r.length, 5) for b, r in got.items()} == {b: round(r[0], 5) for b, r in rows.items()}
    kept = {m for _, _, members in plain_pruned(rows, 3.0).values() for m in members}
    assert {b for b, r in got.items() if r.into is not None} == kept
