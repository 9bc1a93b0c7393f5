"""Reconstruction, watersheds, influence zones, parcels and label images against plain loops, with bricks of several widths."""

import heapq
import itertools
import math
import random

import pytest
from test_catalog import spark  # noqa: F401

from chronovox.operators import flooding

FACES, CHAMFER = flooding.FACES, flooding.CHAMFER


def beside(p, o):
    return tuple(a + b for a, b in zip(p, o))


def frame(spark, rows, last="v", kind="double"):  # noqa: F811
    return spark.createDataFrame([(*p, float(v) if kind == "double" else v) for p, v in rows.items()], f"x long, y long, z long, {last} {kind}")


def values(df, name="v"):
    return {(r.x, r.y, r.z): r[name] for r in df.collect()}


@pytest.fixture(scope="module")
def image():
    rng = random.Random(4)
    return {p: rng.randrange(5) for p in itertools.product(range(-3, 8), range(7), range(5)) if rng.random() < 0.85}


def plain_reconstructed(marker, mask):
    level = {p: min(v, mask[p]) for p, v in marker.items() if p in mask}
    heap = [(-v, p) for p, v in level.items()]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        for o in FACES:
            q = beside(p, o)
            if q in mask and min(-v, mask[q]) > level.get(q, -math.inf):
                level[q] = min(-v, mask[q])
                heapq.heappush(heap, (-level[q], q))
    return level


def plain_watershed(image, markers, most=False):
    """Level by level: the voxels that wait at a level get labels at once, from the neighbours labelled before."""
    labels = {p: k for p, k in markers.items() if p in image}
    waiting = {}
    queued = set(labels)

    def push(p, now):
        for o in FACES:
            q = beside(p, o)
            if q in image and q not in queued:
                queued.add(q)
                waiting.setdefault(max(image[q], now), []).append(q)

    for p in list(labels):
        push(p, -math.inf)
    while waiting:
        now = min(waiting)
        group = waiting.pop(now)
        found = {}
        for q in group:
            near = [labels[beside(q, o)] for o in FACES if beside(q, o) in labels]
            found[q] = min(set(near), key=lambda k: (-near.count(k) if most else 0, k))
        labels |= found
        for q in group:
            push(q, now)
    return labels


def plain_influence(image, seeds):
    best = {p: 0 for p in seeds if p in image}
    heap = [(0, p) for p in best]
    heapq.heapify(heap)
    order = []
    while heap:
        d, p = heapq.heappop(heap)
        if d > best[p]:
            continue
        order.append(p)
        for o, w in CHAMFER.items():
            q = beside(p, o)
            if q in image and d + w < best.get(q, math.inf):
                best[q] = d + w
                heapq.heappush(heap, (d + w, q))
    label = {}
    for p in order:
        if p not in label:
            label[p] = seeds[p] if best[p] == 0 else min(label[beside(p, o)] for o, w in CHAMFER.items() if best.get(beside(p, o), math.inf) + w == best[p])
    return label, best


@pytest.mark.parametrize("width", [5])
def test_reconstruction(spark, image, width):  # noqa: F811
    marker = {p: image[p] - 2 for p in list(image)[::9]} | {p: 99 for p in list(image)[5:7]}
    got = values(flooding.reconstructed(frame(spark, marker), frame(spark, image), width=width))
    assert got == plain_reconstructed(marker, image)
    tops = values(flooding.h_maxima(frame(spark, image), 2, width=width))
    base = plain_reconstructed({p: v - 2 for p, v in image.items()}, image)
    assert tops == {p: image[p] - base[p] for p in image if image[p] > base[p]} and set(tops.values()) == {1.0, 2.0}


@pytest.mark.parametrize("width, choice", [(4, "least"), (6, "most"), (32, "least")])
def test_watershed(spark, image, width, choice):  # noqa: F811
    places = sorted(image)
    markers = {places[10]: 7, places[11]: 7, places[150]: -3, places[200]: 5, places[290]: 1, (50, 0, 0): 9}
    got = values(flooding.watershed(frame(spark, image), frame(spark, markers, "label", "long"), choice, width), "label")
    assert got == plain_watershed(image, markers, choice == "most") and len(set(got.values())) > 2


def test_flat_image_from_several_sides(spark):  # noqa: F811
    image = {(x, y, 0): 1 for x in range(9) for y in range(3)}
    got = values(flooding.watershed(frame(spark, image), frame(spark, {(0, 1, 0): 2, (8, 1, 0): 1}, "label", "long"), width=4), "label")
    assert [got[x, 1, 0] for x in range(9)] == [2, 2, 2, 2, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("width", [5, 32])
def test_influence(spark, image, width):  # noqa: F811
    places = sorted(image)
    seeds = {places[3]: 4, places[100]: 2, places[250]: 9, places[251]: 1}
    label, d = plain_influence(image, seeds)
    rows = flooding.influence(frame(spark, image), frame(spark, seeds, "label", "long"), width=width)
    assert values(rows, "label") == label and values(rows, "d") == d
    assert values(flooding.distances(frame(spark, image), frame(spark, seeds), width=width), "d") == d


def test_parcels(spark, image):  # noqa: F811
    places = sorted(image)
    seeds = {places[0]: 1, places[1]: 2, places[2]: 3}
    found, last = flooding.parcels(frame(spark, image), frame(spark, seeds, "label", "long"))
    now, before = dict(seeds), None
    while True:
        label, _ = plain_influence(image, now)
        new = {}
        for k in set(label.values()):
            own = [p for p in label if label[p] == k]
            mean = [sum(p[c] for p in own) / len(own) for c in range(3)]
            new[min(own, key=lambda p: (round(sum((p[c] - mean[c]) ** 2 for c in range(3)), 9), p))] = k
        if new in (now, before):
            break
        now, before = new, now
    assert values(found, "label") == label and values(last, "label") == now
    once, _ = flooding.parcels(frame(spark, image), frame(spark, seeds, "label", "long"), rounds=0)
    assert values(once, "label") == plain_influence(image, seeds)[0]


@pytest.mark.parametrize("share, width", [(0.4, 7), (1.0, 32)])
def test_labels_between(spark, share, width):  # noqa: F811
    ball = lambda m, r: {p for p in itertools.product(range(14), range(9), range(8)) if sum((a - b) ** 2 for a, b in zip(p, m)) <= r * r}
    a = {p: 5 for p in ball((3, 4, 4), 2.5)} | {p: 6 for p in ball((10, 4, 4), 2)}
    b = {p: 1 for p in ball((5, 4, 4), 3)} | {p: 2 for p in ball((10, 5, 3), 1.5)} | {p: 3 for p in ball((12, 1, 1), 1)}
    couples = [(1, 5, 1), (2, 6, 2), (2, 6, 3), (3, 5, 99)]
    got = values(flooding.labels_between(frame(spark, a), frame(spark, b), spark.createDataFrame(couples, "g long, l long, r long"), share, width=width))
    depth = {}
    for g in (1, 2):
        own = [{p for p, v in image.items() if v in {c[k] for c in couples if c[0] == g}} for image, k in ((a, 1), (b, 2))]
        low, high = [min(p[c] for p in own[0] | own[1]) - 1 for c in range(3)], [max(p[c] for p in own[0] | own[1]) + 2 for c in range(3)]
        space = set(itertools.product(*[range(u, w) for u, w in zip(low, high)]))
        signed = []
        for inside in own:
            _, out = plain_influence(space, dict.fromkeys(inside, 0))
            _, into = plain_influence(space, dict.fromkeys(space - inside, 0))
            signed.append({p: out[p] - into[p] for p in space})
        for p in space:
            s = (1 - share) * signed[0][p] + share * signed[1][p]
            if s < -1e-9:
                depth[p] = min(depth.get(p, (0.0, 0)), (round(s, 9), g))
    assert got == {p: g for p, (_, g) in depth.items()}
    if share in (0.0, 1.0):
        assert set(got) == (set(a) if share == 0 else set(b))


def test_odd_images(spark):  # noqa: F811
    none = frame(spark, {(0, 0, 0): 1}).where("x > 0")
    marks = frame(spark, {(0, 0, 0): 1}, "label", "long")
    assert flooding.watershed(none, marks).isEmpty() and flooding.influence(none, marks).isEmpty() and flooding.h_maxima(none, 1).isEmpty()
    rows = spark.createDataFrame([(0, 0, 0, 1.0, "a"), (0, 0, 0, 3.0, "b"), (1, 0, 0, None, "c"), (2, 0, 0, float("nan"), "d"), (3, 0, 0, 2.0, "e")], "x long, y long, z long, v double, label string")
    marks = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 0, 1), (3, 0, 0, None)], "x long, y long, z long, label long")
    assert values(flooding.watershed(rows, marks), "label") == {(0, 0, 0): 1}
    assert values(flooding.reconstructed(rows, rows)) == {(0, 0, 0): 3.0, (3, 0, 0): 2.0}
    with pytest.raises(ValueError):
        flooding.watershed(rows, marks, "first")
    with pytest.raises(ValueError):
        flooding.h_maxima(rows, 0)
