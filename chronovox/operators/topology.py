"""Digital topology: thinning and growing by simple points, and the trees of curves that thinning leaves.

Foreground voxels touch by faces, edges and corners, background ones by faces. A voxel is simple if it can change sides
without changing what is connected: its foreground neighbours form one component, and its background neighbours that
touch it by a face form one component among those that share a face or an edge with it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.operators import graphs
from chronovox.operators.bricks import in_bricks
from chronovox.operators.checkpoints import stored
from chronovox.operators.voxels import number


@lru_cache(2)
def _around(flat: bool) -> tuple[list[tuple[int, int, int]], list[int], list[int], int, int]:
    """The neighbours' offsets; for each the set of neighbours that it touches as foreground, and as background; the
    background's domain; and the neighbours across a face, as bit sets."""
    offsets = [(i, j, k) for k in ((0,) if flat else (-1, 0, 1)) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    gap = lambda a, b: [abs(p - q) for p, q in zip(a, b, strict=True)]
    near = lambda a, f: sum(1 << n for n, b in enumerate(offsets) if a != b and f(gap(a, b)))
    faces = sum(1 << n for n, o in enumerate(offsets) if sum(map(abs, o)) == 1)
    domain = sum(1 << n for n, o in enumerate(offsets) if sum(map(abs, o)) <= 2)
    return offsets, [near(a, lambda g: max(g) == 1) for a in offsets], [near(a, lambda g: sum(g) == 1) for a in offsets], domain, faces


def _covered(inside: np.ndarray, seeds: np.ndarray, touch: list[int]) -> np.ndarray:
    """Whether steps inside a set of neighbours lead from its first seed to all seeds; bit sets in, bools out."""
    reach = seeds & -seeds
    while True:
        grown = reach.copy()
        for n, t in enumerate(touch):
            grown |= np.where(reach >> n & 1, t, 0)
        grown &= inside
        grown |= reach
        if (grown == reach).all():
            return (seeds & ~reach) == 0
        reach = grown


def kinds(codes: np.ndarray, flat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of components of the foreground neighbours, and of the background ones at a face: 0, 1, or 2 for more. A code
    has a bit for each foreground neighbour."""
    _, front, back, domain, faces = _around(flat)
    codes, where = np.unique(codes.astype(np.int64), return_inverse=True)
    holes = ~codes & domain
    first = np.where(codes == 0, 0, np.where(_covered(codes, codes, front), 1, 2))
    second = np.where(holes & faces == 0, 0, np.where(_covered(holes, holes & faces, back), 1, 2))
    return first[where], second[where]


def sweep(state: np.ndarray, free: np.ndarray, ready: np.ndarray, low: tuple[int, int, int], end: str, flat: bool, grow: bool) -> None:
    """One pass over the eight (or four) classes of places by even and odd coordinates: voxels of a class don't touch, so all
    simple ones change together. state: foreground; free: may change; ready: may change in this pass; all with a rim of one
    voxel. low: the place of the arrays' first voxel."""
    offsets = _around(flat)[0]
    for odd in range(4 if flat else 8):
        at = np.nonzero(ready & free & (state != grow))
        own = np.ones(len(at[0]), bool)
        for axis in range(2 if flat else 3):
            own &= (at[axis] + low[axis]) % 2 == (odd >> axis & 1)
        at = tuple(a[own] for a in at)
        if not len(at[0]):
            continue
        codes = np.zeros(len(at[0]), np.int64)
        for n, o in enumerate(offsets):
            codes |= state[tuple(a + s for a, s in zip(at, o, strict=True))].astype(np.int64) << n
        front, back = kinds(codes, flat)
        simple = (front == 1) & (back == 1)
        if end != "none" and not grow:
            last = simple & (codes & (codes - 1) == 0) if end == "curve" else np.zeros(len(simple), bool)
            stays = last | ~simple & ((front == 2) if end == "curve" else (back == 2))
            free[tuple(a[stays] for a in at)] = False
            simple &= ~last
        state[tuple(a[simple] for a in at)] = grow


def _passes(state: np.ndarray, free: np.ndarray, level: np.ndarray, low, first: float, step: float | None, n: int, end: str, flat: bool, grow: bool) -> None:
    """n passes; in each those voxels are ready whose level the pass has reached or, without levels, that have a neighbour
    of the other side across a face when it begins."""
    for k in range(n):
        if step is None:
            ready = np.zeros(state.shape, bool)
            for axis in range(2 if flat else 3):
                for way in (1, -1):
                    ready |= np.roll(state, way, axis) == grow
        else:
            ready = level <= first + k * step
        sweep(state, free, ready, low, end, flat, grow)


def _changed(image: DataFrame, grow: bool, end: str, step: float | None, flat: bool, passes: int, width: int) -> DataFrame:
    """image: x, y, z, state, free, level. A pass looks one voxel far for each class, and one for the rim."""
    halo = passes * ((4 if flat else 8) + 1)
    image = stored(image)
    start = image.agg(F.min(F.when(F.col("level") > float("-inf"), F.col("level"))).alias("a"), F.max("level").alias("b"), F.count(F.lit(1)).alias("n")).collect()[0]
    reached, most, n = start["a"] or 0.0, start["b"], start["n"]

    def run(rows: pd.DataFrame, first: float) -> pd.DataFrame:
        core = [int(rows[f"b{c}"].iloc[0]) * width for c in "xyz"]
        place = rows[["x", "y", "z"]].to_numpy()
        low, high = place.min(0) - 1, place.max(0) + 2
        at = tuple((place - low).T)
        state, free, level = np.zeros(high - low, bool), np.zeros(high - low, bool), np.full(high - low, np.inf)
        state[at], free[at], level[at] = rows["state"], rows["free"], rows["level"]
        before = state[at].copy()
        _passes(state, free, level, low, first, step, passes, end, flat, grow)
        inside = np.all([(place[:, k] >= core[k]) & (place[:, k] < core[k] + width) for k in range(3)], axis=0)
        out = rows[["x", "y", "z", "level"]].assign(state=state[at], free=free[at], moved=state[at] != before)
        return out[inside & (state[at] | grow)]

    def begun(first: float):
        return lambda rows: run(rows, first)

    while True:
        now = float(reached)
        bricks = in_bricks(image.select("x", "y", "z", "state", "free", "level"), width, halo)
        image = stored(bricks.groupBy("bx", "by", "bz").applyInPandas(begun(now), "x long, y long, z long, level double, state boolean, free boolean, moved boolean"))
        found = image.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("moved").cast("int")).alias("moved")).collect()[0]
        quiet = not found["moved"] if grow else found["n"] == n
        n = found["n"]
        if step is not None:
            reached += passes * step
        if quiet and (step is None or most is None or now + (passes - 1) * step >= most):
            return image


def thinned(image: DataFrame, end: str = "curve", step: float | None = None, flat: bool = False, passes: int = 2, width: int = 64) -> DataFrame:
    """x, y, z of what is left of an image's voxels (x, y, z; optionally anchor, boolean, and level) when no simple voxel can
    go: components, holes and cavities stay.

    `end`: "curve" keeps ends of curves and voxels that alone hold parts together, "surface" those that alone hold background
    apart, "none" neither. `anchor` voxels stay. Voxels go in the order of `level`, such as a distance or a value, `step`
    a pass; without `step` layer by layer from outside. flat: z is no dimension, each plane is thinned for itself.

    Bricks of `width` voxels and a halo make `passes` passes a job, with the same result for any width: a job reads and
    writes what is left of the image, jobs grow with its thickness, and a task holds a brick. Repeated voxels count once, and
    anchors and lower levels prevail; no voxels, no voxels. Nulls in x, y or z are an error; a null level is the least."""
    rows = _prepared(image, flat, step)
    return _changed(rows.withColumn("state", F.lit(True)), False, _known(end), step, flat, passes, width).select("x", "y", "z")


def grown(image: DataFrame, into: DataFrame, step: float | None = None, flat: bool = False, passes: int = 2, width: int = 64) -> DataFrame:
    """x, y, z of an image that grew over voxels of `into` (x, y, z; optionally level) as far as simple ones go: components,
    holes and cavities stay. Otherwise like thinned()."""
    seeds = image.select("x", "y", "z").distinct().withColumns({"state": F.lit(True), "free": F.lit(False), "level": F.lit(float("-inf"))})
    rest = _prepared(into, flat, step).join(seeds.select("x", "y", "z"), ["x", "y", "z"], "left_anti").withColumn("state", F.lit(False))
    whole = _changed(seeds.unionByName(rest.select(*seeds.columns)), True, "none", step, flat, passes, width)
    return whole.where("state").select("x", "y", "z")


def _known(end: str) -> str:
    if end not in ("curve", "surface", "none"):
        raise ValueError(f"unknown end condition: {end}")
    return end


def _prepared(image: DataFrame, flat: bool, step: float | None) -> DataFrame:
    if step is not None and ("level" not in image.columns or step <= 0):
        raise ValueError("steps need a column of levels, and are positive")
    anchor = F.coalesce(F.col("anchor"), F.lit(False)) if "anchor" in image.columns else F.lit(False)
    level = F.coalesce(F.col("level").cast("double"), F.lit(float("-inf"))) if step is not None else F.lit(0.0)
    return image.groupBy(*[F.col(c).cast("long").alias(c) for c in "xyz"]).agg((~F.max(anchor)).alias("free"), F.min(level).alias("level"))


# Trees of curves.

def _pairs(voxels: DataFrame) -> DataFrame:
    """a, b (numbers), and both places: voxels that touch by a face, an edge or a corner, each pair once."""
    ahead = [o for o in _around(False)[0] if o > (0, 0, 0)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", o, strict=True)]) for o in ahead]))
    moved = voxels.withColumn("o", steps).select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"])
    return moved.join(voxels, ["x", "y", "z"]).select("a", F.col("id").alias("b"), "ax", "ay", "az", *[F.col(c).alias(f"b{c}") for c in "xyz"])


def voxel_tree(skeleton: DataFrame, size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(voxels, branches) of a skeleton (x, y, z; optionally anchor).

    voxels: x, y, z, kind, part. Voxels with three neighbours or more are of kind `junction`, others of kind `branch`; voxels of
    a kind that touch form a part, named by its least voxel number. branches: branch, n, length, first, last, kind, anchor. A
    branch is as long as the steps between its voxels and those from its ends to the centres of the junctions there (`first`
    and `last`, null where it ends freely). kind: `inner` between junctions, `end` with one free end, `alone` with two,
    `ring` closed. Parts are found by contraction, in rounds that grow with the logarithm of the voxels."""
    anchor = F.coalesce(F.col("anchor"), F.lit(False)) if "anchor" in skeleton.columns else F.lit(False)
    own = stored(skeleton.groupBy(*[F.col(c).cast("long").alias(c) for c in "xyz"]).agg(F.max(anchor).alias("anchor")).withColumn("id", number()))
    pairs = stored(_pairs(own.select("x", "y", "z", "id")))
    many = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg((F.count(F.lit(1)) >= 3).alias("many"))
    kind = own.join(many, "id", "left").select("id", "x", "y", "z", "anchor", F.coalesce("many", F.lit(False)).alias("many"))
    side = lambda c: kind.select(F.col("id").alias(c), F.col("many").alias(f"{c}_many"))
    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b"))
    part = graphs.named_by_least(pairs.where("a_many = b_many").select("a", "b"))
    voxels = stored(kind.join(part.withColumnRenamed("node", "id"), "id", "left").select("id", "x", "y", "z", "anchor", "many", F.coalesce("component", "id").alias("part")))
    far = lambda p, q: F.sqrt(sum(F.pow((F.col(f"{p}{c}") - F.col(f"{q}{c}")) * s, 2) for c, s in zip("xyz", size, strict=True)))
    of = lambda c, n: voxels.select(F.col("id").alias(c), F.col("part").alias(n))
    steps = pairs.where("NOT a_many AND NOT b_many").select("a", far("a", "b").alias("s")).join(of("a", "branch"), "a").groupBy("branch").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("links"))
    centre = voxels.where("many").groupBy(F.col("part").alias("junction")).agg(*[F.avg(c).alias(f"j{c}") for c in "xyz"])
    meet = pairs.where("a_many <> b_many").select(F.when(F.col("a_many"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("a_many"), F.col("a")).otherwise(F.col("b")).alias("j"))
    meet = meet.join(of("j", "junction"), "j").select("id", "junction").distinct()
    meet = meet.join(voxels.select("id", F.col("part").alias("branch"), *[F.col(c).alias(f"v{c}") for c in "xyz"]), "id").join(centre, "junction").select("branch", "junction", "id", far("v", "j").alias("s"))
    ends = meet.groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("id", "junction"))).alias("ends"), F.sum("s").alias("reach"))
    base = voxels.where("NOT many").groupBy(F.col("part").alias("branch")).agg(F.count(F.lit(1)).alias("n"), F.max("anchor").alias("anchor"))
    met = F.coalesce(F.size("ends"), F.lit(0))
    what = F.when(met >= 2, "inner").when(met == 1, "end").when(F.col("links") == F.col("n"), "ring").otherwise("alone")
    branches = base.join(steps, "branch", "left").join(ends, "branch", "left").select(
        "branch", "n", (F.coalesce("s", F.lit(0.0)) + F.coalesce("reach", F.lit(0.0))).alias("length"), F.get("ends", F.lit(0))["junction"].alias("first"), F.get("ends", F.lit(1))["junction"].alias("last"), what.alias("kind"), "anchor")
    return voxels.select("x", "y", "z", F.when(F.col("many"), "junction").otherwise("branch").alias("kind"), "part"), stored(branches)


def pruned(branches: DataFrame, shortest: float) -> DataFrame:
    """branch, into: the branches of a tree that stay when ends shorter than `shortest` go, the shortest first (ties: least
    number), and the one that each has become part of: where two branches are left at a junction, they become one, as long as
    both, named by the lesser. length, first, last: those of `into`. Branches with an anchor stay.

    What is shortest at its own junction and at those one branch further is what going one by one would take next there, so
    all these go in one round; rounds follow chains of ever longer ends."""
    rows = stored(branches.select("branch", F.col("branch").alias("into"), "length", "first", "last", "anchor"))
    key = F.struct("length", "into")
    while True:
        whole = rows.select("into", "length", "first", "last", "anchor").distinct()
        ends = whole.where("NOT anchor AND length < {0} AND first IS NOT NULL AND last IS NULL".format(float(shortest)))
        least = stored(ends.groupBy(F.col("first").alias("j")).agg(F.min(key).alias("k")))
        inner = whole.where("first IS NOT NULL AND last IS NOT NULL AND first <> last")
        links = inner.select(F.col("first").alias("j"), F.col("last").alias("o")).union(inner.select("last", "first"))
        beside = links.join(least.select(F.col("j").alias("o"), F.col("k").alias("other")), "o").groupBy("j").agg(F.min("other").alias("other"))
        go = stored(least.join(beside, "j", "left").where("other IS NULL OR k < other").select("j", F.col("k.into").alias("gone")))
        if go.isEmpty():
            return rows.select("branch", "into", "length", "first", "last")
        left = whole.join(go.select(F.col("gone").alias("into")), "into", "left_anti")
        at = left.select("into", "length", "first", "last", "anchor", F.explode(F.array_compact(F.array("first", "last"))).alias("j")).join(go.select("j"), "j")
        there = at.groupBy("j").agg(F.collect_list(F.struct("into", "length", "first", "last", "anchor")).alias("b"), F.count(F.lit(1)).alias("n")).where("n <= 2")
        other = lambda b: F.when(b["first"] == F.col("j"), b["last"]).otherwise(b["first"])
        p, q = F.get("b", F.lit(0)), F.get("b", F.lit(1))
        ring = F.col("n") == 2
        merged = there.select("b", F.when(ring & (p["into"] != q["into"]), F.struct(
            F.least(p["into"], q["into"]).alias("into"), (p["length"] + q["length"]).alias("length"), F.coalesce(other(p), other(q)).alias("first"),
            F.when(other(p).isNotNull(), other(q)).alias("last"), (p["anchor"] | q["anchor"]).alias("anchor"))).otherwise(F.struct(
                p["into"].alias("into"), p["length"].alias("length"), F.when(~ring, other(p)).alias("first"), F.lit(None).cast("long").alias("last"), p["anchor"].alias("anchor"))).alias("m"))
        renamed = merged.select(F.explode("b.into").alias("into"), "m").distinct()
        kept = rows.join(go.select(F.col("gone").alias("into")), "into", "left_anti").join(renamed, "into", "left")
        rows = stored(kept.select("branch", *[F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("into", "length", "first", "last", "anchor")]))


def length_lines(branches: DataFrame, full: bool = True) -> DataFrame:
    """branch, line: a text line for each branch, its number and length, or its length alone; the head line has number null."""
    line = F.format_string("%3d %f", "branch", "length") if full else F.format_string("%f", "length")
    rows = branches.select("branch", line.alias("line"))
    return rows.unionByName(rows.sparkSession.createDataFrame([(None, "# label length")], "branch long, line string")) if full else rows


