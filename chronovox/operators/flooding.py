"""Values that spread from voxel to voxel until nothing changes: reconstruction under a mask, extrema of some height,
watersheds from markers, zones of influence, parcels, and signed distances between label images.

Images are cut into bricks with a halo. A job sweeps each brick until it is quiet, and the next one looks again only at
bricks that hold or touch a voxel that changed: jobs grow with the bricks that a way crosses, not with its voxels. A task
holds one brick. Results don't depend on the width of the bricks. Voxels without a value (null or NaN) are not there;
places must not be null; of repeated voxels the greatest value counts; no voxels, no voxels."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.operators.bricks import in_bricks
from chronovox.operators.checkpoints import stored

PLACE = ["x", "y", "z"]
KEY = ["g", *PLACE]
BRICK = ["g", "bx", "by", "bz"]
FACES = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
AROUND = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
#: Steps of voxels that nothing has reached; beyond any way.
_FAR = 2**62

#: Chamfer lengths 3, 4, 5 of steps along one, two, three axes.
CHAMFER = {o: {1: 3, 2: 4, 3: 5}[sum(map(abs, o))] for o in AROUND}

Arrays = dict[str, np.ndarray]


def _beside(a: np.ndarray, o: tuple[int, int, int], r: int) -> np.ndarray:
    """The values at place + o for the places inside a rim of r voxels."""
    return a[tuple(slice(r + d, n - r + d) for d, n in zip(o, a.shape, strict=True))]


def _settled(image: DataFrame, state: Arrays, sweep: Callable[[Arrays, np.ndarray, int], None], width: int, reach: int = 1) -> DataFrame:
    """image (g, x, y, z, further columns) when no sweep changes a column of `state` (name: value where no voxel is). sweep
    gets the columns as arrays, the places that it may change, and the width of the arrays' rim; images of other g don't
    touch each other."""
    cols = [c for c in image.columns if c not in KEY]
    kinds = {f.name: f.dataType.simpleString() for f in image.schema.fields}
    empty = {c: state.get(c, {"double": np.nan, "bigint": 0, "boolean": False}[kinds[c]]) for c in cols}
    dtype = {c: {"double": np.float64, "bigint": np.int64, "boolean": np.bool_}[kinds[c]] for c in cols}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        core = np.array([int(rows[f"b{c}"].iloc[0]) * width for c in PLACE])
        place = rows[PLACE].to_numpy()
        low, high = place.min(0) - reach, place.max(0) + reach + 1
        at = tuple((place - low).T)
        arrays = {c: np.full(high - low, empty[c], dtype[c]) for c in cols}
        inside = ((place >= core) & (place < core + width)).all(1)
        own = np.zeros(high - low, bool)
        own[at] = inside
        for c in cols:
            arrays[c][at] = rows[c].to_numpy()
        before = {c: arrays[c][at].copy() for c in state}
        sweep(arrays, own, reach)
        moved = inside & np.any([arrays[c][at] != before[c] for c in state], axis=0)
        return rows.loc[moved, KEY].assign(**{f"new_{c}": arrays[c][at][moved] for c in state})

    shape = ", ".join([*[f"{c} long" for c in KEY], *[f"new_{c} {kinds[c]}" for c in state]])
    now = stored(image)
    bricks = in_bricks(now, width, reach)
    while True:
        found = stored(bricks.groupBy(*BRICK).applyInPandas(run, shape))
        if found.isEmpty():
            return now
        now = stored(now.join(found, KEY, "left").select(*KEY, *[F.coalesce(f"new_{c}", c).alias(c) if c in state else F.col(c) for c in cols]))
        near = in_bricks(found.select(*KEY), width, reach).select(*BRICK).distinct()
        bricks = in_bricks(now, width, reach).join(near, BRICK, "left_semi")


def _voxels(image: DataFrame, *more: Column) -> DataFrame:
    """g, x, y, z, v and further aggregates of the voxels that have a value."""
    v = F.col("v").cast("double")
    g = F.col("g").cast("long") if "g" in image.columns else F.lit(0).cast("long")
    return image.where(v.isNotNull() & ~F.isnan(v)).groupBy(g.alias("g"), *[F.col(c).cast("long").alias(c) for c in PLACE]).agg(F.max(v).alias("v"), *more)


def _raised(offsets: list) -> Callable[[Arrays, np.ndarray, int], None]:
    def sweep(a: Arrays, own: np.ndarray, r: int) -> None:
        level, most, free = a["level"], _beside(a["v"], (0, 0, 0), r), _beside(own, (0, 0, 0), r)
        while True:
            here = _beside(level, (0, 0, 0), r)
            best = np.maximum.reduce([here, *[_beside(level, o, r) for o in offsets]])
            best = np.where(free, np.maximum(here, np.minimum(best, most)), here)
            if (best == here).all():
                return
            here[...] = best

    return sweep


def reconstructed(marker: DataFrame, mask: DataFrame, offsets: list = FACES, width: int = 32) -> DataFrame:
    """x, y, z, v: the greatest image between the marker and the mask that spreads from the marker: a voxel takes the
    greatest value that a way within the mask's voxels brings, never more than the mask's. Marker values above the mask's
    are cut down to it; voxels of the mask that the marker doesn't reach are left out."""
    seeds = _voxels(marker).withColumnRenamed("v", "level")
    start = _voxels(mask).join(seeds, KEY, "left").withColumn("level", F.when(F.col("level").isNull(), float("-inf")).otherwise(F.least("level", "v")))
    out = _settled(start, {"level": -np.inf}, _raised(offsets), width)
    return out.where(F.col("level") > float("-inf")).select(*PLACE, F.col("level").alias("v"))


def h_maxima(image: DataFrame, height: float, multiplier: float = 1.0, offsets: list = FACES, width: int = 32) -> DataFrame:
    """x, y, z, v: how far each voxel stands above the image reconstructed from multiplier * v - height; only voxels that do.
    With multiplier 1, the tops of maxima that rise by `height` or more over every pass to a higher one stand out by
    `height`, lower maxima by what they rise. Minima: pass the image of -v."""
    if not (height > 0 or multiplier < 1):
        raise ValueError("a height is positive")
    own = stored(_voxels(image))
    base = reconstructed(own.withColumn("v", F.col("v") * multiplier - height), own, offsets, width).withColumnRenamed("v", "u")
    return own.drop("g").join(base, PLACE).select(*PLACE, (F.col("v") - F.col("u")).alias("v")).where("v > 0")


def _flooded(offsets: list) -> Callable[[Arrays, np.ndarray, int], None]:
    """Least (level, step) by which a voxel is reached: the greatest value on the way, and the steps since that level was
    met. Markers have level -inf."""

    def sweep(a: Arrays, own: np.ndarray, r: int) -> None:
        v, free = _beside(a["v"], (0, 0, 0), r), _beside(own & ~a["marker"], (0, 0, 0), r)
        level, step = (_beside(a[c], (0, 0, 0), r) for c in ("level", "step"))
        while True:
            low, few = level.copy(), step.copy()
            for o in offsets:
                near, far = _beside(a["level"], o, r), _beside(a["step"], o, r)
                to = np.maximum(near, v)
                count = np.where(v > near, 0, np.minimum(far + 1, _FAR))
                better = free & ((to < low) | ((to == low) & (count < few)))
                low, few = np.where(better, to, low), np.where(better, count, few)
            if (low == level).all() and (few == step).all():
                return
            level[...], step[...] = low, few

    return sweep


def _chosen(labels: list[np.ndarray], there: list[np.ndarray], most: bool) -> np.ndarray:
    """For each voxel the least label among those that are there, or the most frequent of them, ties to the least."""
    top = np.iinfo(np.int64).max
    if not most:
        return np.minimum.reduce([np.where(t, x, top) for x, t in zip(labels, there, strict=True)])
    best, count = np.full(labels[0].shape, top), np.zeros(labels[0].shape, np.int64)
    for x, t in zip(labels, there, strict=True):
        n = np.where(t, sum((u & (y == x)).astype(np.int64) for y, u in zip(labels, there, strict=True)), 0)
        better = (n > count) | ((n == count) & t & (x < best))
        best, count = np.where(better, x, best), np.where(better, n, count)
    return best


def _named(offsets: list, leads: Callable[[Arrays, tuple, int], np.ndarray], most: bool = False) -> Callable[[Arrays, np.ndarray, int], None]:
    """A voxel gets its label once all neighbours that lead to it on a best way have theirs."""

    def sweep(a: Arrays, own: np.ndarray, r: int) -> None:
        free = _beside(own, (0, 0, 0), r)
        before = [leads(a, o, r) & free for o in offsets]
        some = np.logical_or.reduce(before)
        label, named = (_beside(a[c], (0, 0, 0), r) for c in ("label", "named"))
        while True:
            known = [_beside(a["named"], o, r) for o in offsets]
            waits = np.logical_or.reduce([b & ~k for b, k in zip(before, known, strict=True)])
            now = some & ~named & ~waits
            if not now.any():
                return
            label[now] = _chosen([_beside(a["label"], o, r)[now] for o in offsets], [b[now] for b in before], most)
            named[now] = True

    return sweep


def _over(a: Arrays, o: tuple, r: int) -> np.ndarray:
    """Where the neighbour at o floods a voxel at the level and step that it has."""
    v, near, far = _beside(a["v"], (0, 0, 0), r), _beside(a["level"], o, r), _beside(a["step"], o, r)
    level, step = _beside(a["level"], (0, 0, 0), r), _beside(a["step"], (0, 0, 0), r)
    return (level < np.inf) & ~_beside(a["marker"], (0, 0, 0), r) & (np.maximum(near, v) == level) & (np.where(v > near, 0, far + 1) == step)


def watershed(image: DataFrame, markers: DataFrame, choice: str = "least", width: int = 32) -> DataFrame:
    """x, y, z, label: an image (x, y, z, v), such as a gradient, flooded from markers (x, y, z, label) by rising levels.

    A voxel is reached over the way whose greatest value is least, and among these by the fewest steps since that value was
    met, as if water rose level by level and crossed plateaus voxel by voxel from all sides at once. Of the labels of the
    neighbours by a face that reach it like this, "least" takes the least and "most" the one most of them have (ties: the
    least); there are no lines between basins. Markers outside the image and null labels don't count, the least of several
    at a voxel does; voxels that no marker reaches are left out."""
    if choice not in ("least", "most"):
        raise ValueError(f"unknown choice: {choice}")
    seeds = markers.where("label IS NOT NULL").groupBy(*[F.col(c).cast("long").alias(c) for c in PLACE]).agg(F.min(F.col("label").cast("long")).alias("label"))
    start = _voxels(image).join(seeds, PLACE, "left").withColumn("marker", F.col("label").isNotNull())
    start = start.select(*KEY, "v", "marker", F.when(F.col("marker"), float("-inf")).otherwise(float("inf")).alias("level"),
                         F.when(F.col("marker"), F.lit(0)).otherwise(F.lit(_FAR)).cast("long").alias("step"), F.coalesce("label", F.lit(0).cast("long")).alias("label"))
    flood = _settled(start, {"level": np.inf, "step": _FAR}, _flooded(FACES), width)
    named = _settled(flood.withColumn("named", F.col("marker")), {"label": 0, "named": False}, _named(FACES, _over, choice == "most"), width)
    return named.where("named").select(*PLACE, "label")


def _nearer(steps: dict) -> Callable[[Arrays, np.ndarray, int], None]:
    def sweep(a: Arrays, own: np.ndarray, r: int) -> None:
        d, free = _beside(a["d"], (0, 0, 0), r), _beside(own, (0, 0, 0), r)
        while True:
            best = np.where(free, np.minimum.reduce([d, *[_beside(a["d"], o, r) + w for o, w in steps.items()]]), d)
            if (best == d).all():
                return
            d[...] = best

    return sweep


def _measured(image: DataFrame, sources: DataFrame, steps: dict, width: int) -> tuple[DataFrame, int]:
    """image (g, x, y, z) with label of the sources (g, x, y, z, label) and d, inf where none is reached; and the reach."""
    if min(steps.values(), default=0) <= 0 or (0, 0, 0) in steps:
        raise ValueError("steps lead elsewhere, by positive lengths")
    reach = max(max(map(abs, o)) for o in steps)
    start = image.join(sources, KEY, "left").withColumn("d", F.when(F.col("label").isNotNull(), 0.0).otherwise(float("inf")))
    start = start.select(*KEY, "d", F.coalesce("label", F.lit(0)).cast("long").alias("label"), F.col("label").isNotNull().alias("named"))
    return _settled(start, {"d": np.inf}, _nearer(steps), width, reach), reach


def _places(image: DataFrame) -> DataFrame:
    g = F.col("g").cast("long") if "g" in image.columns else F.lit(0).cast("long")
    return image.select(g.alias("g"), *[F.col(c).cast("long").alias(c) for c in PLACE]).distinct()


def distances(image: DataFrame, sources: DataFrame, chamfer: dict | None = None, width: int = 32) -> DataFrame:
    """x, y, z, d (and g, if the image has it: many images in one go): the least length of a way inside the image from a
    source, by the steps (dx, dy, dz): length of `chamfer`; voxels out of reach are left out."""
    found, _ = _measured(_places(image), _places(sources).withColumn("label", F.lit(0).cast("long")), chamfer or CHAMFER, width)
    return found.where(F.col("d") < float("inf")).select(*(KEY if "g" in image.columns else PLACE), "d")


def influence(image: DataFrame, seeds: DataFrame, chamfer: dict | None = None, width: int = 32) -> DataFrame:
    """x, y, z, label, d: for each voxel of an image (x, y, z) the nearest of the seeds (x, y, z, label) along ways inside it
    (skeleton by influence zones), ties to the least label. Seeds outside the image and null labels don't count, the least
    of several labels at a voxel does; voxels out of reach are left out."""
    steps = chamfer or CHAMFER
    back = {tuple(-c for c in o): w for o, w in steps.items()}  # a step o leads here from place - o
    own = seeds.where("label IS NOT NULL").groupBy(F.lit(0).cast("long").alias("g"), *[F.col(c).cast("long").alias(c) for c in PLACE]).agg(F.min(F.col("label").cast("long")).alias("label"))
    found, reach = _measured(_places(image.select(*PLACE)), own, back, width)

    def leads(a: Arrays, o: tuple, r: int) -> np.ndarray:
        d = _beside(a["d"], (0, 0, 0), r)
        return (d > 0) & (d < np.inf) & (_beside(a["d"], o, r) + back[o] == d)

    named = _settled(found, {"label": 0, "named": False}, _named(list(back), leads), width, reach)
    return named.where("named").select(*PLACE, "label", "d")


def parcels(image: DataFrame, seeds: DataFrame, chamfer: dict | None = None, rounds: int | None = None, width: int = 32) -> tuple[DataFrame, DataFrame]:
    """Voxels x, y, z, label, d of the parcels that an image (x, y, z) falls into around seeds (x, y, z, label, one voxel a
    label), and the seeds they end with. Each round every voxel joins the nearest seed along ways inside the image, and each
    seed moves to the voxel of its parcel nearest the parcel's mean (ties in order of place), until no seed moves or all are
    where they were one or two rounds before, or after `rounds` moves. Voxels that no seed reaches are left out."""
    places = stored(_places(image.select(*PLACE)).drop("g"))
    now, last, k = stored(seeds.groupBy("label").agg(F.min(F.struct(*[F.col(c).cast("long").alias(c) for c in PLACE])).alias("p")).select("label", "p.*")), None, 0
    while True:
        found = stored(influence(places, now, chamfer, width))
        if rounds is not None and k >= rounds:
            return found, now
        mean = found.groupBy("label").agg(*[F.avg(c).alias(f"m{c}") for c in PLACE])
        gap = F.round(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in PLACE), 9)
        new = stored(found.join(mean, "label").groupBy("label").agg(F.min(F.struct(gap.alias("e"), *PLACE)).alias("p")).select("label", *[F.col(f"p.{c}").alias(c) for c in PLACE]))
        if any(old is not None and new.exceptAll(old.select(*new.columns)).isEmpty() for old in (now, last)):
            return found, now
        now, last, k = new, now, k + 1


def _signed(a: DataFrame, couples: DataFrame, side: str) -> DataFrame:
    """g, x, y, z of the voxels of a label image that belong to a couple's side."""
    return a.select(*[F.col(c).cast("long").alias(c) for c in PLACE], F.col("v").cast("long").alias(side)).join(couples, side).select("g", *PLACE).distinct()


def labels_between(a: DataFrame, b: DataFrame, couples: DataFrame, share: float, chamfer: dict | None = None, width: int = 32) -> DataFrame:
    """x, y, z, v: the label image that lies the share (0 to 1) of the way from label image a to b (x, y, z, v).

    couples (g, l, r): labels l of a correspond to labels r of b under the same number g, many to many; g is the label of the
    result. A couple's signed distance in an image is the chamfer length to it outside, less that to its outside within;
    (1 - share) times that in a plus share times that in b is below 0 inside the result. Where several couples are, the one
    deepest inside wins, ties to the least number. Distances go through the couple's bounding box in both images and a rim
    of one voxel around it; a couple that lacks an image's voxels gives none."""
    couples = stored(couples.select(*[F.col(c).cast("long").alias(c) for c in ("g", "l", "r")]).distinct())
    own = [stored(_signed(image, couples, side)) for image, side in ((a, "l"), (b, "r"))]
    box = own[0].withColumn("k", F.lit(0)).unionByName(own[1].withColumn("k", F.lit(1))).groupBy("g").agg(F.countDistinct("k").alias("n"), *[f(c).alias(f"{n}{c}") for c in PLACE for n, f in (("a", F.min), ("b", F.max))])
    space = box.where("n = 2")
    for c in PLACE:
        space = space.withColumn(c, F.explode(F.sequence(F.col(f"a{c}") - 1, F.col(f"b{c}") + 1)))
    space = stored(space.select(*KEY))
    parts = []  # (couple, image, from inside or outside) as images of their own: g * 4 + 2 * image + outside
    for i, image in enumerate(own):
        parts += [image.join(space, KEY, "left_semi").withColumn("g", F.col("g") * 4 + 2 * i), space.join(image, KEY, "left_anti").withColumn("g", F.col("g") * 4 + 2 * i + 1)]
    sources = stored(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    whole = space.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select((F.col("g") * 4 + F.col("k")).alias("g"), *PLACE)
    d = distances(whole, sources, chamfer, width)
    weight = F.when(F.floor(F.pmod("g", F.lit(4)) / 2) == 0, 1 - share).otherwise(share) * F.when(F.pmod("g", F.lit(2)) == 0, 1).otherwise(-1)
    deep = d.groupBy(F.floor(F.col("g") / 4).alias("g"), *PLACE).agg(F.sum(weight * F.col("d")).alias("s")).where("s < -1e-9")
    return deep.groupBy(*PLACE).agg(F.min(F.struct(F.round("s", 9).alias("s"), "g")).alias("p")).select(*PLACE, F.col("p.g").alias("v"))
