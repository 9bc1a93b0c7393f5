"""Filters and structure of sparse images (x, y, z, v): convolution, derivatives, morphology, thresholds, distances,
extrema, basins. Each is a stencil of equi-joins on the voxel's place; nothing is gathered beyond a stencil."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.operators import flooding
from chronovox.operators.checkpoints import stored
from chronovox.operators.flooding import CHAMFER
from chronovox.operators.voxels import CROSS, components, dilated, eroded, number, spread

PLACE = ["x", "y", "z"]


def ball(radius: float) -> list[tuple[int, int, int]]:
    n = int(radius)
    return [(i, j, k) for i in range(-n, n + 1) for j in range(-n, n + 1) for k in range(-n, n + 1) if i * i + j * j + k * k <= radius * radius]


def convolved(image: DataFrame, kernel: dict[int, float], axis: str, whole: bool = False) -> DataFrame:
    """The sum of kernel[d] * v(place + d) along an axis at each voxel, over the voxels that are there; `whole` divides by
    the sum of the weights that met a voxel."""
    taps = F.explode(F.array(*[F.struct(F.lit(-d).alias("d"), F.lit(float(w)).alias("w")) for d, w in sorted(kernel.items())]))
    moved = image.withColumn("k", taps).select(*[(F.col(c) + F.col("k.d")).alias(c) if c == axis else F.col(c) for c in PLACE], (F.col("v") * F.col("k.w")).alias("v"), F.col("k.w").alias("w"))
    out = moved.join(image.select(*PLACE), PLACE, "left_semi").groupBy(*PLACE)
    return out.agg((F.sum("v") / F.sum("w") if whole else F.sum("v")).alias("v"))


def gaussian(image: DataFrame, sigma: float, reach: float = 3.0) -> DataFrame:
    """A Gaussian cut off at reach * sigma, axis by axis, its weights renewed where voxels are missing."""
    n = max(1, math.ceil(reach * sigma))
    kernel = {d: math.exp(-0.5 * d * d / sigma**2) for d in range(-n, n + 1)}
    for axis in PLACE:
        image = convolved(image, kernel, axis, whole=True)
    return image


def derivative(image: DataFrame, axis: str, order: int = 1) -> DataFrame:
    """Central differences; voxels that lack a neighbour along the axis are left out."""
    kernel = {1: {-1: -0.5, 1: 0.5}, 2: {-1: 1.0, 0: -2.0, 1: 1.0}}[order]
    taps = F.explode(F.array(*[F.struct(F.lit(-d).alias("d"), F.lit(w).alias("w")) for d, w in kernel.items()]))
    moved = image.withColumn("k", taps).select(*[(F.col(c) + F.col("k.d")).alias(c) if c == axis else F.col(c) for c in PLACE], (F.col("v") * F.col("k.w")).alias("v"))
    out = moved.join(image.select(*PLACE), PLACE, "left_semi").groupBy(*PLACE).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") == len(kernel)).drop("n")


def _three(image: DataFrame, order: int, join: Column) -> DataFrame:
    d = [derivative(image, a, order).withColumnRenamed("v", f"d{a}") for a in PLACE]
    return d[0].join(d[1], PLACE).join(d[2], PLACE).select(*PLACE, join.alias("v"))


def gradient_modulus(image: DataFrame) -> DataFrame:
    return _three(image, 1, F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))


def laplacian(image: DataFrame) -> DataFrame:
    return _three(image, 2, F.col("dx") + F.col("dy") + F.col("dz"))


def zero_crossings(image: DataFrame) -> DataFrame:
    """Voxels of value >= 0 beside one below 0."""
    low = spread(image.where("v < 0"), CROSS[1:]).select(*PLACE).distinct()
    return image.where("v >= 0").join(low, PLACE, "left_semi")


def closed(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    return eroded(dilated(image, offsets), offsets)


def opened(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    return dilated(eroded(image, offsets), offsets)


def top_hat(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    """What opening takes away; voxels that opening drops keep their value."""
    o = opened(image, offsets).withColumnRenamed("v", "o")
    return image.join(o, PLACE, "left").select(*PLACE, (F.col("v") - F.coalesce("o", F.lit(0.0))).alias("v"))


def bottom_hat(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    """What closing adds; at voxels that closing makes, all of it."""
    c = closed(image, offsets).withColumnRenamed("v", "c")
    return c.join(image, PLACE, "left").select(*PLACE, (F.col("c") - F.coalesce("v", F.lit(0.0))).alias("v"))


def morphological_gradient(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    """Dilation less erosion, where both are defined."""
    return dilated(image, offsets).join(eroded(image, offsets).withColumnRenamed("v", "e"), PLACE).select(*PLACE, (F.col("v") - F.col("e")).alias("v"))


def arithmetic(a: DataFrame, b: DataFrame, what: str) -> DataFrame:
    """min, max, add, sub, mul or div of two images where both have voxels; x / 0 is null."""
    v, u = F.col("v"), F.col("u")
    how = {"min": F.least(v, u), "max": F.greatest(v, u), "add": v + u, "sub": v - u, "mul": v * u, "div": F.when(u != 0, v / u)}
    return a.join(b.withColumnRenamed("v", "u"), PLACE).select(*PLACE, how[what].alias("v"))


def normalised(image: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values from 0 to 255: the quantiles low and high go to 0 and 255, what lies beyond is clamped."""
    q = image.agg(F.percentile("v", F.lit(low)).alias("__a"), F.percentile("v", F.lit(high)).alias("__b"))
    scaled = F.when(F.col("__b") > F.col("__a"), (F.col("v") - F.col("__a")) / (F.col("__b") - F.col("__a")) * 255).otherwise(0.0)
    return image.crossJoin(F.broadcast(q)).select(*PLACE, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)) + 0.5).alias("v"))


def hysteresis(image: DataFrame, low: float, high: float, fewest: int = 1) -> DataFrame:
    """x, y, z, component, n: components of voxels >= low that reach high and have at least `fewest` voxels."""
    c = components(image.where(F.col("v") >= low)).join(image, PLACE)
    good = c.groupBy("component").agg(F.max("v").alias("most"), F.count(F.lit(1)).alias("n")).where((F.col("most") >= high) & (F.col("n") >= fewest)).drop("most")
    return c.join(good, "component").select(*PLACE, "component", "n")


def by_size(labelled: DataFrame, most: int | None = None) -> DataFrame:
    """x, y, z, rank: components named by decreasing size, ties by number; the `most` largest only."""
    n = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # One row a component.
    r = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "component")))
    r = r if most is None else r.where(F.col("rank") <= most)
    return labelled.join(r.select("component", "rank"), "component").select(*PLACE, "rank")


def distance_map(image: DataFrame, sources: DataFrame, chamfer: dict | None = None) -> DataFrame:
    """x, y, z, d: the least chamfer length of a way inside the image from a source; voxels out of reach are left out."""
    found = flooding.distances(image.select(*PLACE), sources.select(*PLACE), chamfer)
    whole = all(isinstance(w, int) for w in (chamfer or CHAMFER).values())
    return found.withColumn("d", F.col("d").cast("long")) if whole else found


def _lowest_step(image: DataFrame) -> DataFrame:
    """id, to: the neighbour (or the voxel itself) of least (v, number)."""
    own = image.select(*PLACE, "v", number().alias("id"))
    o = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", s, strict=True)]) for s in CROSS]))
    moved = own.withColumn("o", o).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in PLACE], F.struct("v", "id").alias("k"))
    return moved.join(own.select(*PLACE, "id"), PLACE).groupBy("id").agg(F.min("k").alias("k")).select("id", F.col("k.id").alias("to"))


def basins(image: DataFrame) -> DataFrame:
    """x, y, z, basin: watershed by steepest descent, equal values in order of number; each voxel takes the number of the
    minimum its way ends at. Pointer doubling: as many rounds as the logarithm of the longest way. For basins of maxima
    (or of a gradient) pass the image of -v (or of the gradient)."""
    step = stored(_lowest_step(image))
    while True:
        new = stored(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        step = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return image.select(*PLACE, number().alias("id")).join(step, "id").select(*PLACE, F.col("to").alias("basin"))


def regional_maxima(image: DataFrame) -> DataFrame:
    """x, y, z, component: plateaus of equal value with no higher neighbour."""
    levels = spread(image, CROSS[1:]).withColumnRenamed("v", "u").join(image, PLACE)
    climb = levels.where("u > v").select(*PLACE).distinct()
    named = stored(components(image, ["v"]))
    lost = named.join(climb, PLACE, "left_semi").select("component").distinct()
    return named.join(lost, "component", "left_anti").select(*PLACE, "component")


def label_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """l, r, n: how many voxels two label images share."""
    return a.select(*PLACE, F.col("v").alias("l")).join(b.select(*PLACE, F.col("v").alias("r")), PLACE).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))


def between(a: DataFrame, b: DataFrame, s: float) -> DataFrame:
    """(1 - s) a + s b; a voxel of one image alone counts 0 in the other."""
    return a.join(b.withColumnRenamed("v", "u"), PLACE, "full").select(*PLACE, ((1 - s) * F.coalesce("v", F.lit(0.0)) + s * F.coalesce("u", F.lit(0.0))).alias("v"))


def in_mask(nodes: DataFrame, mask: DataFrame, scale: tuple[float, float, float], rounding: bool = False) -> DataFrame:
    """Nodes whose voxel (place over scale, floored or rounded, clamped to the mask's box) belongs to the mask (x, y, z)."""
    box = mask.agg(*[F.max(c).alias(f"__h{c}") for c in PLACE], *[F.min(c).alias(f"__l{c}") for c in PLACE])
    how = (lambda x: F.floor(x + 0.5)) if rounding else F.floor
    k = {f"__{c}": F.greatest(F.least(how(F.col(c) / s), F.col(f"__h{c}")), F.col(f"__l{c}")) for c, s in zip(PLACE, scale, strict=True)}
    keyed = nodes.crossJoin(F.broadcast(box)).withColumns(k)
    out = keyed.join(mask.select(*[F.col(c).alias(f"__{c}") for c in PLACE]).distinct(), list(k), "left_semi")
    return out.select(*nodes.columns)
