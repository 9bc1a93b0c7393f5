"""Measures and drawings of sparse images (x, y, z, v): statistics, joint and masked histograms, similarities of blocks,
neighbourhoods, types, cubic resampling, shapes, projections of a sequence, translations by phase correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovox.operators import voxels

PLACE = ["x", "y", "z"]
#: Least and greatest value of each whole-number type.
TYPES = {"u8": (0, 255), "s8": (-128, 127), "u16": (0, 65535), "s16": (-32768, 32767), "u32": (0, 4294967295), "s32": (-2147483648, 2147483647)}


def described(image: DataFrame) -> DataFrame:
    """n, least, mean, most, deviation (of the population): one row."""
    return image.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("most"), F.stddev_pop("v").alias("deviation"))


def converted(image: DataFrame, to: str) -> DataFrame:
    """Values rounded (halves away from 0) and clamped to a whole-number type, or as float or double."""
    if to in ("float", "double"):
        return image.select(*PLACE, F.col("v").cast(to).alias("v"))
    low, high = TYPES[to]
    away = F.signum("v") * F.floor(F.abs("v") + 0.5)
    return image.select(*PLACE, F.greatest(F.lit(low), F.least(F.lit(high), away)).cast("long").alias("v"))


def masked_histogram(image: DataFrame, mask: DataFrame, width: float, least: float = 0.0) -> DataFrame:
    """bin, n, share: the histogram over the voxels of mask (x, y, z) and each bin's share of them."""
    h = image.join(mask.select(*PLACE).distinct(), PLACE, "left_semi").groupBy(F.floor((F.col("v") - least) / width + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("__all")))).select("bin", "n", (F.col("n") / F.col("__all")).alias("share"))


def histogram_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """bin, difference: the counts (bin, n) of a less those of b; absent bins count 0."""
    return a.select("bin", F.col("n").alias("p")).join(b.select("bin", F.col("n").alias("q")), "bin", "full").select("bin", (F.coalesce("p", F.lit(0)) - F.coalesce("q", F.lit(0))).alias("difference"))


def histogram_lines(histogram: DataFrame) -> DataFrame:
    """bin, line: `bin n` lines for to_text(), in order of bin."""
    return histogram.select("bin", F.format_string("%d %d", F.col("bin").cast("long"), F.col("n").cast("long")).alias("line"))


#: Smaller deviations make no correlation.
EPSILON = 1e-9


def block_similarities(a: DataFrame, b: DataFrame, width: int, within: tuple[float, float] = (float("-inf"), float("inf"))) -> DataFrame:
    """bx, by, bz, n, ssd, sad, cc, cc_extended for blocks of two images, over the n places where both have values between the
    two bounds of `within`: sums of squared and absolute differences, the squared correlation, and the extended one, whose
    means and variances are those of each block's own voxels within the bounds, whether the other image has them or not:
    (sum (v - mean_a)(u - mean_b))^2 / (n^2 var_a var_b). Null where variances vanish."""
    cell = [F.floor(F.col(c) / width).alias(f"b{c}") for c in PLACE]
    block = ["bx", "by", "bz"]
    inside = (F.col("v") > within[0]) & (F.col("v") < within[1])
    a, b = a.where(inside).select(*PLACE, "v"), b.where(inside).select(*PLACE, "v")
    both = a.join(b.withColumnRenamed("v", "u"), PLACE)
    gap = F.col("v") - F.col("u")
    g = both.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap * gap).alias("ssd"), F.sum(F.abs(gap)).alias("sad"), F.covar_pop("v", "u").alias("c"), F.var_pop("v").alias("p"), F.var_pop("u").alias("q"), F.avg("v").alias("m"), F.avg("u").alias("k"))
    own = lambda image, s: image.groupBy(*cell).agg(F.avg("v").alias(f"mean_{s}"), F.var_pop("v").alias(f"var_{s}"))
    g = g.join(own(a, "a"), block).join(own(b, "b"), block)
    some = (F.col("p") > EPSILON) & (F.col("q") > EPSILON)
    # The mean over common places of the product of deviations from the blocks' own means.
    shared = F.col("c") + (F.col("m") - F.col("mean_a")) * (F.col("k") - F.col("mean_b"))
    spread = F.col("var_a") * F.col("var_b")
    return g.select(*block, "n", "ssd", "sad", F.when(some, F.col("c") * F.col("c") / (F.col("p") * F.col("q"))).alias("cc"), F.when(spread > EPSILON, shared * shared / spread).alias("cc_extended"))


def windowed_blocks(image: DataFrame, width: int, low: float, high: float, most_removed: float = 0.5) -> DataFrame:
    """bx, by, bz, n, mean, variance of the voxels of low < v < high, for blocks of which the window removes at most the
    share most_removed."""
    inside = (F.col("v") > low) & (F.col("v") < high)
    own = F.when(inside, F.col("v"))
    g = image.groupBy(*[F.floor(F.col(c) / width).alias(f"b{c}") for c in PLACE]).agg(F.count(F.lit(1)).alias("a"), F.count(own).alias("n"), F.avg(own).alias("mean"), F.var_pop(own).alias("variance"))
    return g.where((F.col("n") > 0) & (1 - F.col("n") / F.col("a") <= most_removed)).select("bx", "by", "bz", "n", "mean", "variance")


def neighbourhood(image: DataFrame, what: str, offsets: list = voxels.CROSS, share: float = 0.5) -> DataFrame:
    """min, max, mean, sum, sumsq, std, var, median, quantile (of `share`) or robust (the mean of what lies within two
    deviations of the mean) of the neighbours that are there."""
    v = F.col("v")
    how: dict[str, Column] = {
        "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "sum": F.sum(v), "sumsq": F.sum(v * v), "std": F.stddev_pop(v), "var": F.var_pop(v), "median": F.median(v), "quantile": F.percentile(v, F.lit(float(share)))}
    if what != "robust":
        return voxels.local(image, how[what], offsets)
    stat = voxels.local(image, F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")), offsets).withColumnRenamed("v", "k")
    near = voxels.spread(image, offsets).join(stat, PLACE).where(F.abs(F.col("v") - F.col("k.m")) <= 2 * F.col("k.s") + 1e-9)
    return near.groupBy(*PLACE).agg(F.avg("v").alias("v"))


def cubic(image: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """The image moved by a translation, by cubic convolution (a = -1/2) axis by axis; places that miss one of the four
    voxels along an axis are left out. Whole-numbered shifts move voxels."""
    for axis, s in zip(PLACE, shift, strict=True):
        whole = int(np.floor(s))
        f = s - whole
        if f < 1e-12:
            image = image.select(*[(F.col(c) + whole).alias(c) if c == axis else F.col(c) for c in PLACE], "v")
            continue
        d = {-1: 2 - f, 0: 1 - f, 1: f, 2: 1 + f}  # from a place to the voxels at place - whole - 1 + k, seen backwards
        weight = {k: (1.5 * d[k] - 2.5) * d[k] * d[k] + 1 if d[k] <= 1 else ((-0.5 * d[k] + 2.5) * d[k] - 4) * d[k] + 2 for k in d}
        taps = F.explode(F.array(*[F.struct(F.lit(whole + k).alias("o"), F.lit(float(w)).alias("w")) for k, w in ((-1, weight[2]), (0, weight[1]), (1, weight[0]), (2, weight[-1]))]))
        g = image.withColumn("k", taps).groupBy(*[(F.col(c) + F.col("k.o")).alias(c) if c == axis else F.col(c) for c in PLACE]).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"), F.count(F.lit(1)).alias("n"))
        image = g.where("n = 4").select(*PLACE, "v")
    return image


def box(spark: SparkSession, low: tuple[int, int, int], high: tuple[int, int, int], value: float = 1.0) -> DataFrame:
    """The voxels from low to high, both included, of one value; made by the executors."""
    n = [h - a + 1 for a, h in zip(low, high, strict=True)]
    if min(n) <= 0:
        return spark.range(0).select(*[F.col("id").alias(c) for c in PLACE], F.lit(value).alias("v"))
    i = spark.range(n[0] * n[1] * n[2])
    return i.select((F.col("id") % n[0] + low[0]).alias("x"), (F.expr(f"id div {n[0]}") % n[1] + low[1]).alias("y"), (F.expr(f"id div {n[0] * n[1]}") + low[2]).alias("z"), F.lit(float(value)).alias("v"))


def _square(e: list[Column]) -> Column:
    return e[0] * e[0] + e[1] * e[1] + e[2] * e[2]


def sphere(centre: tuple[float, float, float], radius: float) -> Column:
    return _square([F.col(c) - float(m) for c, m in zip(PLACE, centre, strict=True)]) <= radius * radius


def cylinder(at: tuple[float, float, float], to: tuple[float, float, float], radius: float) -> Column:
    """Places within `radius` of the stretch from at to to, between its ends; with a small radius, a line."""
    axis = np.subtract(to, at)
    length = float(axis @ axis)
    p = [F.col(c) - float(a) for c, a in zip(PLACE, at, strict=True)]
    s = sum((x * float(a) for x, a in zip(p[1:], axis[1:], strict=True)), p[0] * float(axis[0])) / length
    return (s >= 0) & (s <= 1) & (_square([x - s * float(a) for x, a in zip(p, axis, strict=True)]) <= radius * radius)


def slab(at: tuple[float, float, float], normal: tuple[float, float, float], thickness: float) -> Column:
    """Places within half the thickness of a plane."""
    unit = np.asarray(normal) / np.linalg.norm(normal)
    return F.abs(sum(((F.col(c) - float(a)) * float(u) for c, a, u in zip(PLACE, at, unit, strict=True)), F.lit(0.0))) <= thickness / 2


def checkerboard(width: int) -> Column:
    return (F.floor(F.col("x") / width) + F.floor(F.col("y") / width) + F.floor(F.col("z") / width)) % 2 == 0


def grid_lines(step: int) -> Column:
    return (F.col("x") % step == 0) | (F.col("y") % step == 0) | (F.col("z") % step == 0)


def drawn(image: DataFrame, shape: Column, value: float) -> DataFrame:
    """The image with one value where the shape is."""
    return image.select(*PLACE, F.when(shape, float(value)).otherwise(F.col("v")).alias("v"))


def stacked(images: DataFrame, axis: str = "z") -> DataFrame:
    """The greatest values along an axis of each frame's image (t, x, y, z, v), one above the other: the frame takes the
    axis's place."""
    rest = [c for c in PLACE if c != axis]
    return images.groupBy("t", *rest).agg(F.max("v").alias("v")).select(*rest, F.col("t").alias(axis), "v")


def _shift(a: pd.DataFrame, b: pd.DataFrame) -> tuple[float, float]:
    """How far b's content lies behind a's, by the peak of the normalized cross power spectrum; frames alike in size."""
    if a.empty or b.empty:
        return 0.0, 0.0
    shape = np.maximum(a[["p", "q"]].to_numpy().max(axis=0), b[["p", "q"]].to_numpy().max(axis=0)) + 1
    planes = []
    for rows in (a, b):
        plane = np.zeros(shape)
        plane[rows["p"], rows["q"]] = rows["v"]
        planes.append(np.fft.fft2(plane))
    cross = planes[0] * planes[1].conj()
    peak = np.array(np.unravel_index(np.argmax(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real.round(9)), shape), dtype=float)
    wrapped = np.where(peak > shape // 2, peak - shape, peak)
    return float(wrapped[0]), float(wrapped[1])


def phase_translation(images: DataFrame) -> DataFrame:
    """t, dx, dy, dz: how to move the image of frame t (t, x, y, z, v; places from 0 on) onto that of t + 1: the negative
    of half the sum of the shifts that the three projections of greatest values tell, each axis by two of them. What a
    task holds are two planes."""
    planes = None
    for k, axis in enumerate(PLACE):
        p, q = (c for c in PLACE if c != axis)
        own = images.groupBy("t", F.col(p).alias("p"), F.col(q).alias("q")).agg(F.max("v").alias("v")).withColumn("axis", F.lit(k))
        planes = own if planes is None else planes.unionByName(own)
    # Names of its own, lest the two sides of one table be taken for the same columns.
    after = planes.select((F.col("t") - 1).alias("__t"), F.col("axis").alias("__axis"), F.col("p").alias("__p"), F.col("q").alias("__q"), F.col("v").alias("__v"))

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"t": [], "axis": [], "p": [], "q": []})
        p, q = _shift(a, b.rename(columns=lambda c: c.removeprefix("__")))
        return pd.DataFrame({"t": [key[0]], "axis": [key[1]], "p": [p], "q": [q]})

    kind = images.schema["t"].dataType.simpleString()
    found = planes.groupBy("t", "axis").cogroup(after.groupBy("__t", "__axis")).applyInPandas(solve, f"t {kind}, axis int, p double, q double")
    # The axes that p and q stand for, by the axis that the projection takes away.
    seen = {"x": {1: "p", 2: "p"}, "y": {0: "p", 2: "q"}, "z": {0: "q", 1: "q"}}
    way = lambda c: F.sum(sum((F.when(F.col("axis") == k, F.col(own)).otherwise(0.0) for k, own in seen[c].items()), F.lit(0.0)))
    return found.groupBy("t").agg(*[(F.lit(0.0) - way(c) / 2).alias(f"d{c}") for c in PLACE])


def relabelled(cliques: DataFrame) -> DataFrame:
    """side, label, new: labels of two images renamed so that corresponding ones go together. cliques: l, r, pairs of
    labels that correspond. Groups of labels that hang together are ordered: those of one and one first, then one and two,
    one and more, two and one, the rest; inside, by their least labels. Each side counts from 2 on in that order, as 0 and
    1 stand for nothing and the background."""
    from pyspark.sql import Window

    from chronovox.operators import graphs

    edges = cliques.select((F.col("l") * 2).cast("long").alias("a"), (F.col("r") * 2 + 1).cast("long").alias("b"))
    named = graphs.named_by_least(edges).select("component", F.expr("IF(node % 2 = 0, 'l', 'r')").alias("side"), F.expr("node div 2").alias("label")).where("label > 1")
    size = named.groupBy("component").agg(F.count(F.when(F.col("side") == "l", 1)).alias("m"), F.count(F.when(F.col("side") == "r", 1)).alias("n"))
    rank = F.when((F.col("m") == 1) & (F.col("n") == 1), 0).when((F.col("m") == 1) & (F.col("n") == 2), 1).when(F.col("m") == 1, 2).when((F.col("m") == 2) & (F.col("n") == 1), 3).otherwise(4)
    # One row a label, a side a window.
    order = Window.partitionBy("side").orderBy("k", "component", "label")
    return named.join(size.select("component", rank.alias("k")), "component").select("side", "label", (F.row_number().over(order) + 1).cast("long").alias("new"))
