"""Sparse images: x, y, z, v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.operators import graphs

CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def projected(image: DataFrame, axis: str) -> DataFrame:
    return image.groupBy(*[c for c in "xyz" if c != axis]).agg(F.max("v").alias("v"))


def spread(image: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Every voxel at all offsets from its place."""
    o = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", x, strict=True)]) for x in offsets])
    return image.withColumn("o", F.explode(o)).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"], "v")


def dilated(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    return spread(image, offsets).groupBy("x", "y", "z").agg(F.max("v").alias("v"))


def eroded(image: DataFrame, offsets: list = CROSS) -> DataFrame:
    """Binary and grey: a voxel stays if all its neighbours are there, with the least value."""
    return spread(image, offsets).groupBy("x", "y", "z").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).drop("n")


def local(image: DataFrame, what: Column, offsets: list = CROSS) -> DataFrame:
    """An aggregate of v over the neighbours of each voxel."""
    there = image.select("x", "y", "z")
    return spread(image, offsets).join(there, ["x", "y", "z"], "left_semi").groupBy("x", "y", "z").agg(what.alias("v"))


def histogram(image: DataFrame, width: float, least: float = 0.0) -> DataFrame:
    """bin = int((v - least) / width + 0.5), with counts and their running sum."""
    h = image.groupBy(F.floor((F.col("v") - least) / width + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))


def pyramid(image: DataFrame) -> DataFrame:
    return image.groupBy(*[F.floor(F.col(c) / 2).alias(c) for c in "xyz"]).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


def number() -> Column:
    """A voxel's number in raster order. It tells voxels apart while y and z stay below 500,000 and x below 9,000,000 on
    either side of 0; what lies beyond raises an error."""
    inside = (F.abs("x") < 9_000_000) & (F.abs("y") < 500_000) & (F.abs("z") < 500_000)
    return F.when(inside, F.col("x") * 1_000_000_000_000 + F.col("y") * 1_000_000 + F.col("z")).otherwise(F.raise_error(F.lit("a voxel lies beyond the numbered range")))


def touching(image: DataFrame, among: list[str]) -> DataFrame:
    """a, b: numbers of voxels that touch by a face and agree in the columns `among`."""
    ahead = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", o, strict=True)]) for o in CROSS if min(o) == 0 < max(o)]))
    own = image.select("x", "y", "z", *among, number().alias("id"))
    moved = own.withColumn("o", ahead).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"], *among, F.col("id").alias("a"))
    return moved.join(own, ["x", "y", "z", *among]).select("a", F.col("id").alias("b"))


def components(image: DataFrame, among: list[str] | None = None) -> DataFrame:
    """x, y, z, component: the least number of a voxel that steps between voxels that touch by a face reach, within equal
    values of the columns `among`. Rounds grow with the logarithm of the voxels."""
    named = graphs.named_by_least(touching(image, among or []))
    own = image.select("x", "y", "z", number().alias("node"))
    return own.join(named, "node", "left").select("x", "y", "z", F.coalesce("component", "node").alias("component"))


def block_statistics(image: DataFrame, width: int) -> DataFrame:
    b = [F.floor(F.col(c) / width).alias(f"b{c}") for c in "xyz"]
    return image.groupBy(*b).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.count(F.lit(1)).alias("n"))


def block_correlation(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Squared correlation of two images, block by block; null where a variance vanishes."""
    both = a.join(b.withColumnRenamed("v", "u"), ["x", "y", "z"])
    g = both.groupBy(*[F.floor(F.col(c) / width).alias(f"b{c}") for c in "xyz"]).agg(
        F.covar_pop("v", "u").alias("c"), F.var_pop("v").alias("p"), F.var_pop("u").alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select("bx", "by", "bz", "n", F.when((F.col("p") > 1e-9) & (F.col("q") > 1e-9), F.col("c") * F.col("c") / (F.col("p") * F.col("q"))).alias("cc"))


def resampled_nearest(image: DataFrame, scale: float) -> DataFrame:
    """Each voxel of the grid that is `scale` times as fine takes the nearest voxel's value."""
    n = int(scale)
    o = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in range(n) for j in range(n) for k in range(n)])
    return image.withColumn("o", F.explode(o)).select(*[(F.col(c) * n + F.col(f"o.{c}")).alias(c) for c in "xyz"], "v")


def on_canvas(image: DataFrame, axes: str = "xyz") -> DataFrame:
    """The image moved so that its bounding box starts at 0 along the axes; one row of bounds is broadcast."""
    least = image.agg(*[F.min(c).alias(f"__{c}") for c in axes])
    return image.crossJoin(F.broadcast(least)).select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in axes else F.col(c) for c in "xyz"], "v")
