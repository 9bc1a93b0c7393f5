"""Vector fields on grids (x, y, z, dx, dy, dz): made, described, smoothed, composed, inverted and applied.

A field moves the place p to p + d(p). Between grid places it is the mean of the eight corners by volume, and it ends
where a corner is missing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.operators import filters
from chronovox.operators.checkpoints import stored

PLACE = ["x", "y", "z"]
WAY = ["dx", "dy", "dz"]


def sinus(grid: DataFrame, amplitude: tuple[float, float, float], period: tuple[float, float, float]) -> DataFrame:
    """A field over grid (x, y, z) whose way along each axis is amplitude * sin(2 pi place / period)."""
    return grid.select(*PLACE, *[(F.lit(float(a)) * F.sin(F.lit(2 * np.pi) * F.col(c) / float(p))).alias(f"d{c}") for c, a, p in zip(PLACE, amplitude, period, strict=True)])


def from_matrix(grid: DataFrame, m: np.ndarray) -> DataFrame:
    """The field of a 4 x 4 matrix over grid (x, y, z)."""
    line = lambda r: sum((F.col(c) * float(m[r, k]) for k, c in enumerate(PLACE)), F.lit(float(m[r, 3])))
    return grid.select(*PLACE, *[(line(r) - F.col(c)).alias(f"d{c}") for r, c in enumerate(PLACE)])


def random_matrix(kind: str, seed: int, angle: tuple[float, float] = (0.0, 1.57079), scale: tuple[float, float] = (0.7, 1.4), shear: tuple[float, float] = (0.0, 0.3), shift: tuple[float, float] = (-10.0, 10.0)) -> np.ndarray:
    """A 4 x 4 matrix of a kind (identity, translation, rigid, similitude, affine), from a seed; intervals' defaults are
    fixed values."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.eye(4)
    if kind == "identity":
        return out
    out[:3, 3] = rng.uniform(*shift, 3)
    if kind == "translation":
        return out
    axis = rng.normal(size=3)
    axis /= np.linalg.norm(axis)
    turn = rng.uniform(*angle)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    linear = np.eye(3) + np.sin(turn) * k + (1 - np.cos(turn)) * k @ k
    if kind == "similitude":
        linear = linear * rng.uniform(*scale)
    elif kind == "affine":
        linear = linear @ np.diag(rng.uniform(*scale, 3)) @ (np.eye(3) + np.triu(rng.uniform(*shear, (3, 3)), 1))
    elif kind != "rigid":
        raise ValueError(f"unknown kind: {kind}")
    out[:3, :3] = linear
    return out


def statistics(field: DataFrame) -> DataFrame:
    """n, least, mean, most and deviation (of the population) of each component and of the length."""
    d = field.select(*WAY, F.sqrt(sum(F.col(c) * F.col(c) for c in WAY)).alias("length"))
    return d.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in (*WAY, "length") for name, f in (("least", F.min), ("mean", F.avg), ("most", F.max), ("deviation", F.stddev_pop))])


def sampled(points: DataFrame, field: DataFrame, at: dict[str, Column]) -> DataFrame:
    """points with wx, wy, wz: the field at the places `at` (x, y, z as columns of points); points where it ends are left
    out. points needs a key column `__key`. Each point asks its eight corners by equi-joins."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(PLACE, (i, j, k), strict=True)]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    asked = points.select("__key", *[F.round(e, 9).alias(f"__{c}") for c, e in at.items()]).withColumn("o", corner)
    low = {c: F.floor(F.col(f"__{c}")) for c in PLACE}
    share = [F.when(F.col(f"o.{c}") == 1, F.col(f"__{c}") - low[c]).otherwise(1 - (F.col(f"__{c}") - low[c])) for c in PLACE]
    asked = asked.select("__key", *[(low[c] + F.col(f"o.{c}")).cast("long").alias(c) for c in PLACE], (share[0] * share[1] * share[2]).alias("__w")).where("__w > 0")
    got = asked.join(field, PLACE).groupBy("__key").agg(F.sum("__w").alias("__s"), *[F.sum(F.col("__w") * F.col(d)).alias(f"w{c}") for c, d in zip(PLACE, WAY, strict=True)])
    return points.join(got.where("__s > 1 - 1e-6").drop("__s"), "__key")


def moved(points: DataFrame, field: DataFrame) -> DataFrame:
    """id, x, y, z of points (id, x, y, z) under a field; those beyond it are left out. ids tell points apart."""
    rows = points.select(F.col("id").alias("__key"), *PLACE)
    return sampled(rows, field, {c: F.col(c) for c in PLACE}).select(F.col("__key").alias("id"), *[(F.col(c) + F.col(f"w{c}")).alias(c) for c in PLACE])


def _keyed(field: DataFrame) -> DataFrame:
    return field.withColumn("__key", F.struct(*PLACE))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The field of `first`, then `then`, where both are defined."""
    rows = sampled(_keyed(first), then, {c: F.col(c) + F.col(f"d{c}") for c in PLACE})
    return rows.select(*PLACE, *[(F.col(f"d{c}") + F.col(f"w{c}")).alias(f"d{c}") for c in PLACE])


def inverted(field: DataFrame, most: float = 0.05, rounds: int = 10, weight: float = 0.5) -> DataFrame:
    """x, y, z, dx, dy, dz, error: the inverse on the same grid by a fixed point. From 0 on, a round moves each vector e
    by `weight` times what is left of e + d(p + e); it ends when all are nearer than `most`, or after `rounds`, and error
    says what was left at each place. Places from which the way leaves the field keep their last vector."""
    now = stored(field.select(*PLACE, *[F.lit(0.0).alias(f"e{c}") for c in PLACE], F.lit(float("inf")).alias("error")))
    for _ in range(rounds):
        rows = sampled(now.withColumn("__key", F.struct(*PLACE)), field, {c: F.col(c) + F.col(f"e{c}") for c in PLACE})
        rest = {c: F.col(f"e{c}") + F.col(f"w{c}") for c in PLACE}
        error = F.sqrt(sum(r * r for r in rest.values()))
        step = rows.select(*PLACE, *[(F.col(f"e{c}") - weight * rest[c]).alias(f"n{c}") for c in PLACE], error.alias("left"))
        now = stored(now.join(step, PLACE, "left").select(*PLACE, *[F.when(F.col("left") > most, F.col(f"n{c}")).otherwise(F.col(f"e{c}")).alias(f"e{c}") for c in PLACE], F.coalesce("left", "error").alias("error")))
        if now.where((F.col("error") > most) & (F.col("error") < float("inf"))).isEmpty():
            break
    return now.select(*PLACE, *[F.col(f"e{c}").alias(f"d{c}") for c in PLACE], "error")


def smoothed(field: DataFrame, sigma: float) -> DataFrame:
    """Each component under a Gaussian whose weights are renewed at the field's edge."""
    out = field.select(*PLACE)
    for d in WAY:
        out = out.join(filters.gaussian(field.select(*PLACE, F.col(d).alias("v")), sigma).withColumnRenamed("v", d), PLACE)
    return out


def spread_ways(grid: DataFrame, pairings: DataFrame, sigma: float, reach: int) -> DataFrame:
    """x, y, z, dx, dy, dz, w over grid: the mean way of pairings (ax..bz, and w as weight) around each place, weighted by
    w and a Gaussian of the distance, up to `reach` along each axis; 0 where no pairing is near. Pairings spread to the
    places around them, so that no place looks at all pairings."""
    o = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(PLACE, s, strict=True)]) for s in np.ndindex(2 * reach + 1, 2 * reach + 1, 2 * reach + 1)]))
    base = {c: F.floor(F.col(f"a{c}") + 0.5) for c in PLACE}
    near = pairings.withColumn("o", o).select("ax", "ay", "az", *[(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"d{c}") for c in PLACE], F.col("w").alias("u"), *[(base[c] + F.col(f"o.{c}") - reach).cast("long").alias(c) for c in PLACE])
    g = F.col("u") * F.exp(-sum((F.col(c) - F.col(f"a{c}")) * (F.col(c) - F.col(f"a{c}")) for c in PLACE) / (2 * sigma * sigma))
    mean = near.withColumn("g", g).groupBy(*PLACE).agg(F.sum("g").alias("w"), *[(F.sum(F.col("g") * F.col(d)) / F.sum("g")).alias(d) for d in WAY])
    return grid.select(*PLACE).join(mean, PLACE, "left").select(*PLACE, *[F.coalesce(d, F.lit(0.0)).alias(d) for d in WAY], F.coalesce("w", F.lit(0.0)).alias("w"))


def estimated(grid: DataFrame, pairings: DataFrame, sigma: float = 2.0, reach: int = 4, times: float = 3.0, rounds: int = 10) -> DataFrame:
    """x, y, z, dx, dy, dz over grid: a smooth field through pairings (i, ax..bz, w), estimated again without those whose
    residual exceeds mean + times * deviation, until none goes (or after `rounds`)."""
    kept = stored(pairings.select("i", *[f"{p}{c}" for p in "ab" for c in PLACE], "w"))
    for _ in range(rounds):
        field = stored(spread_ways(grid, kept, sigma, reach).drop("w"))
        rows = sampled(kept.withColumn("__key", F.col("i")), field, {c: F.col(f"a{c}") for c in PLACE})
        rated = rows.withColumn("residual", F.sqrt(sum(F.pow(F.col(f"a{c}") + F.col(f"w{c}") - F.col(f"b{c}"), 2) for c in PLACE)))
        bound = rated.agg((F.avg("residual") + times * F.stddev_pop("residual") + 1e-9).alias("bound"))
        bad = stored(rated.crossJoin(F.broadcast(bound)).where("residual > bound").select("i"))
        if bad.isEmpty():
            return field
        kept = stored(kept.join(bad, "i", "left_anti"))
    return spread_ways(grid, kept, sigma, reach).drop("w")


def resampled(image: DataFrame, field: DataFrame) -> DataFrame:
    """x, y, z, v: at each place of the field the image's value at place + way, the mean of the eight corners by volume;
    places that miss a corner are left out."""
    src = image.select(*PLACE, F.col("v").alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return sampled(_keyed(field), src, {c: F.col(c) + F.col(f"d{c}") for c in PLACE}).select(*PLACE, F.col("wx").alias("v"))
