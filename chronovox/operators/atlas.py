"""Shells along rays, non-linear displacement between two shells, landmark pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.operators import spatial
from chronovox.operators.flow import both_ways


def shells(points: DataFrame, rays: DataFrame, radius: float, inner: float = 0.2, outer: float = 0.8, fewest: int = 10, width: float = 5.0) -> DataFrame:
    """ray, low, high: quantiles of the abscissas, ahead of the origin, of points nearer than `radius` to a ray. Abscissas
    beyond `width` deviations from the ray's mean go first; rays of at most `fewest` points are left out. points: x, y, z
    from the origin. rays: ray, ux, uy, uz (unit vectors), a list of directions that doesn't grow with the points; it is
    broadcast if small, and every point meets every ray, which is what the operator asks."""
    s = sum(F.col(c) * F.col(f"u{c}") for c in "xyz")
    off = sum(F.pow(F.col(c) - F.col("s") * F.col(f"u{c}"), 2) for c in "xyz")
    near = points.select("x", "y", "z").crossJoin(rays).withColumn("s", s).where((F.col("s") > 0) & (off < radius * radius)).select("ray", "s")
    stat = near.groupBy("ray").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d"))
    fine = near.join(stat, "ray").where(F.abs(F.col("s") - F.col("m")) <= width * F.col("d"))
    out = fine.groupBy("ray").agg(F.percentile("s", F.lit(inner)).alias("low"), F.percentile("s", F.lit(outer)).alias("high"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") > fewest).drop("n")


def pulled(points: DataFrame, shell: DataFrame, k: int = 2) -> DataFrame:
    """id, t, vx, vy, vz, w: for each point the vectors of its k nearest places on a shell and of their Gabriel neighbours,
    each once, with weight 1 / distance. shell: id, t, x, y, z and target tx, ty, tz. A point on a place takes it alone."""
    places = shell.select("id", "t", "x", "y", "z")
    near = spatial.knn(points, places, k, itself=True).select(F.col("a").alias("p"), "t", F.col("b").alias("s"))
    graph = both_ways(spatial.gabriel(places))
    more = near.join(graph.select("t", F.col("a").alias("s"), F.col("b").alias("o")), ["t", "s"]).select("p", "t", F.col("o").alias("s"))
    pairs = near.unionByName(more).distinct()
    at = points.select(F.col("id").alias("p"), "t", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    goal = shell.select(F.col("id").alias("s"), "t", "x", "y", "z", "tx", "ty", "tz")
    d = F.sqrt(sum(F.pow(F.col(f"p{c}") - F.col(c), 2) for c in "xyz"))
    return pairs.join(at, ["p", "t"]).join(goal, ["s", "t"]).select(F.col("p").alias("id"), "t", *[(F.col(f"t{c}") - F.col(c)).alias(f"v{c}") for c in "xyz"], d.alias("d"))


def displaced(points: DataFrame, low: DataFrame, high: DataFrame, k: int = 2) -> DataFrame:
    """id, t, x, y, z: points moved by the mean vector of both shells, weighted by 1 / distance; where distances are 0, by
    the mean of those vectors. Frames without shells leave points where they are."""
    v = pulled(points, low, k).unionByName(pulled(points, high, k))
    zero = F.max((F.col("d") == 0).cast("int"))
    w = F.when(F.col("d") > 0, 1 / F.col("d"))
    on = F.when(F.col("d") == 0, 1.0)
    mean = v.groupBy("id", "t").agg(*[F.when(zero == 1, F.sum(on * F.col(f"v{c}")) / F.sum(on)).otherwise(F.sum(w * F.col(f"v{c}")) / F.sum(w)).alias(f"v{c}") for c in "xyz"])
    return points.select("id", "t", "x", "y", "z").join(mean, ["id", "t"], "left").select("id", "t", *[(F.col(c) + F.coalesce(f"v{c}", F.lit(0.0))).alias(c) for c in "xyz"])


def mirrored_pairs(landmarks: DataFrame, left: str = "LS", right: str = "RS") -> DataFrame:
    """name, t, ax..az, bx..bz: landmarks whose name holds `left` with those of the same name with `right` in its place."""
    a = landmarks.where(F.col("name").contains(left)).select("name", F.replace("name", F.lit(left), F.lit(right)).alias("other"), "t", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = landmarks.select(F.col("name").alias("other"), "t", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return a.join(b, ["other", "t"]).drop("other")
