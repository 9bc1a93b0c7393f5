"""Transformations and their fits. pairings: g, and points a (ax, ay, az) with their images b (bx, by, bz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def applied(matrix: list[list[float]]) -> list[Column]:
    """x, y, z under a 4 x 4 matrix."""
    return [sum((F.col(c) * float(m) for c, m in zip("xyz", row[:3], strict=True)), F.lit(float(row[3]))).alias(n) for row, n in zip(matrix, ("x", "y", "z"), strict=False)]


def translation(pairings: DataFrame) -> DataFrame:
    return pairings.groupBy("g").agg(*[F.avg(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"d{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"))


def residuals(pairings: DataFrame) -> DataFrame:
    fit = translation(pairings).drop("n")
    r = sum(F.pow(F.col(f"b{c}") - F.col(f"a{c}") - F.col(f"d{c}"), 2) for c in "xyz")
    return pairings.join(fit, "g").withColumn("residual", F.sqrt(r)).drop("dx", "dy", "dz")


def trimmed_translation(pairings: DataFrame, fraction: float) -> DataFrame:
    """One step of least trimmed squares: the fit of the int(fraction * n) pairings of least residual, ties by i."""
    w = Window.partitionBy("g")
    ranked = residuals(pairings).withColumns({"r": F.row_number().over(w.orderBy(F.round("residual", 9), "i")), "m": F.count(F.lit(1)).over(w)})
    return translation(ranked.where(F.col("r") <= F.floor(F.col("m") * fraction)))


def composed(steps: DataFrame) -> DataFrame:
    """t, dx, dy, dz: translations to the first frame, composed along t within each track."""
    w = Window.partitionBy("track").orderBy("t")
    return steps.select("track", "t", *[F.sum(c).over(w).alias(c) for c in ("dx", "dy", "dz")])


def line_fit(pairings: DataFrame) -> DataFrame:
    """Least squares b = s * a + c for each axis, from moments."""
    out = []
    for c in "xyz":
        s = F.regr_slope(f"b{c}", f"a{c}")
        out += [s.alias(f"s{c}"), F.regr_intercept(f"b{c}", f"a{c}").alias(f"c{c}")]
    return pairings.groupBy("g").agg(*out)
