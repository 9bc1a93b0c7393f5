"""Sums of curves fitted to points (x, y, and w if weighted) by Levenberg and Marquardt's method: Spark sums the normal
equations, the driver solves a few unknowns and decides on the damping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.operators.checkpoints import stored

Terms = tuple[Column, list[Column]]


def gaussian(x: Column, p: list[float]) -> Terms:
    """p0 exp(-((x - p1) / p2)^2 / 2)"""
    u = (x - p[1]) / p[2]
    e = F.exp(-u * u / 2)
    return p[0] * e, [e, p[0] * e * u / p[2], p[0] * e * u * u / p[2]]


def two_sided(x: Column, p: list[float]) -> Terms:
    """A Gaussian of width p2 below its top p1 and p3 above."""
    left = x < p[1]
    u = (x - p[1]) / F.when(left, F.lit(p[2])).otherwise(p[3])
    e = F.exp(-u * u / 2)
    to = lambda side, s: F.when(side, p[0] * e * u * u / s).otherwise(0.0)
    return p[0] * e, [e, p[0] * e * u / F.when(left, F.lit(p[2])).otherwise(p[3]), to(left, p[2]), to(~left, p[3])]


def rayleigh(x: Column, p: list[float]) -> Terms:
    """p0 (x - p1) exp(-((x - p1) / p2)^2 / 2) from p1 on, 0 below."""
    u = (x - p[1]) / p[2]
    e = F.exp(-u * u / 2)
    there = lambda c: F.when(u >= 0, c).otherwise(0.0)
    return there(p[0] * (x - p[1]) * e), [there((x - p[1]) * e), there(p[0] * e * (u * u - 1)), there(p[0] * (x - p[1]) * e * u * u / p[2])]


def saturation(x: Column, p: list[float]) -> Terms:
    """p0 x / (p1 + x), 0 at the pole."""
    part = F.when(x + p[1] != 0, x / (x + p[1])).otherwise(0.0)
    return p[0] * part, [part, F.when(x + p[1] != 0, -p[0] * part / (x + p[1])).otherwise(0.0)]


#: Curves by name, with their numbers of parameters.
CURVES = {"gaussian": (gaussian, 3), "two_sided": (two_sided, 4), "rayleigh": (rayleigh, 3), "saturation": (saturation, 2)}


def _split(kinds: list[str], values: list[float]) -> list[list[float]]:
    out, at = [], 0
    for kind in kinds:
        n = CURVES[kind][1]
        out.append(values[at : at + n])
        at += n
    return out


def curve(kinds: list[str], values: list[float], x: Column) -> Terms:
    """The sum of curves of the given kinds and its derivatives by all parameters, as expressions of x."""
    parts = [CURVES[kind][0](x, p) for kind, p in zip(kinds, _split(kinds, values), strict=True)]
    return sum((v for v, _ in parts[1:]), parts[0][0]), [d for _, ds in parts for d in ds]


def fitted(points: DataFrame, kinds: list[str], start: list[float], rounds: int = 200, still: float = 1e-10) -> tuple[list[float], float, bool]:
    """Parameters of the sum of curves of least (weighted) squares, their sum, and whether it settled.

    One job a round adds up (n + 1)(n + 2) / 2 numbers for n parameters, whatever the number of points. A step that makes
    the sum smaller is taken and the damping falls tenfold, one that doesn't raises it tenfold; it has settled when a step
    lowers the sum by less than the share `still`, or none lowers it at all. Points with a null or a value that isn't finite
    don't count; no points give the start."""
    if unknown := set(kinds) - set(CURVES):
        raise ValueError(f"unknown curves: {sorted(unknown)}")
    if len(start) != sum(CURVES[k][1] for k in kinds) or not kinds:
        raise ValueError("a start has a number for each parameter")
    w = F.col("w").cast("double") if "w" in points.columns else F.lit(1.0)
    rows = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w"))
    rows = stored(rows.where(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('infinity')" for c in "xyw")))
    n = len(start)

    def sums(values: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        """The sum of squares, the gradient's half and the normal matrix, in one job."""
        value, slopes = curve(kinds, values, F.col("x"))
        own = rows.select("w", (F.col("y") - value).alias("r"), *[d.alias(f"d{i}") for i, d in enumerate(slopes)])
        total = lambda a, b: F.coalesce(F.sum(F.col("w") * F.col(a) * F.col(b)), F.lit(0.0))
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        got = own.agg(total("r", "r"), *[total("r", f"d{i}") for i in range(n)], *[total(f"d{i}", f"d{j}") for i, j in pairs]).collect()[0]
        normal = np.zeros((n, n))
        for (i, j), s in zip(pairs, got[n + 1 :], strict=True):
            normal[i, j] = normal[j, i] = s
        return got[0], np.array(got[1 : n + 1]), normal

    now, damping = [float(s) for s in start], 1e-3
    error, way, normal = sums(now)
    for _ in range(rounds):
        if error == 0 or not np.abs(way).max() > 0:
            return now, error, True
        weight = np.where(np.diag(normal) > 0, np.diag(normal), 1.0)
        step = np.linalg.solve(normal + damping * np.diag(weight), way)
        then = [a + float(b) for a, b in zip(now, step, strict=True)]
        tried = sums(then)
        if np.isfinite(tried[0]) and tried[0] < error:
            gain = (error - tried[0]) / error
            now, damping = then, max(damping / 10, 1e-12)
            error, way, normal = tried
            if gain < still:
                return now, error, True
        else:
            damping *= 10
            if damping > 1e12:
                return now, error, True
    return now, error, False
