"""Links between frames, speeds, interpolation along tracks, assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.operators.lineage import along


def linked(detections: DataFrame) -> DataFrame:
    """t, cell, parent, linked, lost. detections: t, cell, parent (-1: none). linked (0 or 1): the parent is a cell of the
    frame before; lost: a parent is named that isn't there."""
    before = detections.select((F.col("t") + 1).alias("t"), F.col("cell").alias("parent"), F.lit(1).alias("linked")).distinct()
    out = detections.select("t", "cell", "parent").join(before, ["t", "parent"], "left")
    lost = F.col("linked").isNull() & (F.col("parent") != -1)
    return out.select("t", "cell", "parent", F.coalesce("linked", F.lit(0)).alias("linked"), lost.cast("int").alias("lost"))


def speeds(tracks: DataFrame, size: float = 1.0) -> DataFrame:
    """track, t, id, speed: the way since the detection before, in units of `size`, by the frames between; null at the start."""
    w = along()
    return tracks.select("track", "t", "id", (F.abs(F.col("v") - F.lag("v").over(w)) * size / (F.col("t") - F.lag("t").over(w))).alias("speed"))


def interpolated(knots: DataFrame, at: DataFrame, beyond: str = "clamp") -> DataFrame:
    """track, t, v: piecewise linear through knots (track, t, v; one a frame) at the asked places (track, t).

    beyond the knots: `clamp`, `zero` or `extrapolate` (with the nearest segment's slope; a lone knot's is 0). A track
    without knots gives null. One scan of windows over the union of both sides."""
    if beyond not in ("clamp", "zero", "extrapolate"):
        raise ValueError(f"unknown rule beyond the knots: {beyond}")
    w = along()
    slope = (F.lead("v").over(w) - F.col("v")) / (F.lead("t").over(w) - F.col("t"))
    k = knots.select("track", "t", "v", slope.alias("out")).withColumn("into", F.lag("out").over(w))
    k = k.select("track", "t", F.struct("t", "v", F.coalesce("out", "into", F.lit(0.0)).alias("out"), F.coalesce("into", "out", F.lit(0.0)).alias("into")).alias("k"))
    both = k.withColumn("asked", F.lit(False)).unionByName(at.select("track", "t", F.lit(True).alias("asked")), allowMissingColumns=True)
    both = both.withColumns({
        "a": F.last("k", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "b": F.last("k", ignorenulls=True).over(Window.partitionBy("track").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)),
    }).where("asked")
    ends = {
        "clamp": (F.col("b.v"), F.col("a.v")),
        "zero": (F.lit(0.0), F.lit(0.0)),
        "extrapolate": (F.col("b.v") + F.col("b.out") * (F.col("t") - F.col("b.t")), F.col("a.v") + F.col("a.into") * (F.col("t") - F.col("a.t"))),
    }[beyond]
    inner = F.when(F.col("a.t") == F.col("b.t"), F.col("a.v")).otherwise(
        F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    none = F.col("a").isNull() & F.col("b").isNull()
    return both.select("track", "t", F.when(none, None).when(F.col("a").isNull(), ends[0]).when(F.col("b").isNull(), ends[1]).otherwise(inner).alias("v"))


def weighted_translation(pairings: DataFrame, weight: Column) -> DataFrame:
    """g, dx, dy, dz: the weighted mean of b - a. Null where the weights sum to 0."""
    total = F.sum(weight)
    return pairings.groupBy("g").agg(*[F.when(total != 0, F.sum(weight * (F.col(f"b{c}") - F.col(f"a{c}"))) / total).alias(f"d{c}") for c in "xyz"])


def _least_assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment; rows <= columns. Rows enter one by one, each by a shortest
    augmenting path over reduced costs."""
    n, m = cost.shape
    row_of, u, v = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, last, length = start, -1, 0.0
        while row >= 0:
            through = length + cost[row] - u[row] - v
            shorter = ~done & (through < reach)
            reach[shorter], via[shorter] = through[shorter], last
            last = int(np.argmin(np.where(done, np.inf, reach)))
            length, done[last] = reach[last], True
            row = row_of[last]
        inside = np.flatnonzero(done)
        u[start] += length
        taken = inside[row_of[inside] >= 0]
        u[row_of[taken]] += length - reach[taken]
        v[inside] -= length - reach[inside]
        while last >= 0:
            before = via[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


class _Distances:
    """The matrix of distances between two lists of points, a row at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.shape = a, b, (len(a), len(b))

    def __getitem__(self, row: int) -> np.ndarray:
        return np.sqrt(np.square(self.b - self.a[row]).sum(axis=1))


def assigned_points(left: DataFrame, right: DataFrame) -> DataFrame:
    """t, g, a, b, cost: within each t and g the one-to-one pairs of points of least total distance, as many as the smaller
    side has. left, right: t, g, id, x, y, z; a null g pairs with nothing. Points meet as points, never as a table of pairs,
    so a task holds a group's rows only; its time still grows with the cube of the group."""

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"t": [], "g": [], "a": [], "b": [], "cost": []})
        a, b = a.sort_values("id"), b.rename(columns=lambda c: c.removeprefix("__")).sort_values("id")
        flip = len(a) > len(b)
        few, many = (b, a) if flip else (a, b)
        costs = _Distances(few[list("xyz")].to_numpy(float), many[list("xyz")].to_numpy(float))
        to = _least_assignment(costs)
        own, other = few["id"].to_numpy(), many["id"].to_numpy()[to]
        return pd.DataFrame({"t": key[0], "g": key[1], "a": other if flip else own, "b": own if flip else other, "cost": [costs[i][j] for i, j in enumerate(to)]})

    # The right side's names are its own, lest the two sides of one table be taken for the same columns.
    columns = ["t", "g", "id", "x", "y", "z"]
    sides = [left.where("g IS NOT NULL").select(*columns).groupBy("t", "g"), right.where("g IS NOT NULL").select(*[F.col(c).alias(f"__{c}") for c in columns]).groupBy("__t", "__g")]
    kind = {c: left.schema[c].dataType.simpleString() for c in ("t", "g", "id")}
    return sides[0].cogroup(sides[1]).applyInPandas(solve, f"t {kind['t']}, g {kind['g']}, a {kind['id']}, b {right.schema['id'].dataType.simpleString()}, cost double")


def assigned(costs: DataFrame) -> DataFrame:
    """g, a, b, cost: within each group (a landmark's few candidates) the one-to-one pairs of least total cost, as many as
    the smaller side has. costs: g, a, b, cost, one row for each pair of a group."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="a", columns="b", values="cost")
        flip = table.shape[0] > table.shape[1]
        matrix = (table.T if flip else table).to_numpy(dtype=float)
        to = _least_assignment(matrix)
        i = np.arange(len(to))
        a, b = (to, i) if flip else (i, to)
        return pd.DataFrame({"g": rows["g"].iloc[0], "a": table.index[a], "b": table.columns[b], "cost": matrix[i, to]})

    kind = {c: costs.schema[c].dataType.simpleString() for c in ("g", "a", "b")}
    return costs.select("g", "a", "b", "cost").groupBy("g").applyInPandas(solve, f"g {kind['g']}, a {kind['a']}, b {kind['b']}, cost double")
