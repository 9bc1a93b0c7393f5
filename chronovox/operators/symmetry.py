"""The symmetry plane of a body from its paired landmarks, and piecewise rotations about the plane's normal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions import angles
from chronovox.operators.checkpoints import stored

#: Small tables are broadcast up to so many rows.
FEW = 100_000


def met(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with small's columns: small is broadcast if it has few rows, which is looked up first."""
    return rows.join(F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small, on)


def fitted_line(points: DataFrame, by: list[str]) -> DataFrame:
    """`by`, mx, my, mz, ux, uy, uz, n: for each group of points (x, y, z, place) the mean and unit direction of the line of
    least squared distances. Sums are taken where the points lie; a group's six second moments alone meet in a task. The
    direction points to increasing `place` (its covariance with the abscissa is positive); ties and single points point
    to where their greatest entry is positive. Rows with nulls don't count; groups without others are absent."""
    whole = points.dropna(subset=["x", "y", "z"])
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = whole.groupBy(*by).agg(
        *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs],
        *[F.covar_pop("place", c).alias(f"p{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            m = np.empty((len(g), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = g[f"c{a}{b}"]
            u = np.linalg.eigh(m)[1][:, :, 2] if len(g) else np.empty((0, 3))
            way = np.sign(np.einsum("ij,ij->i", u, g[["px", "py", "pz"]].fillna(0).to_numpy()))
            top = np.sign(u[np.arange(len(g)), np.abs(u).argmax(1)])
            u = u * np.where(way == 0, top, way)[:, None]
            yield g[by + ["mx", "my", "mz", "n"]].assign(ux=u[:, 0], uy=u[:, 1], uz=u[:, 2])

    kinds = dict(whole.select(*by).dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["mx double, my double, mz double, n long, ux double, uy double, uz double"])
    return sums.mapInPandas(solve, schema)


def symmetry_plane(centres: DataFrame, line: DataFrame, by: list[str]) -> DataFrame:
    """`by`, bx, by_, bz, nx, ny, nz: the plane through each centre (bx, by_, bz) and its line, with a unit normal that
    turns the line's direction into the way from the line to the centre. Where the centre lies on the line the normal is null."""
    b = tuple(F.col(c) for c in ("bx", "by_", "bz"))
    n = angles.cross(angles.vector("u"), angles.minus(b, angles.vector("m")))
    length = angles.norm(n)
    return stored(met(centres, line, by).select(*by, "bx", "by_", "bz", *[F.when(length > 1e-12, x / length).alias(f"n{c}") for c, x in zip("xyz", n, strict=True)]))


def _in_plane(p: angles.Vector) -> angles.Vector:
    """From the centre to the foot of p on the plane."""
    b = tuple(F.col(c) for c in ("bx", "by_", "bz"))
    return angles.minus(angles.onto_plane(p, b, angles.vector("n")), b)


def _around(p: angles.Vector, origin: tuple[float, float, float]) -> Column:
    """The angle from the origin's foot to p's, from 0 to a full turn."""
    a = angles.oriented_angle(_in_plane(tuple(map(F.lit, origin))), _in_plane(p), angles.vector("n"))
    return F.when(a < 0, a + 2 * F.pi()).otherwise(a)


def knots(landmarks: DataFrame, plane: DataFrame, by: list[str], origin: tuple[float, float, float], nearest: float = 1.0, digits: int = 3) -> DataFrame:
    """`by`, knots (array of (at, turn), by at): where, around the centre, landmarks stand that must turn, and by how much.

    landmarks: `by`, name, x, y, z and the place to come to, rx, ry, rz. Angles are rounded to `digits`. Landmarks whose feet
    are within `nearest` of the centre don't tell an angle and are left out; of those of one angle the first by name counts."""
    own, goal = angles.vector(""), angles.vector("r")
    foot = _in_plane(own)
    rows = met(landmarks, plane, by).where(angles.norm(foot) > nearest)
    rows = rows.select(*by, "name", F.round(_around(own, origin), digits).alias("at"), angles.oriented_angle(_in_plane(goal), foot, angles.vector("n")).alias("turn"))
    first = Window.partitionBy(*by, "at").orderBy("name")
    rows = rows.where("at IS NOT NULL AND turn IS NOT NULL").withColumn("__k", F.row_number().over(first)).where("__k = 1")
    return stored(rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("knots")))


def turn_at(at: Column, knots: Column, circular: bool = False) -> Column:
    """The turn at an angle, linear between knots; outside of them that of the nearest one or, if `circular`, linear
    between the last and the first across the full turn."""
    below = F.size(F.filter(knots, lambda k: k["at"] <= at))
    n = F.size(knots)
    a, b = F.get(knots, below - 1), F.get(knots, below)
    if circular:
        full = 2 * F.pi()
        last, first = F.get(knots, n - 1), F.get(knots, F.lit(0))
        a_at, a_turn = F.coalesce(a["at"], last["at"] - full), F.coalesce(a["turn"], last["turn"])
        b_at, b_turn = F.coalesce(b["at"], first["at"] + full), F.coalesce(b["turn"], first["turn"])
        return a_turn + (b_turn - a_turn) * (at - a_at) / (b_at - a_at)
    return F.when(below == 0, b["turn"]).when(below == n, a["turn"]).otherwise(a["turn"] + (b["turn"] - a["turn"]) * (at - a["at"]) / (b["at"] - a["at"]))


def piecewise_turned(points: DataFrame, plane: DataFrame, knots: DataFrame, by: list[str], origin: tuple[float, float, float], circular: bool = False) -> DataFrame:
    """points with x, y, z turned about the plane's normal through its centre, by the angle that the knots give where each
    point stands, and that angle as `turn`. Points of groups without a plane or knots, or without a normal, stay with
    turn 0; null coordinates stay null. Planes and knots are a row a group; points aren't shuffled while these are few."""
    both = stored(met(plane, knots, by))
    tagged = points.join(F.broadcast(both) if both.limit(FEW + 1).count() <= FEW else both, by, "left")
    turn = F.coalesce(turn_at(_around(angles.vector(""), origin), F.col("knots"), circular), F.lit(0.0))
    b = tuple(F.col(c) for c in ("bx", "by_", "bz"))
    tagged = tagged.withColumn("turn", turn)
    moved = angles.turned(angles.minus(angles.vector(""), b), angles.vector("n"), F.col("turn"))
    new = [F.when(F.col("turn") == 0, F.col(c)).otherwise(m + o).alias(c) for c, m, o in zip("xyz", moved, b, strict=True)]
    return tagged.select(*[c for c in points.columns if c not in "xyz"], *new, "turn")
