"""Images resampled by cubic B-splines through their voxels, moved by a matrix or a vector field."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.operators.bricks import in_bricks
from chronovox.operators.checkpoints import stored
from chronovox.operators.recursive import Pass, filtered

PLACE = ["x", "y", "z"]
#: The pole of the filter whose response turns values into weights of cubic B-splines: sqrt(3) POLE^|n|.
POLE = math.sqrt(3) - 2


def weights(image: DataFrame) -> DataFrame:
    """x, y, z, v: weights of the B-splines whose sum passes through all voxels of an image (x, y, z, v; absent voxels are
    0), at all places of its bounding box and two beyond it."""
    box = image.agg(*[f(c).cast("long").alias(f"{n}{c}") for c in PLACE for n, f in (("a", F.min), ("b", F.max))]).where("ax IS NOT NULL")
    ends = [box.select(*[(F.col(f"{n}{c}") + d).alias(c) for c in PLACE], F.lit(0.0).alias("v")) for n, d in (("a", -2), ("b", 2))]
    wide = image.select(*[F.col(c).cast("long").alias(c) for c in PLACE], F.col("v").cast("double").alias("v")).unionByName(ends[0]).unionByName(ends[1])
    both = [Pass({0: math.sqrt(3)}, [POLE]), Pass({1: math.sqrt(3) * POLE}, [POLE], reverse=True)]
    return filtered(wide, {c: [both] for c in PLACE})


def _taps(f: np.ndarray) -> np.ndarray:
    """The values at -1, 0, 1, 2 of the B-spline around f, 0 <= f < 1."""
    g = 1 - f
    return np.stack([g**3 / 6, (4 - 6 * f * f + 3 * f**3) / 6, (4 - 6 * g * g + 3 * g**3) / 6, f**3 / 6])


def sampled(spline: DataFrame, asked: DataFrame, low: dict[str, int], high: dict[str, int], width: int = 32) -> DataFrame:
    """x, y, z, v: for each row of asked (x, y, z and a place fx, fy, fz) within low to high the sum of the 64 B-splines around
    that place. Weights and questions meet in bricks of `width` voxels: each weight goes to the bricks that it reaches, each
    question to one."""
    inside = [F.col(f"f{c}").between(low[c], high[c]) for c in PLACE]
    at = asked.where(inside[0] & inside[1] & inside[2]).select(*PLACE, "fx", "fy", "fz", *[F.floor(F.floor(f"f{c}") / width).cast("long").alias(f"b{c}") for c in PLACE])

    def run(q: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        start = [int(q[f"b{c}"].iloc[0]) * width - 1 if len(q) else 0 for c in PLACE]
        grid = np.zeros([width + 3] * 3)
        place = w[PLACE].to_numpy() - start
        ok = ((place >= 0) & (place < width + 3)).all(1)
        grid[tuple(place[ok].T)] = w["v"].to_numpy()[ok]
        f = q[["fx", "fy", "fz"]].to_numpy(float)
        whole = np.floor(f)
        taps = [_taps(f[:, k] - whole[:, k]) for k in range(3)]
        base = (whole - start - 1).astype(int)
        total = np.zeros(len(q))
        for i in range(4):
            for j in range(4):
                for k in range(4):
                    total += taps[0][i] * taps[1][j] * taps[2][k] * grid[base[:, 0] + i, base[:, 1] + j, base[:, 2] + k]
        return q[PLACE].assign(v=total)

    brick = ["bx", "by", "bz"]
    near = in_bricks(spline.select(*PLACE, "v"), width, 2)
    return at.groupBy(*brick).cogroup(near.groupBy(*brick)).applyInPandas(run, "x long, y long, z long, v double")


def _bounds(image: DataFrame) -> tuple[dict, dict] | None:
    box = image.agg(*[f(c).alias(f"{n}{c}") for c in PLACE for n, f in (("a", F.min), ("b", F.max))]).collect()[0]
    return None if box["ax"] is None else ({c: int(box[f"a{c}"]) for c in PLACE}, {c: int(box[f"b{c}"]) for c in PLACE})


def by_matrix(image: DataFrame, matrix: np.ndarray, onto: DataFrame, width: int = 32) -> DataFrame:
    """x, y, z, v: the image moved by a 4 x 4 matrix, at the places x, y, z of `onto` whose origins lie within the image's
    bounding box; absent voxels of the image are 0, whole-numbered moves give its voxels back. Polynomials up to the third
    degree are kept, but near the box's rim. An image without voxels gives none; repeated voxels count with the greatest
    value, null ones as 0."""
    back = np.linalg.inv(matrix)
    line = lambda r: F.round(sum((F.col(c) * float(back[r, k]) for k, c in enumerate(PLACE)), F.lit(float(back[r, 3]))), 9)
    return _at(image, onto.select(*[F.col(c).cast("long").alias(c) for c in PLACE]).select(*PLACE, *[line(r).alias(f"f{c}") for r, c in enumerate(PLACE)]), width)


def by_field(image: DataFrame, field: DataFrame, width: int = 32) -> DataFrame:
    """x, y, z, v: at each place of a field (x, y, z, dx, dy, dz) the image's value at place + way, where that lies within the
    image's bounding box. Otherwise like by_matrix()."""
    return _at(image, field.select(*[F.col(c).cast("long").alias(c) for c in PLACE], *[F.round(F.col(c) + F.col(f"d{c}"), 9).alias(f"f{c}") for c in PLACE]), width)


def _at(image: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    if not (box := _bounds(image)):
        return asked.select(*PLACE, F.lit(0.0).alias("v")).where("false")
    return sampled(stored(weights(image)), asked, *box, width)
