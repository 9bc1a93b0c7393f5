"""Fits of linear transformations to pairings, their algebra, and block matching. A transformation is m: 16 numbers of a
4 x 4 matrix, row by row. pairings: g, i, points a (ax, ay, az) and their images b (bx, by, bz), and w if weighted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.operators import voxels
from chronovox.operators.checkpoints import stored

KINDS = ("translation", "scaling", "rigid", "similitude", "affine")
IDENTITY = np.eye(4)


def solved(kind: str, n: float, a: np.ndarray, b: np.ndarray, aa: np.ndarray, ab: np.ndarray, bb: float) -> np.ndarray | None:
    """The 4 x 4 matrix of least squares from moments: sums of weights, of a, of b, of a a^T, of a b^T, of |b|^2."""
    if not n > 0:
        return None
    ca, cb = a / n, b / n
    saa, sab = aa - n * np.outer(ca, ca), ab - n * np.outer(ca, cb)
    if kind == "translation":
        linear = np.eye(3)
    elif kind == "scaling":
        spread = np.diag(saa)
        linear = np.diag(np.where(spread > 1e-12, np.diag(sab) / np.where(spread > 1e-12, spread, 1), 1.0))
    elif kind == "affine":
        linear = np.linalg.lstsq(saa, sab, rcond=None)[0].T
    else:
        left, _, right = np.linalg.svd(sab)
        flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(right.T @ left.T)) or 1.0])
        linear = right.T @ flip @ left.T
        if kind == "similitude" and np.trace(saa) > 1e-12:
            linear = linear * (np.trace(linear @ sab) / np.trace(saa))
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = linear, cb - linear @ ca
    return out


def fitted(pairings: DataFrame, kind: str = "affine", weighted: bool = False) -> DataFrame:
    """g, m, n: the least-squares transformation of each group. Spark sums the moments; what is solved in Python is one
    row of 24 numbers a group. A group whose weights sum to 0 has a null m."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    s = lambda e, n: F.sum(w * e).alias(n)
    sums = [F.sum(w).alias("sw"), F.count(F.lit(1)).alias("n"), *[s(F.col(f"{p}{c}"), f"s{p}{c}") for p in "ab" for c in "xyz"],
            *[s(F.col(f"a{c}") * F.col(f"{p}{d}"), f"a{p}{c}{d}") for p in "ab" for c in "xyz" for d in "xyz"], s(sum(F.col(f"b{c}") * F.col(f"b{c}") for c in "xyz"), "bb")]
    moments = pairings.groupBy("g").agg(*sums)

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                vec = lambda p: np.array([r[f"s{p}{c}"] for c in "xyz"])
                mat = lambda p: np.array([[r[f"a{p}{c}{d}"] for d in "xyz"] for c in "xyz"])
                m = solved(kind, r["sw"], vec("a"), vec("b"), mat("a"), mat("b"), r["bb"])
                out.append((r["g"], None if m is None else m.ravel().tolist(), r["n"]))
            yield pd.DataFrame(out, columns=["g", "m", "n"])

    return moments.mapInPandas(solve, f"g {pairings.schema['g'].dataType.simpleString()}, m array<double>, n long")


def image_of(m: str | Column, p: str) -> list[Column]:
    """The three coordinates of point p (px, py, pz) under the matrix in column m."""
    m = F.col(m) if isinstance(m, str) else m
    return [sum((m[4 * r + k] * F.col(f"{p}{c}") for k, c in enumerate("xyz")), m[4 * r + 3]) for r in range(3)]


def residuals(pairings: DataFrame, fits: DataFrame) -> DataFrame:
    """pairings with residual: the distance of b from the image of a."""
    j = pairings.join(fits.select("g", F.col("m").alias("__m")), "g")
    d = sum((x - F.col(f"b{c}")) * (x - F.col(f"b{c}")) for x, c in zip(image_of("__m", "a"), "xyz", strict=True))
    return j.withColumn("residual", F.sqrt(d)).drop("__m")


def residual_statistics(rated: DataFrame, times: float = 3.0) -> DataFrame:
    """g, mean, deviation (of the population), bound = mean + times * deviation."""
    s = rated.groupBy("g").agg(F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("deviation"))
    return s.withColumn("bound", F.col("mean") + times * F.col("deviation"))


def trimmed_fit(pairings: DataFrame, kind: str = "affine", fraction: float = 0.5, rounds: int = 100, weighted: bool = False, sigma: float = -1.0, still: float = 1e-6) -> DataFrame:
    """g, m, n by least trimmed squares: fit, keep the int(fraction * n) pairings of least residual (at most mean + sigma *
    deviation if sigma > 0; ties by i), fit again, until no group's matrix moves by more than `still`."""
    pairings = stored(pairings)
    fit = stored(fitted(pairings, kind, weighted))
    for _ in range(rounds):
        rated = residuals(pairings, fit)
        w = Window.partitionBy("g")
        ranked = rated.withColumns({"__r": F.row_number().over(w.orderBy(F.round("residual", 9), "i")), "__n": F.count(F.lit(1)).over(w)})
        kept = ranked.where(F.col("__r") <= F.floor(F.col("__n") * fraction))
        if sigma > 0:
            kept = kept.join(residual_statistics(rated, sigma).select("g", "bound"), "g").where("residual <= bound").drop("bound")
        new = stored(fitted(kept, kind, weighted))
        gap = F.array_max(F.zip_with("m", "o", lambda x, y: F.abs(x - y)))
        moved = new.join(fit.select("g", F.col("m").alias("o")), "g").where(gap > still).isEmpty()
        fit = new
        if moved:
            break
    return fit


def product(p: Column, q: Column) -> Column:
    """p q as an expression: first q, then p."""
    return F.array(*[sum((p[4 * r + k] * q[4 * k + c] for k in range(1, 4)), p[4 * r] * q[c]) for r in range(4) for c in range(4)])


def composed(steps: DataFrame) -> DataFrame:
    """g, m: the product of each group's matrices (g, k, m) in order of k, the last applied first. A chain is folded in one
    row; it is a list of frames, 16 numbers each."""
    chain = steps.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("l"))
    one = F.array(*[F.lit(float(x)) for x in IDENTITY.ravel()])
    return chain.select("g", F.aggregate("l", one, product).alias("m"))


def inverted(m: Column) -> Column:
    """The inverse of an affine matrix by cofactors; null where it has none."""
    a = [[m[4 * r + c] for c in range(3)] for r in range(3)]
    cof = lambda r, c: a[(r + 1) % 3][(c + 1) % 3] * a[(r + 2) % 3][(c + 2) % 3] - a[(r + 1) % 3][(c + 2) % 3] * a[(r + 2) % 3][(c + 1) % 3]
    det = sum((a[0][c] * cof(0, c) for c in range(1, 3)), a[0][0] * cof(0, 0))
    inv = [[cof(c, r) / det for c in range(3)] for r in range(3)]
    shift = [-sum((inv[r][c] * m[4 * c + 3] for c in range(1, 3)), inv[r][0] * m[3]) for r in range(3)]
    rows = [x for r in range(3) for x in (*inv[r], shift[r])] + [F.lit(0.0)] * 3 + [F.lit(1.0)]
    return F.when(det != 0, F.array(*rows))


def part_way(m: Column, s: float) -> Column:
    """A rigid transformation gone the share s of its way: the angle about its axis and the translation times s."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[5] + m[10] - 1) / 2))
    angle = F.acos(cosine)
    raw = (m[9] - m[6], m[2] - m[8], m[4] - m[1])
    length = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    k = [F.when(length > 1e-12, x / length).otherwise(0.0) for x in raw]
    si, co = F.sin(angle * s), F.cos(angle * s)
    skew = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    rows = []
    for r in range(3):
        rows += [(co if r == c else F.lit(0.0)) + skew[r][c] * si + k[r] * k[c] * (1 - co) for c in range(3)] + [m[4 * r + 3] * s]
    return F.when(length > 1e-12, F.array(*rows, *[F.lit(0.0)] * 3, F.lit(1.0))).otherwise(
        F.array(*[m[4 * r + 3] * s if c == 3 else F.lit(float(r == c)) for r in range(3) for c in range(4)], *[F.lit(0.0)] * 3, F.lit(1.0)))


def rescaled(m: Column, source: tuple[float, float, float], target: tuple[float, float, float], to_real: bool = True) -> Column:
    """A matrix between voxel numbers as one between real places (or back), for the two images' voxel sizes."""
    s, t = (*source, 1.0), (*target, 1.0)
    return F.array(*[m[4 * r + c] * ((t[r] / s[c]) if to_real else (s[c] / t[r])) for r in range(4) for c in range(4)])


def best_blocks(image: DataFrame, width: int, keep: float) -> DataFrame:
    """bx, by, bz, variance: the share `keep` of blocks of most variance; ties by place."""
    s = voxels.block_statistics(image, width)
    # One row a block, not a voxel: the ranking is over blocks.
    ranked = s.withColumns({"r": F.row_number().over(Window.orderBy(F.desc(F.round("variance", 9)), "bx", "by", "bz")), "m": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.where(F.col("r") <= F.ceil(F.col("m") * keep)).select("bx", "by", "bz", "variance")


def matched_blocks(floating: DataFrame, reference: DataFrame, width: int = 4, half: int = 2, keep: float = 0.75, least: float = 0.0) -> DataFrame:
    """g, i, ax..az, bx..bz, w: the best blocks of the floating image, centre to centre, with the place within +-half of the
    reference of most squared correlation (the weight); ties to the nearest place, then the least offset."""
    cell = {f"k{c}": F.floor(F.col(c) / width) for c in "xyz"}
    top = best_blocks(floating, width, keep).select(*[F.col(f"b{c}").alias(f"k{c}") for c in "xyz"])
    own = floating.withColumns(cell).join(top, list(cell), "left_semi")
    axis = F.sequence(F.lit(-half), F.lit(half))
    for c in "xyz":
        own = own.withColumn(f"o{c}", F.explode(axis))
    both = own.select(*cell, "ox", "oy", "oz", *[(F.col(c) + F.col(f"o{c}")).alias(c) for c in "xyz"], "v").join(reference.select("x", "y", "z", F.col("v").alias("u")), ["x", "y", "z"])
    s = both.groupBy(*cell, "ox", "oy", "oz").agg(F.covar_pop("v", "u").alias("c"), F.var_pop("v").alias("p"), F.var_pop("u").alias("q"), F.count(F.lit(1)).alias("n"))
    s = s.where((F.col("p") > 1e-9) & (F.col("q") > 1e-9)).withColumn("cc", F.col("c") * F.col("c") / (F.col("p") * F.col("q"))).where(F.col("cc") > least)
    far = F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") + F.col("oz") * F.col("oz")
    best = s.groupBy(*cell).agg(F.max_by(F.struct("ox", "oy", "oz", "cc"), F.struct(F.round("cc", 9), "n", -far, -F.col("ox"), -F.col("oy"), -F.col("oz"))).alias("s"))
    mid = (width - 1) / 2
    a = {c: F.col(f"k{c}") * width + mid for c in "xyz"}
    return best.select(F.lit(0).alias("g"), F.concat_ws(",", *cell).alias("i"), *[a[c].alias(f"a{c}") for c in "xyz"], *[(a[c] + F.col(f"s.o{c}")).alias(f"b{c}") for c in "xyz"], F.col("s.cc").alias("w"))


def between_extents(floating: DataFrame, reference: DataFrame) -> np.ndarray | None:
    """The translation between the mean places of two images' voxels, if either image has one value only; else none."""
    a, b = (i.agg(*[F.avg(c).alias(c) for c in "xyz"], (F.max("v") - F.min("v")).alias("spread")).collect()[0] for i in (floating, reference))
    if a["spread"] is None or b["spread"] is None or min(a["spread"], b["spread"]) ** 2 > 1e-9:
        return None
    out = np.eye(4)
    out[:3, 3] = [b[c] - a[c] for c in "xyz"]
    return out


def block_matching(floating: DataFrame, reference: DataFrame, kind: str = "rigid", levels: int = 2, rounds: int = 4, width: int = 4, half: int = 2, keep: float = 0.75, fraction: float = 0.75) -> np.ndarray:
    """The 4 x 4 matrix from voxels of the floating image to those of the reference: from the coarsest level of the pyramid
    on, move the floating image, match blocks, fit with trimming, compose, until the matrix stays or the rounds are over.
    No block of an image of one value varies: there the step is from the mean place of the floating image's voxels to that
    of the reference's. Only matrices come to the driver."""
    pyramids = [(stored(floating.select("x", "y", "z", "v")), stored(reference.select("x", "y", "z", "v")))]
    for _ in range(levels - 1):
        pyramids.append(tuple(stored(voxels.pyramid(i).drop("n")) for i in pyramids[-1]))
    total = np.eye(4)
    for level in range(levels - 1, -1, -1):
        flo, ref = pyramids[level]
        up = np.diag([2.0**level] * 3 + [1.0])
        shift = np.eye(4)
        shift[:3, 3] = (2.0**level - 1) / 2
        real = shift @ up
        for _ in range(rounds):
            own = np.linalg.inv(real) @ total @ real
            moved = stored(resampled(flo, own))
            fit = trimmed_fit(matched_blocks(moved, ref, width, half, keep), kind, fraction, 10, weighted=True).collect()
            found = np.array(fit[0]["m"]).reshape(4, 4) if fit and fit[0]["m"] is not None else between_extents(moved, ref)
            if found is None:
                break
            step = real @ found @ np.linalg.inv(real)
            total = step @ total
            if np.abs(step - np.eye(4)).max() < 1e-3:
                break
    return total


def resampled(image: DataFrame, matrix: np.ndarray, linear: bool = True) -> DataFrame:
    """The image moved by the matrix onto the whole-numbered grid. Each grid place within reach of a moved voxel asks, by the
    inverse, for the values around its origin: the nearest voxel, or the mean of the eight corners by volume (places that
    miss a corner are left out)."""
    back = np.linalg.inv(matrix)
    reach = int(np.ceil(np.abs(matrix[:3, :3]).sum(axis=1).max())) if linear else int(np.ceil(np.abs(matrix[:3, :3]).sum(axis=1).max() / 2))
    line = lambda m, r: sum((F.col(c) * float(m[r, k]) for k, c in enumerate("xyz")), F.lit(float(m[r, 3])))
    near = image.select(*[F.floor(line(matrix, r) + 0.5).alias(c) for r, c in enumerate("xyz")])
    o = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", (i, j, k), strict=True)]) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1)]))
    grid = near.distinct().withColumn("o", o).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"]).distinct()
    at = grid.select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"), *[F.round(line(back, r), 9).alias(f"f{c}") for r, c in enumerate("xyz")])
    src = image.select("x", "y", "z", "v")
    if not linear:
        return at.select("gx", "gy", "gz", *[F.floor(F.col(f"f{c}") + 0.5).alias(c) for c in "xyz"]).join(src, ["x", "y", "z"]).select(*[F.col(f"g{c}").alias(c) for c in "xyz"], "v")
    corner = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", (i, j, k), strict=True)]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    e = at.withColumn("o", corner)
    low = {c: F.floor(F.col(f"f{c}")) for c in "xyz"}
    share = [F.when(F.col(f"o.{c}") == 1, F.col(f"f{c}") - low[c]).otherwise(1 - (F.col(f"f{c}") - low[c])) for c in "xyz"]
    e = e.select("gx", "gy", "gz", *[(low[c] + F.col(f"o.{c}")).alias(c) for c in "xyz"], (share[0] * share[1] * share[2]).alias("w")).where("w > 0")
    got = e.join(src, ["x", "y", "z"]).groupBy("gx", "gy", "gz").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("v")).alias("v"))
    return got.where("s > 1 - 1e-6").select(*[F.col(f"g{c}").alias(c) for c in "xyz"], "v")
