"""Queries of symmetry, topology and recursive filters; chronovox.catalog imports this module at its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronovox.catalog import _N, _V, _r, query
from chronovox.operators import recursive, symmetry, topology
from chronovox.sources import tables as t

#: Landmarks of the two sides of a frame: means of nodes by label; their middles; the line through these by the
#: trigonometric solution of a symmetric 3 x 3 matrix, whose greatest eigenvector is a cross product of two rows.
_SIDES = f"""{_N}, lm AS (SELECT t, label, (id // 8) % 2 AS side, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM n GROUP BY 1, 2, 3),
    mid AS (SELECT a.t, a.label, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM lm a JOIN lm b ON a.t = b.t AND a.label = b.label AND a.side = 0 AND b.side = 1),
    mo AS (SELECT t, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f,
        covar_pop(label, x) AS px, covar_pop(label, y) AS py, covar_pop(label, z) AS pz FROM mid GROUP BY 1),
    e1 AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM mo),
    e2 AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, (((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (p * p * p)) / 2))) / 3) AS l FROM e1),
    e3 AS (SELECT *, d * f - e * (b - l) AS wx, e * d - (a - l) * f AS wy, (a - l) * (b - l) - d * d AS wz FROM e2),
    ln AS (SELECT t, n, mx, my, mz, s * wx / w AS ux, s * wy / w AS uy, s * wz / w AS uz FROM (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS w, CASE WHEN px * wx + py * wy + pz * wz < 0 THEN -1 ELSE 1 END AS s FROM e3)),
    ce AS (SELECT t, avg(x) AS bx, avg(y) + 0.5 AS cy, avg(z) + 0.25 AS bz FROM n GROUP BY 1),
    nn AS (SELECT *, uy * (bz - mz) - uz * (cy - my) AS kx, uz * (bx - mx) - ux * (bz - mz) AS ky, ux * (cy - my) - uy * (bx - mx) AS kz FROM ce JOIN ln USING (t)),
    pl AS (SELECT t, bx, cy, bz, kx / k AS nx, ky / k AS ny, kz / k AS nz FROM (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS k FROM nn))"""


def _landmarks(spark, d):
    n = t.nodes(spark, d).withColumn("side", F.expr("(id div 8) % 2"))
    return n.groupBy("t", "label", "side").agg(*[F.avg(c).alias(c) for c in "xyz"])


def _plane(spark, d):
    lm = _landmarks(spark, d)
    other = lm.where("side = 1").select("t", "label", *[F.col(c).alias(f"o{c}") for c in "xyz"])
    mid = lm.where("side = 0").join(other, ["t", "label"]).select("t", F.col("label").alias("place"), *[((F.col(c) + F.col(f"o{c}")) / 2).alias(c) for c in "xyz"])
    line = symmetry.fitted_line(mid, ["t"])
    centre = t.nodes(spark, d).groupBy("t").agg(F.avg("x").alias("bx"), (F.avg("y") + 0.5).alias("by_"), (F.avg("z") + 0.25).alias("bz"))
    return line, symmetry.symmetry_plane(centre, line, ["t"])


@query(f"WITH {_SIDES} SELECT t, n, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, round(ux, 5) AS ux, round(uy, 5) AS uy, round(uz, 5) AS uz FROM ln")
def landmark_line(spark, d):
    return _plane(spark, d)[0].select("t", "n", _r("mx"), _r("my"), _r("mz"), _r("ux", 5), _r("uy", 5), _r("uz", 5))


@query(f"WITH {_SIDES} SELECT t, round(bx, 6) AS bx, round(cy, 6) AS cy, round(bz, 6) AS bz, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz FROM pl")
def symmetry_plane(spark, d):
    return _plane(spark, d)[1].select("t", _r("bx"), F.round("by_", 6).alias("cy"), _r("bz"), _r("nx", 5), _r("ny", 5), _r("nz", 5))


def _foot(x: str, y: str, z: str) -> str:
    """SQL: from the centre to the foot of a point on the plane."""
    s = f"(({x} - bx) * nx + ({y} - cy) * ny + ({z} - bz) * nz)"
    return f"{x} - bx - {s} * nx, {y} - cy - {s} * ny, {z} - bz - {s} * nz"


def _oriented(u: str, v: str) -> str:
    """SQL: the oriented angle of the lists u and v about the plane's normal."""
    turn = f"nx * ({u}[2] * {v}[3] - {u}[3] * {v}[2]) + ny * ({u}[3] * {v}[1] - {u}[1] * {v}[3]) + nz * ({u}[1] * {v}[2] - {u}[2] * {v}[1])"
    cosine = f"({u}[1] * {v}[1] + {u}[2] * {v}[2] + {u}[3] * {v}[3]) / sqrt(({u}[1] ** 2 + {u}[2] ** 2 + {u}[3] ** 2) * ({v}[1] ** 2 + {v}[2] ** 2 + {v}[3] ** 2))"
    return f"(CASE WHEN {turn} > 0 THEN -1 ELSE 1 END * acos(greatest(-1, least(1, {cosine}))))"


@query(f"""WITH {_SIDES}, w AS (SELECT pl.*, [{_foot('4.0', '3.0', '2.5')}] AS o FROM pl),
    f AS (SELECT w.*, lm.label, lm.side, [{_foot('lm.x', 'lm.y', 'lm.z')}] AS u, [{_foot('r.x', 'r.y', 'r.z')}] AS r FROM lm JOIN w ON w.t = lm.t JOIN lm r ON r.t = (lm.t + 1) % 8 AND r.label = lm.label AND r.side = lm.side),
    g AS (SELECT t, label, side, {_oriented('o', 'u')} AS a, {_oriented('r', 'u')} AS turn FROM f WHERE sqrt(u[1] ** 2 + u[2] ** 2 + u[3] ** 2) > 0.05),
    k AS (SELECT t, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, 3) AS ang, turn FROM g QUALIFY row_number() OVER (PARTITION BY t, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, 3) ORDER BY label, side) = 1),
    q AS (SELECT n.id, w.*, [{_foot('n.x', 'n.y', 'n.z')}] AS u, n.x, n.y, n.z FROM n JOIN w USING (t)),
    h AS (SELECT *, {_oriented('o', 'u')} AS a FROM q), h2 AS (SELECT *, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS ang FROM h),
    lo AS (SELECT h2.*, k.ang AS a0, k.turn AS t0 FROM h2 ASOF LEFT JOIN k ON h2.t = k.t AND h2.ang >= k.ang), hi AS (SELECT lo.*, k.ang AS a1, k.turn AS t1 FROM lo ASOF LEFT JOIN k ON lo.t = k.t AND lo.ang < k.ang),
    m AS (SELECT *, CASE WHEN a0 IS NULL THEN t1 WHEN a1 IS NULL THEN t0 ELSE t0 + (t1 - t0) * (ang - a0) / (a1 - a0) END AS turn, x - bx AS px, y - cy AS py, z - bz AS pz FROM hi)
    SELECT id, t, round(turn, 4) AS turn, round(bx + px * cos(turn) + (ny * pz - nz * py) * sin(turn) + nx * dt * (1 - cos(turn)), 4) AS x,
        round(cy + py * cos(turn) + (nz * px - nx * pz) * sin(turn) + ny * dt * (1 - cos(turn)), 4) AS y, round(bz + pz * cos(turn) + (nx * py - ny * px) * sin(turn) + nz * dt * (1 - cos(turn)), 4) AS z
    FROM (SELECT *, nx * px + ny * py + nz * pz AS dt FROM m)""")
def piecewise_rotation(spark, d):
    """Each frame turns piecewise so that its landmarks come to where those of the next frame stand."""
    _, plane = _plane(spark, d)
    lm = _landmarks(spark, d)
    goal = lm.select(F.pmod(F.col("t") - 1, F.lit(8)).alias("t"), "label", "side", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    marks = lm.join(goal, ["t", "label", "side"]).withColumn("name", F.format_string("%06d %d", "label", "side"))
    origin = (4.0, 3.0, 2.5)
    where = symmetry.knots(marks, plane, ["t"], origin, nearest=0.05)
    return symmetry.piecewise_turned(t.nodes(spark, d), plane, where, ["t"], origin).select("id", "t", _r("turn", 4), _r("x", 4), _r("y", 4), _r("z", 4))


@query()
def thinned_image(spark, d):
    """Curves that an image is thinned to. SQL can't express it; tests compare it with plain loops."""
    return topology.thinned(t.voxels(spark, d).where("v >= 46"))


@query()
def skeleton_branches(spark, d):
    """The branches of a thinned image, and the one that each belongs to once ends shorter than 3 are gone, if it stays."""
    _, branches = topology.voxel_tree(thinned_image(spark, d))
    kept = topology.pruned(branches, 3.0).select("branch", "into", F.col("length").alias("whole"))
    return branches.join(kept, "branch", "left").select("branch", "n", _r("length"), "first", "last", "kind", "into", _r("whole"))


def _response(sigma: float, order: int, d: str) -> str:
    """SQL: the weight of a voxel that lies d behind, by the closed form of the filter's response."""
    a0, a1, w0, b0, c0, c1, w1, b1 = recursive.DERICHE[order]
    scale = recursive.deriche(sigma, order)[0][0].ahead[0] / (a0 + c0)
    wave = lambda a, b, w, c: f"({a} * cos({w / sigma} * abs({d})) + {b} * sin({w / sigma} * abs({d}))) * exp(-{c / sigma} * abs({d}))"
    return f"({scale} * {f'CASE WHEN {d} < 0 THEN -1 ELSE 1 END * ' if order == 1 else ''}({wave(a0, a1, w0, b0)} + {wave(c0, c1, w1, b1)}))"


def _along(axis: str, before: str, sigma: float, order: int) -> str:
    """SQL: `before` filtered along an axis, at all places of the image's bounds on lines that have voxels."""
    u, v = (c for c in "xyz" if c != axis)
    return f"""SELECT o."{axis}", b."{u}", b."{v}", sum(b.v * {_response(sigma, order, f'(o."{axis}" - b."{axis}")')}) AS v FROM {before} b, (SELECT unnest(range(min("{axis}"), max("{axis}") + 1)) AS "{axis}" FROM im) o GROUP BY 1, 2, 3"""


@query(f"WITH {_V}, a AS ({_along('x', 'im', 1.5, 0)}), b AS ({_along('y', 'a', 2.5, 0)}), c AS ({_along('z', 'b', 0.8, 0)}) SELECT x, y, z, round(v, 6) AS v FROM c")
def recursive_smooth(spark, d):
    return recursive.smoothed(t.voxels(spark, d), (1.5, 2.5, 0.8)).withColumn("v", F.round("v", 6))


@query(f"WITH {_V}, a AS ({_along('x', 'im', 1.5, 1)}), b AS ({_along('y', 'a', 1.5, 2)}) SELECT x, y, z, round(v, 6) AS v FROM b")
def recursive_derivative(spark, d):
    """The first derivative along x of the second one along y."""
    return recursive.filtered(t.voxels(spark, d), {"x": recursive.deriche(1.5, 1), "y": recursive.deriche(1.5, 2)}).withColumn("v", F.round("v", 6))
