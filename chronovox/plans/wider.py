"""Queries of flow, registration, filters, atlas and exports; chronovox.catalog imports this module at its end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.catalog import _E, _N, _O, _P, _V, QUERIES, _pairings, _r, query
from chronovox.operators import atlas, filters, flow, registration, spatial
from chronovox.sources import exports
from chronovox.sources import tables as t


def _links(n: DataFrame) -> DataFrame:
    """Links between frames: a cell's mother is that of the id before, in the frame before."""
    return n.where("t > 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))


_G = f"""{_N}, l AS (SELECT id - 1 AS src, id AS dst FROM n WHERE t > 0), gg AS (SELECT a.t, a.id AS a, b.id AS b FROM n a JOIN n b ON a.t = b.t AND a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM n c
    WHERE c.t = a.t AND c.id <> a.id AND c.id <> b.id AND (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) + (a.z - c.z) * (b.z - c.z) < 0)),
    g AS (SELECT * FROM gg UNION ALL SELECT t, b, a FROM gg), two AS (SELECT DISTINCT p.a AS p, q.b AS q FROM g p JOIN g q ON p.b = q.a),
    tie AS (SELECT p, q, max(c) AS c FROM (SELECT a AS p, b AS q, 4.0 AS c FROM g UNION ALL SELECT p, q, 1.0 FROM two) GROUP BY 1, 2),
    w0 AS (SELECT g.t, g.a, g.b, coalesce(m.c, 0) + coalesce(d.c, 0) AS w FROM g LEFT JOIN l la ON la.dst = g.a LEFT JOIN l lb ON lb.dst = g.b LEFT JOIN tie m ON m.p = la.src AND m.q = lb.src
        LEFT JOIN l ma ON ma.src = g.a LEFT JOIN l mb ON mb.src = g.b LEFT JOIN tie d ON d.p = ma.dst AND d.q = mb.dst),
    w AS (SELECT t, a, b, CASE WHEN max(w) OVER (PARTITION BY a) = 0 THEN 1.0 ELSE w END AS w FROM w0)"""


@query(f"WITH {_G} SELECT t, a, b, CAST(w AS DOUBLE) AS w FROM w")
def neighbour_weights(spark, d):
    n = t.nodes(spark, d)
    return flow.neighbour_weights(spatial.gabriel(n), _links(n))


@query(f"""WITH {_G}, v AS (SELECT w.a AS g, w.b AS i, w.w, m.x - n.x AS x, m.y - n.y AS y, m.z - n.z AS z FROM w JOIN n ON n.id = w.b JOIN l ON l.dst = w.b JOIN n m ON m.id = l.src),
    c AS (SELECT a.g, a.i, sum(b.w * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS cost FROM v a JOIN v b ON a.g = b.g GROUP BY 1, 2),
    k AS (SELECT g, i FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(cost, 9), i) = 1)
    SELECT n.id, round(coalesce(v.x, 0), 6) AS dx, round(coalesce(v.y, 0), 6) AS dy, round(coalesce(v.z, 0), 6) AS dz FROM n LEFT JOIN k ON k.g = n.id LEFT JOIN v ON v.g = k.g AND v.i = k.i""")
def flow_displacement(spark, d):
    n = t.nodes(spark, d)
    w = flow.neighbour_weights(spatial.gabriel(n), _links(n))
    return flow.displacements(n, _links(n), w).select("id", _r("dx"), _r("dy"), _r("dz"))


def flow_propagation(spark, d):
    """Tracks followed back from the last frame of the table to the first; tests follow a common motion back."""
    n = t.nodes(spark, d)
    ends = n.agg(F.max("t").alias("last"), F.min("t").alias("first")).collect()[0]
    last, first = (0, 0) if ends["last"] is None else (ends["last"], ends["first"])
    return flow.propagated(n, _links(n), last, first).select("track", "t", _r("x"), _r("y"), _r("z"))


def fit_affine(spark, d):
    """Least-squares affine maps; tests compare them with numpy's solver, and recover exact maps of every kind."""
    return registration.fitted(_pairings(spark, d), "affine").select("g", F.transform("m", lambda x: F.round(x, 6)).alias("m"), "n")


def fit_rigid(spark, d):
    return registration.fitted(_pairings(spark, d), "rigid").select("g", F.transform("m", lambda x: F.round(x, 6)).alias("m"), "n")


def fit_trimmed(spark, d):
    return registration.trimmed_fit(_pairings(spark, d), "rigid", 0.5, 20).select("g", F.transform("m", lambda x: F.round(x, 6)).alias("m"), "n")


def block_pairs(spark, d):
    """Blocks of the volume paired with the volume moved by one voxel along x; tests recover a known shift."""
    image = t.voxels(spark, d)
    return registration.matched_blocks(image, image.withColumn("x", F.col("x") + 1), 8, 1).select("i", "ax", "ay", "az", "bx", "by", "bz", _r("w"))


QUERIES |= {f.__name__: f for f in (flow_propagation, fit_affine, fit_rigid, fit_trimmed, block_pairs)}


@query(f"""WITH RECURSIVE {_N}, s AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS k, y AS a, x AS b FROM n), u AS (SELECT label, k, 1 + a / 10 AS p, b AS q FROM s),
    r AS (SELECT label, k, p, q FROM u WHERE k = 1 UNION ALL SELECT u.label, u.k, u.p * r.p, u.p * r.q + u.q FROM r JOIN u ON u.label = r.label AND u.k = r.k + 1)
    SELECT label AS g, round(p, 6) AS scale, round(q, 6) AS shift FROM r QUALIFY k = max(k) OVER (PARTITION BY label)""")
def compose_matrix(spark, d):
    z, one = F.lit(0.0), F.lit(1.0)
    s = 1 + F.col("y") / 10
    m = F.array(s, z, z, F.col("x"), z, s, z, z, z, z, s, z, z, z, z, one)
    # The list is in order of application: the product of later ones stands to the left.
    out = registration.composed(t.nodes(spark, d).select(F.col("label").alias("g"), (-F.col("id")).alias("k"), m.alias("m")))
    return out.select("g", F.round(F.col("m")[0], 6).alias("scale"), F.round(F.col("m")[3], 6).alias("shift"))


@query(f"""WITH {_N} SELECT id, round(-x / (2 + y * y), 6) AS tx, round(1 / (2 + y * y), 6) AS s FROM n""")
def invert_matrix(spark, d):
    z, one = F.lit(0.0), F.lit(1.0)
    s = 2 + F.col("y") * F.col("y")
    m = F.array(s, z, z, F.col("x"), z, s, z, z, z, z, s, z, z, z, z, one)
    i = registration.inverted(F.col("m"))
    return t.nodes(spark, d).select("id", m.alias("m")).select("id", i.alias("i")).select("id", F.round(F.col("i")[3], 6).alias("tx"), F.round(F.col("i")[0], 6).alias("s"))


@query(f"""WITH {_P}, r AS (SELECT g, i, sqrt((qx - ax) ** 2 + (qy - ay) ** 2 + (qz - az) ** 2) AS residual FROM pr)
    SELECT g, round(avg(residual), 6) AS mean, round(stddev_pop(residual), 6) AS deviation, round(avg(residual) + 3 * stddev_pop(residual), 6) AS bound FROM r GROUP BY 1""")
def residual_statistics(spark, d):
    p = _pairings(spark, d)
    one = F.array(*[F.lit(float(x)) for x in registration.IDENTITY.ravel()])
    rated = registration.residuals(p, p.select("g").distinct().withColumn("m", one))
    return registration.residual_statistics(rated).select("g", _r("mean"), _r("deviation"), _r("bound"))


@query(f"WITH {_V}, q AS (SELECT x + i AS x, y, z, v * CASE i WHEN 0 THEN 0.5 ELSE 0.5 END AS v FROM im, (VALUES (0), (1)) AS o(i)) SELECT x, y, z, round(sum(v), 6) AS v FROM q GROUP BY 1, 2, 3 HAVING count(*) = 2")
def resample_linear(spark, d):
    m = np.eye(4)
    m[0, 3] = 0.5
    return registration.resampled(t.voxels(spark, d), m).select("x", "y", "z", _r("v"))


def _gauss_sql(axis: str, source: str) -> str:
    at = ", ".join(f"{source}.{c} + o AS {c}" if c == axis else f"{source}.{c}" for c in "xyz")
    return f"(SELECT x, y, z, sum(w * v) / sum(w) AS v FROM (SELECT {at}, v, exp(-0.5 * o * o) AS w FROM {source}, range(-3, 4) AS r(o)) SEMI JOIN im USING (x, y, z) GROUP BY 1, 2, 3)"


@query(f"WITH {_V}, g1 AS {_gauss_sql('x', 'im')}, g2 AS {_gauss_sql('y', 'g1')}, g3 AS {_gauss_sql('z', 'g2')} SELECT x, y, z, round(v, 6) AS v FROM g3")
def gaussian_filter(spark, d):
    return filters.gaussian(t.voxels(spark, d), 1.0).select("x", "y", "z", _r("v"))


_STENCIL = f"""{_V}, {_O}, st AS (SELECT x + i AS x, y + j AS y, z + k AS z, max(CASE WHEN i = 0 AND j = 0 AND k = 0 THEN v END) AS v, max(CASE WHEN i = 1 THEN v END) AS xl, max(CASE WHEN i = -1 THEN v END) AS xr,
    max(CASE WHEN j = 1 THEN v END) AS yl, max(CASE WHEN j = -1 THEN v END) AS yr, max(CASE WHEN k = 1 THEN v END) AS zl, max(CASE WHEN k = -1 THEN v END) AS zr FROM im, o GROUP BY 1, 2, 3 HAVING count(*) = 7)"""


@query(f"WITH {_STENCIL} SELECT x, y, z, round(sqrt((xr - xl) ** 2 + (yr - yl) ** 2 + (zr - zl) ** 2) / 2, 6) AS v FROM st")
def gradient_modulus(spark, d):
    return filters.gradient_modulus(t.voxels(spark, d)).select("x", "y", "z", _r("v"))


@query(f"WITH {_STENCIL} SELECT x, y, z, round(xl + xr + yl + yr + zl + zr - 6 * v, 6) AS v FROM st")
def laplacian(spark, d):
    return filters.laplacian(t.voxels(spark, d)).select("x", "y", "z", _r("v"))


_DE = f"{_V}, {_O}, di AS (SELECT x + i AS x, y + j AS y, z + k AS z, max(v) AS v FROM im, o GROUP BY 1, 2, 3), er AS (SELECT x + i AS x, y + j AS y, z + k AS z, min(v) AS v FROM im, o GROUP BY 1, 2, 3 HAVING count(*) = 7)"


@query(f"WITH {_DE} SELECT x + i AS x, y + j AS y, z + k AS z, min(v) AS v FROM di, o GROUP BY 1, 2, 3 HAVING count(*) = 7")
def closing(spark, d):
    return filters.closed(t.voxels(spark, d))


@query(f"WITH {_DE}, op AS (SELECT x + i AS x, y + j AS y, z + k AS z, max(v) AS v FROM er, o GROUP BY 1, 2, 3) SELECT x, y, z, im.v - coalesce(op.v, 0) AS v FROM im LEFT JOIN op USING (x, y, z)")
def top_hat(spark, d):
    return filters.top_hat(t.voxels(spark, d))


@query(f"WITH {_DE} SELECT x, y, z, di.v - er.v AS v FROM di JOIN er USING (x, y, z)")
def morphological_gradient(spark, d):
    return filters.morphological_gradient(t.voxels(spark, d))


@query(f"WITH {_V} SELECT a.x, a.y, a.z, round(CASE WHEN b.v <> 0 THEN a.v / b.v END, 6) AS v FROM im a JOIN im b ON a.x = b.x AND a.y = b.y AND b.z = a.z + 1")
def image_arithmetic(spark, d):
    a = t.voxels(spark, d)
    return filters.arithmetic(a, a.withColumn("z", F.col("z") - 1), "div").select("x", "y", "z", _r("v"))


@query(f"WITH {_V}, q AS (SELECT min(v) AS a, max(v) AS b FROM im) SELECT x, y, z, CAST(floor((v - a) / (b - a) * 255 + 0.5) AS BIGINT) AS v FROM im, q")
def one_byte(spark, d):
    return filters.normalised(t.voxels(spark, d))


def hysteresis(spark, d):
    """Recursive SQL is too slow for whole tables; tests compare with a search by hand."""
    return filters.hysteresis(t.voxels(spark, d), 47, 49, 2)


@query(f"""WITH {_V}, a AS (SELECT x, y, z, floor(v / 10) AS l FROM im), b AS (SELECT x, y, z - 1 AS z, floor(v / 10) AS r FROM im) SELECT CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, count(*) AS n FROM a JOIN b USING (x, y, z) GROUP BY 1, 2""")
def label_overlap(spark, d):
    a = t.voxels(spark, d).withColumn("v", F.floor(F.col("v") / 10))
    return filters.label_overlap(a, a.withColumn("z", F.col("z") - 1))


@query(f"WITH {_V}, b AS (SELECT x, y, z - 1 AS z, v AS u FROM im) SELECT x, y, z, round(0.75 * coalesce(v, 0) + 0.25 * coalesce(u, 0), 6) AS v FROM im FULL JOIN b USING (x, y, z)")
def image_between(spark, d):
    a = t.voxels(spark, d)
    return filters.between(a, a.withColumn("z", F.col("z") - 1), 0.25).select("x", "y", "z", _r("v"))


@query(f"""WITH {_N}, {_V}, m AS (SELECT DISTINCT x, y, z FROM im WHERE v >= 30), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM m)
    SELECT id, t FROM n, b WHERE EXISTS (SELECT 1 FROM m WHERE m.x = greatest(least(floor(n.x / 0.01), hx), lx) AND m.y = greatest(least(floor(n.y / 0.01), hy), ly) AND m.z = greatest(least(floor(n.z / 0.05), hz), lz))""")
def mask_membership(spark, d):
    mask = t.voxels(spark, d).where("v >= 30").select("x", "y", "z")
    return filters.in_mask(t.nodes(spark, d), mask, (0.01, 0.01, 0.05)).select("id", "t")


def watershed_basins(spark, d):
    """Basins of steepest descent; tests follow each voxel down by hand."""
    return filters.basins(t.voxels(spark, d))


def regional_maxima(spark, d):
    return filters.regional_maxima(t.voxels(spark, d))


def chamfer_distance(spark, d):
    """From the darkest voxels through the image; tests compare with Dijkstra's ways."""
    image = t.voxels(spark, d)
    return filters.distance_map(image, image.where("v <= 10"))


QUERIES |= {f.__name__: f for f in (watershed_basins, regional_maxima, chamfer_distance, hysteresis)}


@query(f"""WITH {_N}, ray AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, -0.6, 0.0, 0.8)) AS q(ray, ux, uy, uz)),
    s AS (SELECT ray, x * ux + y * uy + z * uz AS s, x, y, z, ux, uy, uz FROM n, ray), f AS (SELECT ray, s FROM s WHERE s > 0 AND (x - s * ux) ** 2 + (y - s * uy) ** 2 + (z - s * uz) ** 2 < 0.0225),
    st AS (SELECT ray, avg(s) AS m, stddev_pop(s) AS d FROM f GROUP BY 1) SELECT ray, round(quantile_cont(s, 0.2), 6) AS low, round(quantile_cont(s, 0.8), 6) AS high FROM f JOIN st USING (ray) WHERE abs(s - m) <= 5 * d GROUP BY 1 HAVING count(*) > 10""")
def ray_shells(spark, d):
    rays = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, -0.6, 0.0, 0.8)], "ray int, ux double, uy double, uz double")
    return atlas.shells(t.nodes(spark, d), rays, 0.15).select("ray", _r("low"), _r("high"))


def nonlinear_displacement(spark, d):
    """Points pulled by two shells towards their targets; not compared with anything yet."""
    n = t.nodes(spark, d)
    low, high = (n.where(f"id % 5 = {k}").select("id", "t", "x", "y", "z", *[(F.col(c) * (1.1 + k / 10)).alias(f"t{c}") for c in "xyz"]) for k in (0, 1))
    return atlas.displaced(n.where("id % 5 > 1"), low, high).select("id", "t", _r("x"), _r("y"), _r("z"))


QUERIES["nonlinear_displacement"] = nonlinear_displacement


@query(f"""WITH {_N}, c AS (SELECT t, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM n GROUP BY 1), s AS (SELECT n.*, cx - x AS ux, cy - y AS uy, cz - z AS uz, CASE WHEN t > 0 THEN id - 1 ELSE -1 END AS mother_id FROM n JOIN c USING (t)),
    j AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS r FROM s)
    SELECT j.id, j.mother_id, round(j.x, 5) AS x, round(j.r, 5) AS r, round(atan2(j.uy, j.ux), 5) AS theta, round(acos(j.uz / j.r), 5) AS phi, j.t, j.label, CASE WHEN j.id % 3 = 0 THEN round(j.x * 2, 5) ELSE -1 END AS "D-x",
    round(coalesce(m.r, -1), 5) AS "r_M", round(coalesce(j.r - m.r, -1), 5) AS d_m_r, round(coalesce(sqrt((j.x - m.x) ** 2 + (j.y - m.y) ** 2 + (j.z - m.z) ** 2), -1), 5) AS "d_m_L2" FROM j LEFT JOIN j m ON m.id = j.mother_id""")
def node_database(spark, d):
    n = t.nodes(spark, d)
    c = n.groupBy("t").agg(*[F.avg(c).alias(c) for c in "xyz"])
    div = n.where("id % 3 = 0").select("id", *[(F.col(c) * 2).alias(c) for c in "xyz"])
    out = exports.database_expanded(n, _links(n), c, div)
    return out.select("id", "mother_id", "t", "label", *[F.round(f"`{k}`", 5).alias(k) for k in ("x", "r", "theta", "phi", "D-x", "r_M", "d_m_r", "d_m_L2")])


@query(f"""WITH {_E} SELECT CAST(count(*) AS BIGINT) AS edges, CAST((SELECT count(DISTINCT track) FROM tr WHERE t = 1) AS BIGINT) AS tracks, CAST((SELECT count(*) FROM tr) AS BIGINT) AS spots FROM e""")
def mamut_document(spark, d):
    n = t.tracks(spark, d).select("id", "t", F.col("v").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("label"))
    lines = exports.mamut_lines(n, t.chain_edges(spark, d))
    has = lambda p: F.count(F.when(F.col("line").startswith(p), 1))
    return lines.agg(has("<Edge ").alias("edges"), has("<Track name").alias("tracks"), has("<Spot ").alias("spots"))
