"""Queries of measures, edits, fields and quaternions; chronovox.catalog imports this module at its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronovox.catalog import _N, _O, _S, _T, _V, QUERIES, _r, query
from chronovox.functions import quaternions
from chronovox.operators import edits, fields, measures, voxels
from chronovox.plans.wider import _links
from chronovox.sources import tables as t


@query(f"WITH {_V} SELECT count(*) AS n, min(v) AS least, round(avg(v), 6) AS mean, max(v) AS most, round(stddev_pop(v), 6) AS deviation FROM im")
def image_statistics(spark, d):
    return measures.described(t.voxels(spark, d)).select("n", "least", _r("mean"), "most", _r("deviation"))


@query(f"WITH {_V} SELECT x, y, z, CAST(greatest(-128, least(127, sign(v * 7.3 - 40) * floor(abs(v * 7.3 - 40) + 0.5))) AS BIGINT) AS v FROM im")
def type_conversion(spark, d):
    return measures.converted(t.voxels(spark, d).withColumn("v", F.col("v") * 7.3 - 40), "s8")


@query(f"WITH {_V}, h AS (SELECT CAST(floor(v / 5 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM im WHERE (x + y) % 3 = 0 GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 9) AS share FROM h")
def masked_hist(spark, d):
    image = t.voxels(spark, d)
    return measures.masked_histogram(image, image.where((F.col("x") + F.col("y")) % 3 == 0), 5.0).select("bin", "n", _r("share", 9))


@query(f"WITH {_V}, h AS (SELECT CAST(floor(v / 5 + 0.5) AS BIGINT) AS bin, CAST(sum(CASE WHEN z <= 3 THEN 1 ELSE -1 END) AS BIGINT) AS difference FROM im GROUP BY 1) SELECT * FROM h")
def hist_difference(spark, d):
    image = t.voxels(spark, d)
    return measures.histogram_difference(voxels.histogram(image.where("z <= 3"), 5.0), voxels.histogram(image.where("z > 3"), 5.0))


@query(f"""WITH {_V}, a AS (SELECT * FROM im WHERE v > 5 AND v < 49), b AS (SELECT x, y, z - 1 AS z, v FROM a),
    p AS (SELECT x // 8 AS bx, y // 8 AS by, floor(z / 8) AS bz, avg(v) AS ma, var_pop(v) AS va FROM a GROUP BY 1, 2, 3), q AS (SELECT x // 8 AS bx, y // 8 AS by, floor(z / 8) AS bz, avg(v) AS mb, var_pop(v) AS vb FROM b GROUP BY 1, 2, 3),
    j AS (SELECT a.x // 8 AS bx, a.y // 8 AS by, floor(a.z / 8) AS bz, a.v, b.v AS u FROM a JOIN b USING (x, y, z)),
    g AS (SELECT bx, "by", bz, count(*) AS n, sum((v - u) ** 2) AS ssd, sum(abs(v - u)) AS sad, covar_pop(v, u) AS c, var_pop(v) AS vv, var_pop(u) AS vu, avg((v - ma) * (u - mb)) AS r, any_value(va * vb) AS w FROM j JOIN p USING (bx, "by", bz) JOIN q USING (bx, "by", bz) GROUP BY 1, 2, 3)
    SELECT bx, "by", CAST(bz AS BIGINT) AS bz, n, round(ssd, 6) AS ssd, round(sad, 6) AS sad, round(CASE WHEN vv > 1e-9 AND vu > 1e-9 THEN c * c / (vv * vu) END, 6) AS cc, round(CASE WHEN w > 1e-9 THEN r * r / w END, 6) AS cc_extended FROM g""")
def block_similarities(spark, d):
    a = t.voxels(spark, d)
    return measures.block_similarities(a, a.withColumn("z", F.col("z") - 1), 8, (5.0, 49.0)).select("bx", "by", "bz", "n", *[_r(c) for c in ("ssd", "sad", "cc", "cc_extended")])


@query(f"""WITH {_V}, g AS (SELECT x // 4 AS bx, y // 4 AS by, z // 4 AS bz, count(*) AS a, count(*) FILTER (v > 40 AND v < 49) AS n, avg(v) FILTER (v > 40 AND v < 49) AS mean, var_pop(v) FILTER (v > 40 AND v < 49) AS variance FROM im GROUP BY 1, 2, 3)
    SELECT bx, "by", bz, n, round(mean, 6) AS mean, round(variance, 6) AS variance FROM g WHERE n > 0 AND 1 - n / a <= 0.6""")
def block_window(spark, d):
    return measures.windowed_blocks(t.voxels(spark, d), 4, 40.0, 49.0, 0.6).select("bx", "by", "bz", "n", _r("mean"), _r("variance"))


@query(f"WITH {_S} SELECT x, y, z, round(stddev_pop(sp.v), 6) AS v FROM sp JOIN im USING (x, y, z) GROUP BY 1, 2, 3")
def std_filter(spark, d):
    return measures.neighbourhood(t.voxels(spark, d), "std").select("x", "y", "z", _r("v"))


@query(f"WITH {_S} SELECT x, y, z, round(quantile_cont(sp.v, 0.25), 6) AS v FROM sp JOIN im USING (x, y, z) GROUP BY 1, 2, 3")
def quantile_filter(spark, d):
    return measures.neighbourhood(t.voxels(spark, d), "quantile", share=0.25).select("x", "y", "z", _r("v"))


@query(f"""WITH {_S}, k AS (SELECT x, y, z, avg(sp.v) AS m, stddev_pop(sp.v) AS s FROM sp JOIN im USING (x, y, z) GROUP BY 1, 2, 3)
    SELECT x, y, z, round(avg(sp.v), 6) AS v FROM sp JOIN k USING (x, y, z) WHERE abs(sp.v - m) <= 2 * s + 1e-9 GROUP BY 1, 2, 3""")
def robust_mean_filter(spark, d):
    return measures.neighbourhood(t.voxels(spark, d), "robust").select("x", "y", "z", _r("v"))


@query(f"WITH {_V}, q AS (SELECT x + o AS x, y, z, v * w AS v FROM im, (VALUES (-1, -0.0625), (0, 0.5625), (1, 0.5625), (2, -0.0625)) AS k(o, w)) SELECT x, y, z, round(sum(v), 6) AS v FROM q GROUP BY 1, 2, 3 HAVING count(*) = 4")
def resample_cubic(spark, d):
    return measures.cubic(t.voxels(spark, d), (0.5, 0.0, 0.0)).select("x", "y", "z", _r("v"))


@query(f"WITH {_V} SELECT x, y, z, CASE WHEN (x - 16) ** 2 + (y - 16) ** 2 + (z - 4) ** 2 <= 49 THEN 100.0 ELSE v END AS v FROM im")
def draw_sphere(spark, d):
    return measures.drawn(t.voxels(spark, d), measures.sphere((16, 16, 4), 7.0), 100.0)


@query(f"WITH {_V} SELECT x, y, v % 2 AS z, max(v) AS v FROM im GROUP BY 1, 2, 3")
def stacked_projections(spark, d):
    return measures.stacked(t.voxels(spark, d).withColumn("t", F.col("v") % 2))


@query(f"WITH {_N} SELECT label, quantile_cont(t, 0.5) AS median FROM n GROUP BY 1")
def median_frame(spark, d):
    return t.nodes(spark, d).groupBy("label").agg(F.percentile(F.col("t").cast("double"), F.lit(0.5)).alias("median"))


@query(f"WITH {_N}, l AS (SELECT id - 1 AS src, id AS dst FROM n WHERE t > 0) SELECT src, dst FROM l WHERE src % 7 <> 0 AND dst % 7 <> 0")
def remove_nodes(spark, d):
    n = t.nodes(spark, d)
    return edits.removed(n, _links(n), n.where("id % 7 = 0").select("id"))[1]


@query(f"""WITH {_N}, m AS (SELECT max(id) AS top FROM n), w AS (SELECT id, t, x, y, z, top + row_number() OVER (ORDER BY id) AS new FROM n, m WHERE id % 5 = 0)
    SELECT id, t, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM n UNION ALL SELECT new, t + 1, round(x + 1, 6), round(y, 6), round(z, 6) FROM w""")
def add_nodes(spark, d):
    n = t.nodes(spark, d)
    new = n.where("id % 5 = 0").select(F.col("id").alias("k"), (F.col("t") + 1).alias("t"), (F.col("x") + 1).alias("x"), "y", "z", F.col("id").alias("of"))
    return edits.added(n, _links(n), new)[0].select("id", "t", _r("x"), _r("y"), _r("z"))


@query(f"WITH {_N}, l AS (SELECT id - 1 AS src, id AS dst FROM n WHERE t > 0) SELECT DISTINCT src - src // 8 % 2 * 8 AS src, dst - dst // 8 % 2 * 8 AS dst FROM l")
def fuse_edges(spark, d):
    n = t.nodes(spark, d)
    return edits.merged(n, _links(n), n.select("id", (F.col("id") - F.expr("id div 8") % 2 * 8).alias("new")).where("id <> new"))[1]


@query(f"WITH {_N} SELECT a.id, a.t, b.id AS ref FROM n a JOIN n b ON b.id = a.id - a.t + 3")
def reference_frame(spark, d):
    n = t.nodes(spark, d)
    return edits.at_frame(n, _links(n), 3)


@query(f"""WITH {_N}, s AS (SELECT id, id % 7 AS t, x, y, z, label + 1.0 AS w FROM n), m AS (SELECT a.t, {', '.join(f'sum(a.w * (b.{c} - a.{c})) / sum(a.w) AS d{c}' for c in 'xyz')} FROM s a JOIN s b ON b.id = a.id - a.t + 3 WHERE a.t <> 3 GROUP BY 1)
    SELECT s.id, s.t, {', '.join(f'round(s.{c} + coalesce(d{c}, 0), 6) AS {c}' for c in 'xyz')} FROM s LEFT JOIN m USING (t)""")
def stabilise_frames(spark, d):
    n = t.nodes(spark, d).withColumn("t", F.col("id") % 7)
    out = edits.stabilised(n, _links(n), n.select("id", (F.col("label") + 1.0).alias("density")))
    return out.select("id", "t", _r("x"), _r("y"), _r("z"))


@query(f"WITH {_N}, s AS (SELECT id, label FROM n WHERE id % 4 = 1) SELECT n.id, min(s.label) AS label FROM n JOIN s ON s.id // 8 = n.id // 8 GROUP BY 1 HAVING count(DISTINCT s.label) = 1")
def label_propagation(spark, d):
    n = t.nodes(spark, d)
    return edits.carried_labels(_links(n), n.where("id % 4 = 1").select("id", "label"))


_W = "sqrt(x * x + y * y + z * z)"


@query(f"WITH {_N}, w AS (SELECT id, {_W} AS a, x / {_W} AS kx, y / {_W} AS ky, z / {_W} AS kz FROM n) SELECT id, round(cos(a) + (1 - cos(a)) * kx * kx, 6) AS m00, round((1 - cos(a)) * kx * ky - sin(a) * kz, 6) AS m01, round((1 - cos(a)) * ky * kz - sin(a) * kx, 6) AS m12 FROM w")
def rotation_matrices(spark, d):
    m = quaternions.to_matrix(quaternions.of_vector((F.col("x"), F.col("y"), F.col("z"))))
    return t.nodes(spark, d).select("id", F.round(m[0][0], 6).alias("m00"), F.round(m[0][1], 6).alias("m01"), F.round(m[1][2], 6).alias("m12"))


@query(f"""WITH {_V}, f AS (SELECT 2 * sin(2 * pi() * x / 16) AS dx, sin(2 * pi() * y / 8) AS dy FROM im)
    SELECT count(*) AS n, round(avg(dx), 6) AS mean_dx, round(stddev_pop(dy), 6) AS deviation_dy, round(max(sqrt(dx * dx + dy * dy)), 6) AS most_length FROM f""")
def field_statistics(spark, d):
    f = fields.sinus(t.voxels(spark, d), (2.0, 1.0, 0.0), (16.0, 8.0, 1.0))
    return fields.statistics(f).select("n", _r("mean_dx"), _r("deviation_dy"), _r("most_length"))


@query(f"""WITH {_V} SELECT a.x, a.y, a.z, round(0.5 * a.v + 0.5 * b.v, 6) AS v FROM im a JOIN im b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z""")
def field_resample(spark, d):
    image = t.voxels(spark, d)
    half = image.select("x", "y", "z", F.lit(0.5).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return fields.resampled(image, half).select("x", "y", "z", _r("v"))


def field_inverse(spark, d):
    """The inverse of a wave over all voxels' places; tests compare inverses with what they undo."""
    f = fields.sinus(t.voxels(spark, d), (0.4, 0.0, 0.0), (32.0, 1.0, 1.0))
    return fields.inverted(f).select("x", "y", "z", _r("dx"), _r("dy"), _r("dz"))


def phase_translation(spark, d):
    """The volume against itself moved by a voxel along x; tests recover known translations."""
    image = t.voxels(spark, d).withColumn("t", F.lit(0))
    return measures.phase_translation(image.unionByName(image.withColumns({"t": F.lit(1), "x": F.col("x") + 1})))


def relabelled(spark, d):
    """Labels of two images made to go together; a test does it by hand."""
    a = t.voxels(spark, d).select("x", "y", "z", (F.col("v") + 2).cast("long").alias("l"))
    b = a.select("x", "y", (F.col("z") - 1).alias("z"), (F.expr("l div 3") + 2).alias("r"))
    return measures.relabelled(a.withColumn("l", F.expr("l div 2") + 2).join(b, ["x", "y", "z"]).select("l", "r").distinct())


QUERIES |= {f.__name__: f for f in (field_inverse, phase_translation, relabelled)}


@query(f"WITH {_T} SELECT DISTINCT track FROM tr EXCEPT SELECT track FROM tr WHERE t = 2 AND v > 50")
def set_difference(spark, d):
    x = t.tracks(spark, d)
    return x.select("track").subtract(x.where("t = 2 AND v > 50").select("track"))


@query(f"WITH {_V}, {_O}, c AS (SELECT x + i AS x, y + j AS y, z + k AS z, max(v) AS v FROM im, o GROUP BY 1, 2, 3), e AS (SELECT x + i AS x, y + j AS y, z + k AS z, min(v) AS v FROM c, o GROUP BY 1, 2, 3 HAVING count(*) = 7) SELECT x, y, z, e.v - coalesce(im.v, 0) AS v FROM e LEFT JOIN im USING (x, y, z)")
def bottom_hat(spark, d):
    from chronovox.operators import filters

    return filters.bottom_hat(t.voxels(spark, d))
