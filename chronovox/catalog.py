"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovox.functions import angles
from chronovox.operators import graphs, lineage, motion, spatial, transforms, voxels
from chronovox.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Model tables in SQL.
_N = "n AS (SELECT vec_id AS id, vec_id % 8 AS t, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"
_T = "tr AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id AS id, value AS v FROM events)"
_E = f"{_T}, e AS (SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY track ORDER BY t) AS dst FROM tr) WHERE dst IS NOT NULL)"
_V = "im AS (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, CAST(l_linenumber AS BIGINT) AS z, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_O = "o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS q(i, j, k))"
_S = f"{_V}, {_O}, sp AS (SELECT x + i AS x, y + j AS y, z + k AS z, v FROM im, o)"
_K = f"{_N}, p AS (SELECT a.id AS a, b.id AS b, a.t AS t, {_D} AS d FROM n a JOIN n b ON a.t = b.t AND a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM p)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(f"WITH {_K} SELECT a AS id, t, round(avg(d), 6) AS density FROM k WHERE rank <= 9 GROUP BY 1, 2")
def spatial_density(spark: SparkSession, d: str) -> DataFrame:
    return spatial.density(t.nodes(spark, d), 10).select("id", "t", _r("density"))


@query(f"WITH {_K} SELECT a, b, round(d, 6) AS d FROM k WHERE rank = 1")
def knn1(spark, d):
    n = t.nodes(spark, d)
    return spatial.knn(n, n, 1).select("a", "b", _r("d"))


@query(f"WITH {_K} SELECT a, b, rank, round(d, 6) AS d FROM k WHERE rank <= 10")
def knn10(spark, d):
    n = t.nodes(spark, d)
    return spatial.knn(n, n, 10).select("a", "b", F.col("rank").cast("long").alias("rank"), _r("d"))


@query(f"""WITH RECURSIVE {_K}, l AS (SELECT a, b FROM p WHERE d > 0 AND d < 0.2), c(id, m) AS (SELECT id, id FROM n UNION SELECT c.id, l.b FROM c JOIN l ON c.m = l.a)
    SELECT id, min(m) AS component, (SELECT count(*) FROM l WHERE l.a = c.id) AS links FROM c GROUP BY 1""")
def range_join(spark, d):
    """Each node's number of neighbours nearer than 0.2 in its frame, and its class of nodes that such links connect."""
    return spatial.range_classes(t.nodes(spark, d), 0.2)


@query(f"""WITH {_N} SELECT a.t, a.id AS a, b.id AS b FROM n a JOIN n b ON a.t = b.t AND a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM n c
    WHERE c.t = a.t AND c.id <> a.id AND c.id <> b.id AND (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) + (a.z - c.z) * (b.z - c.z) < 0)""")
def gabriel_edges(spark, d):
    return spatial.gabriel(t.nodes(spark, d))


@query(f"""WITH {_K}, v AS (SELECT k.a AS g, k.b AS i, n.label + 1 AS w, x, y, z FROM k JOIN n ON n.id = k.b WHERE rank <= 6),
    c AS (SELECT a.g, a.i, sum(b.w * {_D}) AS cost FROM v a JOIN v b ON a.g = b.g GROUP BY 1, 2)
    SELECT g, i, round(cost, 6) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(cost, 9), i) = 1""")
def weighted_medoid(spark, d):
    n = t.nodes(spark, d)
    near = spatial.knn(n, n, 6).select(F.col("a").alias("g"), F.col("b").alias("i"))
    v = near.join(n.withColumnRenamed("id", "i"), "i").select("g", "i", (F.col("label") + 1).alias("w"), "x", "y", "z")
    return spatial.medoid(v).select("g", "i", _r("cost"))


@query(f"WITH {_E} SELECT tr.id, tr.t, tr.v, coalesce(e.src, -1) AS mother_id, coalesce(m.t, -1) AS t_m, coalesce(m.v, -1) AS v_m FROM tr LEFT JOIN e ON e.dst = tr.id LEFT JOIN tr m ON m.id = e.src")
def mother_join_db(spark, d):
    return lineage.with_mother(t.tracks(spark, d), t.chain_edges(spark, d), ["t", "v"])


@query(f"WITH {_E} SELECT id, t FROM tr WHERE id NOT IN (SELECT dst FROM e)")
def roots(spark, d):
    return lineage.roots(t.tracks(spark, d), t.chain_edges(spark, d)).select("id", "t")


@query(f"WITH {_E} SELECT id, t FROM tr WHERE id NOT IN (SELECT src FROM e)")
def leaves(spark, d):
    return lineage.leaves(t.tracks(spark, d), t.chain_edges(spark, d)).select("id", "t")


@query(f"WITH {_T} SELECT id, first_value(id) OVER (PARTITION BY track ORDER BY t) AS root, t AS depth FROM tr QUALIFY count(*) OVER (PARTITION BY track) > 1")
def track_roots(spark, d):
    return lineage.to_root(t.chain_edges(spark, d)).select("id", "root", F.col("depth").cast("long").alias("depth"))


def _region_edges(spark, d):
    pre = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = (t.table(spark, d, x) for x in ("nation", "customer", "orders"))
    return (
        n.select(pre("r", "n_regionkey").alias("src"), pre("n", "n_nationkey").alias("dst"))
        .union(c.select(pre("n", "c_nationkey"), pre("c", "c_custkey"))).union(o.select(pre("c", "o_custkey"), pre("o", "o_orderkey")))
    )


@query("""SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (
    SELECT 'r' || n_regionkey AS root, 1 AS depth FROM nation UNION ALL SELECT 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'r' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2""")
def descendants(spark, d):
    return lineage.to_root(_region_edges(spark, d)).where("depth > 0").groupBy("root", F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey AS id, CAST(min(o_orderstatus) AS VARCHAR) AS label FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, o_custkey HAVING count(DISTINCT o_orderstatus) = 1""")
def unique_label(spark, d):
    j = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_nationkey").alias("id"), "o_custkey").agg(F.count_distinct("o_orderstatus").alias("n"), F.min("o_orderstatus").alias("label"))
    return g.where("n = 1").select("id", "label")


@query(f"WITH {_T} SELECT track, t, id, round(v - lag(v) OVER (PARTITION BY track ORDER BY t), 6) AS dv FROM tr")
def track_displacement(spark, d):
    return lineage.displacement(t.tracks(spark, d)).select("track", "t", "id", _r("dv"))


@query(f"""WITH {_T} SELECT id, concat_ws('-', id, {', '.join(f'coalesce(lag(id, {k}) OVER w, first_value(id) OVER w)' for k in (1, 2, 3))}) AS line
    FROM tr WINDOW w AS (PARTITION BY track ORDER BY t)""")
def ancestor_polyline(spark, d):
    return lineage.ancestor_steps(t.tracks(spark, d), 3).select("id", F.array_join(F.transform("line", lambda x: x.cast("string")), "-").alias("line"))


@query(f"""WITH {_T}, g AS (SELECT *, max(CASE WHEN v > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS grown FROM tr)
    SELECT id, min(grown) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS kept FROM g""")
def prune_closing(spark, d):
    return lineage.closing(t.tracks(spark, d), F.col("v") > 90).select("id", "kept")


@query(f"""WITH {_T}, c AS (SELECT track, count(*) AS n FROM tr GROUP BY 1), a AS (SELECT tr.track, tr.t, c.n, o, ((tr.t + o) % (2 * n) + 2 * n) % (2 * n) AS f FROM tr JOIN c USING (track), range(-20, 21) AS r(o)),
    b AS (SELECT track, t, exp(-0.5 * o * o / 25.0) AS w, CASE WHEN f < n THEN f ELSE 2 * n - 1 - f END AS at FROM a)
    SELECT b.track, b.t, round(sum(w * v) / sum(w), 6) AS smooth FROM b JOIN tr ON tr.track = b.track AND tr.t = b.at GROUP BY 1, 2""")
def gaussian_smooth(spark, d):
    return lineage.smoothed(t.tracks(spark, d)).select("track", "t", _r("smooth"))


@query(f"""WITH {_T}, s AS (SELECT track, t, v FROM tr WHERE t % 3 = 0), x AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY track ORDER BY t))
    SELECT track, u.q AS t, round(CASE WHEN t2 IS NULL THEN v ELSE v + (v2 - v) * (u.q - t) / (t2 - t) END, 6) AS v FROM x, unnest(range(t, coalesce(t2, t + 1))) AS u(q)""")
def gap_fill(spark, d):
    return lineage.filled(t.tracks(spark, d).where("t % 3 = 0")).select("track", "t", _r("v"))


@query(f"""WITH {_T} SELECT a.track, a.t, min_by(b.t, abs(a.t - b.t) * 1000000 + b.t) AS near FROM tr a JOIN tr b ON a.track = b.track AND b.t % 5 = 2 WHERE a.t % 2 = 0 GROUP BY 1, 2""")
def asof_nearest(spark, d):
    x = t.tracks(spark, d)
    return lineage.nearest_in_time(x.where("t % 2 = 0"), x.where("t % 5 = 2")).where("near IS NOT NULL")


@query(f"WITH {_N} SELECT id - id % 2 AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM n GROUP BY 1")
def fuse_nodes(spark, d):
    return lineage.fused(t.nodes(spark, d), F.col("id") - F.col("id") % 2).select("id", _r("x"), _r("y"), _r("z"), "n")


@query(f"WITH {_N}, r AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM n) SELECT id, round(r, 6) AS r, round(atan2(y, x), 6) AS theta, round(acos(z / r), 6) AS phi, round((pi() / 2 + atan2(x, z) + 2 * pi()) % (2 * pi()), 6) AS alpha FROM r")
def spherical(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return t.nodes(spark, d).withColumn("r", r).select(
        "id", _r("r"), F.round(F.atan2("y", "x"), 6).alias("theta"), F.round(F.acos(F.col("z") / F.col("r")), 6).alias("phi"), F.round(F.pmod(F.pi() / 2 + F.atan2("x", "z"), 2 * F.pi()), 6).alias("alpha"))


def _set(name, sql, f):
    f.__name__ = name
    query(f"WITH {_T}, a AS (SELECT DISTINCT track FROM tr WHERE v > 90), b AS (SELECT DISTINCT track FROM tr WHERE v < 10) SELECT track FROM a {sql} SELECT track FROM b")(f)


def _ab(spark, d):
    x = t.tracks(spark, d)
    return x.where("v > 90").select("track").distinct(), x.where("v < 10").select("track").distinct()


_set("set_union", "UNION", lambda s, d: (lambda a, b: a.union(b).distinct())(*_ab(s, d)))
_set("set_intersect", "INTERSECT", lambda s, d: (lambda a, b: a.intersect(b))(*_ab(s, d)))
_set("set_except", "EXCEPT", lambda s, d: (lambda a, b: a.subtract(b))(*_ab(s, d)))


def _projection(axis):
    a, b = (c for c in "xyz" if c != axis)

    def f(spark, d):
        return voxels.projected(t.voxels(spark, d), axis)

    f.__name__ = f"mip_{a}{b}"
    query(f"WITH {_V} SELECT {a}, {b}, max(v) AS v FROM im GROUP BY 1, 2")(f)


for _axis in "zyx":
    _projection(_axis)


@query(f"WITH {_V} SELECT x, y, z, CAST(v >= 40 AS INTEGER) AS v FROM im")
def threshold(spark, d):
    return t.voxels(spark, d).withColumn("v", (F.col("v") >= 40).cast("int"))


@query(f"WITH {_V} SELECT x - 8 AS x, y - 8 AS y, z, v FROM im WHERE x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23")
def crop(spark, d):
    return t.voxels(spark, d).where(F.col("x").between(8, 23) & F.col("y").between(8, 23)).select((F.col("x") - 8).alias("x"), (F.col("y") - 8).alias("y"), "z", "v")


@query(f"WITH {_S} SELECT x, y, z, max(v) AS v FROM sp GROUP BY 1, 2, 3")
def dilate(spark, d):
    return voxels.dilated(t.voxels(spark, d))


@query(f"WITH {_S} SELECT x, y, z, min(v) AS v FROM sp GROUP BY 1, 2, 3 HAVING count(*) = 7")
def erode(spark, d):
    return voxels.eroded(t.voxels(spark, d))


@query(f"""WITH {_S}, er AS (SELECT x, y, z, min(v) AS v FROM sp GROUP BY 1, 2, 3 HAVING count(*) = 7)
    SELECT x + i AS x, y + j AS y, z + k AS z, max(v) AS v FROM er, o GROUP BY 1, 2, 3""")
def opening(spark, d):
    return voxels.dilated(voxels.eroded(t.voxels(spark, d)))


@query(f"WITH {_S} SELECT x, y, z, round(avg(sp.v), 6) AS v FROM sp JOIN im USING (x, y, z) GROUP BY 1, 2, 3")
def mean_filter(spark, d):
    return voxels.local(t.voxels(spark, d), F.round(F.avg("v"), 6))


@query(f"WITH {_S} SELECT x, y, z, median(sp.v) AS v FROM sp JOIN im USING (x, y, z) GROUP BY 1, 2, 3")
def median_filter(spark, d):
    return voxels.local(t.voxels(spark, d), F.median("v"))


@query(f"WITH {_V}, h AS (SELECT CAST(floor(v / 5 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM im GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS upto FROM h")
def cumulative_hist(spark, d):
    return voxels.histogram(t.voxels(spark, d), 5.0)


@query(f"WITH {_V} SELECT CAST(floor(a.v / 10 + 0.5) AS BIGINT) AS i, CAST(floor(b.v / 10 + 0.5) AS BIGINT) AS j, count(*) AS n FROM im a JOIN im b ON a.x = b.x AND a.y = b.y AND a.z + 1 = b.z GROUP BY 1, 2")
def histogram2d(spark, d):
    a = t.voxels(spark, d)
    b = a.select("x", "y", (F.col("z") - 1).alias("z"), F.col("v").alias("u"))
    return a.join(b, ["x", "y", "z"]).groupBy(F.floor(F.col("v") / 10 + 0.5).alias("i"), F.floor(F.col("u") / 10 + 0.5).alias("j")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_V} SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, round(avg(v), 6) AS v, count(*) AS n FROM im GROUP BY 1, 2, 3")
def pyramid(spark, d):
    return voxels.pyramid(t.voxels(spark, d)).withColumn("v", F.round("v", 6))


@query(f"""WITH RECURSIVE {_V}, s AS (SELECT x, y, z, x * 1000000000000 + y * 1000000 + z AS id FROM im WHERE v >= 48),
    l AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1), c(id, m) AS (SELECT a, b FROM l UNION SELECT c.id, l.b FROM c JOIN l ON c.m = l.a)
    SELECT x, y, z, min(m) AS component FROM c JOIN s USING (id) GROUP BY 1, 2, 3""")
def connected_components(spark, d):
    return voxels.components(t.voxels(spark, d).where("v >= 48"))


@query(f"WITH {_V} SELECT x // 4 AS bx, y // 4 AS by, z // 4 AS bz, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, count(*) AS n FROM im GROUP BY 1, 2, 3")
def block_stats(spark, d):
    return voxels.block_statistics(t.voxels(spark, d), 4).select("bx", "by", "bz", _r("mean"), _r("variance"), "n")


@query(f"""WITH {_V}, g AS (SELECT a.x // 8 AS bx, a.y // 8 AS by, a.z // 8 AS bz, count(*) AS n, covar_pop(a.v, b.v) AS c, var_pop(a.v) AS p, var_pop(b.v) AS q FROM im a JOIN im b ON a.x = b.x AND a.y = b.y AND b.z = a.z + 1 GROUP BY 1, 2, 3)
    SELECT bx, "by", bz, n, round(CASE WHEN p > 1e-9 AND q > 1e-9 THEN c * c / (p * q) END, 6) AS cc FROM g""")
def block_cc(spark, d):
    a = t.voxels(spark, d)
    return voxels.block_correlation(a, a.withColumn("z", F.col("z") - 1), 8).select("bx", "by", "bz", "n", _r("cc"))


@query(f"WITH {_V} SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, v FROM im, range(2) AS a(i), range(2) AS b(j), range(2) AS c(k)")
def resample_nearest(spark, d):
    return voxels.resampled_nearest(t.voxels(spark, d), 2)


@query(f"WITH {_N} SELECT id, round(-y + 1, 6) AS x, round(x + 2, 6) AS y, round(2 * z - 1, 6) AS z FROM n")
def apply_matrix(spark, d):
    m = [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 2, -1], [0, 0, 0, 1]]
    return t.nodes(spark, d).select("id", *transforms.applied(m)).select("id", _r("x"), _r("y"), _r("z"))


_P = f"{_N}, pr AS (SELECT a.label AS g, a.id AS i, a.x AS ax, a.y AS ay, a.z AS az, b.x AS qx, b.y AS qy, b.z AS qz FROM n a JOIN n b ON b.id = a.id + 1)"


def _pairings(spark, d):
    n = t.nodes(spark, d)
    b = n.select((F.col("id") - 1).alias("i"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return n.select(F.col("label").alias("g"), F.col("id").alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(b, "i")


@query(f"WITH {_P} SELECT g, round(avg(qx - ax), 6) AS dx, round(avg(qy - ay), 6) AS dy, round(avg(qz - az), 6) AS dz, count(*) AS n FROM pr GROUP BY 1")
def fit_translation(spark, d):
    return transforms.translation(_pairings(spark, d)).select("g", _r("dx"), _r("dy"), _r("dz"), "n")


@query(f"""WITH {_P}, f AS (SELECT g, avg(qx - ax) AS dx, avg(qy - ay) AS dy, avg(qz - az) AS dz FROM pr GROUP BY 1),
    r AS (SELECT pr.*, sqrt((qx - ax - dx) ** 2 + (qy - ay - dy) ** 2 + (qz - az - dz) ** 2) AS e FROM pr JOIN f USING (g)),
    k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(e, 9), i) AS r, count(*) OVER (PARTITION BY g) AS m FROM r)
    SELECT g, round(avg(qx - ax), 6) AS dx, round(avg(qy - ay), 6) AS dy, round(avg(qz - az), 6) AS dz, count(*) AS n FROM k WHERE r <= floor(m * 0.5) GROUP BY 1""")
def residual_trim(spark, d):
    return transforms.trimmed_translation(_pairings(spark, d), 0.5).select("g", _r("dx"), _r("dy"), _r("dz"), "n")


@query(f"WITH {_P} SELECT g, {', '.join(f'round(regr_slope(q{c}, a{c}), 6) AS s{c}, round(regr_intercept(q{c}, a{c}), 6) AS c{c}' for c in 'xyz')} FROM pr GROUP BY 1")
def fit_scaling(spark, d):
    return transforms.line_fit(_pairings(spark, d)).select("g", *[_r(f"{k}{c}") for c in "xyz" for k in "sc"])


@query(f"WITH {_T} SELECT track, t, round(sum(v) OVER w, 4) AS dx, round(sum(v / 2) OVER w, 4) AS dy, round(sum(-v) OVER w, 4) AS dz FROM tr WINDOW w AS (PARTITION BY track ORDER BY t)")
def compose_translation(spark, d):
    steps = t.tracks(spark, d).select("track", "t", F.col("v").alias("dx"), (F.col("v") / 2).alias("dy"), (-F.col("v")).alias("dz"))
    return transforms.composed(steps).select("track", "t", _r("dx", 4), _r("dy", 4), _r("dz", 4))


@query(f"WITH {_N}, r AS (SELECT label, sqrt(x * x + y * y + z * z) AS r FROM n) SELECT label, round(quantile_cont(r, 0.8), 6) AS outer_r, round(quantile_cont(r, 0.2), 6) AS inner_r FROM r GROUP BY 1")
def percentile_shells(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return t.nodes(spark, d).groupBy("label").agg(F.round(F.percentile(r, 0.8), 6).alias("outer_r"), F.round(F.percentile(r, 0.2), 6).alias("inner_r"))


@query("""WITH d AS (SELECT vec_id % 8 AS t, vec_id // 8 AS cell, CASE WHEN vec_id % 8 = 0 THEN -1 ELSE vec_id // 8 + label * 3 END AS parent FROM embeddings)
    SELECT d.t, d.cell, d.parent, CAST(m.cell IS NOT NULL AS INTEGER) AS linked, CAST(m.cell IS NULL AND d.parent <> -1 AS INTEGER) AS lost FROM d LEFT JOIN d m ON m.t = d.t - 1 AND m.cell = d.parent""")
def parent_link(spark, d):
    e = t.table(spark, d, "embeddings")
    cell = F.expr("vec_id div 8")
    return motion.linked(e.select((F.col("vec_id") % 8).alias("t"), cell.alias("cell"), F.when(F.col("vec_id") % 8 == 0, -1).otherwise(cell + F.col("label") * 3).alias("parent")))


@query(f"WITH {_T}, s AS (SELECT * FROM tr WHERE t % 3 <> 1) SELECT track, t, id, round(abs(v - lag(v) OVER w) * 2.0 / (t - lag(t) OVER w), 6) AS speed FROM s WINDOW w AS (PARTITION BY track ORDER BY t)")
def velocity(spark, d):
    return motion.speeds(t.tracks(spark, d).where("t % 3 <> 1"), 2.0).select("track", "t", "id", _r("speed"))


_I = f"""{_T}, k AS (SELECT track, t, v, (lead(v) OVER w - v) / (lead(t) OVER w - t) AS o, (v - lag(v) OVER w) / (t - lag(t) OVER w) AS i FROM tr WHERE t % 4 = 1 WINDOW w AS (PARTITION BY track ORDER BY t)),
    q AS (SELECT track, t FROM tr WHERE t % 4 <> 1)"""
_NEAR = "q ASOF LEFT JOIN k a ON q.track = a.track AND q.t >= a.t ASOF LEFT JOIN k b ON q.track = b.track AND q.t <= b.t"


def _interpolation(name, beyond, before, after):
    def f(spark, d):
        x = t.tracks(spark, d)
        return motion.interpolated(x.where("t % 4 = 1"), x.where("t % 4 <> 1"), beyond).select("track", "t", _r("v"))

    f.__name__ = name
    query(f"""WITH {_I} SELECT q.track, q.t, round(CASE WHEN a.t IS NULL AND b.t IS NULL THEN NULL WHEN a.t IS NULL THEN {before} WHEN b.t IS NULL THEN {after}
        ELSE a.v + (b.v - a.v) * (q.t - a.t) / (b.t - a.t) END, 6) AS v FROM {_NEAR}""")(f)


_interpolation("interp_linear", "clamp", "b.v", "a.v")
_interpolation("interp_zero", "zero", "0", "0")
_interpolation("interp_extrapolate", "extrapolate", "b.v + coalesce(b.o, b.i, 0) * (q.t - b.t)", "a.v + coalesce(a.i, a.o, 0) * (q.t - a.t)")


@query(f"""WITH {_P}, c AS (SELECT i, CASE WHEN ax * qy - ay * qx > 0 THEN -1 ELSE 1 END AS s,
    greatest(-1, least(1, (ax * qx + ay * qy + az * qz) / sqrt((ax * ax + ay * ay + az * az) * (qx * qx + qy * qy + qz * qz)))) AS cs FROM pr) SELECT i, round(s * acos(cs), 5) AS angle FROM c""")
def oriented_angle(spark, d):
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return _pairings(spark, d).select("i", F.round(angles.oriented_angle(angles.vector("a"), angles.vector("b"), up), 5).alias("angle"))


@query(f"WITH {_P} SELECT g, {', '.join(f'round(sum((i % 5 + 1) * (q{c} - a{c})) / sum(i % 5 + 1), 6) AS d{c}' for c in 'xyz')} FROM pr GROUP BY 1")
def stabilise(spark, d):
    return motion.weighted_translation(_pairings(spark, d), F.col("i") % 5 + 1).select("g", _r("dx"), _r("dy"), _r("dz"))


@query(f"""WITH {_K}, f AS (SELECT a AS id, t, avg(d) AS density FROM k WHERE rank <= 9 GROUP BY 1, 2), v AS (SELECT a.id, min({_D}) AS d FROM n a JOIN n b ON a.t = b.t AND b.id % 3 = 0 GROUP BY 1)
    SELECT f.id, f.t, round(v.d / f.density, 6) AS ratio FROM f JOIN v USING (id) WHERE v.d / f.density > 1.25""")
def seed_candidates(spark, d):
    n = t.nodes(spark, d)
    return spatial.seeds(n, n.where("id % 3 = 0")).select("id", "t", _r("ratio"))


@query(f"WITH {_V} SELECT x + 3 * z - lx AS x, y - z - ly AS y, v, z FROM im, (SELECT min(x + 3 * z) AS lx, min(y - z) AS ly FROM im)")
def shift_bbox(spark, d):
    return voxels.on_canvas(t.voxels(spark, d).select((F.col("x") + 3 * F.col("z")).alias("x"), (F.col("y") - F.col("z")).alias("y"), "z", "v"), "xy")


def landmark_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest one-to-one pairs between the nodes of a label in each frame, t, and the next."""
    n = t.nodes(spark, d).select("t", F.col("label").alias("g"), "id", "x", "y", "z")
    return motion.assigned_points(n, n.withColumn("t", F.col("t") - 1))


#: SQL can't express it; tests compare it with all permutations.
QUERIES["landmark_assignment"] = landmark_assignment

from chronovox.plans import wider as _wider  # noqa: E402, F401, I001
from chronovox.plans import further as _further  # noqa: E402, F401
from chronovox.plans import files as _files  # noqa: E402, F401
from chronovox.plans import shapes as _shapes  # noqa: E402, F401
from chronovox.plans import floods as _floods  # noqa: E402, F401
