"""Queries of flooding, label images, splines and fitted curves; chronovox.catalog imports this module at its end."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from chronovox.catalog import _V, _r, query
from chronovox.operators import curves, flooding, registration, splines
from chronovox.sources import tables as t


@query()
def marker_watershed(spark, d):
    """An image flooded from its darkest voxels. SQL can't express it; tests compare it with a plain flood."""
    image = t.voxels(spark, d)
    marks = image.where("v <= 20").select("x", "y", "z", (F.col("x") * 1000 + F.col("y") * 10 + F.col("z")).alias("label"))
    return flooding.watershed(image, marks)


@query()
def h_maxima(spark, d):
    """Maxima that rise by 6 over their surroundings, lower ones by what they rise."""
    return flooding.h_maxima(t.voxels(spark, d), 6.0)


#: Chamfer length between a and b in a box without holes.
_WAY = """(3 * greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) + abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) - greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)))"""


def _box(image):
    """All places of an image's bounding box."""
    box = image.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))]).where("ax IS NOT NULL")
    for c in "xyz":
        box = box.withColumn(c, F.explode(F.sequence(f"a{c}", f"b{c}")))
    return box.select("x", "y", "z")


@query(f"""WITH {_V}, s AS (SELECT x, y, z, x * 1000 + y * 10 + z AS label FROM im WHERE v = 50),
    bx AS (SELECT p.x, q.y, r.z FROM (SELECT unnest(range(min(x), max(x) + 1)) AS x FROM im) p, (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM im) q, (SELECT unnest(range(min(z), max(z) + 1)) AS z FROM im) r),
    k AS (SELECT a.x, a.y, a.z, min({_WAY} * 1000000 + b.label) AS k FROM bx a, s b GROUP BY 1, 2, 3) SELECT x, y, z, CAST(k % 1000000 AS BIGINT) AS label, CAST(k // 1000000 AS BIGINT) AS d FROM k""")
def influence_zones(spark, d):
    """The nearest of the brightest voxels to every place of the image's box."""
    image = t.voxels(spark, d)
    seeds = image.where("v = 50").select("x", "y", "z", (F.col("x") * 1000 + F.col("y") * 10 + F.col("z")).alias("label"))
    return flooding.influence(_box(image), seeds).withColumn("d", F.col("d").cast("long"))


@query()
def parcelled(spark, d):
    """Bright voxels in parcels around seeds that move to their middles. SQL can't express the rounds; tests compare them."""
    image = t.voxels(spark, d).where("v >= 30")
    seeds = image.where("x % 8 = 4 AND y % 8 = 4 AND z = 4").select("x", "y", "z", (F.col("x") * 100 + F.col("y")).alias("label"))
    return flooding.parcels(image, seeds, rounds=3)[0].withColumn("d", F.col("d").cast("long"))


_SIDE = "SELECT DISTINCT CAST(floor(v / 25) AS BIGINT) + 1 AS g, x, y, {z} AS z, {k} AS k, TRUE AS own FROM im WHERE {where}"


@query(f"""WITH {_V}, i AS ({_SIDE.format(z='z', k=0, where='z <= 3')} UNION ALL {_SIDE.format(z='z - 3', k=1, where='z > 3')}),
    b AS (SELECT g, min(x) - 1 AS ax, max(x) + 2 AS bx, min(y) - 1 AS ay, max(y) + 2 AS bb, min(z) - 1 AS az, max(z) + 2 AS bz FROM i GROUP BY 1 HAVING count(DISTINCT k) = 2),
    px AS (SELECT g, unnest(range(CAST(ax AS BIGINT), CAST(bx AS BIGINT))) AS x FROM b), py AS (SELECT g, unnest(range(CAST(ay AS BIGINT), CAST(bb AS BIGINT))) AS y FROM b), pz AS (SELECT g, unnest(range(CAST(az AS BIGINT), CAST(bz AS BIGINT))) AS z FROM b),
    s AS (SELECT g, k, x, y, z, i.own IS NOT NULL AS has FROM (SELECT g, k, x, y, z FROM px JOIN py USING (g) JOIN pz USING (g), (VALUES (0), (1)) AS v(k)) LEFT JOIN i USING (g, k, x, y, z)),
    w AS (SELECT a.g, a.k, a.x, a.y, a.z, min(CASE WHEN a.has THEN -1 ELSE 1 END) * min({_WAY}) AS d FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.has <> b.has GROUP BY 1, 2, 3, 4, 5),
    e AS (SELECT g, x, y, z, sum(CASE WHEN k = 0 THEN 0.6 ELSE 0.4 END * d) AS s FROM w GROUP BY 1, 2, 3, 4)
    SELECT x, y, z, CAST(g AS BIGINT) AS v FROM e WHERE s < -1e-9 QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY round(s, 9), g) = 1""")
def labels_between(spark, d):
    """The label image 0.4 of the way from the lower slices to the upper ones."""
    label = t.voxels(spark, d).select("x", "y", "z", F.floor(F.col("v") / 25).alias("v"))
    low, high = label.where("z <= 3"), label.where("z > 3").withColumn("z", F.col("z") - 3)
    couples = label.select((F.col("v") + 1).alias("g"), F.col("v").alias("l"), F.col("v").alias("r")).distinct()
    return flooding.labels_between(low, high, couples, 0.4)


_M = np.array([[0.96, -0.2, 0.0, 1.3], [0.2, 0.97, 0.05, -0.8], [0.0, -0.05, 1.02, 0.1], [0.0, 0.0, 0.0, 1.0]])
_BACK = [[float(u) for u in row] for row in np.linalg.inv(_M)]


def _weights(axis: str, before: str) -> str:
    """SQL: weights of B-splines through `before` along an axis, two places beyond the image's bounds too."""
    u, v = (c for c in "xyz" if c != axis)
    return f"""SELECT o."{axis}", b."{u}", b."{v}", sum(b.v * {math.sqrt(3)} * pow({splines.POLE}, abs(o."{axis}" - b."{axis}"))) AS v
        FROM {before} b, (SELECT unnest(range(min("{axis}") - 2, max("{axis}") + 3)) AS "{axis}" FROM im) o GROUP BY 1, 2, 3"""


def _bump(u: str) -> str:
    return f"(CASE WHEN abs({u}) < 1 THEN 2.0 / 3 - {u} * {u} + abs({u}) ** 3 / 2 WHEN abs({u}) < 2 THEN (2 - abs({u})) ** 3 / 6 ELSE 0 END)"


@query(f"""WITH {_V}, wx AS ({_weights('x', 'im')}), wy AS ({_weights('y', 'wx')}), wz AS ({_weights('z', 'wy')}),
    q AS (SELECT x, y, z, {', '.join(f'round({r[0]} * x + {r[1]} * y + {r[2]} * z + {r[3]}, 9) AS f{c}' for r, c in zip(_BACK, 'xyz'))} FROM im),
    b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS bb, min(z) AS az, max(z) AS bz FROM im),
    k AS (SELECT q.*, {', '.join(f'CAST(floor(f{c}) AS BIGINT) + {n}.o AS k{c}' for c, n in zip('xyz', ('i', 'j', 'l')))} FROM q, b, (SELECT unnest([-1, 0, 1, 2]) AS o) i, (SELECT unnest([-1, 0, 1, 2]) AS o) j, (SELECT unnest([-1, 0, 1, 2]) AS o) l
        WHERE fx BETWEEN ax AND bx AND fy BETWEEN ay AND bb AND fz BETWEEN az AND bz)
    SELECT k.x, k.y, k.z, round(sum({_bump('(fx - kx)')} * {_bump('(fy - ky)')} * {_bump('(fz - kz)')} * wz.v), 6) AS v FROM k JOIN wz ON wz.x = kx AND wz.y = ky AND wz.z = kz GROUP BY 1, 2, 3""")
def resample_spline(spark, d):
    """The image turned and stretched, through cubic B-splines."""
    image = t.voxels(spark, d)
    return splines.by_matrix(image, _M, image).select("x", "y", "z", _r("v"))


@query()
def fitted_histogram(spark, d):
    """A Gaussian fitted to the histogram of places along x; SQL can't express the rounds, tests compare the fit."""
    bins = t.nodes(spark, d).groupBy(F.floor(F.col("x") * 64).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("y")).select(((F.col("b") + 0.5) / 64).alias("x"), "y")
    m = bins.agg((F.sum(F.col("x") * F.col("y")) / F.sum("y")).alias("m"), (F.sum(F.col("x") * F.col("x") * F.col("y")) / F.sum("y")).alias("q"), F.max("y").alias("a")).collect()[0]
    if m["m"] is None:
        return spark.createDataFrame([], "top double, mean double, deviation double, error double, settled boolean")
    start = [m["a"], m["m"], math.sqrt(max(m["q"] - m["m"] ** 2, 1e-6))]
    found, error, settled = curves.fitted(bins, ["gaussian"], start)
    row = [*[round(p, 4) for p in (found[0], found[1], abs(found[2]))], round(error, 3), settled]
    return spark.createDataFrame([row], "top double, mean double, deviation double, error double, settled boolean")


@query(f"WITH {_V} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(CASE WHEN r = c OR (r = 0 AND c = 3) THEN 1 WHEN r = 1 AND c = 3 THEN -1 ELSE 0 END AS DOUBLE) AS v FROM range(4) AS a(r), range(4) AS b(c) WHERE EXISTS (SELECT 1 FROM im)")
def block_matching(spark, d):
    """The translation that an image moved by (1, -1, 0) is found to have made."""
    image = t.voxels(spark, d)
    moved = image.withColumns({"x": F.col("x") + 1, "y": F.col("y") - 1})
    m = registration.block_matching(image, moved, "translation", levels=1, rounds=3, width=8, half=1)
    return spark.createDataFrame([(r, c, round(float(m[r, c]), 6) + 0.0) for r in range(4) for c in range(4)], "r long, c long, v double")
