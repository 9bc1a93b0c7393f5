"""Queries that write files below the shared folder, read them back and return what they hold, and queries of streams;
chronovox.catalog imports this module at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.catalog import _N, _V, query
from chronovox.operators import spatial, voxels
from chronovox.operators.checkpoints import new_folder, stored
from chronovox.plans.wider import _links
from chronovox.sources import binaries, exports, grids, texts
from chronovox.sources import tables as t
from chronovox.streaming import frames

_M = f"{_N}, m AS (SELECT n.*, CASE WHEN t > 0 THEN id - 1 END AS mother FROM n)"


def _written(spark, encoded: DataFrame) -> str:
    """The folder of files (name, content)."""
    at = new_folder(spark, "files")
    binaries.saved(encoded, at.removeprefix("file://").removeprefix("file:"))
    return at


@query(f"WITH {_M} SELECT id, t, x, y, z, mother FROM m")
def lineage_file(spark, d):
    n = t.nodes(spark, d)
    at = _written(spark, binaries.lineage_encoded(n, _links(n), 4))
    return binaries.lineages(spark, at).drop("file")


@query(f"""WITH {_N}, g AS (SELECT a.t, a.id AS a, b.id AS b FROM n a JOIN n b ON a.t = b.t AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.t = a.t AND c.id <> a.id AND c.id <> b.id
    AND (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) + (a.z - c.z) * (b.z - c.z) < 0)) SELECT * FROM g""")
def graph_file(spark, d):
    """The Gabriel graph of every frame, written and read: rows grow with the nodes."""
    at = _written(spark, binaries.gabriel_encoded(spatial.gabriel(t.nodes(spark, d))))
    return binaries.gabriel_graphs(spark, at).drop("file")


def _in_pieces(spark, parts: DataFrame) -> str:
    """The folder of files put together from (name, piece, content)."""
    at = new_folder(spark, "files")
    grids.saved(parts, at)
    return at


def _image_file(form: str, kind: str, size: tuple[float, float, float]):
    def run(spark, d):
        image = t.voxels(spark, d).withColumn("image", F.concat(F.lit("image"), F.col("x") % 3))
        if form == "tif":
            read = binaries.images(spark, _written(spark, binaries.images_encoded(image, kind)))
        else:
            read = grids.images(spark, _in_pieces(spark, grids.pieces(image, form, kind, size, block=(16, 9, 3))))
        name = F.regexp_extract("file", r"image([0-9]+)\.[a-z0-9]+$", 1).cast("long")
        return read.select(name.alias("image"), "x", "y", "z", "v", "vx", "vy", "vz")

    run.__name__ = f"{form}_file"
    vx, vy, vz = size
    query(f"WITH {_V} SELECT x % 3 AS image, x, y, z, v, CAST({vx} AS DOUBLE) AS vx, CAST({vy} AS DOUBLE) AS vy, CAST({vz} AS DOUBLE) AS vz FROM im")(run)


for _form, _kind, _size in (("inr", "f4", (1.0, 2.0, 6.25)), ("npy", "u2", (1.0, 1.0, 1.0)), ("tif", "u1", (1.0, 1.0, 1.0)), ("mha", "i2", (1.0, 0.5, 3.0)), ("nii", "f8", (0.5, 0.5, 2.0)), ("klb", "u2", (0.5, 0.5, 2.0)), ("h5", "i4", (1.0, 1.0, 1.0))):
    _image_file(_form, _kind, _size)


@query(f"WITH {_V} SELECT x, y, z, v FROM im WHERE x BETWEEN 5 AND 20 AND y < 7 AND z = 3")
def klb_roi(spark, d):
    """Of a compressed image only the blocks that meet the region are read."""
    at = _in_pieces(spark, grids.pieces(t.voxels(spark, d).withColumn("image", F.lit("whole")), "klb", "u2", block=(8, 8, 2), pack="bzip2"))
    return grids.images(spark, at).where("x BETWEEN 5 AND 20 AND y < 7 AND z = 3").select("x", "y", "z", "v")


@query(f"WITH {_V}, m AS (SELECT min(x - z) AS lx, min(y - 2 * z) AS ly FROM im) SELECT x - z - lx AS x, y - 2 * z - ly AS y, z, v FROM im, m")
def resampled_file(spark, d):
    """A sheared image has negative places: it is moved onto a canvas, written and read."""
    sheared = t.voxels(spark, d).select((F.col("x") - F.col("z")).alias("x"), (F.col("y") - 2 * F.col("z")).alias("y"), "z", "v")
    at = _in_pieces(spark, grids.pieces(voxels.on_canvas(sheared, "xy").withColumn("image", F.lit("sheared")), "inr", "u1"))
    return grids.images(spark, at).select("x", "y", "z", "v")


@query(f"WITH {_V} SELECT x, y, z, v AS dx, v - x AS dy, z / 4 AS dz FROM im")
def field_file(spark, d):
    """A vector field as an image of three values a voxel; voxels without a vector are absent."""
    field = t.voxels(spark, d).select(F.lit("field").alias("image"), "x", "y", "z", F.col("v").alias("dx"), (F.col("v") - F.col("x")).alias("dy"), (F.col("z") / 4).alias("dz"))
    at = _in_pieces(spark, grids.pieces(field, "inr", "f8", values=("dx", "dy", "dz")))
    return grids.images(spark, at, vectors=True).where("dx <> 0 OR dy <> 0 OR dz <> 0").select("x", "y", "z", "dx", "dy", "dz")


@query(f"WITH {_V} SELECT x, y, dense_rank() OVER (ORDER BY z) - 1 AS z, v FROM im")
def slices_folder(spark, d):
    image = t.voxels(spark, d).withColumn("image", F.format_string("slice%08d", "z")).withColumn("z", F.lit(0))
    return binaries.stack(spark, _in_pieces(spark, grids.pieces(image, "npy", "u1")))


@query(f"WITH {_N} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM n")
def point_file(spark, d):
    at = new_folder(spark, "points")
    exports.to_text(exports.point_lines(t.nodes(spark, d).withColumnRenamed("id", "i")), ["t", "i"], at)
    return texts.points(spark, at).select("x", "y", "z")


@query(f"WITH {_N} SELECT id, label FROM n")
def label_file(spark, d):
    n, at = t.nodes(spark, d), new_folder(spark, "database")
    exports.to_csv(exports.database(n, _links(n)), at)
    return texts.node_labels(spark, at)


@query(f"WITH {_N} SELECT round(x, 5) AS x, round(y, 5) AS y, round(round(z, 5) * 5, 6) AS z, t FROM n")
def position_file(spark, d):
    at = new_folder(spark, "positions")
    exports.to_csv(t.nodes(spark, d).select("x", "y", "z", "t"), at)
    return texts.positions(spark, at, (1.0, 1.0, 5.0)).select("x", "y", F.round("z", 6).alias("z"), "t")


def _spots(spark, d) -> tuple[str, DataFrame]:
    n, at = t.nodes(spark, d), new_folder(spark, "spots")
    exports.to_mamut(n, _links(n), at)
    return at, texts.spots(spark, at)


@query(f"WITH {_N} SELECT id, t, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM n")
def spot_file(spark, d):
    return _spots(spark, d)[1]


@query(f"WITH {_M} SELECT id - t AS track, mother AS src, id AS dst FROM m WHERE mother IS NOT NULL")
def spot_edge_file(spark, d):
    return texts.spot_edges(spark, *_spots(spark, d))


def _detections(spark, d) -> DataFrame:
    """A file a frame: every node an element; every seventh has no mother, every eleventh one that isn't there."""
    n = t.nodes(spark, d)
    parent = F.when((F.col("t") == 0) | (F.col("id") % 7 == 0), -1).when(F.col("id") % 11 == 0, -2).otherwise(F.col("id") - 1)
    at = F.when(F.col("id") % 13 == 0, F.lit("-1.#IND -1.#IND -1.#IND")).otherwise(F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]))
    line = F.format_string(
        '<GaussianMixtureModel id="%d" lineage="%d" parent="%d" m="%s" svIdx="1 2 " alpha="3.5" alphaPrior="0.5" nu="2.0" W="1 2 3 4 5 6 7 8 9"></GaussianMixtureModel>',
        F.col("id"), F.col("id") - F.col("t"), parent, at)
    whole = n.groupBy("t").agg(F.concat_ws("\n", F.lit("<document>"), F.array_sort(F.collect_list(line)), F.lit("</document>")).alias("text"))
    files = whole.select(F.format_string("frame_%04d.xml", "t").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return texts.detections(spark, _written(spark, files), "GaussianMixtureModel", 2.0)


_F = f"""{_N}, f AS (SELECT t, id AS cell, CASE WHEN t = 0 OR id % 7 = 0 THEN -1 WHEN id % 11 = 0 THEN -2 ELSE id - 1 END AS parent, id - t AS lineage, id % 13 = 0 AS invalid,
    CASE WHEN id % 13 > 0 THEN x END AS x, CASE WHEN id % 13 > 0 THEN y END AS y, CASE WHEN id % 13 > 0 THEN z * 2 END AS z FROM n)"""


@query(f"WITH {_F} SELECT t, cell, parent, lineage, x, y, z, 3.0::DOUBLE AS intensity, invalid FROM f")
def detection_files(spark, d):
    return _detections(spark, d).select("t", "cell", "parent", "lineage", "x", "y", "z", "intensity", "invalid")


@query(f"WITH {_F} SELECT t, count(*) AS n, count(*) FILTER (invalid) AS invalid FROM f GROUP BY 1")
def detections_per_frame(spark, d):
    return _detections(spark, d).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if("invalid").alias("invalid"))


@query(f"""WITH {_F}, i AS (SELECT *, row_number() OVER (ORDER BY t, cell) - 1 AS id FROM f WHERE NOT invalid)
    SELECT a.id, a.t, a.cell, b.id IS NULL AS is_root, b.id IS NULL AND a.parent <> -1 AS lost FROM i a LEFT JOIN i b ON b.t = a.t - 1 AND b.cell = a.parent""")
def sequential_ids(spark, d):
    return texts.numbered(_detections(spark, d))[0].select("id", "t", "cell", "is_root", "lost")


@query("SELECT s_suppkey AS id, CAST(1 + (s_suppkey % 5 = i % 5)::INT * i AS DOUBLE) AS v, CAST(i AS BIGINT) AS i FROM supplier, range(16) r(i)")
def matrix_files(spark, d):
    s = t.table(spark, d, "supplier").select("s_suppkey")
    number = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (1 + F.when(F.col("s_suppkey") % 5 == i % 5, i).otherwise(0)).cast("string"))
    rows = F.concat_ws("\n", F.lit("("), *[F.concat_ws(" ", F.slice(number, 4 * k + 1, 4)) for k in range(4)], F.lit(")"))
    files = s.select(F.format_string("map%08d.trsf", "s_suppkey").alias("name"), F.encode(rows, "UTF-8").alias("content"))
    got = texts.matrices(spark, _written(spark, files)).select(F.regexp_extract("file", r"map([0-9]+)", 1).cast("long").alias("id"), F.posexplode("m").alias("i", "v"))
    return got.select("id", "v", F.col("i").cast("long").alias("i"))


@query("""SELECT CAST(p_partkey AS BIGINT) + i AS l, CAST(p_size AS BIGINT) + j AS r FROM part, range(2) a(i), range(2) b(j)""")
def correspondence_file(spark, d):
    at = new_folder(spark, "pairs")
    part = t.table(spark, d, "part")
    for name, column in (("l", "p_partkey"), ("r", "p_size")):
        part = part.withColumn(name, F.explode(F.array(F.col(column), F.col(column) + 1)))
    exports.to_correspondences(part.select(F.col("p_partkey").alias("g"), "l", "r"), at)
    return texts.correspondences(spark, at).select("l", "r")


@query(f"""WITH {_N} SELECT 1 AS section, printf('(node %d)', id) AS line FROM n UNION ALL SELECT 4, printf('(node %d "%d")', id, t) FROM n""")
def tulip_document(spark, d):
    n, at = t.nodes(spark, d), new_folder(spark, "tulip")
    lines = exports.tulip_lines(n, _links(n))
    exports.to_text(lines.where("section IN (1, 4)"), ["section", "k"], at)
    return spark.read.text(at).select(F.when(F.col("value").contains('"'), 4).otherwise(1).alias("section"), F.col("value").alias("line"))


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for the files there are: the rows of every batch, written once however often it runs."""
    spark = stream.sparkSession
    at, marks = new_folder(spark, "stream"), new_folder(spark, "marks")
    put = lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/batch={i}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", marks).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(at)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    """Windows are updated batch by batch; the watermark is so wide that no row is late."""
    events = t.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    at = new_folder(spark, "events")
    events.write.mode("overwrite").parquet(at)
    got = _finished(frames.counted(frames.arriving(spark, at, events.schema, 2), "ts", "1 hour", "36500 days", ["event_type"]), "update")
    return got.groupBy(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.max("n").alias("n"))


@query(f"WITH {_M} SELECT t, id AS cell, mother AS parent FROM m WHERE mother IS NOT NULL")
def stream_links(spark, d):
    n = t.nodes(spark, d)
    found = n.select("t", F.col("id").alias("cell"), (F.col("id") - 1).alias("parent"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * 60).alias("at"))
    at = new_folder(spark, "frames")
    found.write.mode("overwrite").parquet(at)
    a, b = (frames.arriving(spark, at, found.schema, 2) for _ in range(2))
    return _finished(frames.linked(a, b, "at", "36500 days"), "append").select("t", "cell", "parent")
