"""Text, CSV and XML files: points, matrices, correspondences, parameters, positions, labels, detections, spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What starts a comment in a point list.
COMMENT = r"^\s*(#|%|//)"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({_NUMBER})")), lambda x: x.cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (number from 0), text. Such files are small; each is one row, as their order counts."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """file, i, x, y, z of lines of two or three numbers (z = 0 if absent); comments, blank and other lines are left out."""
    rows = _lines(spark, path).where(~F.col("text").rlike(COMMENT)).withColumn("n", _numbers(F.col("text"))).where("size(n) IN (2, 3)")
    i = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return rows.select("file", i.cast("long").alias("i"), F.col("n")[0].alias("x"), F.col("n")[1].alias("y"), F.coalesce(F.get("n", F.lit(2)), F.lit(0.0)).alias("z"))


def matrices(spark: SparkSession, path: str, sign: float = 1.0) -> DataFrame:
    """file, m: the 16 numbers of a 4 x 4 matrix, row by row; a header in parentheses is skipped. Files of another shape are
    left out. sign = -1 negates every entry."""
    rows = _lines(spark, path).withColumn("n", _numbers(F.col("text"))).where("size(n) = 4")
    m = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "n"))), lambda r: r["n"]))
    return rows.groupBy("file").agg(F.transform(m, lambda x: x * sign).alias("m")).where("size(m) = 16")


def correspondences(spark: SparkSession, path: str) -> DataFrame:
    """file, line, l, r: every pair of labels across the dash of `l0 l1 - r0 r1`."""
    side = lambda k: F.expr(f"transform(regexp_extract_all(get(split(text, '-'), {k}), '([0-9]+)'), x -> CAST(x AS BIGINT))")
    rows = _lines(spark, path).where(F.col("text").contains("-") & ~F.col("text").rlike(COMMENT)).select("file", "line", side(0).alias("ls"), side(1).alias("rs"))
    return rows.withColumn("l", F.explode("ls")).select("file", "line", "l", F.explode("rs").alias("r"))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """file, name, k, value of `name,value,comment` lines; a blank name goes on with the list above."""
    parts = _lines(spark, path).withColumn("p", F.split("text", ",")).where("size(p) >= 2")
    named = parts.select("file", "line", F.when(F.trim(F.col("p")[0]) != "", F.trim(F.col("p")[0])).alias("own"), F.trim(F.col("p")[1]).alias("value"))
    w = Window.partitionBy("file").orderBy("line")
    filled = named.withColumn("name", F.last("own", ignorenulls=True).over(w)).where("name IS NOT NULL AND value <> ''")
    k = F.row_number().over(Window.partitionBy("file", "name").orderBy("line")) - 1
    return filled.select("file", "name", k.alias("k"), "value")


def positions(spark: SparkSession, path: str, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """x, y, z, t of CSV rows with a header (barycentres; divisions with scale (1, 1, 5)); rows that don't parse are left out."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").schema("x double, y double, z double, t double").csv(path)
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND t IS NOT NULL").select(
        *[(F.col(c) * s).alias(c) for c, s in zip("xyz", scale, strict=True)], F.col("t").cast("long").alias("t"))


def node_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label: the first and tenth column of a node database in CSV."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("p"))
    n = lambda k: F.expr(f"try_cast(get(p, {k}) AS double)").cast("long")
    return rows.select(n(0).alias("id"), n(9).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")


def detections(spark: SparkSession, path: str, row_tag: str, z_scale: float = 1.0) -> DataFrame:
    """t, cell, parent, lineage, x, y, z, supervoxels, intensity, shape (nine numbers), coeffs (its upper triangle times nu,
    then the position), invalid. One XML file a frame; t is the last number of its name. Rows whose position isn't finite
    are kept with invalid = true and null positions, so that they can be counted; rows that don't parse are left out."""
    names = ("id", "parent", "lineage", "m", "svIdx", "alpha", "alphaPrior", "nu", "W")
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(", ".join(f"_{n} string" for n in names)).load(path)
    arr = lambda c, kind: F.expr(f"transform(filter(split(trim({c}), '\\\\s+'), x -> x <> ''), x -> try_cast(x AS {kind}))")
    num = lambda c, kind: F.expr(f"try_cast({c} AS {kind})")
    bad = F.col("_m").contains("-1.#IND")
    m = F.when(~bad, arr("_m", "double"))
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)[^0-9/]*$", 1).cast("long").alias("t"), num("_id", "bigint").alias("cell"), num("_parent", "bigint").alias("parent"),
        num("_lineage", "bigint").alias("lineage"), m.alias("p"), arr("_svIdx", "int").alias("supervoxels"), F.greatest(num("_alpha", "double") - num("_alphaPrior", "double"), F.lit(0.0)).alias("intensity"),
        arr("_W", "double").alias("shape"), num("_nu", "double").alias("nu"), bad.alias("invalid"))
    fine = rows.where("invalid OR (cell IS NOT NULL AND parent IS NOT NULL AND size(p) = 3 AND size(shape) = 9 AND nu IS NOT NULL AND intensity IS NOT NULL)")
    at = F.array(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2)) * z_scale)
    upper = F.transform(F.array(*[F.get("shape", F.lit(k)) for k in (0, 1, 2, 4, 5, 8)]), lambda x: x * F.col("nu"))
    return fine.withColumn("p", at).select(
        "t", "cell", "parent", "lineage", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")], "supervoxels", "intensity", "shape", F.concat(upper, F.col("p")).alias("coeffs"), "invalid")


def numbered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, t, cell, x, y, z, is_root, lost) and edges (src, dst) of detections. Ids run in order of (t, cell), without
    a sort into one task: an id is the count of earlier frames' rows plus the rank in its own."""
    good = found.where("NOT invalid")
    ahead = good.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select("t", (F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("ahead"))
    ids = good.join(F.broadcast(ahead), "t").withColumn("id", F.col("ahead") + F.row_number().over(Window.partitionBy("t").orderBy("cell")) - 1)
    mothers = ids.select((F.col("t") + 1).alias("t"), F.col("cell").alias("parent"), F.col("id").alias("src"))
    both = ids.join(mothers, ["t", "parent"], "left")
    nodes = both.select("id", "t", "cell", "x", "y", "z", F.col("src").isNull().alias("is_root"), (F.col("src").isNull() & (F.col("parent") != -1)).alias("lost"))
    return nodes, both.where("src IS NOT NULL").select("src", F.col("id").alias("dst"))


def spots(spark: SparkSession, path: str) -> DataFrame:
    """id, t, x, y, z of the spots in a MaMuT file."""
    s = "_ID string, _frame string, _POSITION_X string, _POSITION_Y string, _POSITION_Z string"
    rows = spark.read.format("xml").option("rowTag", "SpotsInFrame").schema(f"_frame string, Spot array<struct<{s}>>").load(path)
    rows = rows.select(F.col("_frame").cast("long").alias("t"), F.explode("Spot").alias("s"))
    return rows.select(F.expr("try_cast(s._ID AS bigint)").alias("id"), "t", *[F.expr(f"try_cast(s._POSITION_{c.upper()} AS double)").alias(c) for c in "xyz"])


def spot_edges(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """track, src, dst; src is the earlier spot. Edges with an unknown end are left out."""
    rows = spark.read.format("xml").option("rowTag", "Track").schema("_TRACK_ID string, Edge array<struct<_SPOT_SOURCE_ID string, _SPOT_TARGET_ID string>>").load(path)
    e = rows.select(F.expr("try_cast(_TRACK_ID AS bigint)").alias("track"), F.explode("Edge").alias("e")).select(
        "track", F.expr("try_cast(e._SPOT_SOURCE_ID AS bigint)").alias("a"), F.expr("try_cast(e._SPOT_TARGET_ID AS bigint)").alias("b"))
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("t").alias(f"t{c}"))
    known = e.join(at("a"), "a").join(at("b"), "b")
    turned = F.col("ta") > F.col("tb")
    return known.select("track", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("dst"))
