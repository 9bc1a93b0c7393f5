"""Helpers that several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronovox.operators.checkpoints import stored

#: A word is a run of code points other than ASCII white space.
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks held-out rows. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def unit(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) for each key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(1 << 53)


#: Groups of rows whose sizes the driver may hold and broadcast.
FEW = 10_000


def group_sizes(rows: DataFrame, by: str) -> list[tuple]:
    """(value of `by`, number of rows) of each group, or of FEW + 1 groups if there are more."""
    return [(r[0], r[1]) for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).limit(FEW + 1).collect()]


def bounded_sample(rows: DataFrame, by: str, key: str, most: int, seed: int = 7, sizes: list[tuple] | None = None) -> DataFrame:
    """About `most` rows, or all if fewer, of each non-null value of `by`: a row stays if a hash of `key` falls below
    most / count. Up to FEW counts are broadcast, so that rows stay where they lie; more meet the rows in salted groups, so
    that a frequent value is no single task's. sizes: what group_sizes() gave, if it's known."""
    spark, kind = rows.sparkSession, rows.schema[by].dataType
    sizes = group_sizes(rows, by) if sizes is None else sizes
    share = lambda n: F.lit(float(most)) / n
    if len(sizes) <= FEW:
        known = spark.createDataFrame(sizes, T.StructType([T.StructField(by, kind), T.StructField("__n", T.LongType())]))
        met = rows.join(F.broadcast(known), by)
    else:
        counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        met = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)).cast("int")).join(counts, [by, "__salt"]).drop("__salt")
    return met.where(unit(F.col(key), seed) < share(F.col("__n"))).drop("__n")


def in_order(df: DataFrame, order: list[Column], first: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """df with running sums and totals, at any number of rows: rows are dealt into ranges of `order`, summed inside each,
    and the ranges before are added; one row a range meets in a window.

    first: name -> expression whose sum over the rows before is wanted; total: likewise over all rows."""
    both = first | total
    n = partitions(df.sparkSession)
    dealt = stored(df.withColumns({f"__o{k}": c for k, c in enumerate(order)}).repartitionByRange(n, *[F.col(f"__o{k}") for k in range(len(order))]).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__s{k}") for k, c in enumerate(both.values())])
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    place = {name: k for k, name in enumerate(both)}
    ranges = sums.select("__range", *[F.sum(f"__s{place[name]}").over(ahead).alias(f"__a{place[name]}") for name in first], *[F.sum(f"__s{place[name]}").over(Window.partitionBy()).alias(f"__t{place[name]}") for name in total])
    inside = Window.partitionBy("__range").orderBy(*[F.col(f"__o{k}") for k in range(len(order))]).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"__i{place[name]}": F.sum(c).over(inside) for name, c in first.items()}).join(F.broadcast(ranges), "__range")
    zero = F.lit(0)
    return out.select(
        *df.columns, *[(F.coalesce(f"__a{place[name]}", zero) + F.coalesce(f"__i{place[name]}", zero)).alias(name) for name in first],
        *[F.col(f"__t{place[name]}").alias(name) for name in total])


#: Components of a graph of at most so many edges are solved in one task.
SMALL = 1 << 16


def joined_by_key(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with the columns of names, which has one row for every value of `key` and, in `rows`, how many rows have it.

    Values of over a thousandth of all rows are fewer than a thousand: their names are broadcast, so that no task gathers
    the rows of such a value. The others meet by a shuffle."""
    total = names.agg(F.sum("rows").alias("n")).collect()[0]["n"] or 0
    hot = F.broadcast(names.where(F.col("rows") * 1000 > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(names.where(F.col("rows") * 1000 <= total), key)
    return rows.join(hot, key).unionByName(rest).drop("rows")
