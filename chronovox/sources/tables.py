"""Model tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: id, t, x, y, z, label."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 8).alias("t"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), "label")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains: track, t (rank), id, v."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("event_id").alias("id"), F.col("value").alias("v"))


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of consecutive detections of a track."""
    w = Window.partitionBy("track").orderBy("t")
    return tracks(spark, sf_dir).select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst IS NOT NULL")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse image: x, y, z, v."""
    k = lambda c: (F.col(c) % 32).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(
        k("l_partkey").alias("x"), k("l_suppkey").alias("y"), F.col("l_linenumber").cast("long").alias("z")).agg(F.max("l_quantity").cast("double").alias("v"))
