"""Detections that arrive frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """A stream of Parquet files below a folder, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counted(stream: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """start, the columns of `by`, n: rows in windows of time; rows later than `late` behind the newest are dropped by the
    watermark, once their window is closed."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *(by or []), "n")


def linked(stream: DataFrame, parents: DataFrame, time: str, late: str = "10 minutes", apart: str = "10 minutes") -> DataFrame:
    """A stream's detections (t, cell, parent, time) with those of the frame before, from the same folder read a second time
    as `parents`: an inner join of two streams, whose state a watermark bounds."""
    a = stream.withWatermark(time, late).select("t", "cell", "parent", F.col(time).alias("at"))
    b = parents.withWatermark(time, late).select((F.col("t") + 1).alias("u"), F.col("cell").alias("mother"), F.col(time).alias("before"))
    on = (F.col("t") == F.col("u")) & (F.col("parent") == F.col("mother")) & F.expr(f"at >= before AND at <= before + INTERVAL {apart}")
    return a.join(b, on).select("t", "cell", "parent", "at")
