"""Results that iterations build on, kept as Parquet below the folder that the cluster names in spark.checkpoint.dir.

What is read back has the size of its files, not an estimate that every join of an iteration would multiply, so plans
stay as small in the last round as in the first. Executors may be lost at any time: nothing depends on their disks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder serves a local session, whose driver and
    executors are one process; on a cluster that would lose data, so it is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master, session = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if session not in _own:
        _own[session] = tempfile.mkdtemp(prefix="chronovox-")
    return _own[session]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses; it goes when the driver ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p, files = _path(spark, at)
    files.mkdirs(p)
    files.deleteOnExit(p)
    return at


def removed(spark: SparkSession, path: str) -> None:
    p, files = _path(spark, path)
    files.delete(p, True)


def stored_at(df: DataFrame) -> tuple[str, DataFrame]:
    """stored(df) and the folder that holds it, for those who want to remove it early."""
    spark = df.sparkSession
    at = new_folder(spark, "stored")
    df.write.mode("overwrite").parquet(at)
    return at, spark.read.schema(df.schema).parquet(at)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, written, and read back. Column names must differ."""
    return stored_at(df)[1]
