"""Versioned tables: every commit is a new folder, and a pointer file names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def version(spark: SparkSession, folder: str) -> int | None:
    """The committed version: the greatest pointer there is."""
    fs = _fs(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    numbers = [int(n[len("current-") :]) for n in found if n.startswith("current-") and n[len("current-") :].isdigit()]
    return max(numbers, default=None)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    n = version(spark, folder)
    return None if n is None else spark.read.parquet(f"{folder}/snapshot={n}")


def commit(df: DataFrame, folder: str, partition_by: str | None = None) -> int:
    """Writes the next snapshot and then its pointer, which no writer can make twice. Readers see all of it or none."""
    spark = df.sparkSession
    n = (version(spark, folder) or 0) + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/snapshot={n}")
    if not _fs(spark, folder).createNewFile(_path(spark, f"{folder}/current-{n}")):
        raise RuntimeError(f"version {n} was committed by someone else")
    return n


def open_or_create(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    found = current(spark, folder)
    if found is None:
        commit(spark.createDataFrame([], schema), folder)
        found = current(spark, folder)
    return found
