"""Intermediate tables that every executor can read, in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, removed when the session's JVM ends or by :func:`release`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends here, and a lost executor costs
    nothing that was written."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table of :func:`stored` that nothing reads any more."""
    fs, at = file_system(table.sparkSession, table._stored_at)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Remove what this session wrote here; results that still read it are lost with it."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        fs, at = file_system(spark, path)
        fs.delete(at, True)


def last_change(spark: SparkSession, path: str) -> int | None:
    """When the newest file below ``path`` was written, in milliseconds; None if there is none."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    files, newest = fs.listFiles(at, True), None
    while files.hasNext():
        newest = max(newest or 0, files.next().getModificationTime())
    return newest


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
