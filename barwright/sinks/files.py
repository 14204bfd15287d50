"""File tables.

Rows are gathered by partition value before a partitioned write, so a day becomes a few files
and not one per task. The gathering is a rebalance: a day that outgrows the advisory partition
size is split over several tasks instead of landing in one.
"""

import math
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barwright.scratch import file_system, stored
from barwright.sources.files import read_or_empty


class Target(NamedTuple):
    path: str
    partition_by: Sequence[str] = ()
    codec: str | None = "snappy"


class _Counted:
    """A writer and the number of rows that went through it.

    Rows are counted as they are written, in the stage that writes them, so nothing is read again and
    a task that ran twice before that stage counts once.
    """

    def __init__(self, df: DataFrame, mode: str, partition_by: Sequence[str], tasks: int | None = None):
        self._seen = Observation()
        if tasks:
            df = df.repartition(tasks, *[F.col(name) for name in partition_by])
        elif partition_by:
            df = df.hint("rebalance", *[F.col(name) for name in partition_by])
        self.writer = df.observe(self._seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
        if partition_by:
            self.writer = self.writer.partitionBy(*partition_by)

    @property
    def rows(self) -> int:
        return self._seen.get.get("rows", 0)


#: What a task writes of a table of many small partitions, and the rows of one that is not small.
TASK_FOLDERS = 100
FOLDER_ROWS = 100_000


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str]) -> DataFrameWriter:
    """Of a stored table. A rebalance puts as many partitions into a task as have its bytes together, which
    is all of them where a folder holds a few rows: these are dealt out by their number."""
    tasks = None
    if partition_by:
        sizes = df.groupBy(*partition_by).agg(F.count("*").alias("rows"))
        folders, most = sizes.agg(F.count("*"), F.max("rows")).first()
        if folders > TASK_FOLDERS and most <= FOLDER_ROWS:
            tasks = math.ceil(folders / TASK_FOLDERS)
    return _Counted(df, mode, partition_by, tasks).writer


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> int:
    """Replace the partitions present in ``df``; leave all others as they are. Returns the rows written.

    A partition is replaced as a whole, so ``df`` must hold every row of the days it touches; for
    some of its rows there is :func:`merge_partitions`.
    """
    counted = _Counted(df, "overwrite", partition_by)
    counted.writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return counted.rows


def overwrite_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Replace the whole table. Returns the rows written."""
    counted = _Counted(df, "overwrite", partition_by)
    counted.writer.option("partitionOverwriteMode", "static").parquet(path)
    return counted.rows


def merge_partitions(
    df: DataFrame,
    path: str,
    schema: StructType | str,
    keys: Sequence[str],
    partition_by: Sequence[str],
    *,
    gone: DataFrame | None = None,
) -> int:
    """Put the rows of ``df`` into a table by ``keys``, which name the partition columns too: a row of the
    same key is replaced, all others stay. Returns the rows of the partitions written.

    ``gone`` lists keys whose rows are removed. Only partitions that ``df`` or ``gone`` touch are read.
    They are staged in the shared folder and swapped in at the end, so a run that fails leaves the
    table as it was. Keys compare NULL-safe; of rows of ``df`` with one key any one is kept.
    """
    spark = df.sparkSession
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    new = stored(df.select(schema.names).dropDuplicates(list(keys)), "merged")
    named = new.select(*keys)
    named = named if gone is None else stored(named.union(gone.select(*keys)).distinct(), "replaced")
    day = partition_by[0]
    touched = {r[0] for r in named.select(day).distinct().collect()}  # no more than the table has folders
    held = read_or_empty(spark, path, schema)
    part = F.col(day).isin([v for v in touched if v is not None])
    held = held.filter(part | F.col(day).isNull() if None in touched else part)
    same = [held[key].eqNullSafe(named[key]) for key in keys]
    kept = held.join(named, same, "left_anti")
    whole = stored(kept.select(schema.names).unionByName(new), "staged")
    written = overwrite_partitions(whole, path, partition_by)
    if gone is not None:
        left = {r[0] for r in whole.select(day).distinct().collect()}
        drop_partitions(spark, path, day, touched - left)
    return written


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of the first partition column, as the folders name them; none of a missing table."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(at)]
    return sorted(name.partition("=")[2] for name in names if name.startswith(f"{column}="))


def drop_partitions(spark: SparkSession, path: str, column: str, values: Iterable[object]) -> None:
    """Remove partitions by the values of their first column. Values that are not there are no error."""
    for value in values:
        named = _NO_VALUE if value is None else value
        fs, at = file_system(spark, f"{path}/{column}={named}")
        fs.delete(at, True)


#: Fixed: how the folder of a null is named.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def append_new(
    df: DataFrame,
    path: str,
    schema: StructType | str,
    keys: Sequence[str],
    partition_by: Sequence[str] = (),
    *,
    held: DataFrame | None = None,
) -> int:
    """Append the rows whose key the table, or ``held`` as a part of it, does not hold yet. Returns how
    many these are.

    Keys compare NULL-safe. ``df`` must be unique on the keys.
    """
    if held is None:
        held = read_or_empty(df.sparkSession, path, schema, keys)
    same = [F.col(f"new.{key}").eqNullSafe(F.col(f"held.{key}")) for key in keys]
    new = df.alias("new").join(held.alias("held"), same, "left_anti")
    return append_rows(new, path, partition_by)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Append all rows. Returns how many these are."""
    counted = _Counted(df, "append", partition_by)
    counted.writer.parquet(path)
    return counted.rows


def write_formats(df: DataFrame, targets: Mapping[str, Target]) -> None:
    """Write the same rows in each format, with its own path, partitioning and codec.

    The rows are computed once, into the shared folder, before any target is touched: rows that
    cannot be computed leave what was there.

    Any format on the classpath will do: ``parquet``, ``orc``, ``json``; ``avro`` needs the
    spark-avro package.
    """
    df = stored(df, "formats")
    for fmt, target in targets.items():
        writer = _writer(df, "overwrite", target.partition_by)
        if target.codec:
            writer = writer.option("compression", target.codec)
        writer.option("partitionOverwriteMode", "static").format(fmt).save(target.path)
