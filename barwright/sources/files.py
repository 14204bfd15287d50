"""Curated tables and delimited text."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    **options: object,
) -> DataFrame:
    """A table, or only the named columns of it, under a fixed schema.

    The schema also types the partition columns, so a symbol such as ``0700`` stays text, and
    sets the column order, which otherwise puts them last.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = spark.read.schema(schema).format(fmt).options(**options).load(path)
    return table.select(*(columns or schema.names))


def read_or_empty(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    **options: object,
) -> DataFrame:
    """Like :func:`read_table`, but a table that was never written has no rows."""
    try:
        return read_table(spark, path, schema, columns, fmt, **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], schema)
        return empty.select(*columns) if columns else empty


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header row; every column is text.

    Pass the column names to skip the job that looks at the header first.
    """
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path)
