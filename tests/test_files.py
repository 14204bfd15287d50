"""Readers and writers, through the file system."""

from datetime import date
from unittest import mock

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from barwright import schemas
from barwright.operators.quality import not_yet_landed
from barwright.sinks import (
    append_new,
    envelopes,
    land_envelopes,
    overwrite_partitions,
    overwrite_table,
    write_formats,
    write_jdbc,
)
from barwright.sinks.files import Target
from barwright.sources import read_csv_text, read_landing, read_or_empty, read_table

SCHEMA = "symbol string, day date, close double"
D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(spark, path, schema=SCHEMA, **options):
    return sorted(tuple(r) for r in read_table(spark, path, schema, **options).collect())


def test_partition_overwrite_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_partitions(table(spark, ("A", D1, 1.0), ("A", D2, 2.0), ("B", D2, 3.0)), path, ["day"])
    overwrite_partitions(table(spark, ("A", D2, 9.0)), path, ["day"])
    # The whole day is replaced: B's bar of that day is gone, which is why landing is checked first.
    assert content(spark, path) == [("A", D1, 1.0), ("A", D2, 9.0)]


def test_full_overwrite_drops_vanished_days(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_table(table(spark, ("A", D1, 1.0), ("A", D2, 2.0)), path, ["day"])
    overwrite_table(table(spark, ("A", D3, 9.0)), path, ["day"])
    assert content(spark, path) == [("A", D3, 9.0)]


def test_full_overwrite_whatever_the_session_says(spark, tmp_path):
    path, key = str(tmp_path / "t"), "spark.sql.sources.partitionOverwriteMode"
    spark.conf.set(key, "dynamic")
    try:
        overwrite_table(table(spark, ("A", D1, 1.0)), path, ["day"])
        overwrite_table(table(spark, ("A", D3, 9.0)), path, ["day"])
    finally:
        spark.conf.unset(key)
    assert content(spark, path) == [("A", D3, 9.0)]


def test_a_day_becomes_few_files(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.range(2000, numPartitions=16).select(
        F.lit("A").alias("symbol"),
        F.date_add(F.lit(D1), (F.col("id") % 4).cast("int")).alias("day"),
        F.col("id").cast("double").alias("close"),
    )
    overwrite_table(rows, str(path), ["day"])
    assert len(list(path.glob("day=*"))) == 4
    assert len(list(path.glob("day=*/*.parquet"))) == 4


def test_append_new(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["symbol", "day"]
    for rows in ([("A", D1, 1.0), (None, D1, 2.0)], [("A", D1, 5.0), (None, D1, 6.0), ("A", D2, 3.0)], []):
        append_new(table(spark, *rows), path, SCHEMA, keys, ["day"])
    held = read_table(spark, path, SCHEMA).collect()
    assert {tuple(r) for r in held} == {("A", D1, 1.0), (None, D1, 2.0), ("A", D2, 3.0)}
    assert len(held) == 3


def test_append_of_nothing_leaves_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    append_new(table(spark), path, SCHEMA, ["symbol"], ["day"])
    assert read_or_empty(spark, path, SCHEMA).collect() == []


def test_numeric_symbol_stays_text(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_table(table(spark, ("0700", D1, 1.0), ("1e3", D1, 2.0)), path, ["day", "symbol"])
    assert content(spark, path) == [("0700", D1, 1.0), ("1e3", D1, 2.0)]


def test_formats(spark, tmp_path):
    targets = {
        "parquet": Target(str(tmp_path / "p"), ["day", "symbol"]),
        "orc": Target(str(tmp_path / "o"), ["day"], "zlib"),
        "json": Target(str(tmp_path / "j"), codec=None),
    }
    rows = [("A", D1, 1.0), ("B", D2, 2.0)]
    for _ in range(2):
        write_formats(table(spark, *rows), targets)
        for fmt, target in targets.items():
            assert content(spark, target.path, fmt=fmt) == rows
    assert list((tmp_path / "p").glob("day=*/symbol=*/*.snappy.parquet"))
    assert list((tmp_path / "o").glob("day=*/*.zlib.orc"))


def test_column_subset_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_table(table(spark, ("A", D1, 1.0)), path, ["day"])
    subset = read_table(spark, path, SCHEMA, ["close"]).filter("close > 0")
    plan = subset._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<close:double>" in plan and "PushedFilters: [IsNotNull(close)" in plan


def test_only_a_missing_path_is_forgiven(spark, tmp_path):
    empty = read_or_empty(spark, str(tmp_path / "none"), SCHEMA, ["close"])
    assert empty.columns == ["close"] and empty.collect() == []
    overwrite_table(table(spark, ("A", D1, 1.0)), str(tmp_path / "t"))
    with pytest.raises(AnalysisException, match="no_such_column"):
        read_or_empty(spark, str(tmp_path / "t"), SCHEMA, ["no_such_column"])
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path / "none"), SCHEMA)


def test_csv_is_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text('E-mail,Contact,Name\na@x,007,"Doe, J"\n,12,\n')
    for names in (None, ["E-mail", "Contact", "Name"]):
        rows = read_csv_text(spark, str(tmp_path / "c.csv"), names)
        assert rows.columns == ["E-mail", "Contact", "Name"]
        assert {tuple(r) for r in rows.collect()} == {("a@x", "007", "Doe, J"), (None, "12", None)}


SPLIT = "symbol string, id string, execution_date string, split_from double, split_to double"


def test_envelopes(spark, tmp_path):
    splits = spark.createDataFrame(
        [("A.NS", "1", "2020-01-01", 1.0, 2.0), ("A.NS", "2", "2021-01-01", 1.0, 3.0)], SPLIT
    )
    asked = spark.createDataFrame([("A.NS",), ("B",), ("B",)], "symbol string")
    stamp = F.lit("2024-01-02 03:00:00").cast("timestamp")
    wrapped = envelopes(splits, "splits", "2024-01-02", requested=asked, ingested_at=stamp)
    assert wrapped.schema.simpleString() == schemas.landing_schema(schemas.SPLIT_RESULT).simpleString()
    for _ in range(2):
        held = read_landing(spark, str(tmp_path), "splits", "2024-01-02", required=False)
        land_envelopes(not_yet_landed(wrapped, held), str(tmp_path), "splits")
    rows = read_landing(spark, str(tmp_path), "splits", "2024-01-02").collect()
    assert sorted((r.symbol, r.market_timezone, [x.id for x in r.payload.results]) for r in rows) == [
        ("A.NS", "Asia/Kolkata", ["1"]),
        ("A.NS", "Asia/Kolkata", ["2"]),
        ("B", "US/Eastern", []),
    ]
    assert {(r.source, r.endpoint_type, r.execution_date, r.ingestion_timestamp) for r in rows} == {
        ("polygon", "splits", "2024-01-02", "2024-01-02T03:00:00.000000Z")
    }


def test_no_empty_envelope_for_bars(spark):
    bars = spark.createDataFrame([], "symbol string, t double, o double, h double, l double, c double, v double, vw double, n double")
    asked = spark.createDataFrame([("B",)], "symbol string")
    assert envelopes(bars, "daily_ohlcv", "2024-01-02", requested=asked).count() == 0


def test_jdbc_call(spark):
    """No database here: only what is handed to the writer is checked."""
    with mock.patch.object(DataFrameWriter, "jdbc", autospec=True) as write:
        write_jdbc(table(spark, ("A", D1, 1.0)), "jdbc:x", "contacts", {"user": "u", "batchsize": "5"})
    writer = write.call_args.args[0]
    assert writer._df.rdd.getNumPartitions() == 16
    write.assert_called_once_with(
        writer,
        "jdbc:x",
        "contacts",
        mode="overwrite",
        properties={"numPartitions": "16", "batchsize": "5", "user": "u"},
    )


def test_many_small_partitions_are_dealt_out_over_tasks(spark, tmp_path):
    """Their bytes fit a task many times over, but a task would make all the folders."""
    rows = spark.range(450).select(F.concat(F.lit("S"), "id").alias("symbol"), F.lit(D1).alias("day"), F.col("id").cast("double").alias("close"))
    write_formats(rows, {"parquet": Target(str(tmp_path / "p"), ["day", "symbol"])})
    files = list((tmp_path / "p").glob("day=*/symbol=*/*.parquet"))
    assert len(files) == 450 and len({f.name.split("-")[1] for f in files}) > 1
    assert read_table(spark, str(tmp_path / "p"), SCHEMA).count() == 450
