"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path
from unittest import mock

import pytest
from oracle_check import compare, connect

from barwright.scratch import discard, release, shared_folder, stored
from barwright.workload.oracle import ORACLE
from barwright.workload.queries import QUERIES
from barwright.workload.tables import scratch

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no benchmark tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


#: Queries that write a folder per day; a table of few days will do here.
BY_DAY = ("partition_overwrite", "partition_merge", "full_overwrite", "multi_format", "append_once", "append_events_twice", "append_corrections")


@pytest.fixture(scope="module")
def few_days(duck, tmp_path_factory):
    folder = tmp_path_factory.mktemp("few_days")
    for table in Path(SF_DIR).glob("*.parquet"):
        if table.stem != "lineitem":
            (folder / table.name).symlink_to(table)
    duck.execute(
        f"""COPY (SELECT * FROM '{SF_DIR}/lineitem.parquet'
            WHERE strftime(l_shipdate, '%Y-%m') IN ('1998-12', '1999-01', '2001-01')) TO '{folder}/lineitem.parquet'"""
    )
    return str(folder), connect(str(folder))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, few_days, name):
    sf_dir, con = few_days if name in BY_DAY else (SF_DIR, duck)
    same, note = compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])
    assert same, note


@pytest.mark.parametrize("name, scans", [("adjusted_ohlc", 4), ("adjusted_back", 4), ("adjusted_regime", 4)])
def test_tables_are_read_no_more_than_needed(spark, name, scans):
    """Bars twice, to find the steps of the factors and to adjust them, and each table of events once."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scans
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["adjusted_changes", "regime_restated"])
def test_bars_are_derived_once(spark, name):
    """What compares two adjustments of the same bars reads them as they were first derived."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).limit(1).count() == 1


def test_scratch_folder(spark, tmp_path):
    """Shared if the session names one, else below the warehouse; never the same twice."""
    first, second = scratch(spark, "x"), scratch(spark, "x")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert first != second and all(p.startswith(f"{shared}/x-") for p in (first, second))
    unnamed = mock.Mock()
    unnamed.conf.get.side_effect = lambda key, *_: "file:/house/" if "warehouse" in key else None
    assert shared_folder(unnamed) == "file:/house/_scratch"


def test_intermediate_tables(spark):
    """Written, typed as before, and gone once released."""
    rows = spark.createDataFrame([(1, None), (2, ["a"])], "k int, v array<string>")
    kept = stored(rows, "trial")
    assert kept.schema == rows.schema and sorted(kept.collect()) == sorted(rows.collect())
    folders = list(Path(spark.conf.get("spark.checkpoint.dir")).glob("trial-*"))
    assert folders
    other = stored(rows, "other")
    discard(other)
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).glob("other-*")) and kept.count() == 2
    release(spark)
    assert not any(f.exists() for f in folders)
