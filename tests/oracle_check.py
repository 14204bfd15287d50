"""Run queries against their SQL oracle: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return str(value) if isinstance(value, Decimal) else repr(value)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, function, sql) -> tuple[bool, str]:
    df = function(spark, sf_dir)
    got_columns, got = _rows(df.columns, df.collect())
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got == want:
        return True, f"{len(got)} rows"
    extra, missing = set(got) - set(want), set(want) - set(got)
    return False, (
        f"{len(got)} rows against {len(want)}; {len(extra)} only here, e.g. {sorted(extra)[:2]}, "
        f"{len(missing)} only there, e.g. {sorted(missing)[:2]}"
    )


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [name for name in queries() if name in oracle_sql()]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{Path.cwd().as_uri()}/spark-warehouse/_oracle")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, queries()[name], oracle_sql()[name])
        except Exception as error:  # noqa: BLE001 - the check goes on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
