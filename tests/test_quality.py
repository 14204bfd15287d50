"""Completeness, de-duplication, counts."""

from datetime import date

import pytest

from barwright.operators import quality

RUN = "2024-01-02"
LANDED = "symbol string, endpoint_type string, execution_date string"


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def landed(spark, *pairs, run=RUN):
    return spark.createDataFrame([(s, e, run) for s, e in pairs], LANDED)


ALL_A = [("A", "daily_ohlcv"), ("A", "splits"), ("A", "dividends")]


def test_gaps(spark):
    expected = quality.expected_landings(symbols(spark, "A", "B", "B"), RUN)
    assert expected.count() == 6
    gaps = quality.landing_gaps(expected, landed(spark, *ALL_A, ("B", "splits"), ("B", "splits"), ("C", "splits")))
    assert sorted(tuple(r) for r in gaps.collect()) == [("B", "daily_ohlcv", RUN), ("B", "dividends", RUN)]
    with pytest.raises(quality.IncompleteLanding, match="2 landings"):
        quality.require_complete(gaps)


def test_no_gaps(spark):
    expected = quality.expected_landings(symbols(spark, "A"), RUN)
    quality.require_complete(quality.landing_gaps(expected, landed(spark, *ALL_A)))


def test_other_run_dates_do_not_count(spark):
    expected = quality.expected_landings(symbols(spark, "A"), RUN)
    assert quality.landing_gaps(expected, landed(spark, *ALL_A, run="2024-01-01")).count() == 3


def test_all_gaps_are_reported(spark):
    gaps = landed(spark, *[(f"S{i:03}", "splits") for i in range(160)])
    with pytest.raises(quality.IncompleteLanding, match="160 landings") as error:
        quality.require_complete(gaps)
    assert error.value.count == 160 and sorted(error.value.gaps.collect()) == sorted(gaps.collect())


def test_summary(spark):
    expected = quality.expected_landings(symbols(spark, "A", "B", "C"), RUN)
    summary = quality.landing_summary(expected, landed(spark, *ALL_A, ("B", "splits")))
    assert sorted(tuple(r) for r in summary.collect()) == [
        ("A", RUN, 3, 0, "", True),
        ("B", RUN, 1, 2, "daily_ohlcv,dividends", False),
        ("C", RUN, 0, 3, "daily_ohlcv,dividends,splits", False),
    ]


def test_not_yet_landed(spark):
    incoming = landed(spark, ("A", "splits"), ("B", "splits"), ("A", "dividends"))
    new = quality.not_yet_landed(incoming, landed(spark, ("A", "splits")))
    assert sorted(r.symbol + r.endpoint_type for r in new.collect()) == ["Adividends", "Bsplits"]


CONTACTS = "`E-mail` string, Contact string, `Full.Name` string, no int"


def test_duplicate_keys(spark):
    rows = [("a", "1", "x", 3), ("a", "1", "y", 1), ("a", None, "z", 5), ("a", None, "w", 4), (None, None, "q", 6), (None, None, None, 7)]
    contacts = spark.createDataFrame(rows, CONTACTS)
    keys = ["E-mail", "Contact"]
    kept = quality.drop_duplicate_keys(contacts, keys, keep_lowest="no")
    assert kept.columns == ["E-mail", "Contact", "Full.Name", "no"]
    assert {tuple(r) for r in kept.collect()} == {rows[1], rows[3], rows[4]}
    anyone = {tuple(r) for r in quality.drop_duplicate_keys(contacts, keys).collect()}
    assert len(anyone) == 3 and anyone <= set(rows)


def test_newest_per_symbol(spark):
    rows = [("A", date(2024, 1, 1), 1.0), ("A", date(2024, 1, 3), None), ("B", date(2023, 1, 1), 2.0)]
    daily = spark.createDataFrame(rows, "symbol string, trade_date_market date, close double")
    assert {tuple(r) for r in quality.newest_per_symbol(daily).collect()} == {rows[1], rows[2]}


def test_counts_symbols_union(spark):
    a, b = symbols(spark, "A", "B", "A"), symbols(spark)
    assert {tuple(r) for r in quality.row_counts({"x": a, "y": b}).collect()} == {("x", 3), ("y", 0)}
    assert sorted(r.symbol for r in quality.distinct_symbols(a).collect()) == ["A", "B"]
    other = spark.createDataFrame([(1.5, "C")], "close double, symbol string")
    assert [tuple(r) for r in quality.union_providers(symbols(spark, "A"), other).collect()] == [("A", None), ("C", 1.5)]
