"""Splits and dividends on bars."""

import re
from datetime import date, datetime, timedelta
from math import exp, log

import pytest
from helpers import BAR_SCHEMA, bar, by_symbol, random_bars

from barwright.operators import actions, indicators, regime

SPLIT = "symbol string, split_id string, execution_date date, split_ratio double"
DIVIDEND = "symbol string, dividend_id string, ex_dividend_date date, cash_amount double"


def frames(spark, bars, splits=(), dividends=()):
    return (
        spark.createDataFrame(bars, BAR_SCHEMA),
        spark.createDataFrame(list(splits), SPLIT),
        spark.createDataFrame(list(dividends), DIVIDEND),
    )


def factors(df):
    return {(r.symbol, r.trade_date_market): r.adjustment_factor for r in df.collect()}


MARCH = [bar("A", date(2024, 3, d), c) for d, c in ((7, 199.0), (8, 200.0), (9, 100.0), (10, 100.0))]


def test_worked_example(spark):
    adjusted = actions.adjust_prices(
        *frames(
            spark,
            MARCH,
            [("A", "s", date(2024, 3, 8), 2.0)],
            [("A", "d", date(2024, 3, 7), 1.0)],
        )
    )
    rows = sorted(adjusted.collect(), key=lambda r: r.trade_date_market, reverse=True)
    assert [r.adjustment_factor for r in rows] == pytest.approx([1, 1, 2, 2 * (1 + 1 / 199)])
    assert [r.adjusted_close for r in rows] == pytest.approx([100, 100, 400, 400])
    assert [r.volume for r in rows] == [100.0] * 4


def test_no_events(spark):
    rows = actions.adjust_prices(*frames(spark, random_bars(1, {"A": 50, "B": 5}))).collect()
    assert all(r.adjustment_factor == 1.0 and r.adjusted_low == r.low for r in rows)
    assert len(rows) == 55


def test_no_bars(spark):
    assert actions.adjust_prices(*frames(spark, [])).collect() == []


def test_events_of_other_symbols_do_not_matter(spark):
    adjusted = actions.adjust_prices(*frames(spark, MARCH, [("B", "s", date(2024, 3, 8), 2.0)]))
    assert set(factors(adjusted).values()) == {1.0}


def test_two_events_on_one_day_make_one_row(spark):
    day = date(2024, 3, 10)
    adjusted = actions.adjust_prices(
        *frames(
            spark,
            MARCH[-1:],
            [("A", "s1", day, 2.0), ("A", "s2", day, 3.0)],
            [("A", "d1", day, 1.0), ("A", "d2", day, 4.0)],
        )
    )
    assert list(factors(adjusted).values()) == pytest.approx([6 * 1.05])


def test_day_without_bar_has_no_effect_and_is_reported(spark):
    bars, splits, dividends = frames(
        spark,
        MARCH,
        [("A", "s", date(2024, 3, 1), 5.0), ("A", "t", date(2024, 3, 9), 2.0)],
        [("A", "d", date(2024, 4, 1), 5.0)],
    )
    assert sorted(factors(actions.adjust_prices(bars, splits, dividends)).values()) == pytest.approx([1, 2, 2, 2])
    lost = actions.unmatched_events(bars, splits, "execution_date").collect()
    assert [r.split_id for r in lost] == ["s"]
    lost = actions.unmatched_events(bars, dividends, "ex_dividend_date").collect()
    assert [r.dividend_id for r in lost] == ["d"]


def test_unmatched_events_take_one_join(spark):
    bars, splits, _ = frames(spark, [*MARCH, *MARCH], [("A", "s", date(2024, 3, 1), 5.0), (None, "t", None, 2.0), ("A", "u", date(2024, 3, 1), 5.0)], [])
    lost = actions.unmatched_events(bars, splits, "execution_date")
    assert sorted(r.split_id for r in lost.collect()) == ["s", "t", "u"]
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_zero_close_and_odd_amounts(spark, ansi):
    bars = [bar("A", date(2024, 3, 8), 0.0), bar("A", date(2024, 3, 7), 10.0)]
    dividends = [
        ("A", "a", date(2024, 3, 8), 1.0),
        ("A", "b", date(2024, 3, 7), None),
        ("A", "c", date(2024, 3, 7), 0.0),
        ("A", "d", date(2024, 3, 7), -2.0),
    ]
    adjusted = actions.adjust_prices(*frames(spark, bars, [], dividends))
    assert set(factors(adjusted).values()) == {1.0}


def test_ratio_that_is_not_positive_is_left_out(spark, ansi):
    splits = [("A", "s", date(2024, 3, 8), 0.0), ("A", "t", date(2024, 3, 9), None)]
    adjusted = actions.adjust_prices(*frames(spark, MARCH, splits))
    assert set(factors(adjusted).values()) == {1.0}
    # On the newest bar there is nothing to sum yet.
    newest = actions.adjust_prices(*frames(spark, MARCH, [("A", "s", date(2024, 3, 10), 0.0)]))
    got = factors(newest)
    assert got.pop(("A", date(2024, 3, 10))) is None
    assert set(got.values()) == {1.0}


def test_factors_match_brute_force_over_many_years(spark):
    """Sparse and dense histories, one symbol far above the rest, events on about every fifth bar."""
    bars = random_bars(41, {"HOT": 300, "MID": 40, "ONE": 1})
    splits, dividends, want = [], [], {}
    for symbol, history in by_symbol(bars).items():
        log_split, paid = 0.0, 0.0
        for i, (_, day, _, _, _, close, _) in reversed(list(enumerate(history))):
            if i % 5 == 0:
                ratio = (2.0, 0.5, 3.0, 1 / 3)[i % 4]
                splits.append((symbol, f"s{i}", day, ratio))
                log_split += log(ratio)
            if i % 7 == 0:
                dividends.append((symbol, f"d{i}", day, 0.25))
                paid += 0.25 / close
            want[(symbol, day)] = exp(log_split) * (1 + paid)
    got = factors(actions.adjust_prices(*frames(spark, bars, splits, dividends)))
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], rel=1e-9) for key in want)


def test_separate_joins_agree_with_the_merged_one(spark):
    bars, splits, dividends = frames(
        spark,
        MARCH,
        [("A", "s", date(2024, 3, 8), 2.0), ("A", "s2", date(2024, 3, 8), 1.5)],
        [("A", "d", date(2024, 3, 8), 1.0), ("A", "e", date(2024, 3, 9), 0.0)],
    )
    merged = actions.join_events(bars, splits, dividends)
    apart = actions.join_dividends(actions.join_splits(bars, splits), dividends)
    assert sorted(merged.collect()) == sorted(apart.select(merged.columns).collect())


def test_latest_events(spark):
    schema = SPLIT + ", ingestion_timestamp timestamp"
    first, second = datetime(2024, 3, 1, 3), datetime(2024, 3, 2, 3)
    rows = [
        ("A", "s", date(2024, 3, 8), 2.0, first),
        ("A", "s", date(2024, 3, 8), 2.0, second),
        ("A", "s", date(2024, 3, 8), 2.0, first),
        ("B", "s", date(2024, 3, 8), 2.0, first),
        ("A", "fixed", date(2024, 3, 8), 4.0, first),
        ("A", "fixed", date(2024, 3, 9), 5.0, second),
        ("A", None, date(2024, 3, 8), 7.0, first),
        ("A", None, date(2024, 3, 8), 7.0, second),
        ("A", None, date(2024, 3, 9), 7.0, first),
    ]
    latest = actions.latest_events(spark.createDataFrame(rows, schema), "split_id")
    assert latest.columns == [f.split()[0] for f in schema.split(", ")]
    assert {tuple(r) for r in latest.collect()} == {rows[i] for i in (1, 3, 5, 7, 8)}


def test_split_stored_three_times_counts_once(spark):
    schema = SPLIT + ", ingestion_timestamp timestamp"
    copies = [("A", "s", date(2024, 3, 10), 2.0, datetime(2024, 3, d)) for d in (1, 2, 3)]
    bars, _, dividends = frames(spark, MARCH[-1:])
    splits = actions.latest_events(spark.createDataFrame(copies, schema), "split_id")
    assert list(factors(actions.adjust_prices(bars, splits, dividends)).values()) == [2.0]


def test_numbered_bars_give_the_same_regimes(spark):
    bars = random_bars(43, {"HOT": 200, "B": 30})
    day = by_symbol(bars)["HOT"][100][1]
    tables = frames(spark, bars, [("HOT", "s", day, 2.0)], [("HOT", "d", day, 0.5)])
    in_one_plan = regime.on_adjusted_prices(actions.adjust_prices(*tables, numbered=True))
    in_two = regime.on_adjusted_prices(actions.adjust_prices(*tables))
    assert "bar_no" in in_one_plan.columns and "bar_no" not in in_two.columns
    got = [
        sorted(indicators.trend_indicators(b, segment_rows=40).select("symbol", "trade_date_market", "adx_14").collect())
        for b in (in_one_plan, in_two)
    ]
    assert got[0] == got[1]


def test_one_day_apart_from_year_end(spark):
    """Events either side of a slice boundary."""
    days = [date(2023, 12, 29) + timedelta(i) for i in range(6)]
    bars = [bar("A", d, 100.0) for d in days]
    splits = [("A", "s", date(2024, 1, 1), 2.0), ("A", "t", date(2023, 12, 31), 3.0)]
    got = factors(actions.adjust_prices(*frames(spark, bars, splits)))
    assert [got[("A", d)] for d in days] == pytest.approx([6, 6, 6, 2, 1, 1])


def test_undated_rows(spark):
    """An undated bar comes before all others; an undated event has no day to act on."""
    splits = [("A", "s", date(2024, 3, 8), 2.0), ("A", "t", None, 7.0)]
    dividends = [("A", "d", None, 1.0)]
    got = factors(actions.adjust_prices(*frames(spark, MARCH + [bar("A", None, 50.0)], splits, dividends)))
    assert got[("A", None)] == pytest.approx(2.0)
    assert sorted(got.values()) == pytest.approx([1, 1, 2, 2, 2])


def test_bars_are_not_shuffled_for_the_events(spark):
    """Without any broadcast, the join rides on the shuffle by symbol and year."""
    tables = frames(spark, MARCH, [("A", "s", date(2024, 3, 8), 2.0)], [("A", "d", date(2024, 3, 7), 1.0)])
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        adjusted = actions.adjust_prices(*tables, numbered=True)
        regimes = regime.detect_regimes(regime.on_adjusted_prices(adjusted))
        plan = regimes._jdf.queryExecution().executedPlan().toString()
        assert len(regimes.collect()) == 4
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    by = re.findall(r"- Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan))
    assert sorted(by) == sorted(
        # bars twice, bars' closes, events by day, events by year, bars per year twice
        ["_key, _slice", "symbol, _segment", "_key, _slice", "symbol, day", "_key, _slice", "_key", "_key, _slice"]
    )
