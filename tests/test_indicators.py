"""Indicators and regimes: hand-computed cases, brute force over awkward histories, invariants."""

import re
from datetime import date, timedelta
from decimal import Decimal

import pytest
from helpers import BAR_SCHEMA, bar, by_symbol, indicators as brute_force, random_bars
from pyspark.sql import functions as F

from barwright.operators import indicators, quality, regime
from barwright.operators.segments import number_bars, over_segments

DAY = date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)


def rows_by_key(df, *names):
    return {(r.symbol, r.trade_date_market): tuple(r[n] for n in names) for r in df.collect()}


def test_first_bar(spark):
    row = indicators.trend_indicators(frame(spark, [bar("A", DAY, 1.0, 2.0, 0.0)])).first()
    assert (row.tr, row.atr_14, row.plus_dm, row.minus_dm) == (2.0, 2.0, 0.0, 0.0)
    assert (row.plus_di, row.minus_di, row.dx, row.adx_14) == (0.0, 0.0, 0.0, 0.0)
    assert row.prev_close is None


def test_flat_market(spark):
    flat = [bar("A", DAY + timedelta(i), 50.0) for i in range(30)]
    rows = indicators.trend_indicators(frame(spark, flat)).collect()
    assert {(r.tr, r.plus_di, r.minus_di, r.dx, r.adx_14, r.atr_pct) for r in rows} == {
        (0.0, None, None, 0.0, 0.0, 0.0)
    }
    labels = regime.detect_regimes(frame(spark, flat)).collect()
    assert {(r.regime, r.confidence) for r in labels} == {("range_stable", 0.9)}


def test_zero_close_is_unknown(spark, ansi):
    row = regime.detect_regimes(frame(spark, [bar("A", DAY, 0.0, 1.0, 0.0)])).first()
    assert (row.regime, row.atr_percent, row.atr) == ("unknown", None, Decimal("1.00"))


@pytest.mark.parametrize(
    "adx, atr_pct, label",
    [
        (25.0, 3.0, "range_volatile"),
        (25.0, 2.99, "range_stable"),
        (25.01, 2.99, "trending_stable"),
        (25.01, 3.0, "trending_volatile"),
        (30.0, None, "unknown"),
        (None, 1.0, "unknown"),
    ],
)
def test_labels(spark, adx, atr_pct, label):
    row = spark.createDataFrame([(adx, atr_pct)], "adx double, atr double")
    assert row.select(regime.regime_label(F.col("adx"), F.col("atr")).alias("x")).first().x == label


@pytest.mark.parametrize(
    "adx, confidence",
    [(30.0, 0.7), (30.1, 0.9), (20.0, 0.7), (19.9, 0.9), (27.0, 0.5), (23.0, 0.5), (25.0, 0.5), (None, 0.5)],
)
def test_confidence(spark, adx, confidence):
    row = spark.createDataFrame([(adx,)], "adx double")
    assert row.select(regime.regime_confidence(F.col("adx")).alias("x")).first().x == confidence


SIZES = {"HOT": 400, "MID": 70, "SMALL": 3, "ONE": 1}


@pytest.mark.parametrize("segment_rows", [28, 50, 1024])
def test_segments_match_brute_force(spark, segment_rows):
    """One symbol far above the rest; segments down to one more than the look-back."""
    rows = random_bars(7, SIZES)
    names = ("tr", "atr_14", "plus_di", "minus_di", "dx", "adx_14")
    got = rows_by_key(
        indicators.trend_indicators(frame(spark, rows), segment_rows=segment_rows), *names
    )
    assert len(got) == len(rows)
    for symbol, history in by_symbol(rows).items():
        for r, want in zip(history, brute_force(history)):
            assert got[(symbol, r[1])] == pytest.approx(want, rel=1e-9, abs=1e-9), (symbol, r[1])


@pytest.mark.parametrize(
    "function, names, look_back",
    [
        (indicators.previous_prices, ("prev_close", "prev_high", "prev_low"), 1),
        (indicators.true_range, ("tr",), 1),
        (indicators.average_true_range, ("atr_14", "atr_pct"), 14),
        (indicators.directional_movement, ("plus_dm", "minus_dm"), 1),
        (indicators.directional_index, ("plus_di", "minus_di"), 14),
    ],
)
def test_each_operator_has_the_look_back_it_needs(spark, function, names, look_back):
    bars = frame(spark, random_bars(11, SIZES))
    whole = rows_by_key(function(bars, segment_rows=100_000), *names)
    cut = rows_by_key(function(bars, segment_rows=look_back + 1), *names)
    assert cut == whole


def test_trailing_mean(spark):
    rows = [bar("A", DAY + timedelta(i), float(i)) for i in range(40)]
    mean = indicators.trailing_mean(frame(spark, rows), "close", "m", segment_rows=14)
    for row in mean.collect():
        i = int(row.close)
        assert row.m == pytest.approx(sum(range(max(0, i - 13), i + 1)) / min(i + 1, 14))


def test_bar_numbers(spark):
    rows = random_bars(3, SIZES) + [("HOT", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = rows_by_key(number_bars(frame(spark, rows)), "bar_no")
    for symbol, history in by_symbol([r for r in rows if r[1]]).items():
        shift = 1 if symbol == "HOT" else 0
        for i, r in enumerate(history):
            assert got[(symbol, r[1])] == (i + shift,)
    assert got[("HOT", None)] == (0,)


def test_calendar_may_stand_in_for_the_bars(spark):
    bars = frame(spark, random_bars(5, SIZES))
    calendar = bars.select("symbol", "trade_date_market")
    names = ("adx_14",)
    assert rows_by_key(indicators.trend_indicators(bars, calendar=calendar), *names) == rows_by_key(
        indicators.trend_indicators(bars), *names
    )


def test_segment_must_exceed_look_back(spark):
    with pytest.raises(ValueError):
        over_segments(frame(spark, [bar("A", DAY, 1.0)]), [], 27, segment_rows=27)


def test_bounds(spark):
    row = (
        indicators.trend_indicators(frame(spark, random_bars(13, SIZES)))
        .agg(
            *[F.min(c).alias(f"min_{c}") for c in ("adx_14", "plus_di", "minus_di")],
            *[F.max(c).alias(f"max_{c}") for c in ("adx_14", "plus_di", "minus_di")],
        )
        .first()
    )
    assert all(0 <= value <= 100 + 1e-9 for value in row)


def test_rescaled_prices_keep_the_ratios(spark):
    bars = frame(spark, random_bars(17, SIZES))
    # A power of two changes no digit of the mantissa, so the results are equal to the bit.
    scaled = bars.withColumns({c: F.col(c) * 4 for c in ("open", "high", "low", "close")})
    names = ("adx_14", "plus_di", "minus_di", "atr_pct")
    assert rows_by_key(indicators.trend_indicators(bars), *names) == rows_by_key(
        indicators.trend_indicators(scaled), *names
    )


def test_input_order_is_irrelevant(spark):
    rows = random_bars(19, SIZES)
    one = regime.detect_regimes(frame(spark, rows)).collect()
    two = regime.detect_regimes(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(one) == sorted(two)


@pytest.mark.parametrize("since", ["1990-01-01", "1979-01-01", "2200-01-01"])
def test_look_back_gives_the_values_of_a_full_run(spark, since):
    bars = frame(spark, random_bars(23, SIZES))
    newer = F.col("trade_date_market") >= since
    full = regime.detect_regimes(bars).filter(newer).collect()
    recent = regime.detect_regimes(indicators.look_back_from(bars, since)).filter(newer).collect()
    assert sorted(full) == sorted(recent)


def test_distribution_and_listing(spark):
    regimes = regime.detect_regimes(frame(spark, random_bars(29, SIZES)))
    rows = regimes.collect()
    distribution = regime.regime_distribution(regimes).collect()
    assert sum(r["count"] for r in distribution) == len(rows)
    assert [r["count"] for r in distribution] == sorted((r["count"] for r in distribution), reverse=True)
    listing = quality.newest_first_listing(regimes).collect()
    want = sorted(rows, key=lambda r: (r.symbol, -r.trade_date_market.toordinal()))[:20]
    assert listing == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_for_the_windows(spark):
    """The window chain over segments needs one shuffle and one sort."""
    lines = plan_of(regime.detect_regimes(frame(spark, random_bars(31, SIZES)))).splitlines()
    assert sum("_segment" in line for line in lines if "Exchange" in line) == 1
    assert sum("_segment" in line for line in lines if " Sort " in line) == 1


def test_no_task_gets_all_bars_of_a_symbol(spark):
    """Only the table of bars per year is gathered by symbol."""
    plan = plan_of(regime.detect_regimes(frame(spark, random_bars(31, SIZES))))
    assert len(re.findall(r"hashpartitioning\(_key#\d+, \d+\)", plan)) == 1
    assert "partial_count(1)" in plan


def test_look_back_is_limited_before_the_shuffle(spark):
    plan = plan_of(indicators.look_back_from(frame(spark, random_bars(31, SIZES)), "1990-01-01"))
    assert re.search(r"WindowGroupLimit .*, 27, Partial", plan)


@pytest.mark.parametrize("segment_rows", [28, 1024])
def test_bars_without_symbol_are_a_group_of_their_own(spark, segment_rows):
    """As many rows come out as go in, with the values a symbol of that name would have."""
    rows = [(None if r[0] == "N" else r[0], *r[1:]) for r in random_bars(9, {"A": 40, "N": 70})]
    named = [("N" if r[0] is None else r[0], *r[1:]) for r in rows]
    for step in (indicators.previous_prices, indicators.true_range, indicators.average_true_range, indicators.directional_movement, indicators.directional_index, indicators.trend_indicators):
        got = step(spark.createDataFrame(rows, BAR_SCHEMA), segment_rows=segment_rows).fillna({"symbol": "N"})
        want = step(spark.createDataFrame(named, BAR_SCHEMA), segment_rows=segment_rows)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 110


def test_bars_before_the_minimum_have_no_regime(spark):
    rows = random_bars(71, {"A": 60, "B": 13, "C": 14})
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    every = regime.detect_regimes(bars, segment_rows=40).collect()
    want = {}
    for symbol, history in by_symbol(rows).items():
        settled = {r[1] for r in history[13:]}
        want |= {(r.symbol, r.trade_date_market): r for r in every if r.symbol == symbol and r.trade_date_market in settled}
    got = {(r.symbol, r.trade_date_market): r for r in regime.detect_regimes(bars, min_periods=14, segment_rows=40).collect()}
    assert got == want and {s for s, _ in got} == {"A", "C"}
