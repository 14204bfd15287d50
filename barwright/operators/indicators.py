"""Volatility and trend indicators per symbol, in date order.

The steps below add columns to a frame of bars given a window over one symbol. The public
functions run the steps they need with the look-back those need.
"""

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwright.operators.segments import BAR_NO, over_segments

PERIOD = 14


def _trailing(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1 - PERIOD, 0)


def _previous(bars: DataFrame, w: WindowSpec) -> DataFrame:
    return bars.withColumns(
        {f"prev_{price}": F.lag(price, 1).over(w) for price in ("close", "high", "low")}
    )


def _range(bars: DataFrame, w: WindowSpec) -> DataFrame:
    # greatest() skips NULLs: the first bar has its own range only.
    gap_from_close = [F.abs(F.col(price) - F.col("prev_close")) for price in ("high", "low")]
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), *gap_from_close))


def _movement(bars: DataFrame, w: WindowSpec) -> DataFrame:
    up, down = F.col("rise"), F.col("fall")

    def prevailing(this, other):
        return F.when((this > other) & (this > 0), this).otherwise(0.0)

    return bars.withColumns(
        {
            "rise": F.col("high") - F.col("prev_high"),
            "fall": F.col("prev_low") - F.col("low"),
        }
    ).withColumns({"plus_dm": prevailing(up, down), "minus_dm": prevailing(down, up)})


# The smoothed true range that the DIs are measured against is the ATR.
SMOOTHED = {"atr_14": "tr", "mean_plus": "plus_dm", "mean_minus": "minus_dm"}


def _smooth(bars: DataFrame, w: WindowSpec) -> DataFrame:
    known = {name: of for name, of in SMOOTHED.items() if of in bars.columns}
    return bars.withColumns({name: F.avg(of).over(_trailing(w)) for name, of in known.items()})


def _range_percent(bars: DataFrame, w: WindowSpec) -> DataFrame:
    return bars.withColumn("atr_pct", F.try_divide("atr_14", "close") * 100)


def _direction(bars: DataFrame, w: WindowSpec) -> DataFrame:
    return bars.withColumns(
        {
            f"{side}_di": F.try_divide(f"mean_{side}", "atr_14") * 100
            for side in ("plus", "minus")
        }
    )


def _trend(bars: DataFrame, w: WindowSpec) -> DataFrame:
    apart = F.abs(F.col("plus_di") - F.col("minus_di"))
    total = F.col("plus_di") + F.col("minus_di")
    dx = F.when(total > 0, F.try_divide(apart, total) * 100).otherwise(0.0)
    return bars.withColumn("dx", dx).withColumn("adx_14", F.avg("dx").over(_trailing(w)))


def previous_prices(bars: DataFrame, **segments) -> DataFrame:
    """Add ``prev_close``, ``prev_high`` and ``prev_low``, NULL on the first bar."""
    return over_segments(bars, [_previous], 1, **segments)


def trailing_mean(bars: DataFrame, column: str, name: str, **segments) -> DataFrame:
    """Add the mean over this bar and up to 13 before it."""

    def step(frame: DataFrame, w: WindowSpec) -> DataFrame:
        return frame.withColumn(name, F.avg(column).over(_trailing(w)))

    return over_segments(bars, [step], PERIOD - 1, **segments)


def true_range(bars: DataFrame, **segments) -> DataFrame:
    """Add ``tr``: the day's range, widened to the previous close."""
    return over_segments(bars, [_previous, _range], 1, **segments)


def average_true_range(bars: DataFrame, **segments) -> DataFrame:
    """Add ``atr_14`` (simple mean of the true range) and ``atr_pct`` (of the close)."""
    return over_segments(bars, [_previous, _range, _smooth, _range_percent], PERIOD, **segments)


def directional_movement(bars: DataFrame, **segments) -> DataFrame:
    """Add ``plus_dm`` and ``minus_dm``: the larger of the two moves if positive, else 0."""
    return over_segments(bars, [_previous, _movement], 1, **segments)


def directional_index(bars: DataFrame, **segments) -> DataFrame:
    """Add ``plus_di`` and ``minus_di``; NULL while the smoothed range is 0."""
    steps = [_previous, _range, _movement, _smooth, _direction]
    return over_segments(bars, steps, PERIOD, **segments)


def trend_indicators(bars: DataFrame, *, min_periods: int = 1, **segments) -> DataFrame:
    """Add every indicator up to ``adx_14``.

    A value rests on 14 DX, the first of them on 14 ranges, the first of those on one bar more.
    ``atr_14`` and ``adx_14`` are NULL on the bars of a symbol before its ``min_periods``-th one.
    """

    def settled(frame: DataFrame, w: WindowSpec) -> DataFrame:
        enough = F.col(BAR_NO) + 1 >= min_periods
        return frame.withColumns({name: F.when(enough, F.col(name)) for name in ("atr_14", "adx_14")})

    steps = [_previous, _range, _movement, _smooth, _range_percent, _direction, _trend]
    if min_periods > 1:
        steps.append(settled)
    return over_segments(bars, steps, 2 * PERIOD - 1, **segments)


def look_back_from(bars: DataFrame, since: str, rows: int = 2 * PERIOD - 1) -> DataFrame:
    """Bars from a day on, and the last ``rows`` bars of each symbol before it.

    Enough to compute the indicators of the newer days; each map task passes on at most ``rows``
    older bars per symbol. Where the look-back begins is found from symbols and days alone, so that
    the other columns are only read from there on. Symbols without newer bars look back on nothing.
    """
    day = F.col("trade_date_market")
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("trade_date_market"))

    def latest(older: DataFrame) -> DataFrame:
        return older.withColumn("_age", F.row_number().over(newest_first)).filter(f"_age <= {rows}")

    days = bars.select("symbol", "trade_date_market")
    active = days.filter(day >= since).select(F.col("symbol").alias("_active")).distinct()
    needed = days.filter(day < since).join(active, F.col("symbol").eqNullSafe(F.col("_active")), "left_semi")
    first = latest(needed).agg(F.min("trade_date_market")).first()[0]
    older = bars.filter(day < since) if first is None else bars.filter((day < since) & (day >= first))
    older = latest(older)
    return bars.filter(day >= since).unionByName(older.filter(f"_age <= {rows}").drop("_age"))
