"""Market regime of each bar."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.columns import to_money
from barwright.operators.indicators import look_back_from, trend_indicators
from barwright.operators.segments import BAR_NO
from barwright.scratch import stored

# The labels, trend and volatility bounds, and the confidence by distance from the trend bound.
TREND_ADX = 25
VOLATILE_ATR_PCT = 3
CLEAR, CLEAR_ABOVE, CLEAR_BELOW = 0.9, 30, 20
FAIR, FAIR_ABOVE, FAIR_BELOW = 0.7, 27, 23
WEAK = 0.5


def regime_label(adx: Column, atr_pct: Column) -> Column:
    """One of the five labels; ``unknown`` on NULL input."""
    stable, volatile = atr_pct < VOLATILE_ATR_PCT, atr_pct >= VOLATILE_ATR_PCT
    return (
        F.when((adx > TREND_ADX) & stable, "trending_stable")
        .when((adx > TREND_ADX) & volatile, "trending_volatile")
        .when((adx <= TREND_ADX) & stable, "range_stable")
        .when((adx <= TREND_ADX) & volatile, "range_volatile")
        .otherwise("unknown")
    )


def regime_confidence(adx: Column) -> Column:
    """Higher the further ADX is from the bound between range and trend."""
    return (
        F.when((adx > CLEAR_ABOVE) | (adx < CLEAR_BELOW), CLEAR)
        .when((adx > FAIR_ABOVE) | (adx < FAIR_BELOW), FAIR)
        .otherwise(WEAK)
    )


def on_adjusted_prices(adjusted: DataFrame) -> DataFrame:
    """Bars whose open, high, low and close are the adjusted ones, with ``bar_no`` if known."""
    prices = [F.col(f"adjusted_{p}").alias(p) for p in ("open", "high", "low", "close")]
    number = [name for name in adjusted.columns if name == BAR_NO]
    return adjusted.select("symbol", "trade_date_market", *prices, "volume", *number)


def classify(indicators: DataFrame) -> DataFrame:
    """The regime table from a frame with ``adx_14``, ``atr_14``, ``atr_pct`` and the DIs."""
    adx, atr_pct = F.col("adx_14"), F.col("atr_pct")
    known = indicators.filter(adx.isNotNull() & F.col("atr_14").isNotNull())
    return known.select(
        "symbol",
        "trade_date_market",
        regime_label(adx, atr_pct).alias("regime"),
        regime_confidence(adx).alias("confidence"),
        to_money(adx).alias("adx"),
        to_money("atr_14").alias("atr"),
        to_money(atr_pct).alias("atr_percent"),
        to_money("plus_di").alias("plus_di"),
        to_money("minus_di").alias("minus_di"),
        to_money("close").alias("close_price"),
    )


def detect_regimes(bars: DataFrame, *, min_periods: int = 1, **segments) -> DataFrame:
    """Regime of every bar, from bars that are already adjusted; with ``min_periods``, of those that so
    many bars of the symbol lead up to, itself included."""
    return classify(trend_indicators(bars, min_periods=min_periods, **segments))


def regime_distribution(regimes: DataFrame) -> DataFrame:
    """Bars and mean readings per regime, most frequent first."""
    means = {"avg_confidence": "confidence", "avg_adx": "adx", "avg_atr_pct": "atr_percent"}
    return (
        regimes.groupBy("regime")
        .agg(
            F.count("*").alias("count"),
            *[to_money(F.avg(column)).alias(name) for name, column in means.items()],
        )
        .orderBy(F.desc("count"))
    )


def restated_symbols(bars: DataFrame, held: DataFrame, since: str) -> DataFrame:
    """Symbols whose bars before ``since`` do not give the held regimes: a new event changed their
    prices, or a day came or went. Only the symbol, the day and the close are compared."""
    day = F.col("trade_date_market") < since
    now = bars.filter(day).select("symbol", "trade_date_market", to_money("close").alias("_now"))
    then = held.filter(day).select("symbol", "trade_date_market", F.col("close_price").alias("_then"))
    both = now.withColumn("_in", F.lit(1)).unionByName(
        then.withColumn("_in", F.lit(2)), allowMissingColumns=True
    )
    days = both.groupBy("symbol", "trade_date_market").agg(
        F.sum("_in").alias("_in"), F.max("_now").alias("_now"), F.max("_then").alias("_then")
    )
    apart = (F.col("_in") != 3) | ~F.col("_now").eqNullSafe(F.col("_then"))
    return days.filter(apart).select("symbol").distinct()


def regime_updates(bars: DataFrame, held: DataFrame, since: str) -> DataFrame:
    """All rows of the days on which a run from ``since`` on changes the ``held`` regimes.

    Days from ``since`` on are computed with as much history as they need. A symbol whose earlier
    prices were restated is computed as a whole; on its earlier days the rows of the other symbols
    are the held ones.
    """
    restated = stored(restated_symbols(bars, held, since), "restated")
    same = lambda rows: rows["symbol"].eqNullSafe(restated["symbol"])
    day = F.col("trade_date_market")
    steady = bars.join(restated, same(bars), "left_anti")
    recent = detect_regimes(look_back_from(steady, since)).filter(day >= since)
    if restated.isEmpty():
        return recent
    whole = stored(detect_regimes(bars.join(restated, same(bars), "left_semi")), "restated_regimes")
    before = held.filter(day < since)
    gone = before.join(restated, same(before), "left_semi").select("trade_date_market")
    days = whole.filter(day < since).select("trade_date_market").union(gone).distinct()
    others = before.join(restated, same(before), "left_anti").join(days, "trade_date_market", "left_semi")
    return recent.unionByName(whole).unionByName(others.select(recent.columns))
