"""State carried from run to run, so that a run reads the newest days and not the history.

The indicators of a bar rest on the 27 bars before it. The last bars of each symbol are kept in a
table as large as the symbols are many; a run joins the new days to them. Twice the look-back is
kept, so that a run of the last days can be repeated. Only symbols whose earlier prices changed, or
that are asked for days further back than what is kept, are computed from their history.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.indicators import PERIOD
from barwright.operators.regime import detect_regimes

LOOK_BACK = 2 * PERIOD - 1
KEPT = 2 * LOOK_BACK
_PRICES = ["symbol", "trade_date_market", "high", "low", "close"]
#: Whether a symbol has bars older than those kept.
OLDER = "has_older"


def _earlier(since: str) -> Column:
    """An undated bar comes before all others."""
    day = F.col("trade_date_market")
    return day.isNull() | (day < since)


def last_bars(bars: DataFrame, kept: int = KEPT) -> DataFrame:
    """``symbol, trade_date_market, high, low, close, has_older``: the last bars of each symbol, of bars
    that may carry ``has_older`` themselves.

    Tasks pass on no more than ``kept + 1`` bars of a symbol.
    """
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("trade_date_market"))
    older = F.col(OLDER) if OLDER in bars.columns else F.lit(False)
    ranked = bars.select(*_PRICES, older.alias(OLDER)).withColumn("_age", F.row_number().over(newest_first))
    near = ranked.filter(F.col("_age") <= kept + 1)
    more = F.max(F.col(OLDER) | (F.col("_age") > kept)).over(Window.partitionBy("symbol"))
    return near.withColumn(OLDER, more).filter(F.col("_age") <= kept).drop("_age")


def beyond_state(state: DataFrame, bars: DataFrame, since: str) -> DataFrame:
    """Symbols with ``bars`` from ``since`` on that the state holds too few earlier bars of."""
    day = F.col("trade_date_market")
    held = state.groupBy("symbol").agg(F.count_if(_earlier(since)).alias("before"), F.max(OLDER).alias(OLDER))
    short = held.filter((F.col("before") < LOOK_BACK) & F.col(OLDER)).select("symbol")
    active = bars.filter(day >= since).select("symbol").distinct()
    return active.join(short, active["symbol"].eqNullSafe(short["symbol"]), "left_semi")


def regimes_from_state(state: DataFrame, bars: DataFrame, since: str) -> DataFrame:
    """Regimes of the ``bars`` from ``since`` on, given the state before them: what a run over the whole
    history gives for these days, where the state reaches back far enough."""
    day = F.col("trade_date_market")
    both = state.filter(_earlier(since)).select(_PRICES).unionByName(bars.filter(day >= since).select(_PRICES))
    return detect_regimes(both).filter(day >= since)


def next_state(state: DataFrame, bars: DataFrame, since: str) -> DataFrame:
    """The state after ``bars`` from ``since`` on, which replace those of these days."""
    day = F.col("trade_date_market")
    fresh = bars.filter(day >= since).select(*_PRICES, F.lit(False).alias(OLDER))
    return last_bars(state.filter(_earlier(since)).unionByName(fresh))
