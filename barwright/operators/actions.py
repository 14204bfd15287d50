"""Splits and dividends applied to price bars.

The convention: walking back from the newest bar, every split multiplies earlier prices by its
ratio and every dividend *raises* them by its yield, the event day included. That is what the
tables downstream are defined on. The usual back-adjustment, which divides and lowers the days before
an event, is there by name.

Prices are adjusted by step functions: a symbol's factor changes on event days only, so its steps are
as many as its events, and a bar takes the step its day lies in. Nothing is summed over bars.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.segments import BAR_NO, DAY, KEY, SLICE, number_bars, with_slice

BAR_KEY = ["symbol", "trade_date_market"]
#: What an event does to earlier prices: raise them from its day back, or lower them before it.
RAISE, LOWER = "raise", "lower"


def latest_events(events: DataFrame, id_column: str) -> DataFrame:
    """One row per symbol and event id: the one ingested last.

    Events without an id are told apart by their content. Copies are merged before the shuffle,
    so an event ingested over and over does not pile up in one task.
    """
    identity, version, columns = _versions(events.columns, id_column)
    merged = events.groupBy(*identity).agg(F.max(version).alias("newest"))
    return merged.select(*columns("newest"))


def _versions(names: Sequence[str], id_column: str) -> tuple[list[Column], Column, Callable[[str], list[Column]]]:
    """What tells events apart, the version of one without that, and the columns of an event again from the
    name of its version: keys are shuffled once and not in the version too."""
    keys = ("symbol", id_column)
    rest = [name for name in names if name not in (*keys, "ingestion_timestamp")]
    content = F.to_json(F.struct(*[name for name in names if name != "ingestion_timestamp"]))
    nameless = F.when(F.col(id_column).isNull(), content).alias("_nameless")
    version = F.struct("ingestion_timestamp", F.struct(*rest).alias("content"))

    def columns(newest: str) -> list[Column]:
        places = {name: f"{newest}.content.{name}" for name in rest} | {"ingestion_timestamp": f"{newest}.ingestion_timestamp"}
        return [F.col(places.get(name, name)).alias(name) for name in names]

    return [*map(F.col, keys), nameless], version, columns


def new_versions(events: DataFrame, held: DataFrame, id_column: str) -> DataFrame:
    """The latest version of each event that differs from the latest one held.

    Both tables have the same columns. They are grouped together, so each of their rows is shuffled once.
    """
    names = events.columns
    identity, version, columns = _versions(names, id_column)
    both = events.withColumn("_held", F.lit(False)).unionByName(held.select(names).withColumn("_held", F.lit(True)))
    latest = both.groupBy(*identity).agg(
        F.max(F.when(~F.col("_held"), version)).alias("new"), F.max(F.when(F.col("_held"), version)).alias("old")
    )
    same = F.col("new.content").eqNullSafe(F.col("old.content")) & F.col("old").isNotNull()
    return latest.filter(F.col("new").isNotNull() & ~same).select(*columns("new"))


def positive_dividends(dividends: DataFrame) -> DataFrame:
    return dividends.filter(F.col("cash_amount") > 0)


def _by_day(events: DataFrame, date_column: str, **totals) -> DataFrame:
    """One row per symbol and day, so a bar meets at most one; merged before the shuffle."""
    day = F.col(date_column).alias("trade_date_market")
    return events.groupBy("symbol", day).agg(*[v.alias(name) for name, v in totals.items()])


def _join_days(bars: DataFrame, days: DataFrame, **defaults: float) -> DataFrame:
    return bars.join(days, BAR_KEY, "left").withColumns(
        {name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()}
    )


def join_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Add ``split_ratio``, the product of the day's ratios, 1.0 without a split."""
    days = _by_day(splits, "execution_date", split_ratio=F.product("split_ratio"))
    return _join_days(bars, days, split_ratio=1.0)


def join_dividends(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Add ``dividend_amount``, the sum of the day's positive amounts, 0.0 without one."""
    paid = positive_dividends(dividends)
    days = _by_day(paid, "ex_dividend_date", dividend_amount=F.sum("cash_amount"))
    return _join_days(bars, days, dividend_amount=0.0)


def _events_by_year(splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """The days with events of each symbol and year, at most one entry per day, as a map.

    Bars that look their day up in it are joined on the keys that running totals are grouped by, and
    need no shuffle of their own however many events there are. Splits one for one and dividends
    that pay nothing are left out.
    """
    changing = splits.filter("split_ratio <> 1")
    events = changing.select("symbol", F.col("execution_date").alias("day"), "split_ratio").unionByName(
        positive_dividends(dividends).select(
            "symbol", F.col("ex_dividend_date").alias("day"), "cash_amount"
        ),
        allowMissingColumns=True,
    )
    days = _by_day(
        events.filter(F.col("symbol").isNotNull() & F.col("day").isNotNull()),
        "day",
        split_ratio=F.product("split_ratio"),
        dividend_amount=F.sum("cash_amount"),
    )
    entry = F.struct("trade_date_market", F.struct("split_ratio", "dividend_amount"))
    return (
        with_slice(days)
        .groupBy(KEY, SLICE)
        .agg(F.map_from_entries(F.collect_list(entry)).alias("_events"))
    )


def join_events(bars: DataFrame, splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """Both of the above at the price of one join, on symbol and year."""
    event = F.try_element_at("_events", F.col("trade_date_market"))
    joined = with_slice(bars).join(_events_by_year(splits, dividends), [KEY, SLICE], "left")
    return joined.select(
        *bars.columns,
        F.coalesce(event["split_ratio"], F.lit(1.0)).alias("split_ratio"),
        F.coalesce(event["dividend_amount"], F.lit(0.0)).alias("dividend_amount"),
    )


def add_adjustment_factor(bars: DataFrame) -> DataFrame:
    """Add the cumulative factors to bars that carry ``split_ratio`` and ``dividend_amount``.

    ``cumulative_split_factor`` is the product of the ratios from the newest bar back (ratios
    that are not positive are left out), ``dividend_adjustment`` the sum of dividend yields,
    ``adjustment_factor`` the first times one plus the second. ``bar_no`` comes with them.
    """
    dividend_yield = F.when(
        F.col("close") > 0, F.col("dividend_amount") / F.col("close")
    ).otherwise(0.0)
    totals = number_bars(
        bars, {"_log_split": F.log("split_ratio"), "dividend_adjustment": dividend_yield}
    )
    return (
        totals.withColumn("cumulative_split_factor", F.exp("_log_split"))
        .drop("_log_split")
        .withColumn(
            "adjustment_factor",
            F.col("cumulative_split_factor") * (1 + F.col("dividend_adjustment")),
        )
    )


def factor_steps(
    bars: DataFrame, splits: DataFrame, dividends: DataFrame, convention: str = RAISE
) -> DataFrame:
    """The steps of each symbol's factors, one row per symbol and year with bars.

    ``_steps`` has an entry for each day of the year with an event and a bar, newest first, with the
    logarithm of the split factor and the dividend term summed over the year's events so far;
    ``_newer_split`` and ``_newer_paid`` are the sums of later years. ``_sound`` is the symbol's newest
    bar whose split can be used: later ones have no split factor. ``_rows_to_here`` counts the bars up
    to the end of the year.
    """
    if convention not in (RAISE, LOWER):
        raise ValueError(f"no such convention: {convention}")
    met = with_slice(bars.select(*BAR_KEY, "close")).join(_events_by_year(splits, dividends), [KEY, SLICE], "left")
    met = met.withColumn("_event", F.try_element_at("_events", F.col(DAY)))
    within = Window.partitionBy(KEY, SLICE).orderBy(DAY)
    # only what lowers by the price before the day has to know it
    before = F.lag("close").over(within) if convention == LOWER else F.lit(None).cast("double")
    met = met.withColumn("_before", before)
    entry = F.struct(
        F.col(DAY).alias("day"),
        F.coalesce(F.col("_event.split_ratio"), F.lit(1.0)).alias("ratio"),
        F.coalesce(F.col("_event.dividend_amount"), F.lit(0.0)).alias("cash"),
        "close",
        F.col("_before").alias("before"),
    )
    usable = F.col("_event.split_ratio").isNull() | (F.col("_event.split_ratio") > 0)
    years = met.groupBy(KEY, SLICE).agg(
        F.count("*").alias("_rows"),
        F.sort_array(F.collect_list(F.when(F.col("_event").isNotNull(), entry)), asc=False).alias("_met"),
        F.max(F.when(usable, F.col(DAY))).alias("_sound"),
        F.max_by("close", DAY).alias("_last_close"),
    )
    symbol = Window.partitionBy(KEY)
    oldest_first = symbol.orderBy(SLICE)
    newer = symbol.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.lag("_last_close").over(oldest_first)
    years = years.select(
        KEY,
        SLICE,
        F.sum("_rows").over(oldest_first.rowsBetween(Window.unboundedPreceding, 0)).alias("_rows_to_here"),
        F.max("_sound").over(symbol).alias("_sound"),
        _summed("_met", convention, carried).alias("_steps"),
    )
    # the last entry of a year has all of it
    total = {name: F.coalesce(F.try_element_at("_steps", F.lit(-1))[name], F.lit(0.0)) for name in ("split", "paid")}
    return years.select(
        "*", *[F.coalesce(F.sum(total[name]).over(newer), F.lit(0.0)).alias(f"_newer_{name}") for name in total]
    )


def _summed(met: str, convention: str, carried: Column) -> Column:
    """``(day, split, paid)`` of each event, summed from the newest one back."""

    def terms(e: Column) -> Column:
        ratio, cash = F.when(e["ratio"] > 0, F.log(e["ratio"])).otherwise(0.0), e["cash"]
        if convention == RAISE:
            return F.struct(ratio.alias("split"), F.when(e["close"] > 0, cash / e["close"]).otherwise(0.0).alias("paid"))
        price = F.coalesce(e["before"], e["carried"])
        lowered = F.when((price > 0) & (cash < price), F.log(1 - cash / price)).otherwise(0.0)
        return F.struct((-ratio).alias("split"), lowered.alias("paid"))

    known = F.transform(met, lambda e: e.withField("carried", carried))
    each = F.transform(known, lambda e: F.struct(e["day"].alias("day"), terms(e).alias("x")))

    def so_far(name: str, k: Column) -> Column:
        return F.aggregate(F.slice(each, F.lit(1), k + 1), F.lit(0.0), lambda a, e: a + e["x"][name])

    return F.transform(each, lambda e, k: F.struct(e["day"].alias("day"), so_far("split", k).alias("split"), so_far("paid", k).alias("paid")))


def factor_table(steps: DataFrame) -> DataFrame:
    """``symbol, day, split, paid``: the steps of :func:`factor_steps` as rows, one per symbol and event
    day: the sums over this event and all newer ones."""
    rows = steps.select(KEY, "_sound", "_newer_split", "_newer_paid", F.explode("_steps").alias("s"))
    symbol = F.when(F.col(KEY) != "", F.substr(KEY, F.lit(2)))
    return rows.select(
        symbol.alias("symbol"),
        F.col("s.day").alias("day"),
        F.when(F.col("s.day") <= F.col("_sound"), F.col("_newer_split") + F.col("s.split")).alias("split"),
        (F.col("_newer_paid") + F.col("s.paid")).alias("paid"),
    ).dropDuplicates(["symbol", "day"])


def changed_intervals(held: DataFrame, now: DataFrame) -> DataFrame:
    """``symbol, after, until``: the days later than ``after``, or all earlier ones if it is null, and up to
    ``until``, on which two tables of :func:`factor_table` give a symbol different factors. Days later
    than all events of both have the factor 1 in both."""
    columns = ["split", "paid"]
    both = held.select("symbol", "day", F.struct(*columns).alias("was"), F.lit(None).cast(_STEP).alias("is")).unionByName(
        now.select("symbol", "day", F.lit(None).cast(_STEP).alias("was"), F.struct(*columns).alias("is"))
    )
    days = both.groupBy("symbol", "day").agg(F.max("was").alias("was"), F.max("is").alias("is"))
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("day"))
    so_far = newest_first.rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.struct(F.lit(0.0).alias("split"), F.lit(0.0).alias("paid"))

    def at(name: str) -> Column:  # a step holds back to the next older event
        return F.coalesce(F.last(name, ignorenulls=True).over(so_far), nothing)

    spans = days.select("symbol", F.lead("day").over(newest_first).alias("after"), F.col("day").alias("until"), at("was").alias("was"), at("is").alias("is"))
    spans = spans.filter(~F.col("was").eqNullSafe(F.col("is"))).select("symbol", "after", "until")
    # neighbours are one interval: an event that changes mostly changes all days before it
    oldest_first = Window.partitionBy("symbol").orderBy("until")
    begins = (~F.col("after").eqNullSafe(F.lag("until").over(oldest_first))).cast("int")
    numbered = spans.withColumn("begins", begins).withColumn("run", F.sum("begins").over(oldest_first))
    merged = numbered.groupBy("symbol", "run").agg(F.min_by("after", "until").alias("after"), F.max("until").alias("until"))
    return merged.drop("run")


_STEP = "struct<split:double,paid:double>"


def bars_in(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """``symbol, trade_date_market`` of the bars on the days of :func:`changed_intervals`."""
    day, after = F.col("trade_date_market"), F.col("after")
    inside = (day <= F.col("until")) & (after.isNull() | (day > after))
    spans = intervals.withColumnRenamed("symbol", "_of")
    return bars.select(*BAR_KEY).join(spans, (F.col("symbol") == F.col("_of")) & inside, "left_semi")


def with_factors(
    bars: DataFrame, steps: DataFrame, convention: str = RAISE, *, numbered: bool = False
) -> DataFrame:
    """Add ``cumulative_split_factor``, ``dividend_adjustment`` and ``adjustment_factor`` to bars by the
    step of :func:`factor_steps` that each one's day lies in."""
    sliced = with_slice(bars)
    if numbered:
        newest_first = Window.partitionBy(KEY, SLICE).orderBy(F.desc(DAY))
        sliced = sliced.withColumn("_row", F.row_number().over(newest_first))
    joined = sliced.join(steps, [KEY, SLICE], "left")
    day = F.col(DAY)
    counts = (lambda s: s["day"] >= day) if convention == RAISE else (lambda s: s["day"] > day)
    # steps are newest first, so the last one that counts has all that do
    step = F.try_element_at(F.filter("_steps", counts), F.lit(-1))
    split, paid = (F.col(f"_newer_{name}") + F.coalesce(step[name], F.lit(0.0)) for name in ("split", "paid"))
    sound = (day <= F.col("_sound")) | day.isNull()
    factors = joined.select(
        *[name for name in bars.columns if name not in (KEY, SLICE)],
        F.exp(F.when(sound, split) if convention == RAISE else split).alias("cumulative_split_factor"),
        (paid if convention == RAISE else F.exp(paid)).alias("dividend_adjustment"),
        *([(F.col("_rows_to_here") - F.col("_row")).alias(BAR_NO)] if numbered else []),
    )
    dividend = 1 + F.col("dividend_adjustment") if convention == RAISE else F.col("dividend_adjustment")
    return factors.withColumn("adjustment_factor", F.col("cumulative_split_factor") * dividend)


def adjusted_ohlc(bars: DataFrame, *also: str) -> DataFrame:
    """Raw and adjusted prices; the volume stays as traded."""
    prices = ("open", "high", "low", "close")
    return bars.select(
        *BAR_KEY,
        *prices,
        *[(F.col(p) * F.col("adjustment_factor")).alias(f"adjusted_{p}") for p in prices],
        "volume",
        "adjustment_factor",
        *also,
    )


def adjust_prices(
    bars: DataFrame,
    splits: DataFrame,
    dividends: DataFrame,
    *,
    numbered: bool = False,
    convention: str = RAISE,
) -> DataFrame:
    """Adjusted bars of all symbols in one plan; one row out per bar in.

    ``numbered`` keeps ``bar_no``, for indicators computed in the same plan. With ``convention``
    LOWER, prices before a split are divided by its ratio, and prices before an ex-dividend day are
    lowered by the share that the dividend has of the last close before it; a dividend that is not
    below that close, or has none before it, changes nothing.
    """
    needed = with_slice(bars.select(*BAR_KEY, "open", "high", "low", "close", "volume"))
    steps = factor_steps(bars, splits, dividends, convention)
    factors = with_factors(needed, steps, convention, numbered=numbered)
    return adjusted_ohlc(factors, *([BAR_NO] if numbered else []))


def unmatched_events(
    bars: DataFrame, events: DataFrame, date_column: str
) -> DataFrame:
    """Events on a day without a bar: they have no effect on the adjusted prices."""
    days = bars.select("symbol", F.col("trade_date_market").alias(date_column))
    return events.join(days, ["symbol", date_column], "left_anti")
