"""Per-symbol window functions without a task per symbol.

``Window.partitionBy("symbol")`` hands the whole history of a symbol to one task. Here a symbol
is cut along its time axis instead, and each cut carries in just what the window needs from
its neighbours:

* running totals: a *slice* is one calendar year. Each slice sums its own rows, and the totals
  of the other slices, one row per symbol and year, are added on top;
* trailing row frames: a *segment* is a fixed number of consecutive bars, preceded by copies of
  the last bars of the segment before it (the warm-up), so each frame finds all of its rows.

Both give exactly the rows and frames of the plain window.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT_ROWS = 1024
BAR_NO = "bar_no"
#: The symbol for joins: bars without one are a group of their own there too, as in a window.
KEY = "_key"
DAY = "trade_date_market"
SLICE = "_slice"

Step = Callable[[DataFrame, WindowSpec], DataFrame]


def with_slice(rows: DataFrame, day: str = DAY) -> DataFrame:
    """Add the slice of each row, unless it is there: steps that share it share a shuffle."""
    if SLICE in rows.columns:
        return rows
    # An undated bar sorts before all others, so its slice does too.
    return rows.withColumns(
        {
            KEY: F.coalesce(F.concat(F.lit("="), "symbol"), F.lit("")),
            SLICE: F.coalesce(F.year(day), F.lit(-1)),
        }
    )


def number_bars(
    bars: DataFrame,
    totals_back: Mapping[str, Column] | None = None,
    *,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Add ``bar_no``, counting a symbol's bars from 0 at the oldest, and running totals.

    ``totals_back`` maps names to expressions to be summed from the newest bar of the symbol
    back to each bar, bars of the same day included. Without totals, ``calendar`` may stand in
    for ``bars`` in counting the bars per year: any cheaper frame with the same symbols and days.
    """
    totals = dict(totals_back or {})
    symbol = Window.partitionBy(KEY)
    to_here = symbol.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    newer = symbol.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    newest_first = Window.partitionBy(KEY, SLICE).orderBy(F.desc(DAY))

    counted = with_slice(bars if totals or calendar is None else calendar)
    slices = (
        counted.groupBy(KEY, SLICE)
        .agg(F.count("*").alias("_rows"), *[F.sum(v).alias(name) for name, v in totals.items()])
        .select(
            KEY,
            SLICE,
            F.sum("_rows").over(to_here).alias("_rows_to_here"),
            *[F.sum(name).over(newer).alias(f"_newer_{name}") for name in totals],
        )
    )
    local = with_slice(bars).withColumns(
        {
            "_row": F.row_number().over(newest_first),
            **{name: F.sum(value).over(newest_first) for name, value in totals.items()},
        }
    )

    def total(name: str) -> Column:
        # A sum over NULLs alone is NULL, as in a single window.
        here, carried = F.col(name), F.col(f"_newer_{name}")
        return F.coalesce(here + carried, here, carried).alias(name)

    return local.join(slices, [KEY, SLICE], "left").select(
        *[name for name in bars.columns if name not in (KEY, SLICE)],
        *[total(name) for name in totals],
        (F.col("_rows_to_here") - F.col("_row")).alias(BAR_NO),
    )


def over_segments(
    bars: DataFrame,
    steps: Sequence[Step],
    look_back: int,
    *,
    calendar: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Run window steps over segments; each bar sees up to ``look_back`` earlier bars.

    A step takes the frame and the window to use (a symbol in date order) and adds columns.
    Bars that carry ``bar_no`` already are not numbered again.
    """
    if look_back >= segment_rows:
        raise ValueError("a segment must be longer than the look-back")
    numbered = bars if BAR_NO in bars.columns else number_bars(bars, calendar=calendar)

    segment = F.floor(F.col(BAR_NO) / segment_rows)
    is_tail = F.col(BAR_NO) % segment_rows >= segment_rows - look_back
    copies = F.when(is_tail, F.array(segment, segment + 1)).otherwise(F.array(segment))
    seg = numbered.withColumn("_segment", F.explode(copies)).withColumn(
        "_warm_up", F.col("_segment") > segment
    )

    in_order = Window.partitionBy("symbol", "_segment").orderBy(BAR_NO)
    for step in steps:
        seg = step(seg, in_order)
    return seg.filter(~F.col("_warm_up")).drop("_segment", "_warm_up", BAR_NO)
