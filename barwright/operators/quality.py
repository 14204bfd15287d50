"""Completeness, de-duplication and row-count checks."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.schemas import ENDPOINTS

BAR_KEY = ["symbol", "trade_date_market"]
LANDING_KEY = ["symbol", "endpoint_type", "execution_date"]


class IncompleteLanding(RuntimeError):
    """Some expected symbol and endpoint did not land; ``gaps`` has all of them as a table."""

    def __init__(self, count: int, gaps: DataFrame):
        super().__init__(f"{count} landings are missing, so nothing is curated")
        self.count, self.gaps = count, gaps


def landed_keys(envelopes: DataFrame) -> DataFrame:
    """Symbol, endpoint and run date of everything landed, each once."""
    return envelopes.select(LANDING_KEY).distinct()


def expected_landings(
    symbols: DataFrame, execution_date: str, endpoints: Sequence[str] = ENDPOINTS
) -> DataFrame:
    """Each symbol with each endpoint for one run date."""
    return (
        symbols.select("symbol")
        .distinct()
        .select(
            "symbol",
            F.explode(F.array(*[F.lit(e) for e in endpoints])).alias("endpoint_type"),
            F.lit(execution_date).alias("execution_date"),
        )
    )


def landing_gaps(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """Expected symbol and endpoint pairs that are not there."""
    return expected.select(LANDING_KEY).join(landed_keys(landed), LANDING_KEY, "left_anti")


def not_yet_landed(incoming: DataFrame, landed: DataFrame) -> DataFrame:
    """Incoming envelopes whose symbol, endpoint and run date have not landed before."""
    return incoming.join(landed_keys(landed), LANDING_KEY, "left_anti")


def require_complete(gaps: DataFrame) -> None:
    """Raise if there is any gap; the error counts and carries them all."""
    count = gaps.count()
    if count:
        raise IncompleteLanding(count, gaps.select(LANDING_KEY))


def landing_summary(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """Per symbol and run date: what landed, what failed, and whether the symbol succeeded.

    A symbol has at most one row per endpoint here, so the list of failures stays short.
    """
    status = expected.select(LANDING_KEY).join(
        landed_keys(landed).withColumn("ok", F.lit(True)), LANDING_KEY, "left"
    )
    failed = F.collect_list(F.when(F.col("ok").isNull(), F.col("endpoint_type")))
    return (
        status.groupBy("symbol", "execution_date")
        .agg(
            F.count("ok").alias("n_landed"),
            F.count_if(F.col("ok").isNull()).alias("n_failed"),
            F.array_join(F.array_sort(failed), ",").alias("failed_endpoints"),
        )
        .withColumn("succeeded", F.col("n_failed") == 0)
    )


def distinct_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def row_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per named table."""
    counts = [
        table.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("layer"), "row_count")
        for name, table in layers.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def drop_duplicate_keys(
    rows: DataFrame, keys: Sequence[str], keep_lowest: str | None = None
) -> DataFrame:
    """One row per key, NULLs counting as equal.

    Any of the rows survives, or the one lowest in ``keep_lowest``. Either way copies are merged
    before the shuffle, so a key with very many copies stays cheap.
    """
    if keep_lowest is None:
        return rows.dropDuplicates(list(keys))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    survivor = F.min(F.struct(F.col(f"`{keep_lowest}`").alias("_rank"), *columns)).alias("kept")
    merged = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(survivor)
    return merged.select(*[F.col("kept").getField(c).alias(c) for c in rows.columns])


def newest_per_symbol(daily: DataFrame, date_column: str = "trade_date_market") -> DataFrame:
    """Each symbol's record of its latest date."""
    rest = [c for c in daily.columns if c not in ("symbol", date_column)]
    newest = F.max(F.struct(date_column, *rest)).alias("newest")
    latest = daily.groupBy("symbol").agg(newest)
    return latest.select("symbol", *[F.col(f"newest.{c}").alias(c) for c in (date_column, *rest)])


def union_providers(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bars of several providers under one another, matched by column name; all are kept."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def by_precedence(providers: Mapping[str, DataFrame]) -> DataFrame:
    """Bars of several providers, told apart by ``provider`` and ``rank``, the first-named one's first."""
    ranked = [
        bars.withColumns({"provider": F.lit(name), "rank": F.lit(rank)})
        for rank, (name, bars) in enumerate(providers.items())
    ]
    return union_providers(*ranked)


def merge_providers(ranked: DataFrame, keys: Sequence[str] = BAR_KEY) -> DataFrame:
    """One bar per key of what :func:`by_precedence` gives: the one of the first-named provider that has
    it; of several bars of one provider, the lowest by its other columns. Merged before the shuffle."""
    rest = [c for c in ranked.columns if c not in (*keys, "rank")]
    first = F.min(F.struct("rank", *rest)).alias("first")
    merged = ranked.groupBy(*keys).agg(first)
    return merged.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def provider_conflicts(ranked: DataFrame, value: str = "close", keys: Sequence[str] = BAR_KEY) -> DataFrame:
    """Keys for which providers give different values: how many providers there are, whose bar is
    taken, and the least and largest value. Providers without a value do not disagree."""
    told = ranked.groupBy(*keys).agg(
        F.count_distinct("provider").alias("n_providers"),
        F.min_by("provider", "rank").alias("taken"),
        F.min(value).alias(f"least_{value}"),
        F.max(value).alias(f"largest_{value}"),
    )
    return told.filter((F.col("n_providers") > 1) & (F.col(f"least_{value}") < F.col(f"largest_{value}")))


def missing_days(bars: DataFrame) -> DataFrame:
    """``symbol, first_day, last_day, n_days``: the trading days that a symbol has no bar of, since its
    first bar, neighbouring ones together.

    A trading day is one on which any symbol has a bar. Undated bars are left out; a symbol has a row
    per day at most, so none is too long for a task.
    """
    dated = bars.filter("trade_date_market is not null").select(*BAR_KEY)
    days = dated.select(F.col("trade_date_market").alias("day")).distinct()
    # the days of the calendar are few: they are numbered in one task and sent to every executor
    numbered = days.withColumn("number", F.row_number().over(Window.orderBy("day")))
    calendar = numbered.withColumn("end", F.count("*").over(Window.partitionBy()))
    present = dated.distinct().join(F.broadcast(calendar), F.col("trade_date_market") == F.col("day"))
    following = F.lead("number").over(Window.partitionBy("symbol").orderBy("number"))
    gaps = present.select(
        "symbol",
        (F.col("number") + 1).alias("a"),
        (F.coalesce(following, F.col("end") + 1) - 1).alias("b"),
    )
    gaps = gaps.filter(F.col("a") <= F.col("b"))

    def named(number: str, day: str) -> DataFrame:
        return F.broadcast(calendar.select(F.col("number").alias(number), F.col("day").alias(day)))

    spans = gaps.join(named("a", "first_day"), "a").join(named("b", "last_day"), "b")
    return spans.select("symbol", "first_day", "last_day", (F.col("b") - F.col("a") + 1).alias("n_days"))


def newest_first_listing(daily: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows by symbol, newest day first: the report after a run."""
    return daily.orderBy("symbol", F.desc("trade_date_market")).limit(rows)
