"""IO around the operators: one function per batch job.

Each reads its layer, runs one plan and writes the next layer; a job run twice leaves the same
tables. Rows are counted as they are written, not by reading anything again.
"""

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barwright import schemas
from barwright.operators import curate as curation
from barwright.operators import quality
from barwright.operators.actions import (
    adjusted_ohlc,
    bars_in,
    changed_intervals,
    factor_steps,
    factor_table,
    latest_events,
    new_versions,
    unmatched_events,
    with_factors,
)
from barwright.operators.carried import beyond_state, last_bars, next_state, regimes_from_state
from barwright.operators.regime import detect_regimes, on_adjusted_prices, regime_updates
from barwright.scratch import last_change, stored
from barwright.sinks import (
    append_rows,
    drop_partitions,
    land_envelopes,
    merge_partitions,
    overwrite_partitions,
    overwrite_table,
    partition_values,
    write_formats,
    write_jdbc,
)
from barwright.sinks.files import Target
from barwright.sources import (
    landing_path,
    parse_landing,
    parsed_documents,
    parsed_schema,
    quarantined,
    read_csv_text,
    read_landing,
    read_or_empty,
    read_stock_documents,
    read_table,
)


#: A batch of so many events is sent to every executor.
FEW_EVENTS = 10_000


@dataclass(frozen=True)
class Layout:
    """Where the layers live below one base path. The folder names are fixed values."""

    base: str

    @property
    def landing(self) -> str:
        return f"{self.base}/landing/{schemas.PROVIDER}"

    def parsed(self, endpoint: str, execution_date: str) -> str:
        return f"{self.base}/parsed/{endpoint}/ingestion_date={execution_date}"

    def curated(self, table: str) -> str:
        return f"{self.base}/curated/{table}"

    def stock_document(self, run_date: str) -> str:
        return f"{self.base}/landing/fact_date={run_date}/stocks.json"

    def processed(self, fmt: str, run_date: str) -> str:
        return f"{self.base}/processed/{fmt}/fact_date={run_date}"


def _landed(spark: SparkSession, layout: Layout, execution_date: str) -> DataFrame:
    """Keys of all envelopes of a run date, over the endpoints, as the gate has parsed them."""
    parsed = [read_table(spark, layout.parsed(e, execution_date), parsed_schema(e)) for e in schemas.ENDPOINTS]
    return reduce(DataFrame.unionByName, [quality.landed_keys(parsed_documents(p)) for p in parsed])


def _parsed(spark: SparkSession, layout: Layout, endpoint: str, execution_date: str) -> DataFrame | None:
    """What :func:`parse_landed` wrote, unless something has landed since."""
    path = layout.parsed(endpoint, execution_date)
    written = last_change(spark, path)
    landed = last_change(spark, landing_path(layout.landing, endpoint, execution_date))
    if written is None or landed is None or landed >= written:
        return None
    return read_table(spark, path, parsed_schema(endpoint))


def parse_landed(spark: SparkSession, layout: Layout, execution_date: str) -> dict[str, int]:
    """Parse each landed document once, to a table that marks the good and the bad ones, from which
    the gate and the curation read. Returns the number of documents by endpoint."""
    rows = {}
    for endpoint in schemas.ENDPOINTS:
        parsed = parse_landing(spark, layout.landing, endpoint, execution_date)
        rows[endpoint] = overwrite_table(parsed, layout.parsed(endpoint, execution_date))
    return rows


def land(
    layout: Layout, execution_date: str, envelopes: Mapping[str, DataFrame]
) -> None:
    """Add envelopes, by endpoint, that this run date does not hold yet."""
    for endpoint, incoming in envelopes.items():
        held = read_landing(
            incoming.sparkSession,
            layout.landing,
            endpoint,
            execution_date,
            required=False,
        )
        land_envelopes(quality.not_yet_landed(incoming, held), layout.landing, endpoint)


def check_landing(
    spark: SparkSession,
    layout: Layout,
    symbols: DataFrame,
    execution_date: str,
) -> DataFrame:
    """Raise unless every symbol landed at every endpoint and everything landed can be read;
    otherwise the summary per symbol. The documents are parsed here, once, for the curation too."""
    parse_landed(spark, layout, execution_date)
    rejected = {}
    for endpoint in schemas.ENDPOINTS:
        parsed = read_table(spark, layout.parsed(endpoint, execution_date), parsed_schema(endpoint))
        rejected[endpoint] = quarantined(parsed).count()
    if any(rejected.values()):
        counts = ", ".join(f"{n} of {e}" for e, n in rejected.items() if n)
        raise ValueError(f"landed documents that do not parse: {counts}")
    expected = quality.expected_landings(symbols, execution_date)
    landed = _landed(spark, layout, execution_date)
    quality.require_complete(quality.landing_gaps(expected, landed))
    return quality.landing_summary(expected, landed)


def append_events(
    events: DataFrame, id_column: str, path: str, schema: StructType, date_column: str
) -> int:
    """Append events that differ from the latest version held; readers take the latest per id. Returns
    how many these are.

    Of the held table only what has an id of the batch is looked at, while the batch is small enough to be
    sent to every executor; with a large one the whole table is compared, each row shuffled once.
    """
    extra = [name for name in events.columns if name not in schema.names]
    batch = (latest_events(events, id_column) if extra else events).select(schema.names)
    held = read_or_empty(batch.sparkSession, path, schema)
    if batch.limit(FEW_EVENTS + 1).count() <= FEW_EVENTS:
        ids = F.broadcast(batch.select("symbol", id_column).distinct())
        held = held.join(ids, [held[c].eqNullSafe(ids[c]) for c in ("symbol", id_column)], "left_semi")
    return append_rows(new_versions(batch, held, id_column), path, [date_column])


def curate(
    spark: SparkSession,
    layout: Layout,
    execution_date: str,
    *,
    ingested_at: Column | None = None,
    merge: bool = False,
) -> dict[str, int]:
    """Landing to ``ohlcv``, ``splits`` and ``dividends``; returns the rows written to each, counted as
    they are written.

    Bars must have landed; the two event tables may be missing. Replacing a trade date drops
    the bars of symbols that did not land for it, so run :func:`check_landing` first, or let
    ``merge`` replace the bars that landed and keep the others. What the gate has parsed is not parsed
    again.
    """

    def landing(endpoint: str, required: bool) -> DataFrame:
        parsed = _parsed(spark, layout, endpoint, execution_date)
        if parsed is not None:
            return parsed_documents(parsed)
        return read_landing(
            spark,
            layout.landing,
            endpoint,
            execution_date,
            required=required,
        )

    bars, path = curation.curate_ohlcv(landing("daily_ohlcv", required=True)), layout.curated("ohlcv")
    day = ["trade_date_market"]
    rows = {
        "ohlcv": merge_partitions(bars, path, schemas.OHLCV, ["symbol", *day], day) if merge else overwrite_partitions(bars, path, day)
    }
    splits = curation.curate_splits(landing("splits", required=False), ingested_at)
    rows["splits"] = append_events(splits, "split_id", layout.curated("splits"), schemas.SPLITS, "execution_date")
    dividends = curation.curate_dividends(landing("dividends", required=False), ingested_at)
    rows["dividends"] = append_events(
        dividends, "dividend_id", layout.curated("dividends"), schemas.DIVIDENDS, "ex_dividend_date"
    )
    return rows


def _bars_and_steps(spark: SparkSession, layout: Layout) -> tuple[DataFrame, DataFrame]:
    columns = ["symbol", "trade_date_market", "open", "high", "low", "close", "volume"]
    bars = read_table(spark, layout.curated("ohlcv"), schemas.OHLCV, columns)
    splits = read_or_empty(spark, layout.curated("splits"), schemas.SPLITS)
    dividends = read_or_empty(spark, layout.curated("dividends"), schemas.DIVIDENDS)
    events = latest_events(splits, "split_id"), latest_events(dividends, "dividend_id")
    return bars, stored(factor_steps(bars, *events), "steps")


def adjust(spark: SparkSession, layout: Layout, rows: dict[str, int] | None = None) -> DataFrame:
    """``ohlcv`` with ``splits`` and ``dividends`` to ``ohlcv_adjusted``; returns what was written, and puts
    the number of rows written into ``rows``, if given."""
    bars, steps = _bars_and_steps(spark, layout)
    adjusted = adjusted_ohlc(with_factors(bars, steps))
    path = layout.curated("ohlcv_adjusted")
    written = overwrite_table(adjusted, path, ["trade_date_market"])
    overwrite_table(factor_table(steps), layout.curated("factor_steps"))
    if rows is not None:
        rows["ohlcv_adjusted"] = written
    return read_table(spark, path, schemas.OHLCV_ADJUSTED)


def adjust_changes(
    spark: SparkSession, layout: Layout, days: Iterable[str], rows: dict[str, int] | None = None
) -> DataFrame:
    """Bring ``ohlcv_adjusted`` up to date after bars of ``days`` and any events were curated.

    The factors' steps are compared with those of the last run; the days that changed for a symbol
    are adjusted anew for it, ``days`` as a whole, and nothing else is read or written. Days that no
    longer have bars go. Gives what :func:`adjust` gives. Returns the changed intervals of earlier
    days, by symbol.
    """
    day, path = "trade_date_market", layout.curated("ohlcv_adjusted")
    bars, steps = _bars_and_steps(spark, layout)
    now = stored(factor_table(steps), "factors")
    held = read_or_empty(spark, layout.curated("factor_steps"), schemas.FACTOR_STEPS)
    changes = stored(changed_intervals(held, now), "changes")
    new = F.col(day).isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False)

    restated = stored(bars_in(bars, changes), "restated")
    touched = [r[0] for r in restated.select(day).distinct().collect()]  # as many as there are days at most
    older = bars.filter(F.col(day).isin(touched)) if touched else bars.limit(0)
    same = [older[c].eqNullSafe(restated[c]) for c in ("symbol", day)]
    wanted = older.filter(~new).join(restated, same, "left_semi").unionByName(bars.filter(new))
    gone = read_or_empty(spark, path, schemas.OHLCV_ADJUSTED, ["symbol", day]).filter(new)
    written = merge_partitions(
        adjusted_ohlc(with_factors(wanted, steps)), path, schemas.OHLCV_ADJUSTED, ["symbol", day], [day], gone=gone
    )
    _drop_vanished(spark, path, layout.curated("ohlcv"), day)
    overwrite_table(now, layout.curated("factor_steps"))
    if rows is not None:
        rows["ohlcv_adjusted"] = written
    return changes


def _drop_vanished(spark: SparkSession, path: str, source: str, day: str) -> None:
    """Remove the days of a table that its source has none of any more."""
    vanished = set(partition_values(spark, path, day)) - set(partition_values(spark, source, day))
    drop_partitions(spark, path, day, sorted(vanished))


def events_without_bar(spark: SparkSession, layout: Layout) -> DataFrame:
    """``symbol, event_id, event_date`` of splits and dividends that no bar shows, so that they
    change no price."""
    bars = read_table(spark, layout.curated("ohlcv"), schemas.OHLCV, ["symbol", "trade_date_market"])
    tables = (
        ("splits", schemas.SPLITS, "split_id", "execution_date"),
        ("dividends", schemas.DIVIDENDS, "dividend_id", "ex_dividend_date"),
    )
    found = []
    for name, schema, event_id, day in tables:
        events = latest_events(read_or_empty(spark, layout.curated(name), schema), event_id)
        lost = unmatched_events(bars, events.select("symbol", event_id, day), day)
        found.append(lost.select("symbol", F.col(event_id).alias("event_id"), F.col(day).alias("event_date")))
    return quality.union_providers(*found)


def detect(
    spark: SparkSession, layout: Layout, since: str | None = None, rows: dict[str, int] | None = None
) -> DataFrame:
    """``ohlcv_adjusted`` to ``regime``; returns the written table for reports on it, and puts the number
    of rows written into ``rows``, if given.

    A full run replaces the table and the state that :func:`detect_changes` starts from. With
    ``since``, that day and later ones are computed and replaced, and the earlier days of symbols
    whose adjusted prices a new event has changed; days that lost their last bar go.
    """
    path, day = layout.curated("regime"), "trade_date_market"
    adjusted = read_table(spark, layout.curated("ohlcv_adjusted"), schemas.OHLCV_ADJUSTED)
    bars = on_adjusted_prices(adjusted)
    if since is None:
        written = overwrite_table(detect_regimes(bars), path, [day])
    else:
        held = read_or_empty(spark, path, schemas.REGIME)
        updates = stored(regime_updates(bars, held, since), "regimes")
        written = overwrite_partitions(updates, path, [day])
        _drop_vanished(spark, path, layout.curated("ohlcv_adjusted"), day)
    overwrite_table(last_bars(bars), layout.curated("regime_state"))
    if rows is not None:
        rows["regime"] = written
    return read_table(spark, path, schemas.REGIME)


def detect_changes(
    spark: SparkSession, layout: Layout, since: str, changes: DataFrame, rows: dict[str, int] | None = None
) -> DataFrame:
    """Bring ``regime`` up to date after :func:`adjust_changes`, which gave ``changes``, with new bars from
    ``since`` on only.

    Of most symbols the days from ``since`` on are read, and the bars before them come from the
    state. Symbols with changed earlier prices, and those the state does not reach back far enough
    for, are computed from their history. Gives what a full :func:`detect` gives.
    """
    path, day = layout.curated("regime"), "trade_date_market"
    bars = on_adjusted_prices(read_table(spark, layout.curated("ohlcv_adjusted"), schemas.OHLCV_ADJUSTED))
    state = read_or_empty(spark, layout.curated("regime_state"), schemas.REGIME_STATE)
    earlier = F.col("after").isNull() | (F.date_add("after", 1) < since)
    whole = changes.filter(earlier).select("symbol").union(beyond_state(state, bars, since).select("symbol"))
    whole = stored(whole.distinct(), "whole")

    def of(frame: DataFrame, how: str) -> DataFrame:
        return frame.join(whole, frame["symbol"].eqNullSafe(whole["symbol"]), how)

    recent = bars.filter(F.col(day) >= since)
    steady_state, steady = of(state, "left_anti"), of(recent, "left_anti")
    updates = regimes_from_state(steady_state, steady, since)
    kept = next_state(steady_state, steady, since)
    held = read_or_empty(spark, path, schemas.REGIME, ["symbol", day])
    gone = held.filter(F.col(day) >= since)
    if not whole.isEmpty():
        history = stored(of(bars, "left_semi"), "history")
        updates = updates.unionByName(detect_regimes(history))
        kept = kept.unionByName(last_bars(history))
        gone = gone.union(of(held.filter(F.col(day) < since), "left_semi"))
    kept = stored(kept, "state")
    written = merge_partitions(updates, path, schemas.REGIME, ["symbol", day], [day], gone=gone)
    _drop_vanished(spark, path, layout.curated("ohlcv_adjusted"), day)
    overwrite_table(kept, layout.curated("regime_state"))
    if rows is not None:
        rows["regime"] = written
    return read_table(spark, path, schemas.REGIME)


def daily(spark: SparkSession, layout: Layout, execution_date: str) -> dict[str, int]:
    """What landed on a run date, through all layers, without reading or writing what it leaves alone.
    Returns the rows written to each table."""
    landed = _parsed(spark, layout, "daily_ohlcv", execution_date)
    documents = read_landing(spark, layout.landing, "daily_ohlcv", execution_date) if landed is None else parsed_documents(landed)
    days = curation.curate_ohlcv(documents).select("trade_date_market").distinct()
    days = sorted(str(r[0]) for r in days.collect() if r[0])  # as many as there are days at most
    rows = curate(spark, layout, execution_date, merge=True)
    changes = adjust_changes(spark, layout, days, rows)
    if days:
        detect_changes(spark, layout, days[0], changes, rows)
    return rows


def stocks(
    spark: SparkSession,
    layout: Layout,
    run_date: str,
    formats: Mapping[str, Target] | None = None,
) -> None:
    """The stock document of a day to row and columnar files."""
    rows = curation.curate_stocks(
        read_stock_documents(spark, layout.stock_document(run_date)), run_date
    )
    write_formats(rows, formats or stock_targets(layout, run_date))


def stock_targets(layout: Layout, run_date: str) -> dict[str, Target]:
    return {
        "avro": Target(layout.processed("avro", run_date), ["date"]),
        "parquet": Target(layout.processed("parquet", run_date), ["date", "symbol"]),
    }


def load_contacts(
    spark: SparkSession,
    csv_path: str,
    url: str,
    properties: Mapping[str, str],
    table: str,
) -> None:
    """A contact CSV, one row per e-mail and contact, to a database table."""
    contacts = read_csv_text(spark, csv_path)
    unique = quality.drop_duplicate_keys(contacts, ["E-mail", "Contact"])
    write_jdbc(unique, url, table, properties)
