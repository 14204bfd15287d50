"""One query per operator, over the derived market tables.

Each takes the session and the folder of benchmark tables. Queries about files write to a fresh
folder first and return what a reader then finds there.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright import schemas
from barwright.functions import columns, dates
from barwright.operators import actions, carried, curate, indicators, quality, regime
from barwright.plans.jobs import append_events
from barwright.scratch import stored
from barwright.sinks import (
    append_new,
    envelopes,
    land_envelopes,
    land_texts,
    merge_partitions,
    overwrite_partitions,
    overwrite_table,
    write_formats,
)
from barwright.sinks.files import Target
from barwright.sources import (
    parse_landing,
    quarantined,
    read_csv_text,
    read_landing,
    read_or_empty,
    read_stock_documents,
    read_table,
)
from barwright.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
KEY = ("symbol", "trade_date_market")
PRICES = ("open", "high", "low", "close")
# The run date under which the derived tables are landed.
RUN_DATE = "2001-08-02"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(
        *[F.round(name, digits).alias(name) if name in names else F.col(name) for name in df.columns]
    )


# --- bars and scalar columns ---------------------------------------------------------------


@query
def bars_daily(spark, sf_dir):
    return rounded(t.bars(spark, sf_dir), 6, "low", "vwap")


@query
def market_date(spark, sf_dir):
    zone = F.element_at(
        F.array(F.lit(dates.INDIA), F.lit(dates.US), F.lit("Europe/Paris"), F.lit(None)),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    return _event_times(spark, sf_dir).select(
        "event_id", dates.market_date("ms", zone).alias("trade_date_market")
    )


@query
def utc_date(spark, sf_dir):
    return _event_times(spark, sf_dir).select(
        "event_id",
        dates.utc_date("ms").alias("trade_date_utc"),
        dates.utc_date(-F.col("ms")).alias("mirrored_date_utc"),
    )


def _event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return t.table(spark, sf_dir, "events").withColumn("ms", ms)


@query
def market_zone(spark, sf_dir):
    return quality.distinct_symbols(t.bars(spark, sf_dir)).select(
        "symbol", dates.market_zone("symbol").alias("market_timezone")
    )


@query
def parse_dates(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), iso)).otherwise(iso)
    return orders.select(
        "o_orderkey",
        dates.parse_date(text).alias("loose_date"),
        dates.parse_date(text, "yyyy-MM-dd").alias("strict_date"),
    )


@query
def number_casts(spark, sf_dir):
    user = F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .when(F.col("event_type") == "click", F.concat(user, F.lit(".75")))
        .otherwise(user)
    )
    return t.table(spark, sf_dir, "events").select(
        "event_id",
        columns.to_double(text).alias("as_double"),
        columns.to_whole(text).alias("as_long"),
        columns.to_whole(text, "int").alias("as_int"),
    )


@query
def money_cast(spark, sf_dir):
    price = F.col("l_extendedprice") * F.col("l_quantity") / 7
    return t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        columns.to_money(F.max(price)).alias("price"),
        columns.to_money(F.max(price) * 1000).alias("price_times_1000"),
    )


@query
def split_ratio(spark, sf_dir):
    old = F.round(F.col("l_discount") * 100)
    return (
        t.table(spark, sf_dir, "lineitem")
        .select(old.alias("split_from"), F.col("l_quantity").alias("split_to"))
        .withColumn("split_ratio", F.round(columns.split_ratio("split_from", "split_to"), 8))
    )


@query
def return_pct(spark, sf_dir):
    value = columns.return_pct("open", "close")
    return t.bars(spark, sf_dir).select(*KEY, F.round(value, 8).alias("return_pct"))


@query
def short_key(spark, sf_dir):
    number = F.col("o_orderkey") * 1_000_003
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        columns.short_key(number, 84).alias("key_84"),
        columns.short_key(number, 16).alias("key_16"),
    )


# --- landing and curation ------------------------------------------------------------------


def _ohlcv_results(spark: SparkSession, sf_dir: str, *also: Column) -> DataFrame:
    return t.bars(spark, sf_dir).select(
        "symbol",
        *also,
        t.open_of_day_ms().alias("t"),
        F.col("open").alias("o"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("close").alias("c"),
        F.col("volume").alias("v"),
        F.col("vwap").alias("vw"),
        F.col("transactions").alias("n"),
    )


def _split_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.splits(spark, sf_dir).withColumnRenamed("split_id", "id")


def _dividend_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = {"dividend_id": "id", "distribution_type": "dividend_type"}
    return t.dividends(spark, sf_dir).withColumnsRenamed(renamed)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = t.table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return suppliers.selectExpr(t.SYMBOL)


def _landed(
    spark: SparkSession,
    results: DataFrame,
    endpoint: str,
    requested: DataFrame | None = None,
) -> DataFrame:
    base = t.scratch(spark, "landing")
    land_envelopes(envelopes(results, endpoint, RUN_DATE, requested=requested), base, endpoint)
    return read_landing(spark, base, endpoint, RUN_DATE)


@query
def curate_ohlcv(spark, sf_dir):
    landed = _landed(spark, _ohlcv_results(spark, sf_dir), "daily_ohlcv")
    return rounded(curate.curate_ohlcv(landed), 6, "low", "vwap")


@query
def curate_splits(spark, sf_dir):
    landed = _landed(
        spark, _split_results(spark, sf_dir), "splits", requested=_suppliers(spark, sf_dir)
    )
    return curate.curate_splits(landed).drop("ingestion_timestamp")


@query
def curate_documents(spark, sf_dir):
    """Indented documents, each with all bars of a symbol and year."""
    results = _ohlcv_results(spark, sf_dir, F.year("trade_date_market").alias("year"))
    fields = [f.name for f in schemas.ENDPOINT_RESULTS["daily_ohlcv"]]
    yearly = results.groupBy("symbol", "year").agg(F.collect_list(F.struct(*fields)).alias("results"))
    document = F.to_json(
        F.struct(
            "symbol",
            F.lit("daily_ohlcv").alias("endpoint_type"),
            F.lit(RUN_DATE).alias("execution_date"),
            dates.market_zone("symbol").alias("market_timezone"),
            F.struct("results").alias("payload"),
        ),
        {"pretty": "true"},
    )
    base = t.scratch(spark, "documents")
    land_texts(yearly.select(document.alias("value")), base, "daily_ohlcv", RUN_DATE, lines=False)
    landed = read_landing(spark, base, "daily_ohlcv", RUN_DATE)
    return rounded(curate.curate_ohlcv(landed), 6, "low", "vwap")


@query
def curate_dividends(spark, sf_dir):
    landed = _landed(
        spark, _dividend_results(spark, sf_dir), "dividends", requested=_suppliers(spark, sf_dir)
    )
    return curate.curate_dividends(landed).drop("ingestion_timestamp")


@query
def landing_envelope(spark, sf_dir):
    landed = _landed(
        spark, _split_results(spark, sf_dir), "splits", requested=_suppliers(spark, sf_dir)
    )
    results = F.col("payload.results")
    return landed.select(
        "symbol",
        "source",
        "endpoint_type",
        "execution_date",
        "market_timezone",
        F.size(results).cast("bigint").alias("n_results"),
        F.try_element_at(results, F.lit(1)).getField("id").alias("first_id"),
    )


@query
def landing_quarantine(spark, sf_dir):
    """Documents of all bars, those of fifty units cut off, each parsed once: how many are good, by
    symbol, and how many are not, without one."""
    landed = envelopes(_ohlcv_results(spark, sf_dir), "daily_ohlcv", RUN_DATE)
    text = F.to_json(F.struct(*landed.columns))
    cut = F.when(F.get("payload.results", F.lit(0))["v"] == 50, F.left(text, F.length(text) - 7)).otherwise(text)
    base = t.scratch(spark, "quarantine")
    land_texts(landed.select(cut.alias("value")), base, "daily_ohlcv", RUN_DATE, lines=True)
    parsed = stored(parse_landing(spark, base, "daily_ohlcv", RUN_DATE), "parsed")
    good = parsed.filter("record is null").groupBy("document.symbol").agg(F.count("*").alias("n_documents"))
    bad = quarantined(parsed).agg(F.count("*").alias("n_documents"))
    return good.unionByName(bad.withColumn("symbol", F.lit(None).cast("string")))


def _landing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What landed at each endpoint: symbols with bars, with splits and dividends that change a price."""
    splits = t.splits(spark, sf_dir).filter("split_ratio <> 1")
    dividends = actions.positive_dividends(t.dividends(spark, sf_dir))
    sources = zip(schemas.ENDPOINTS, (t.bars(spark, sf_dir), splits, dividends))
    keys = [
        rows.select(
            "symbol", F.lit(endpoint).alias("endpoint_type"), F.lit(RUN_DATE).alias("execution_date")
        )
        for endpoint, rows in sources
    ]
    return quality.union_providers(*keys)


@query
def landing_gaps(spark, sf_dir):
    expected = quality.expected_landings(_suppliers(spark, sf_dir), RUN_DATE)
    return quality.landing_gaps(expected, _landing_keys(spark, sf_dir))


@query
def landing_summary(spark, sf_dir):
    expected = quality.expected_landings(_suppliers(spark, sf_dir), RUN_DATE)
    return quality.landing_summary(expected, _landing_keys(spark, sf_dir))


@query
def new_landings_only(spark, sf_dir):
    daily = t.bars(spark, sf_dir).select(
        "symbol",
        F.lit("daily_ohlcv").alias("endpoint_type"),
        F.col("trade_date_market").cast("string").alias("execution_date"),
        "close",
    )
    return quality.not_yet_landed(daily, daily.filter(F.col("execution_date") < "1999-01-01"))


#: Symbols of a stock document, about.
DOCUMENT_SYMBOLS = 500


def _stock_documents(spark: SparkSession, sf_dir: str, key: str) -> str:
    """Files of the newest bar of each symbol, documents of the symbols that share ``key``; very many of
    these are dealt out over several documents."""
    newest = quality.newest_per_symbol(t.bars(spark, sf_dir))
    sizes = newest.groupBy(key).agg(F.ceil(F.count("*") / DOCUMENT_SYMBOLS).alias("documents"))
    newest = newest.join(sizes, key).withColumn("document", F.pmod(F.xxhash64("symbol"), F.col("documents")))
    whole = F.col("volume").cast("bigint")
    texts = {**{p: F.col(p) for p in ("open", "high", "low", "close")}, "volume": whole}
    prices = F.struct(
        *[texts[name].cast("string").alias(field) for field, name in schemas.STOCK_FIELDS.items()],
        F.col("trade_date_market").cast("string").alias(schemas.STOCK_RECORD_DATE),
    )
    each = F.struct("symbol", prices)
    documents = newest.groupBy(key, "document").agg(F.map_from_entries(F.collect_list(each)).alias("stocks"))
    path = t.scratch(spark, "stocks")
    documents.select(F.to_json("stocks", {"pretty": "true"}).alias("value")).write.text(path)
    return path


@query
def stock_document_rows(spark, sf_dir):
    """A document per symbol."""
    path = _stock_documents(spark, sf_dir, "symbol")
    rows = curate.curate_stocks(read_stock_documents(spark, path), RUN_DATE)
    return rounded(rows, 8, "low", "return_pct")


@query
def curate_stock_documents(spark, sf_dir):
    """Indented documents of several symbols, those whose newest bars are of one day, written as
    Parquet by date and symbol and read again."""
    path = _stock_documents(spark, sf_dir, "trade_date_market")
    rows = curate.curate_stocks(read_stock_documents(spark, path), RUN_DATE)
    target = Target(t.scratch(spark, "processed"), ["date", "symbol"])
    write_formats(rows, {"parquet": target})
    return rounded(read_table(spark, target.path, schemas.STOCKS), 8, "low", "return_pct")


@query
def latest_per_symbol(spark, sf_dir):
    return rounded(quality.newest_per_symbol(t.bars(spark, sf_dir)), 6, "low", "vwap")


# --- corporate actions ---------------------------------------------------------------------


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.bars(spark, sf_dir), t.splits(spark, sf_dir), t.dividends(spark, sf_dir)


@query
def positive_dividends(spark, sf_dir):
    paid = actions.positive_dividends(t.dividends(spark, sf_dir))
    return paid.select("symbol", "dividend_id", "ex_dividend_date", "cash_amount")


@query
def split_join(spark, sf_dir):
    bars, splits, _ = _three(spark, sf_dir)
    return actions.join_splits(bars, splits).select(*KEY, "close", "split_ratio")


@query
def dividend_join(spark, sf_dir):
    bars, _, dividends = _three(spark, sf_dir)
    return actions.join_dividends(bars, dividends).select(*KEY, "close", "dividend_amount")


@query
def unmatched_events(spark, sf_dir):
    bars, splits, dividends = _three(spark, sf_dir)
    bars = stored(bars.select(*KEY), "days")
    no_bar = [
        actions.unmatched_events(bars, events, date).select(
            "symbol", F.col(event_id).alias("event_id"), F.col(date).alias("event_date")
        )
        for events, event_id, date in (
            (splits, "split_id", "execution_date"),
            (dividends, "dividend_id", "ex_dividend_date"),
        )
    ]
    return quality.union_providers(*no_bar)


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.add_adjustment_factor(actions.join_events(*_three(spark, sf_dir)))


@query
def cumulative_split(spark, sf_dir):
    factor = F.round("cumulative_split_factor", 6).alias("cumulative_split_factor")
    return _factors(spark, sf_dir).select(*KEY, factor)


@query
def cumulative_dividend(spark, sf_dir):
    total = F.round("dividend_adjustment", 8).alias("dividend_adjustment")
    return _factors(spark, sf_dir).select(*KEY, total)


@query
def adjustment_factor(spark, sf_dir):
    factor = F.round("adjustment_factor", 6).alias("adjustment_factor")
    return _factors(spark, sf_dir).select(*KEY, factor)


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.adjust_prices(*_three(spark, sf_dir))


@query
def adjusted_ohlc(spark, sf_dir):
    prices = [f"adjusted_{p}" for p in ("open", "high", "low", "close")]
    return rounded(_adjusted(spark, sf_dir), 4, "low", "adjustment_factor", *prices)


@query
def adjusted_back(spark, sf_dir):
    """The usual back-adjustment: prices before an event are divided and lowered."""
    adjusted = actions.adjust_prices(*_three(spark, sf_dir), convention=actions.LOWER)
    prices = adjusted.select(*KEY, "close", "adjusted_close", "adjustment_factor")
    return rounded(prices, 4, "adjusted_close", "adjustment_factor")


@query
def factor_steps(spark, sf_dir):
    """The steps of the adjustment factors: one for each day with an event and a bar."""
    steps = actions.factor_table(actions.factor_steps(*_three(spark, sf_dir)))
    return steps.select(
        "symbol", "day", F.round(F.exp("split"), 6).alias("split_factor"), F.round("paid", 8).alias("dividend_adjustment")
    )


@query
def adjusted_changes(spark, sf_dir):
    """Bars adjusted by the splits before 2000 only, then brought up to date with all of them: the steps
    of the factors are compared, and only the days that they change for a symbol are adjusted again."""
    bars, splits, dividends = _three(spark, sf_dir)
    bars = stored(bars.select(*KEY, *PRICES, "volume"), "bars")
    early = splits.filter("execution_date < DATE '2000-01-01'")
    was, now = (stored(actions.factor_steps(bars, s, dividends), "steps") for s in (early, splits))
    changes = actions.changed_intervals(actions.factor_table(was), actions.factor_table(now))
    changed = stored(actions.bars_in(bars, changes), "changed")
    held = actions.with_factors(bars, was)
    again = actions.with_factors(bars.join(changed, list(KEY), "left_semi"), now)
    both = held.join(changed, list(KEY), "left_anti").select(held.columns).unionByName(again.select(held.columns))
    prices = actions.adjusted_ohlc(both).select(*KEY, "adjusted_close", "adjustment_factor")
    return rounded(prices, 4, "adjusted_close", "adjustment_factor")


@query
def adjusted_latest20(spark, sf_dir):
    adjusted = quality.newest_first_listing(_adjusted(spark, sf_dir))
    prices = adjusted.select(*KEY, "close", "adjusted_close", "adjustment_factor")
    return rounded(prices, 4, "adjusted_close", "adjustment_factor")


@query
def optional_source(spark, sf_dir):
    """Adjustment when no event table was ever written."""
    nowhere = t.scratch(spark, "never-written")
    splits = read_or_empty(spark, f"{nowhere}/splits", schemas.SPLITS)
    dividends = read_or_empty(spark, f"{nowhere}/dividends", schemas.DIVIDENDS)
    adjusted = actions.adjust_prices(t.bars(spark, sf_dir), splits, dividends)
    return adjusted.select(*KEY, "close", "adjusted_close", "adjustment_factor")


# --- indicators and regimes ----------------------------------------------------------------


@query
def lag_prices(spark, sf_dir):
    previous = ("prev_close", "prev_high", "prev_low")
    rows = indicators.previous_prices(t.bars(spark, sf_dir)).select(*KEY, *previous)
    return rounded(rows, 6, "prev_low")


@query
def rolling_mean_14(spark, sf_dir):
    rows = indicators.trailing_mean(t.bars(spark, sf_dir), "close", "mean_close_14")
    return rounded(rows.select(*KEY, "mean_close_14"), 6, "mean_close_14")


@query
def true_range(spark, sf_dir):
    rows = indicators.true_range(t.bars(spark, sf_dir)).select(*KEY, "tr")
    return rounded(rows, 6, "tr")


@query
def atr_14(spark, sf_dir):
    rows = indicators.average_true_range(t.bars(spark, sf_dir))
    return rounded(rows.select(*KEY, "atr_14", "atr_pct"), 6, "atr_14", "atr_pct")


@query
def directional_movement(spark, sf_dir):
    rows = indicators.directional_movement(t.bars(spark, sf_dir))
    return rounded(rows.select(*KEY, "plus_dm", "minus_dm"), 6, "plus_dm", "minus_dm")


@query
def directional_index(spark, sf_dir):
    rows = indicators.directional_index(t.bars(spark, sf_dir))
    return rounded(rows.select(*KEY, "plus_di", "minus_di"), 6, "plus_di", "minus_di")


@query
def adx_14(spark, sf_dir):
    rows = indicators.trend_indicators(t.bars(spark, sf_dir))
    return rounded(rows.select(*KEY, "dx", "adx_14"), 6, "dx", "adx_14")


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.detect_regimes(t.bars(spark, sf_dir))


@query
def regime_table(spark, sf_dir):
    return _regimes(spark, sf_dir)


@query
def regime_settled(spark, sf_dir):
    """Regimes of the bars that fourteen of their symbol lead up to."""
    return regime.detect_regimes(t.bars(spark, sf_dir), min_periods=14)


@query
def regime_confidence(spark, sf_dir):
    return _regimes(spark, sf_dir).select(*KEY, "regime", "confidence")


@query
def regime_distribution(spark, sf_dir):
    return regime.regime_distribution(_regimes(spark, sf_dir))


@query
def regime_latest20(spark, sf_dir):
    return quality.newest_first_listing(_regimes(spark, sf_dir))


@query
def adjusted_regime(spark, sf_dir):
    """Bars and events to regimes in one plan."""
    adjusted = actions.adjust_prices(*_three(spark, sf_dir), numbered=True)
    return regime.detect_regimes(regime.on_adjusted_prices(adjusted))


@query
def regime_without_symbol(spark, sf_dir):
    """Regimes where the bars of every fifth supplier have no symbol: they are a group of their own,
    here told apart in time by their supplier."""
    bars = t.bars(spark, sf_dir)
    nameless = F.pmod(F.regexp_extract("symbol", "[0-9]+", 0).cast("int"), F.lit(5)) == 0
    kept = bars.filter(~nameless)
    lost = bars.filter(nameless).groupBy("trade_date_market").agg(
        *[F.max(p).alias(p) for p in ("open", "high", "close", "volume")], F.min("low").alias("low")
    )
    columns = [*KEY, "open", "high", "low", "close", "volume"]
    both = kept.select(columns).unionByName(lost.withColumn("symbol", F.lit(None).cast("string")).select(columns))
    return regime.detect_regimes(both)


@query
def regime_restated(spark, sf_dir):
    """Regimes of bars adjusted by the splits before 2000 only, then a run since 2001 with all splits:
    as if all had been there from the start."""
    bars, splits, dividends = _three(spark, sf_dir)
    bars = stored(bars.select(*KEY, *PRICES, "volume"), "bars")
    early = splits.filter("execution_date < DATE '2000-01-01'")
    first, then = (
        regime.on_adjusted_prices(actions.adjust_prices(bars, s, dividends)) for s in (early, splits)
    )
    held = stored(regime.detect_regimes(first), "regimes")
    then = stored(then, "adjusted")
    updates = stored(regime.regime_updates(then, held, "2001-01-01"), "updates")
    days = updates.select("trade_date_market").distinct()
    return held.join(days, "trade_date_market", "left_anti").select(updates.columns).unionByName(updates)


@query
def regime_since(spark, sf_dir):
    """Regimes from 2001 on, computed from those bars and the look-back before them."""
    bars = indicators.look_back_from(t.bars(spark, sf_dir), "2001-01-01")
    return regime.detect_regimes(bars).filter(F.col("trade_date_market") >= "2001-01-01")


@query
def regime_from_state(spark, sf_dir):
    """Regimes from 2001 on, computed from those bars and the state kept of each symbol before."""
    bars, since = t.bars(spark, sf_dir), "2001-01-01"
    state = stored(carried.last_bars(bars.filter(F.col("trade_date_market") < since)), "state")
    return carried.regimes_from_state(state, bars, since)


# --- quality -------------------------------------------------------------------------------


@query
def distinct_symbols(spark, sf_dir):
    return quality.distinct_symbols(t.bars(spark, sf_dir))


@query
def layer_counts(spark, sf_dir):
    bars, splits, dividends = _three(spark, sf_dir)
    return quality.row_counts({"ohlcv": bars, "splits": splits, "dividends": dividends})


@query
def written_counts(spark, sf_dir):
    """The same counts, taken while the tables are written."""
    bars, splits, dividends = _three(spark, sf_dir)
    base = t.scratch(spark, "counted")
    counts = {
        "ohlcv": overwrite_table(bars, f"{base}/ohlcv"),
        "splits": append_new(splits, f"{base}/splits", splits.schema, ["symbol", "split_id"]),
        "dividends": append_new(dividends, f"{base}/dividends", dividends.schema, ["symbol", "dividend_id"]),
    }
    return spark.createDataFrame(list(counts.items()), "layer string, row_count bigint")


@query
def missing_days(spark, sf_dir):
    """Trading days without a bar, of all symbols."""
    return quality.missing_days(t.bars(spark, sf_dir))


def _providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers, who know the trades of one return flag each."""
    names = (*KEY, "open", "high", "low", "close", "volume")
    bars = {name: t.bars(spark, sf_dir, flag).select(*names) for name, flag in (("first", "N"), ("second", "A"), ("third", "R"))}
    return quality.by_precedence(bars)


@query
def merge_providers(spark, sf_dir):
    return rounded(quality.merge_providers(_providers(spark, sf_dir)), 6, "low")


@query
def provider_conflicts(spark, sf_dir):
    return quality.provider_conflicts(_providers(spark, sf_dir))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("E-mail"), F.col("c_nationkey").alias("Contact")
    )


@query
def dedupe_contacts(spark, sf_dir):
    contacts = _contacts(spark, sf_dir)
    return quality.drop_duplicate_keys(contacts, ["E-mail", "Contact"], keep_lowest="c_custkey")


@query
def dedupe_contact_keys(spark, sf_dir):
    unique = quality.drop_duplicate_keys(_contacts(spark, sf_dir), ["E-mail", "Contact"])
    return unique.select("E-mail", "Contact")


@query
def dedupe_actions(spark, sf_dir):
    """Splits ingested twice, the second time with the ratio doubled."""
    first = t.splits(spark, sf_dir).withColumn(
        "ingestion_timestamp", F.lit("2001-08-02 03:00:00").cast("timestamp")
    )
    second = first.withColumns(
        {
            "split_ratio": F.col("split_ratio") * 2,
            "ingestion_timestamp": F.lit("2001-08-03 03:00:00").cast("timestamp"),
        }
    )
    latest = actions.latest_events(first.unionByName(second), "split_id")
    return latest.select("symbol", "split_id", "execution_date", "split_ratio")


@query
def union_providers(spark, sf_dir):
    names = (*KEY, "high", "low", "volume", "transactions")
    united = quality.union_providers(
        t.bars(spark, sf_dir).select(*names), t.order_bars(spark, sf_dir)
    )
    return rounded(united, 6, "low")


# --- files ---------------------------------------------------------------------------------

BY_DAY = "symbol string, trade_date_market date, close double, volume double"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).select(*KEY, "close", "volume")


@query
def partition_overwrite(spark, sf_dir):
    """All days, then those of 2001 again with other volumes: the other days stay."""
    path, bars = t.scratch(spark, "partitions"), _daily(spark, sf_dir)
    overwrite_partitions(bars, path, ["trade_date_market"])
    again = bars.filter(F.year("trade_date_market") == 2001).withColumn("volume", F.col("volume") + 1)
    overwrite_partitions(again, path, ["trade_date_market"])
    return read_table(spark, path, BY_DAY)


@query
def partition_merge(spark, sf_dir):
    """All days, then those of 2001 again for some symbols with other volumes: the bars of the other
    symbols stay."""
    path, bars = t.scratch(spark, "merged"), _daily(spark, sf_dir)
    overwrite_partitions(bars, path, ["trade_date_market"])
    some = bars.filter((F.year("trade_date_market") == 2001) & (F.col("symbol") < "S5"))
    again = some.withColumn("volume", F.col("volume") + 1)
    merge_partitions(again, path, BY_DAY, KEY, ["trade_date_market"])
    return read_table(spark, path, BY_DAY)


@query
def full_overwrite(spark, sf_dir):
    """All days, then the table again from 1999: the earlier days go."""
    path, bars = t.scratch(spark, "table"), _daily(spark, sf_dir)
    overwrite_table(bars, path, ["trade_date_market"])
    overwrite_table(bars.filter(F.year("trade_date_market") >= 1999), path, ["trade_date_market"])
    return read_table(spark, path, BY_DAY)


@query
def append_once(spark, sf_dir):
    """Events to 1999, then all of them: each is there once."""
    path = t.scratch(spark, "events")
    schema = "symbol string, dividend_id string, cash_amount double, ex_dividend_date date"
    keys = ["symbol", "dividend_id", "cash_amount", "ex_dividend_date"]
    paid = t.dividends(spark, sf_dir).select(keys).distinct()
    append_new(paid.filter("year(ex_dividend_date) < 2000"), path, schema, keys, ["ex_dividend_date"])
    append_new(paid, path, schema, keys, ["ex_dividend_date"])
    return read_table(spark, path, schema)


def _append_runs(spark: SparkSession, sf_dir: str, *ratios: float) -> DataFrame:
    """The table of splits after a run for each factor of the ratios."""
    path = t.scratch(spark, "splits")
    for day, ratio in enumerate(ratios, 2):
        curated = t.splits(spark, sf_dir).withColumns(
            {
                "split_ratio": F.col("split_ratio") * ratio,
                "ingestion_timestamp": F.lit(f"2001-08-0{day} 03:00:00").cast("timestamp"),
            }
        )
        append_events(curated, "split_id", path, schemas.SPLITS, "execution_date")
    return read_table(spark, path, schemas.SPLITS)


@query
def append_events_twice(spark, sf_dir):
    """Curated splits appended by two runs."""
    return _append_runs(spark, sf_dir, 1.0, 1.0).drop("ingestion_timestamp")


@query
def append_corrections(spark, sf_dir):
    """Splits whose ratios are doubled by a second run and put back by a third."""
    latest = actions.latest_events(_append_runs(spark, sf_dir, 1.0, 2.0, 1.0), "split_id")
    return latest.drop("ingestion_timestamp")


@query
def multi_format(spark, sf_dir):
    """The same rows as Parquet by day and as ORC, read back from both."""
    base, bars = t.scratch(spark, "formats"), _daily(spark, sf_dir)
    targets = {
        "parquet": Target(f"{base}/parquet", ["trade_date_market"]),
        "orc": Target(f"{base}/orc", codec="zlib"),
    }
    write_formats(bars, targets)
    copies = [
        read_table(spark, target.path, BY_DAY, fmt=fmt).withColumn("format", F.lit(fmt))
        for fmt, target in targets.items()
    ]
    return quality.union_providers(*copies)


@query
def parquet_subset(spark, sf_dir):
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_tax double"
    path = f"{sf_dir}/lineitem.parquet"
    return read_table(spark, path, schema, ["l_orderkey", "l_linenumber", "l_quantity"])


@query
def csv_load(spark, sf_dir):
    path = t.scratch(spark, "contacts")
    _contacts(spark, sf_dir).write.option("header", True).csv(path)
    return read_csv_text(spark, path)
