"""Landed documents to typed tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.columns import return_pct, split_ratio, to_double, to_whole
from barwright.functions.dates import market_date, parse_date, utc_date
from barwright.schemas import PROVIDER, STOCK_FIELDS, STOCK_RECORD_DATE


def explode_results(landing: DataFrame) -> DataFrame:
    """One row per element of ``payload.results``; an empty or missing array gives none."""
    return landing.select("symbol", "market_timezone", F.explode("payload.results").alias("r"))


def curate_ohlcv(landing: DataFrame, provider: str = PROVIDER) -> DataFrame:
    """Bars with market and UTC dates."""
    return explode_results(landing).select(
        "symbol",
        market_date("r.t", "market_timezone").alias("trade_date_market"),
        utc_date("r.t").alias("trade_date_utc"),
        F.col("r.o").alias("open"),
        F.col("r.h").alias("high"),
        F.col("r.l").alias("low"),
        F.col("r.c").alias("close"),
        F.col("r.v").alias("volume"),
        F.col("r.vw").alias("vwap"),
        F.col("r.n").try_cast("int").alias("transactions"),
        F.col("r.t").try_cast("bigint").alias("raw_timestamp_ms"),
        F.lit(provider).alias("provider"),
    )


def _stamp(ingested_at: Column | None) -> Column:
    return F.current_timestamp() if ingested_at is None else ingested_at


def curate_splits(landing: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Splits with their ratio."""
    return explode_results(landing).select(
        "symbol",
        F.col("r.id").alias("split_id"),
        parse_date("r.execution_date").alias("execution_date"),
        to_double("r.split_from").alias("split_from"),
        to_double("r.split_to").alias("split_to"),
        split_ratio("r.split_from", "r.split_to").alias("split_ratio"),
        _stamp(ingested_at).alias("ingestion_timestamp"),
    )


def curate_dividends(landing: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Dividends with their four dates."""
    dates = ("declaration_date", "ex_dividend_date", "record_date", "pay_date")
    return explode_results(landing).select(
        "symbol",
        F.col("r.id").alias("dividend_id"),
        to_double("r.cash_amount").alias("cash_amount"),
        F.col("r.currency").alias("currency"),
        *[parse_date(f"r.{name}").alias(name) for name in dates],
        F.col("r.dividend_type").alias("distribution_type"),
        F.col("r.frequency").try_cast("int").alias("frequency"),
        _stamp(ingested_at).alias("ingestion_timestamp"),
    )


def stock_rows(documents: DataFrame, run_date: str) -> DataFrame:
    """Symbol-keyed documents to one row per symbol, numbers parsed, with the run date and the date
    of the record, NULL where the document has none."""
    entries = documents.select(F.explode("stocks").alias("symbol", "s"))
    columns = []
    for field, name in STOCK_FIELDS.items():
        text = F.col("s").getField(field)
        columns.append((to_whole(text) if name == "volume" else to_double(text)).alias(name))
    record_date = parse_date(F.col("s").getField(STOCK_RECORD_DATE)).alias("record_date")
    return entries.select("symbol", *columns, record_date, F.lit(run_date).alias("date"))


def enrich_stocks(rows: DataFrame) -> DataFrame:
    """Add the day's return and type the date."""
    return rows.withColumns(
        {"return_pct": return_pct("open", "close"), "date": parse_date("date", "yyyy-MM-dd")}
    )


def curate_stocks(documents: DataFrame, run_date: str) -> DataFrame:
    return enrich_stocks(stock_rows(documents, run_date))
