"""Explicit schemas of every table the jobs read or write.

Nothing is inferred on read: an empty ``results`` array, a day on which every price happens
to be a whole number, or a partition value such as ``0700`` keeps its declared type.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STRING, DOUBLE, LONG, INT, BOOLEAN = StringType(), DoubleType(), LongType(), IntegerType(), BooleanType()
DATE, TIMESTAMP, MONEY = DateType(), TimestampType(), DecimalType(10, 2)


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def landing_schema(result: StructType) -> StructType:
    """The landing envelope around one endpoint's result rows."""
    return _struct(
        symbol=STRING,
        source=STRING,
        endpoint_type=STRING,
        ingestion_timestamp=STRING,
        execution_date=STRING,
        market_timezone=STRING,
        payload=_struct(results=ArrayType(result)),
    )


# Numbers arrive as 12 or 12.0 depending on the day, so all of them are parsed as double
# and narrowed by the curation step.
OHLCV_RESULT = _struct(t=DOUBLE, o=DOUBLE, h=DOUBLE, l=DOUBLE, c=DOUBLE, v=DOUBLE, vw=DOUBLE, n=DOUBLE)
SPLIT_RESULT = _struct(id=STRING, execution_date=STRING, split_from=DOUBLE, split_to=DOUBLE)
DIVIDEND_RESULT = _struct(
    id=STRING,
    cash_amount=DOUBLE,
    currency=STRING,
    declaration_date=STRING,
    ex_dividend_date=STRING,
    record_date=STRING,
    pay_date=STRING,
    dividend_type=STRING,
    frequency=DOUBLE,
)

# Endpoint names as they appear in landing paths and envelopes.
ENDPOINT_RESULTS = {
    "daily_ohlcv": OHLCV_RESULT,
    "splits": SPLIT_RESULT,
    "dividends": DIVIDEND_RESULT,
}
ENDPOINTS = tuple(ENDPOINT_RESULTS)
# Fixed value: the provider name stored in envelopes and bars.
PROVIDER = "polygon"

OHLCV = _struct(
    symbol=STRING,
    trade_date_market=DATE,
    trade_date_utc=DATE,
    open=DOUBLE,
    high=DOUBLE,
    low=DOUBLE,
    close=DOUBLE,
    volume=DOUBLE,
    vwap=DOUBLE,
    transactions=INT,
    raw_timestamp_ms=LONG,
    provider=STRING,
)
SPLITS = _struct(
    symbol=STRING,
    split_id=STRING,
    execution_date=DATE,
    split_from=DOUBLE,
    split_to=DOUBLE,
    split_ratio=DOUBLE,
    ingestion_timestamp=TIMESTAMP,
)
DIVIDENDS = _struct(
    symbol=STRING,
    dividend_id=STRING,
    cash_amount=DOUBLE,
    currency=STRING,
    declaration_date=DATE,
    ex_dividend_date=DATE,
    record_date=DATE,
    pay_date=DATE,
    distribution_type=STRING,
    frequency=INT,
    ingestion_timestamp=TIMESTAMP,
)
OHLCV_ADJUSTED = _struct(
    symbol=STRING,
    trade_date_market=DATE,
    open=DOUBLE,
    high=DOUBLE,
    low=DOUBLE,
    close=DOUBLE,
    adjusted_open=DOUBLE,
    adjusted_high=DOUBLE,
    adjusted_low=DOUBLE,
    adjusted_close=DOUBLE,
    volume=DOUBLE,
    adjustment_factor=DOUBLE,
)
#: The steps of the adjustment factors that the adjusted bars were made with.
FACTOR_STEPS = _struct(symbol=STRING, day=DATE, split=DOUBLE, paid=DOUBLE)
#: The last adjusted bars of each symbol.
REGIME_STATE = _struct(
    symbol=STRING,
    trade_date_market=DATE,
    high=DOUBLE,
    low=DOUBLE,
    close=DOUBLE,
    has_older=BOOLEAN,
)
REGIME = _struct(
    symbol=STRING,
    trade_date_market=DATE,
    regime=STRING,
    confidence=DOUBLE,
    adx=MONEY,
    atr=MONEY,
    atr_percent=MONEY,
    plus_di=MONEY,
    minus_di=MONEY,
    close_price=MONEY,
)
STOCKS = _struct(
    symbol=STRING,
    open=DOUBLE,
    high=DOUBLE,
    low=DOUBLE,
    close=DOUBLE,
    volume=LONG,
    record_date=DATE,
    date=DATE,
    return_pct=DOUBLE,
)

#: Field of a stock document for the day of its record, where the run that fetched it noted one.
STOCK_RECORD_DATE = "record_date"

# Field names of the symbol-keyed stock document, with the column each becomes.
STOCK_FIELDS = {
    "1. open": "open",
    "2. high": "high",
    "3. low": "low",
    "4. close": "close",
    "5. volume": "volume",
}
STOCK_DOCUMENT = MapType(
    STRING, StructType([StructField(name, STRING) for name in (*STOCK_FIELDS, STOCK_RECORD_DATE)])
)
