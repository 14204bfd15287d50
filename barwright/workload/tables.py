"""Market tables derived from the benchmark tables; they grow with them.

A supplier is a symbol and a shipping day a trading day; line items are the day's trades. Trade
prices are whole numbers and lows carry an odd multiple of 1/2048, so sums are exact in any
order and moves up and down never tie; dividends are fractions over a prime above any price, so that
adjusted prices do not end on a rounding boundary. Results then do not hang on the order of
summation.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.scratch import fresh_folder

DAY = "trade_date_market"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share, removed when the session ends."""
    return fresh_folder(spark, name)


# Supplier key with an exchange suffix: none, ``.NS`` or ``.BO``.
SYMBOL = """concat('S', l_suppkey,
    CASE l_suppkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' ELSE '' END) AS symbol"""


def bars(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """Daily bars per supplier: one row per symbol and day. With ``flag``, of the trades a provider
    knows, those of that return flag."""
    items = table(spark, sf_dir, "lineitem")
    trades = (items if flag is None else items.filter(F.col("l_returnflag") == flag)).selectExpr(
        "l_suppkey",
        "CAST(l_shipdate AS DATE) AS trade_date_market",
        "l_quantity AS quantity",
        "20 + ceil(l_extendedprice / 100) AS price",
        "l_orderkey * 8 + l_linenumber AS trade_no",
        "floor(l_tax * 100 + 0.5D) AS up",
        "floor(l_discount * 100 + 0.5D) AS down",
    )
    daily = trades.groupBy("l_suppkey", DAY).agg(
        F.expr("min_by(price, trade_no) AS open"),
        F.expr("max(price + up) AS high"),
        F.expr("min(price - down) AS bottom"),
        F.expr("max_by(price, trade_no) AS close"),
        F.expr("sum(quantity) AS volume"),
        F.expr("sum(price * quantity) / sum(quantity) AS vwap"),
        F.expr("count(*) AS transactions"),
    )
    return daily.selectExpr(
        SYMBOL,
        DAY,
        "CAST(open AS DOUBLE) AS open",
        "CAST(high AS DOUBLE) AS high",
        "bottom - (2 * (unix_date(trade_date_market) % 512) + 1) / 2048D AS low",
        "CAST(close AS DOUBLE) AS close",
        "volume",
        "vwap",
        "transactions",
    )


#: What tells two line items apart, after a letter.
EVENT_ID = "l_orderkey, '-', l_linenumber, '-', l_partkey, '-', date_format(CAST(l_shipdate AS DATE), 'yyyyMMdd')"


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a split, most of them one for one; seventh items of fifty units change the
    price. Returned ones are a day late, mostly without a bar."""
    items = table(spark, sf_dir, "lineitem").withColumn(
        "new", F.expr("CASE WHEN l_linenumber = 7 AND l_quantity = 50 THEN IF(l_linestatus = 'O', 3D, 2D) ELSE 1D END")
    )
    return items.selectExpr(
        SYMBOL,
        f"concat('S-', {EVENT_ID}) AS split_id",
        "date_add(CAST(l_shipdate AS DATE), IF(l_returnflag = 'R', 1, 0)) AS execution_date",
        "1D AS split_from",
        "new AS split_to",
        "new AS split_ratio",
    )


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a dividend; only first items at a high discount pay, and the others have no
    amount or zero."""
    items = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return items.selectExpr(
        SYMBOL,
        f"concat('D-', {EVENT_ID}) AS dividend_id",
        """CASE WHEN l_tax < 0.005D THEN NULL WHEN l_tax < 0.015D OR l_linenumber <> 1 OR l_discount < 0.09D THEN 0D
           ELSE l_quantity * 25 / 1103 END AS cash_amount""",
        "'USD' AS currency",
        "date_sub(day, 30) AS declaration_date",
        "day AS ex_dividend_date",
        "date_add(day, 1) AS record_date",
        "date_add(day, 14) AS pay_date",
        "IF(l_returnflag = 'N', 'SC', 'CD') AS distribution_type",
        "4 AS frequency",
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second provider's bars: order totals per priority and day, without volume detail."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS symbol",
        "CAST(o_orderdate AS DATE) AS trade_date_market",
        "CAST(ceil(o_totalprice / 1000) AS DOUBLE) AS price",
    )
    return orders.groupBy("symbol", DAY).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("transactions")
    )


def open_of_day_ms(day: str = DAY) -> Column:
    """Epoch milliseconds at 02:00, 09:00, 16:00 and 23:00 UTC in turn: early hours are the day
    before in the US, late ones the day after in India. Every seventh day is out of range."""
    number = F.unix_date(day).cast("bigint")
    ms = (number * 24 + 2 + 7 * (number % 4)) * 3_600_000
    return F.when(number % 7 == 0, 1e18).otherwise(ms.cast("double"))
