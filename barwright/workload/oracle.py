"""The same results as plain SQL over the benchmark tables, written independently of Spark.

Per-symbol windows are ordinary windows here and running factors run over the whole symbol.
"""

RUN_DATE = "2001-08-02"

BARS = """
trades AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_quantity,
         20 + ceil(l_extendedprice / 100) AS price,
         l_orderkey * 8 + l_linenumber AS trade_no,
         round(l_tax * 100) AS up, round(l_discount * 100) AS down
  FROM lineitem
),
bars AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR)
           || CASE l_suppkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' ELSE '' END AS symbol,
         d AS trade_date_market,
         CAST((min(struct_pack(n := trade_no, p := price))).p AS DOUBLE) AS open,
         CAST(max(price + up) AS DOUBLE) AS high,
         CAST(min(price - down) AS DOUBLE)
           - (2 * (date_diff('day', DATE '1970-01-01', d) % 512) + 1) / 2048.0::DOUBLE AS low,
         CAST((max(struct_pack(n := trade_no, p := price))).p AS DOUBLE) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume,
         CAST(sum(price * l_quantity) / sum(l_quantity) AS DOUBLE) AS vwap,
         CAST(count(*) AS BIGINT) AS transactions
  FROM trades GROUP BY l_suppkey, d
)"""

SYMBOL = """'S' || CAST(l_suppkey AS VARCHAR)
    || CASE l_suppkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' ELSE '' END"""

EVENT_ID = """CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
    || CAST(l_partkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d')"""

SPLITS = f"""
splits AS (
  SELECT symbol, split_id, execution_date, CAST(1 AS DOUBLE) AS split_from, n AS split_to, n AS split_ratio
  FROM (
    SELECT {SYMBOL} AS symbol, 'S-' || {EVENT_ID} AS split_id,
           CAST(CAST(l_shipdate AS DATE) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DATE) AS execution_date,
           CAST(CASE WHEN l_linenumber <> 7 OR l_quantity <> 50 THEN 1
                     WHEN l_linestatus = 'O' THEN 3 ELSE 2 END AS DOUBLE) AS n
    FROM lineitem)
)"""

DIVIDENDS = f"""
dividends AS (
  SELECT {SYMBOL} AS symbol, 'D-' || {EVENT_ID} AS dividend_id,
         CASE WHEN l_tax < 0.005 THEN NULL
              WHEN l_tax >= 0.015 AND l_linenumber = 1 AND l_discount >= 0.09 THEN l_quantity * 25 / 1103
              ELSE CAST(0 AS DOUBLE) END AS cash_amount,
         'USD' AS currency,
         CAST(CAST(l_shipdate AS DATE) - 30 AS DATE) AS declaration_date,
         CAST(l_shipdate AS DATE) AS ex_dividend_date,
         CAST(CAST(l_shipdate AS DATE) + 1 AS DATE) AS record_date,
         CAST(CAST(l_shipdate AS DATE) + 14 AS DATE) AS pay_date,
         CASE WHEN l_returnflag = 'N' THEN 'SC' ELSE 'CD' END AS distribution_type,
         CAST(4 AS INTEGER) AS frequency
  FROM lineitem
)"""

SUPPLIERS = """
suppliers AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR)
    || CASE s_suppkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' ELSE '' END AS symbol
  FROM supplier
)"""

WITH_EVENTS = """
split_days AS (
  SELECT symbol, execution_date AS d, product(split_ratio) AS split_ratio FROM splits GROUP BY ALL
),
dividend_days AS (
  SELECT symbol, ex_dividend_date AS d, sum(cash_amount) AS dividend_amount
  FROM dividends WHERE cash_amount > 0 GROUP BY symbol, ex_dividend_date
),
with_events AS (
  SELECT bars.*, coalesce(s.split_ratio, 1) AS split_ratio,
         coalesce(v.dividend_amount, CAST(0 AS DOUBLE)) AS dividend_amount
  FROM bars
  LEFT JOIN split_days s ON bars.symbol = s.symbol AND bars.trade_date_market = s.d
  LEFT JOIN dividend_days v ON bars.symbol = v.symbol AND bars.trade_date_market = v.d
)"""

FACTORS = """
factors AS (
  SELECT *, exp(sum(ln(split_ratio)) OVER back) AS cumulative_split_factor,
         sum(CASE WHEN close > 0 THEN dividend_amount / close ELSE 0 END) OVER back AS dividend_adjustment
  FROM with_events
  WINDOW back AS (PARTITION BY symbol ORDER BY trade_date_market DESC)
),
adjusted AS (
  SELECT *, open * f AS adjusted_open, high * f AS adjusted_high, low * f AS adjusted_low,
         close * f AS adjusted_close, f AS adjustment_factor
  FROM (SELECT *, cumulative_split_factor * (1 + dividend_adjustment) AS f FROM factors)
)"""

RAW_PRICES = """
prices AS (SELECT symbol, trade_date_market, high, low, close FROM bars)"""
NAMELESS = """
prices AS (
  SELECT symbol, trade_date_market, high, low, close FROM bars
  WHERE CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) % 5 <> 0
  UNION ALL
  SELECT NULL, trade_date_market, max(high), min(low), max(close) FROM bars
  WHERE CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) % 5 = 0 GROUP BY trade_date_market
)"""
ADJUSTED_PRICES = """
prices AS (
  SELECT symbol, trade_date_market, adjusted_high AS high, adjusted_low AS low, adjusted_close AS close
  FROM adjusted
)"""

INDICATORS = """
lagged AS (
  SELECT *, lag(close) OVER o AS prev_close, lag(high) OVER o AS prev_high, lag(low) OVER o AS prev_low
  FROM prices WINDOW o AS (PARTITION BY symbol ORDER BY trade_date_market)
),
moves AS (
  SELECT *, high - prev_high AS up, prev_low - low AS down,
         greatest(high - low, coalesce(abs(high - prev_close), high - low),
                  coalesce(abs(low - prev_close), high - low)) AS tr
  FROM lagged
),
dm AS (
  SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus_dm,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus_dm
  FROM moves
),
smooth AS (
  SELECT *, avg(tr) OVER w AS atr_14, avg(plus_dm) OVER w AS p, avg(minus_dm) OVER w AS m
  FROM dm
  WINDOW w AS (PARTITION BY symbol ORDER BY trade_date_market ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
),
di AS (
  SELECT *, atr_14 / nullif(close, 0) * 100 AS atr_pct,
         p / nullif(atr_14, 0) * 100 AS plus_di, m / nullif(atr_14, 0) * 100 AS minus_di
  FROM smooth
),
dxs AS (
  SELECT *, CASE WHEN plus_di + minus_di > 0
                 THEN abs(plus_di - minus_di) / (plus_di + minus_di) * 100 ELSE 0 END AS dx
  FROM di
),
trend AS (
  SELECT *, avg(dx) OVER w AS adx_14 FROM dxs
  WINDOW w AS (PARTITION BY symbol ORDER BY trade_date_market ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
)"""


def _money(expression: str) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(28,10)) AS DECIMAL(10,2))"


REGIMES = f"""
regimes AS (
  SELECT symbol, trade_date_market,
         CASE WHEN adx_14 > 25 AND atr_pct < 3 THEN 'trending_stable'
              WHEN adx_14 > 25 AND atr_pct >= 3 THEN 'trending_volatile'
              WHEN adx_14 <= 25 AND atr_pct >= 3 THEN 'range_volatile'
              WHEN adx_14 <= 25 AND atr_pct < 3 THEN 'range_stable'
              ELSE 'unknown' END AS regime,
         CAST(CASE WHEN adx_14 > 30 OR adx_14 < 20 THEN 0.9
                   WHEN adx_14 > 27 OR adx_14 < 23 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
         {_money('adx_14')} AS adx, {_money('atr_14')} AS atr, {_money('atr_pct')} AS atr_percent,
         {_money('plus_di')} AS plus_di, {_money('minus_di')} AS minus_di, {_money('close')} AS close_price
  FROM trend WHERE adx_14 IS NOT NULL AND atr_14 IS NOT NULL
)"""

LANDED = f"""
landed AS (
  SELECT DISTINCT symbol, 'daily_ohlcv' AS endpoint_type FROM bars
  UNION ALL SELECT DISTINCT symbol, 'splits' FROM splits WHERE split_ratio <> 1
  UNION ALL SELECT DISTINCT symbol, 'dividends' FROM dividends WHERE cash_amount > 0
),
expected AS (
  SELECT symbol, e.endpoint_type
  FROM suppliers, (VALUES ('daily_ohlcv'), ('splits'), ('dividends')) e(endpoint_type)
)"""



def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_EVENTS = _with(BARS, SPLITS, DIVIDENDS, WITH_EVENTS)
_FACTORS = _with(BARS, SPLITS, DIVIDENDS, WITH_EVENTS, FACTORS)
_TREND = _with(BARS, RAW_PRICES, INDICATORS)
_REGIMES = _with(BARS, RAW_PRICES, INDICATORS, REGIMES)
_ADJUSTED_REGIMES = _with(
    BARS, SPLITS, DIVIDENDS, WITH_EVENTS, FACTORS, ADJUSTED_PRICES, INDICATORS, REGIMES
)
#: The bars of each return flag's trades, in order of precedence.
_PROVIDED = "WITH " + ",".join(
    BARS.replace("trades AS", f"trades_{name} AS").replace("bars AS", f"bars_{name} AS").replace("FROM lineitem", f"FROM lineitem WHERE l_returnflag = '{flag}'").replace("FROM trades ", f"FROM trades_{name} ")
    for name, flag in (("first", "N"), ("second", "A"), ("third", "R"))
) + """, provided AS (
  SELECT *, 'first' AS provider, 0 AS rank FROM bars_first
  UNION ALL SELECT *, 'second', 1 FROM bars_second
  UNION ALL SELECT *, 'third', 2 FROM bars_third
)
"""
_LANDED = _with(BARS, SPLITS, DIVIDENDS, SUPPLIERS, LANDED)
_KEY = "symbol, trade_date_market"


def _digits(number: str, base: int, most: int) -> str:
    """Digits of a number by position, most significant first, leading zeros dropped."""
    alphabet = (
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+,-./:;<=>?@[]^_{|}~"
    )
    return f"""(SELECT string_agg(substr('{alphabet}',
        CAST(({number}) // CAST(pow({base}, i) AS BIGINT) % {base} AS INTEGER) + 1, 1), '' ORDER BY i DESC)
      FROM range({most}) r(i) WHERE i = 0 OR CAST(pow({base}, i) AS BIGINT) <= {number})"""


_TEXT = """CASE event_type WHEN 'error' THEN 'n/a'
      WHEN 'click' THEN CAST(user_id AS VARCHAR) || '.75' ELSE CAST(user_id AS VARCHAR) END"""
_MS = "epoch_ms(ts)"

_CURATED_BARS = _with(BARS) + f"""
    SELECT symbol, CASE WHEN ms IS NOT NULL THEN CAST(timezone(CASE WHEN symbol LIKE '%.NS' OR symbol LIKE '%.BO' THEN 'Asia/Kolkata' ELSE 'US/Eastern' END,
            timezone('UTC', make_timestamp(ms * 1000))) AS DATE) END AS trade_date_market,
        CASE WHEN ms IS NOT NULL THEN CAST(make_timestamp(ms * 1000) AS DATE) END AS trade_date_utc,
        open, high, round(low, 6) AS low, close, volume, round(vwap, 6) AS vwap,
        CAST(transactions AS INTEGER) AS transactions,
        coalesce(ms, 1000000000000000000) AS raw_timestamp_ms, 'polygon' AS provider
    FROM (SELECT *, CASE WHEN n % 7 <> 0 THEN (n * 24 + 2 + 7 * (n % 4)) * 3600000 END AS ms
        FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', trade_date_market) AS BIGINT) AS n FROM bars))"""

_STOCKS = _with(BARS) + f"""SELECT symbol, open, high, round(low, 8) AS low, close, CAST(volume AS BIGINT) AS volume,
        trade_date_market AS record_date, DATE '{RUN_DATE}' AS date, round((close - open) / nullif(open, 0), 8) AS return_pct
        FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date_market DESC) = 1"""

ORACLE = {
    "bars_daily": _with(BARS)
    + f"SELECT {_KEY}, open, high, round(low, 6) AS low, close, volume, round(vwap, 6) AS vwap, transactions FROM bars",
    "market_date": """SELECT event_id, CAST(timezone(
        CASE user_id % 4 WHEN 0 THEN 'Asia/Kolkata' ELSE 'US/Eastern' END,
        timezone('UTC', ts)) AS DATE) AS trade_date_market FROM events""",
    "utc_date": f"""SELECT event_id, CAST(ts AS DATE) AS trade_date_utc,
        CAST(DATE '1970-01-01' + CAST(floor(-{_MS} / 86400000.0) AS INTEGER) AS DATE) AS mirrored_date_utc
        FROM events""",
    "market_zone": _with(BARS)
    + """SELECT DISTINCT symbol, CASE WHEN symbol LIKE '%.NS' OR symbol LIKE '%.BO'
        THEN 'Asia/Kolkata' ELSE 'US/Eastern' END AS market_timezone FROM bars""",
    "parse_dates": """SELECT o_orderkey,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS loose_date,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS strict_date FROM orders""",
    "number_casts": f"""SELECT event_id, TRY_CAST({_TEXT} AS DOUBLE) AS as_double,
        CAST(trunc(TRY_CAST({_TEXT} AS DOUBLE)) AS BIGINT) AS as_long,
        CAST(trunc(TRY_CAST({_TEXT} AS DOUBLE)) AS INTEGER) AS as_int FROM events""",
    "money_cast": """SELECT l_orderkey, l_linenumber,
        CAST(CAST(p AS DECIMAL(28,10)) AS DECIMAL(10,2)) AS price,
        CASE WHEN round(p * 1000, 2) < 1e8
             THEN TRY_CAST(CAST(p * 1000 AS DECIMAL(28,10)) AS DECIMAL(10,2)) END AS price_times_1000
        FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice * l_quantity / 7) AS p
              FROM lineitem GROUP BY ALL)""",
    "split_ratio": """SELECT round(l_discount * 100) AS split_from, l_quantity AS split_to,
        round(l_quantity / nullif(round(l_discount * 100), 0), 8) AS split_ratio FROM lineitem""",
    "return_pct": _with(BARS)
    + f"SELECT {_KEY}, round((close - open) / nullif(open, 0), 8) AS return_pct FROM bars",
    "short_key": f"""SELECT o_orderkey, {_digits('o_orderkey * 1000003', 84, 9)} AS key_84,
        {_digits('o_orderkey * 1000003', 16, 15)} AS key_16 FROM orders""",
    "curate_ohlcv": _CURATED_BARS,
    "curate_documents": _CURATED_BARS,
    "curate_splits": _with(SPLITS)
    + "SELECT symbol, split_id, execution_date, split_from, split_to, split_to / split_from AS split_ratio FROM splits",
    "curate_dividends": _with(DIVIDENDS) + "SELECT * FROM dividends",
    "landing_envelope": _with(SPLITS, SUPPLIERS)
    + f"""SELECT u.symbol, 'polygon' AS source, 'splits' AS endpoint_type, '{RUN_DATE}' AS execution_date,
        CASE WHEN u.symbol LIKE '%.NS' OR u.symbol LIKE '%.BO' THEN 'Asia/Kolkata' ELSE 'US/Eastern' END AS market_timezone,
        n_results, first_id
        FROM (SELECT symbol, CAST(1 AS BIGINT) AS n_results, split_id AS first_id FROM splits
              UNION ALL
              SELECT symbol, CAST(0 AS BIGINT), NULL FROM suppliers
              WHERE symbol NOT IN (SELECT symbol FROM splits)) u""",
    "landing_quarantine": _with(BARS)
    + """SELECT CASE WHEN volume <> 50 THEN symbol END AS symbol, CAST(count(*) AS BIGINT) AS n_documents
        FROM bars GROUP BY 1""",
    "landing_gaps": _LANDED
    + f"""SELECT symbol, endpoint_type, '{RUN_DATE}' AS execution_date FROM expected
        EXCEPT SELECT symbol, endpoint_type, '{RUN_DATE}' FROM landed""",
    "landing_summary": _LANDED
    + f"""SELECT symbol, '{RUN_DATE}' AS execution_date,
        CAST(sum(ok) AS BIGINT) AS n_landed, CAST(sum(1 - ok) AS BIGINT) AS n_failed,
        coalesce(string_agg(CASE WHEN ok = 0 THEN endpoint_type END, ',' ORDER BY endpoint_type), '') AS failed_endpoints,
        sum(1 - ok) = 0 AS succeeded
        FROM (SELECT e.*, CASE WHEN l.symbol IS NULL THEN 0 ELSE 1 END AS ok
              FROM expected e LEFT JOIN landed l USING (symbol, endpoint_type)) s
        GROUP BY symbol""",
    "new_landings_only": _with(BARS)
    + """SELECT symbol, 'daily_ohlcv' AS endpoint_type, CAST(trade_date_market AS VARCHAR) AS execution_date, close
        FROM bars WHERE trade_date_market >= DATE '1999-01-01'""",
    "stock_document_rows": _STOCKS,
    "curate_stock_documents": _STOCKS,
    "latest_per_symbol": _with(BARS)
    + f"""SELECT {_KEY}, open, high, round(low, 6) AS low, close, volume, round(vwap, 6) AS vwap, transactions
        FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date_market DESC) = 1""",
    "positive_dividends": _with(DIVIDENDS)
    + """SELECT symbol, dividend_id, ex_dividend_date, cash_amount FROM dividends
        WHERE cash_amount IS NOT NULL AND cash_amount > 0""",
    "split_join": _EVENTS + f"SELECT {_KEY}, close, split_ratio FROM with_events",
    "dividend_join": _EVENTS + f"SELECT {_KEY}, close, dividend_amount FROM with_events",
    "unmatched_events": _EVENTS
    + """SELECT e.* FROM (
          SELECT symbol, split_id AS event_id, execution_date AS event_date FROM splits
          UNION ALL SELECT symbol, dividend_id, ex_dividend_date FROM dividends) e
        WHERE NOT EXISTS (SELECT 1 FROM bars b
                          WHERE b.symbol = e.symbol AND b.trade_date_market = e.event_date)""",
    "cumulative_split": _FACTORS
    + f"SELECT {_KEY}, round(cumulative_split_factor, 6) AS cumulative_split_factor FROM factors",
    "cumulative_dividend": _FACTORS
    + f"SELECT {_KEY}, round(dividend_adjustment, 8) AS dividend_adjustment FROM factors",
    "adjustment_factor": _FACTORS
    + f"SELECT {_KEY}, round(adjustment_factor, 6) AS adjustment_factor FROM adjusted",
    "adjusted_ohlc": _FACTORS
    + f"""SELECT {_KEY}, open, high, round(low, 4) AS low, close,
        round(adjusted_open, 4) AS adjusted_open, round(adjusted_high, 4) AS adjusted_high,
        round(adjusted_low, 4) AS adjusted_low, round(adjusted_close, 4) AS adjusted_close,
        volume, round(adjustment_factor, 4) AS adjustment_factor FROM adjusted""",
    "adjusted_back": _EVENTS
    + f"""SELECT {_KEY}, close, round(close * f, 4) AS adjusted_close, round(f, 4) AS adjustment_factor
        FROM (SELECT *, exp(coalesce(sum(term) OVER (PARTITION BY symbol ORDER BY trade_date_market DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f
              FROM (SELECT *, CASE WHEN before > 0 AND dividend_amount < before THEN ln(1 - dividend_amount / before) ELSE 0 END
                        - ln(split_ratio) AS term
                    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date_market) AS before FROM with_events)))""",
    "factor_steps": _FACTORS
    + """SELECT symbol, trade_date_market AS day, round(cumulative_split_factor, 6) AS split_factor,
        round(dividend_adjustment, 8) AS dividend_adjustment
        FROM factors WHERE split_ratio <> 1 OR dividend_amount > 0""",
    "adjusted_changes": _FACTORS
    + f"""SELECT {_KEY}, round(adjusted_close, 4) AS adjusted_close, round(adjustment_factor, 4) AS adjustment_factor
        FROM adjusted""",
    "adjusted_latest20": _FACTORS
    + f"""SELECT {_KEY}, close, round(adjusted_close, 4) AS adjusted_close,
        round(adjustment_factor, 4) AS adjustment_factor
        FROM adjusted ORDER BY symbol, trade_date_market DESC LIMIT 20""",
    "optional_source": _with(BARS)
    + f"SELECT {_KEY}, close, close AS adjusted_close, CAST(1 AS DOUBLE) AS adjustment_factor FROM bars",
    "lag_prices": _TREND
    + f"SELECT {_KEY}, prev_close, prev_high, round(prev_low, 6) AS prev_low FROM lagged",
    "rolling_mean_14": _with(BARS)
    + f"""SELECT {_KEY}, round(avg(close) OVER (PARTITION BY symbol ORDER BY trade_date_market
        ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS mean_close_14 FROM bars""",
    "true_range": _TREND + f"SELECT {_KEY}, round(tr, 6) AS tr FROM moves",
    "atr_14": _TREND
    + f"SELECT {_KEY}, round(atr_14, 6) AS atr_14, round(atr_pct, 6) AS atr_pct FROM di",
    "directional_movement": _TREND
    + f"SELECT {_KEY}, round(plus_dm, 6) AS plus_dm, round(minus_dm, 6) AS minus_dm FROM dm",
    "directional_index": _TREND
    + f"SELECT {_KEY}, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di FROM di",
    "adx_14": _TREND + f"SELECT {_KEY}, round(dx, 6) AS dx, round(adx_14, 6) AS adx_14 FROM trend",
    "regime_table": _REGIMES + "SELECT * FROM regimes",
    "regime_settled": _REGIMES
    + f"""SELECT * FROM regimes SEMI JOIN (
          SELECT {_KEY} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date_market) >= 14) b
        USING ({_KEY})""",
    "regime_confidence": _REGIMES + f"SELECT {_KEY}, regime, confidence FROM regimes",
    "regime_distribution": _REGIMES
    + f"""SELECT regime, CAST(count(*) AS BIGINT) AS count, {_money('avg(confidence)')} AS avg_confidence,
        {_money('avg(adx)')} AS avg_adx, {_money('avg(atr_percent)')} AS avg_atr_pct
        FROM regimes GROUP BY regime ORDER BY count DESC""",
    "regime_latest20": _REGIMES
    + "SELECT * FROM regimes ORDER BY symbol, trade_date_market DESC LIMIT 20",
    "regime_since": _REGIMES
    + "SELECT * FROM regimes WHERE trade_date_market >= DATE '2001-01-01'",
    "regime_from_state": _REGIMES
    + "SELECT * FROM regimes WHERE trade_date_market >= DATE '2001-01-01'",
    "adjusted_regime": _ADJUSTED_REGIMES + "SELECT * FROM regimes",
    "regime_restated": _ADJUSTED_REGIMES + "SELECT * FROM regimes",
    "regime_without_symbol": _with(BARS, NAMELESS, INDICATORS, REGIMES) + "SELECT * FROM regimes",
    "distinct_symbols": _with(BARS) + "SELECT DISTINCT symbol FROM bars",
    "layer_counts": _with(BARS, SPLITS, DIVIDENDS)
    + """SELECT 'ohlcv' AS layer, CAST(count(*) AS BIGINT) AS row_count FROM bars
        UNION ALL SELECT 'splits', count(*) FROM splits
        UNION ALL SELECT 'dividends', count(*) FROM dividends""",
    "written_counts": _with(BARS, SPLITS, DIVIDENDS)
    + """SELECT 'ohlcv' AS layer, CAST(count(*) AS BIGINT) AS row_count FROM bars
        UNION ALL SELECT 'splits', count(*) FROM splits
        UNION ALL SELECT 'dividends', count(*) FROM dividends""",
    "missing_days": _with(BARS)
    + """, calendar AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT trade_date_market AS d FROM bars)),
        firsts AS (SELECT symbol, min(trade_date_market) AS first FROM bars GROUP BY symbol),
        missing AS (
          SELECT f.symbol, c.d, c.n FROM firsts f JOIN calendar c ON c.d > f.first
          ANTI JOIN bars b ON b.symbol = f.symbol AND b.trade_date_market = c.d),
        islands AS (SELECT *, n - row_number() OVER (PARTITION BY symbol ORDER BY n) AS island FROM missing)
        SELECT symbol, min(d) AS first_day, max(d) AS last_day, CAST(count(*) AS INTEGER) AS n_days
        FROM islands GROUP BY symbol, island""",
    "merge_providers": _PROVIDED
    + f"""SELECT {_KEY}, open, high, round(low, 6) AS low, close, volume, provider FROM provided
        QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY rank) = 1""",
    "provider_conflicts": _PROVIDED
    + f"""SELECT {_KEY}, CAST(count(*) AS BIGINT) AS n_providers, arg_min(provider, rank) AS taken,
        min(close) AS least_close, max(close) AS largest_close
        FROM provided GROUP BY {_KEY} HAVING count(*) > 1 AND min(close) < max(close)""",
    "dedupe_contacts": """SELECT min(c_custkey) AS c_custkey, c_mktsegment AS "E-mail", c_nationkey AS "Contact"
        FROM customer GROUP BY c_mktsegment, c_nationkey""",
    "dedupe_contact_keys": """SELECT DISTINCT c_mktsegment AS "E-mail", c_nationkey AS "Contact" FROM customer""",
    "dedupe_actions": _with(SPLITS)
    + """SELECT symbol, split_id, max(execution_date) AS execution_date, 2 * max(split_ratio) AS split_ratio
        FROM splits GROUP BY symbol, split_id""",
    "union_providers": _with(BARS)
    + """SELECT symbol, trade_date_market, high, round(low, 6) AS low, volume, transactions FROM bars
        UNION ALL
        SELECT o_orderpriority, CAST(o_orderdate AS DATE), max(ceil(o_totalprice / 1000)),
               min(ceil(o_totalprice / 1000)), NULL, count(*)
        FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "partition_overwrite": _with(BARS)
    + f"""SELECT {_KEY}, close, volume + CASE WHEN year(trade_date_market) = 2001 THEN 1 ELSE 0 END AS volume
        FROM bars""",
    "partition_merge": _with(BARS)
    + f"""SELECT {_KEY}, close,
        volume + CASE WHEN year(trade_date_market) = 2001 AND symbol < 'S5' THEN 1 ELSE 0 END AS volume FROM bars""",
    "full_overwrite": _with(BARS)
    + f"SELECT {_KEY}, close, volume FROM bars WHERE year(trade_date_market) >= 1999",
    "append_once": _with(DIVIDENDS)
    + "SELECT DISTINCT symbol, dividend_id, cash_amount, ex_dividend_date FROM dividends",
    "append_events_twice": _with(SPLITS)
    + "SELECT symbol, split_id, execution_date, split_from, split_to, split_ratio FROM splits",
    "append_corrections": _with(SPLITS)
    + "SELECT symbol, split_id, execution_date, split_from, split_to, split_ratio FROM splits",
    "multi_format": _with(BARS)
    + f"""SELECT {_KEY}, close, volume, f.format FROM bars, (VALUES ('parquet'), ('orc')) f(format)""",
    "parquet_subset": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "csv_load": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment AS "E-mail",
        CAST(c_nationkey AS VARCHAR) AS "Contact" FROM customer""",
}
