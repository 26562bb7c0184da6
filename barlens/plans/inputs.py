"""Inputs the registered queries share, in Spark and as SQL subqueries.

The calendars, intervals, actions and folds are small fixed tables spelled the
same way on both sides; everything they are joined with comes from the driver
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.plans.registry import cte
from barlens.schema import SessionSpec
from barlens.sources import market

DAY_4H = SessionSpec(0, 1440, "UTC", 240, 2)
DAY_1H = SessionSpec(0, 1440, "UTC", 60, 2)
MARKET = SessionSpec()

CALENDAR = """
SELECT CAST(date '2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS DATE) AS session_date,
       CASE WHEN id IN (14, 25) THEN 720 ELSE 1440 END AS minutes, id IN (14, 25) AS early_close
FROM range(1, 30)
"""
cte(
    "c_calendar",
    """SELECT CAST(DATE '2024-01-01' + CAST(range AS INTEGER) AS DATE) AS session_date,
       CASE WHEN range IN (14, 25) THEN 720 ELSE 1440 END AS minutes, range IN (14, 25) AS early_close
FROM range(1, 30)""",
)


def calendar(spark: SparkSession) -> DataFrame:
    """Intraday calendar: Jan 2-30 2024, two early closes, Jan 1 closed."""
    return spark.sql(CALENDAR)


def weekdays(spark: SparkSession) -> DataFrame:
    """Daily calendar: the weekdays of 1995-2001."""
    return spark.sql(
        "SELECT d AS session_date FROM (SELECT explode(sequence(date '1995-01-02', date '2001-12-31')) AS d) "
        "WHERE weekday(d) < 5"
    )


cte(
    "c_weekdays",
    """SELECT CAST(range AS DATE) AS session_date FROM range(DATE '1995-01-02', DATE '2002-01-01', INTERVAL 1 DAY)
WHERE isodow(range) < 6""",
)

cte(
    "c_ticks",
    """SELECT event_type AS instrument_id, ts, event_id AS seq, value AS price,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS size FROM events""",
)


def bars_cte(name: str, minutes: int) -> None:
    cte(
        name,
        f"""SELECT instrument_id, upper(instrument_id) AS symbol, CAST(ts AS DATE) AS session_date,
       CAST((hour(ts) * 60 + minute(ts)) // {minutes} * {minutes} AS INTEGER) AS minute,
       first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, seq) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count,
       CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE avg(price) END AS vwap
FROM c_ticks WHERE price > 0 GROUP BY ALL""",
    )


bars_cte("c_min", 1)
bars_cte("c_hour", 60)

TOKEN_SQL = """SELECT instrument_id, session_date, token,
       arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close,
       CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
       sum(vwap * volume) AS dollar_volume, {vwap} AS vwap,
       sqrt(coalesce(sum(sq), 0)) AS realized_volatility, count(*) AS observed,
       (token + 1) * {width} AS token_end_minute
FROM (SELECT *, power(ln(close) - lag(ln(close)) OVER (PARTITION BY instrument_id, session_date, token ORDER BY minute), 2) AS sq
      FROM (SELECT *, minute // {width} AS token FROM c_min))
GROUP BY instrument_id, session_date, token {having}"""
KEPT = "HAVING count(*) >= 2 AND sum(volume) > 0"
cte("c_tok", TOKEN_SQL.format(vwap="sum(vwap * volume) / nullif(sum(volume), 0)", width=240, having=KEPT))
cte("c_tok60", TOKEN_SQL.format(vwap="sum(vwap * volume) / nullif(sum(volume), 0)", width=60, having=KEPT))
cte("c_tok_exact", TOKEN_SQL.format(vwap="sum(vwap * volume) / greatest(sum(volume), 1)", width=240, having=""))

ORDER_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
cte(
    "c_daily",
    f"""SELECT p_brand AS instrument_id, upper(replace(p_brand, '#', '.')) AS symbol, CAST(l_shipdate AS DATE) AS session_date,
       first(l_extendedprice / l_quantity ORDER BY {ORDER_KEY}) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       last(l_extendedprice / l_quantity ORDER BY {ORDER_KEY}) AS close,
       CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS volume, count(*) AS trade_count,
       sum(l_extendedprice / l_quantity * CAST(l_quantity AS INTEGER)) / sum(CAST(l_quantity AS INTEGER)) AS vwap
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
cte(
    "c_orders",
    """SELECT o_orderkey AS order_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS instrument_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
       CAST(greatest(floor(o_totalprice / 1000), 1) AS BIGINT) AS quantity,
       CAST(DATE '2024-01-01' + CAST((o_orderkey // 5) % 30 AS INTEGER) AS DATE) AS session_date,
       CAST(240 * (o_orderkey % 3) AS INTEGER) AS start_minute,
       CAST(240 * (o_orderkey % 3) + 480 + 60 * (o_orderkey % 7) AS INTEGER) AS end_minute FROM orders""",
)

# raw provider rows: one bar per tick at its minute, each re-sent later with a corrected price
cte(
    "c_raw",
    """SELECT instrument_id AS symbol, date_trunc('minute', ts) AS ts, price + corr AS open, price + corr AS high,
       price + corr AS low, price + corr AS close, CAST(size AS BIGINT) AS volume, CAST(1 AS BIGINT) AS trade_count,
       price + corr AS vwap, seq + 1000000000000 * corr AS seq
FROM c_ticks, (VALUES (0), (1)) v(corr)""",
)


def raw_bars(spark: SparkSession, root: str) -> DataFrame:
    """Provider rows with duplicates: every tick arrives twice, the second one corrected."""
    t = market.ticks(spark, root, positive=False).withColumn("corr", F.explode(F.array(F.lit(0), F.lit(1))))
    px = F.col("price") + F.col("corr")
    return t.select(
        F.col("instrument_id").alias("symbol"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
        px.alias("open"), px.alias("high"), px.alias("low"), px.alias("close"),
        F.col("size").cast("bigint").alias("volume"),
        F.lit(1).cast("bigint").alias("trade_count"),
        px.alias("vwap"),
        (F.col("seq") + F.lit(1000000000000) * F.col("corr")).alias("seq"),
    )


def bars(spark: SparkSession, root: str) -> DataFrame:
    return market.intraday_bars(spark, root, 1)


def hour_bars(spark: SparkSession, root: str) -> DataFrame:
    return market.intraday_bars(spark, root, 60)


def daily(spark: SparkSession, root: str) -> DataFrame:
    return market.daily_bars(spark, root)
