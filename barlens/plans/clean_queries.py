"""Cleaning, validation and session-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import bars as B
from barlens.operators import clean as C
from barlens.operators import quality as Q
from barlens.plans.inputs import (
    DAY_1H, DAY_4H, MARKET, bars, calendar, daily, hour_bars, raw_bars, weekdays,
)
from barlens.plans.registry import cte, query
from barlens.sources import market


def joined(df, *columns):
    """Reason arrays as text, at the edge only."""
    return df.withColumns({c: F.array_join(c, ";") for c in columns})


@query(
    "clean_bars",
    """SELECT upper(symbol) AS symbol, ts, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session_date,
       hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) - 570 AS minute, open, close, volume, vwap
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM c_raw)
WHERE rn = 1 AND hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) BETWEEN 570 AND 959""",
)
def clean_bars(spark, d):
    out = C.clean_bars(raw_bars(spark, d), MARKET)
    return out.select(
        "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "session_date", "minute", "open", "close", "volume", "vwap"
    )


@query("dedupe_keep_last", """SELECT symbol, ts, close FROM
(SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM c_raw) WHERE rn = 1""")
def dedupe_keep_last(spark, d):
    raw = raw_bars(spark, d).select("symbol", "ts", "close", "seq")
    return C.keep_last(raw, ["symbol", "ts"], "seq").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("regular_hours", """SELECT instrument_id, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume FROM c_min
WHERE minute BETWEEN 570 AND 959 GROUP BY 1""")
def regular_hours(spark, d):
    shifted = bars(spark, d).withColumn("minute", F.col("minute") - MARKET.open_minute)
    return C.regular_hours(shifted, MARKET).groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume")
    )


@query("slice_bars", """SELECT symbol, session_date, minute, open, close, volume FROM c_min
WHERE symbol = 'CLICK' AND session_date = DATE '2024-01-03' AND minute >= 600 AND minute < 900""")
def slice_bars(spark, d):
    return C.slice_bars(bars(spark, d), "click", "2024-01-03", 600, 900).select(
        "symbol", "session_date", "minute", "open", "close", "volume"
    )


VALIDATE = """SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, count(*) - count(DISTINCT ts) AS duplicate_timestamps,
       count(*) - count(DISTINCT ts) AS non_increasing_timestamps, count(*) FILTER (close IS NULL) AS null_close,
       count(*) FILTER (volume <= 0) AS non_positive_volume_rows,
       count(*) = count(DISTINCT ts) AND count(*) FILTER (volume <= 0) = 0 AND count(*) FILTER (close IS NULL) = 0 AS is_valid
FROM c_raw GROUP BY symbol"""


@query("validate_bars", VALIDATE)
def validate_bars(spark, d):
    return C.validate_bars(raw_bars(spark, d)).select(
        "symbol", "n_rows", "duplicate_timestamps", "non_increasing_timestamps", "null_close",
        "non_positive_volume_rows", "is_valid",
    )


cte(
    "c_rawday",
    """SELECT symbol AS instrument_id, symbol, CAST(ts AS DATE) AS session_date, hour(ts) * 60 + minute(ts) AS minute,
       open, high, low, close, volume, trade_count, vwap FROM c_raw""",
)


def raw_day(spark, d):
    raw = raw_bars(spark, d)
    return raw.withColumns(
        {
            "instrument_id": F.col("symbol"),
            "session_date": F.to_date("ts"),
            "minute": F.hour("ts") * 60 + F.minute("ts"),
        }
    )


SESSION_SQL = """SELECT instrument_id, session_date, CAST(count(*) AS BIGINT) AS n_rows, concat_ws(';',
  CASE WHEN count(*) > count(DISTINCT minute) THEN 'duplicate_timestamp' END,
  CASE WHEN count(*) <> 1440 THEN 'rows_expected_1440_got_' || count(*) END,
  CASE WHEN max(least(open, low, close, vwap)) IS NULL THEN 'nonfinite_bar_values' END,
  CASE WHEN min(least(open, high, low, close, vwap)) <= 0 THEN 'nonpositive_price' END,
  CASE WHEN min(volume) < 0 OR min(trade_count) < 0 THEN 'negative_volume_or_trade_count' END,
  CASE WHEN bool_or(high < greatest(open, close, low) OR low > least(open, close, high)) THEN 'invalid_ohlc' END) AS reasons
FROM {src} GROUP BY 1, 2"""


@query("validate_session", SESSION_SQL.format(src="c_rawday"))
def validate_session(spark, d):
    return joined(C.validate_session(raw_day(spark, d), 1440), "reasons")


@query("validate_exact_grid", """SELECT b.instrument_id, b.session_date, CAST(count(*) AS BIGINT) AS n_rows,
  max(c.minutes) - count(*) FILTER (minute < c.minutes) AS missing_minutes,
  count(*) - count(*) FILTER (minute < c.minutes) AS extra_minutes,
  concat_ws(';', CASE WHEN count(*) <> 1440 THEN 'rows_expected_1440_got_' || count(*) END,
    CASE WHEN max(c.minutes) IS NULL THEN 'not_a_session' END,
    CASE WHEN bool_or(c.early_close) THEN 'early_close_excluded' END,
    CASE WHEN max(c.minutes) - count(*) FILTER (minute < c.minutes) > 0 OR (max(c.minutes) IS NOT NULL AND count(*) > count(*) FILTER (minute < c.minutes))
      THEN 'grid_mismatch(missing=' || (max(c.minutes) - count(*) FILTER (minute < c.minutes)) || ',extra=' ||
           (count(*) - count(*) FILTER (minute < c.minutes)) || ')' END) AS reasons
FROM c_min b LEFT JOIN c_calendar c USING (session_date) GROUP BY 1, 2""")
def validate_exact_grid(spark, d):
    return joined(C.validate_exact_grid(bars(spark, d), calendar(spark), DAY_1H), "reasons")


@query("missing_extra", """WITH g AS (SELECT i.instrument_id, c.session_date, m.range AS minute
  FROM (SELECT DISTINCT instrument_id FROM c_min) i, c_calendar c, range(0, 24) m WHERE m.range * 60 < c.minutes),
 a AS (SELECT DISTINCT instrument_id, session_date, minute // 60 AS minute FROM c_min)
SELECT coalesce(a.instrument_id, g.instrument_id) AS instrument_id,
  count(*) FILTER (a.minute IS NULL) AS missing, count(*) FILTER (g.minute IS NULL) AS extra
FROM g FULL JOIN a ON a.instrument_id = g.instrument_id AND a.session_date = g.session_date AND a.minute = g.minute GROUP BY 1""")
def missing_extra(spark, d):
    """Expected-but-absent and present-but-unexpected hours, both as anti joins."""
    seen = hour_bars(spark, d).select("instrument_id", "session_date", (F.col("minute") / 60).cast("int").alias("hour"))
    key = ["instrument_id", "session_date", "hour"]
    dates = calendar(spark).select(
        "session_date", F.explode(F.sequence(F.lit(0), (F.col("minutes") / 60 - 1).cast("int"))).alias("hour")
    )
    slots = dates.agg(F.collect_list(F.struct("session_date", "hour")).alias("s"))
    grid = seen.select("instrument_id").distinct().select("instrument_id", F.inline(slots.scalar()))
    both = (
        grid.join(seen, key, "left_anti").withColumn("missing", F.lit(1)).withColumn("extra", F.lit(0))
        .unionByName(seen.join(grid, key, "left_anti").withColumn("missing", F.lit(0)).withColumn("extra", F.lit(1)))
    )
    return both.groupBy("instrument_id").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


@query("classify_session", """SELECT instrument_id, session_date, observed, CASE WHEN observed = 24 AND NOT early_close THEN 'primary_regular'
  WHEN early_close AND observed > 0 AND observed < 24 THEN 'robustness_early_close' ELSE 'excluded_incomplete_or_ambiguous' END AS use
FROM (SELECT instrument_id, session_date, count(*) AS observed, bool_or(coalesce(early_close, false)) AS early_close
      FROM c_hour LEFT JOIN c_calendar USING (session_date) GROUP BY 1, 2)""")
def classify_session(spark, d):
    g = hour_bars(spark, d).groupBy("instrument_id", "session_date").agg(F.count(F.lit(1)).alias("observed"))
    g = g.join(calendar(spark), "session_date", "left")
    early = F.coalesce("early_close", F.lit(False))
    return g.select("instrument_id", "session_date", "observed", C.classify_session(F.col("observed"), early, 24).alias("use"))


DAILY_REASONS = """SELECT d.*, concat_ws(';',
  CASE WHEN w.session_date IS NULL THEN 'daily timestamp is not an expected XNYS session' END,
  CASE WHEN least(open, high, low, close, vwap) <= 0 THEN 'daily prices must be positive' END,
  CASE WHEN volume <= 0 OR trade_count <= 0 THEN 'daily volume and trade count must be positive' END,
  CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'daily OHLC high/low invariants are violated' END) AS reasons
FROM c_daily d LEFT JOIN c_weekdays w USING (session_date)"""
cte("c_daily_checked", DAILY_REASONS)


@query("validate_daily", "SELECT reasons, count(*) AS bars, count(DISTINCT instrument_id) AS instruments FROM c_daily_checked GROUP BY 1")
def validate_daily(spark, d):
    checked = joined(C.validate_daily(daily(spark, d), weekdays(spark)), "reasons")
    return checked.groupBy("reasons").agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("instrument_id").alias("instruments")
    )


@query("finite_check", """SELECT instrument_id, reasons, count(*) AS bars FROM (SELECT instrument_id, concat_ws(';',
  CASE WHEN close IS NULL OR size_ratio IS NULL THEN 'nonfinite_bar_values' END,
  CASE WHEN size_ratio IS NOT NULL AND close <= 0 THEN 'nonpositive_price' END) AS reasons
  FROM (SELECT instrument_id, price AS close, CASE WHEN size > 0 THEN price / size END AS size_ratio FROM c_ticks)) GROUP BY 1, 2""")
def finite_check(spark, d):
    """Ticks as bars whose VWAP is undefined for an empty trade."""
    t = market.ticks(spark, d, positive=False)
    px = F.col("price")
    rows = t.select(
        "instrument_id", px.alias("open"), px.alias("high"), px.alias("low"), px.alias("close"),
        F.col("size").alias("volume"), F.lit(1).alias("trade_count"),
        F.when(F.col("size") > 0, px + 1).alias("vwap"),
    )
    return joined(C.finite_check(rows), "reasons").groupBy("instrument_id", "reasons").agg(F.count(F.lit(1)).alias("bars"))


@query("order_valid", """SELECT violations, count(*) AS orders FROM (SELECT concat_ws(';',
  CASE WHEN upper(trim(o_orderpriority[3:])) = '' THEN 'symbol' END,
  CASE WHEN lower(trim(CASE o_orderstatus WHEN 'F' THEN ' Buy ' WHEN 'O' THEN 'SELL' ELSE 'hold' END)) NOT IN ('buy', 'sell') THEN 'side' END,
  CASE WHEN o_totalprice / 100 <> floor(o_totalprice / 100) THEN 'quantity' END,
  CASE WHEN o_custkey % 1440 >= o_orderkey % 1440 THEN 'window' END) AS violations FROM orders) GROUP BY 1""")
def order_valid(spark, d):
    o = market.table(spark, d, "orders").select(
        F.expr("substring(o_orderpriority, 3)").alias("symbol"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN ' Buy ' WHEN 'O' THEN 'SELL' ELSE 'hold' END").alias("side"),
        (F.col("o_totalprice") / 100).alias("quantity"),
        (F.col("o_custkey") % 1440).alias("start_minute"),
        (F.col("o_orderkey") % 1440).alias("end_minute"),
    )
    return joined(C.order_valid(o), "violations").groupBy("violations").agg(F.count(F.lit(1)).alias("orders"))


@query("normalize_chunk", """SELECT instrument_id, symbol, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session_date, count(*) AS bars
FROM (SELECT 'id-' || symbol AS instrument_id, upper(symbol) AS symbol, ts FROM c_raw)
WHERE hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) BETWEEN 570 AND 959 GROUP BY ALL""")
def normalize_chunk(spark, d):
    out = C.normalize_chunk(raw_bars(spark, d), F.concat(F.lit("id-"), F.col("symbol")), F.col("symbol"), MARKET)
    return out.groupBy("instrument_id", "symbol", "session_date").agg(F.count(F.lit(1)).alias("bars"))


# --- session quality -------------------------------------------------------------------------


@query("bucket_bars", """SELECT symbol, time_bucket(INTERVAL 15 MINUTE, CAST(session_date AS TIMESTAMP) + to_minutes(minute)) AS ts,
  arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM c_min GROUP BY 1, 2""")
def bucket_bars(spark, d):
    b = bars(spark, d).withColumn(
        "ts", F.expr("cast(session_date as timestamp_ntz) + make_interval(0, 0, 0, 0, 0, minute)")
    )
    return B.bucket_bars(b, 15)


TOKEN_OUT = """SELECT instrument_id, session_date, token, open, high, low, close, volume, trade_count,
  round(vwap + 1e-9, 6) AS vwap, round(realized_volatility, 6) AS realized_volatility, observed FROM {src}"""


def token_out(df):
    return df.select(
        "instrument_id", "session_date", "token", "open", "high", "low", "close", "volume", "trade_count",
        rnd_ratio("vwap").alias("vwap"), rnd("realized_volatility").alias("realized_volatility"), "observed",
    )


@query("token_agg", TOKEN_OUT.format(src="c_tok"))
def token_agg(spark, d):
    return token_out(B.token_bars(bars(spark, d), DAY_4H))


@query("token_agg_hourly", TOKEN_OUT.format(src="c_tok60"))
def token_agg_hourly(spark, d):
    return token_out(B.token_bars(bars(spark, d), DAY_1H))


@query("token_agg_exact", TOKEN_OUT.format(src="c_tok_exact"))
def token_agg_exact(spark, d):
    return token_out(B.token_bars(bars(spark, d), DAY_4H, exact=True))


def quality_sql(width: int, calendar_join: bool) -> str:
    n = 1440 // width
    cal = "LEFT JOIN c_calendar c USING (session_date)" if calendar_join else ", (SELECT 1440 AS minutes, false AS early_close) c"
    return f"""WITH s AS (SELECT b.instrument_id, b.session_date, max(b.symbol) AS symbol, max(c.minutes) AS minutes,
    bool_or(c.early_close) AS early_close, count(*) AS n, count(*) FILTER (b.minute < c.minutes) AS ongrid,
    count(*) FILTER (b.minute BETWEEN 600 AND 899) AS inwin FROM c_min b {cal} GROUP BY 1, 2),
 g AS (SELECT s.*, t.range AS token FROM s, range(0, {n}) t),
 k AS (SELECT instrument_id, session_date, minute // {width} AS token, count(*) AS n, sum(volume) AS v FROM c_min GROUP BY 1, 2, 3),
 r AS (SELECT g.instrument_id, g.session_date, count(*) FILTER (k.n >= 2 AND k.v > 0) AS valid,
    coalesce(string_agg(CASE WHEN coalesce(k.n, 0) < 2 THEN 'token_' || lpad(CAST(g.token AS VARCHAR), 2, '0') || '_observed_bars_lt_2' END, ';' ORDER BY g.token), '') AS few,
    coalesce(string_agg(CASE WHEN k.n >= 2 AND k.v <= 0 THEN 'token_' || lpad(CAST(g.token AS VARCHAR), 2, '0') || '_nonpositive_volume' END, ';' ORDER BY g.token), '') AS dry,
    string_agg(CAST(coalesce(k.n, 0) AS VARCHAR), ',' ORDER BY g.token) AS counts
   FROM g LEFT JOIN k ON k.instrument_id = g.instrument_id AND k.session_date = g.session_date AND k.token = g.token GROUP BY 1, 2),
 f AS (SELECT s.*, r.counts, coalesce(s.n > s.ongrid, true) AS off, CASE WHEN s.minutes IS NULL THEN s.n ELSE s.n - s.ongrid END AS noff, r.valid, r.few, r.dry FROM s JOIN r USING (instrument_id, session_date)),
 q AS (SELECT *, concat_ws(';', CASE WHEN noff > 0 THEN 'off_grid_minutes:' || noff END,
    CASE WHEN early_close THEN 'early_close_not_primary_{n}_token_session' WHEN noff = 0 THEN nullif(concat_ws(';', nullif(few, ''), nullif(dry, '')), '') END) AS reason FROM f)
SELECT instrument_id, session_date, symbol, noff = 0 AND n = minutes AS minute_exact_full_session,
  reason = '' AND valid = {n} AS token_valid_full_session, noff = 0 AND inwin = 300 AS tca_window_exact, early_close,
  minutes - ongrid AS provider_gap_count, CAST(n AS BIGINT) AS observed_minute_count,
  CASE WHEN noff = 0 AND NOT early_close THEN valid ELSE 0 END AS valid_token_count,
  reason AS invalid_token_reason, CASE WHEN early_close THEN '' ELSE counts END AS token_counts FROM q"""


cte("c_quality4", quality_sql(240, False))
cte("c_quality1", quality_sql(60, False))


def quality(spark, d, spec):
    return Q.session_quality(bars(spark, d), spec, window=(600, 900))


def quality_out(df):
    out = df.withColumn("token_counts", F.array_join(F.col("token_observed_bar_counts").cast("array<string>"), ","))
    return out.drop("token_observed_bar_counts", "token_provider_gap_counts")


@query("session_quality", "SELECT * FROM c_quality4")
def session_quality(spark, d):
    return quality_out(quality(spark, d, DAY_4H))


@query("session_quality_hourly", "SELECT * FROM c_quality1")
def session_quality_hourly(spark, d):
    return quality_out(quality(spark, d, DAY_1H))


CAL_SESSION = quality_sql(240, True) + " WHERE minutes IS NOT NULL"


@query("session_quality_calendar", CAL_SESSION)
def session_quality_calendar(spark, d):
    cal = calendar(spark)
    on_sessions = bars(spark, d).join(cal, "session_date", "left_semi")
    return quality_out(Q.session_quality(on_sessions, DAY_4H, calendar=cal, window=(600, 900)))


@query("token_counts", """SELECT s.instrument_id, s.session_date, CAST(t.range AS INTEGER) AS token, count(k.minute) AS observed, 60 - count(k.minute) AS gap
FROM (SELECT DISTINCT instrument_id, session_date FROM c_min) s CROSS JOIN range(0, 24) t
LEFT JOIN c_min k ON k.instrument_id = s.instrument_id AND k.session_date = s.session_date AND k.minute // 60 = t.range GROUP BY 1, 2, 3""")
def token_counts(spark, d):
    return Q.token_counts(bars(spark, d), DAY_1H)


@query("scan_receipt", """SELECT CAST(sum(observed_minute_count) AS BIGINT) AS minute_rows, count(*) AS sessions, CAST(sum(valid_token_count) AS BIGINT) AS valid_tokens,
  count(*) FILTER (minute_exact_full_session) AS minute_exact, count(*) FILTER (token_valid_full_session) AS token_valid,
  count(*) FILTER (tca_window_exact) AS window_exact, count(*) FILTER (early_close) AS early_closes,
  CAST(sum(provider_gap_count) AS BIGINT) AS gaps FROM c_quality1""")
def scan_receipt(spark, d):
    return Q.scan_receipt(quality(spark, d, DAY_1H))


@query("grid_fill", """WITH q AS (SELECT * FROM c_quality4), i AS (SELECT DISTINCT event_type AS instrument_id FROM events UNION ALL SELECT n_name FROM nation)
SELECT i.instrument_id, c.session_date, c.early_close, coalesce(minute_exact_full_session, false) AS minute_exact_full_session,
  coalesce(token_valid_full_session, false) AS token_valid_full_session, coalesce(tca_window_exact, false) AS tca_window_exact,
  CASE WHEN q.session_date IS NULL THEN c.minutes ELSE provider_gap_count END AS provider_gap_count,
  coalesce(observed_minute_count, 0) AS observed_minute_count, coalesce(valid_token_count, 0) AS valid_token_count,
  CASE WHEN q.session_date IS NULL THEN 'missing_provider_session' ELSE invalid_token_reason END AS invalid_token_reason
FROM i CROSS JOIN c_calendar c LEFT JOIN q ON q.instrument_id = i.instrument_id AND q.session_date = c.session_date""")
def grid_fill(spark, d):
    """Candidates without any bars (nations) must appear on every session too."""
    ids = market.table(spark, d, "events").select(F.col("event_type").alias("instrument_id")).distinct()
    ids = ids.unionByName(market.table(spark, d, "nation").select(F.col("n_name").alias("instrument_id")))
    return Q.grid_fill(quality(spark, d, DAY_4H), ids, calendar(spark))


@query("daily_counts", """SELECT session_date, count(*) AS bar_count, count(*) = 1440 AS is_full_day FROM c_min GROUP BY 1""")
def daily_counts(spark, d):
    return Q.daily_counts(bars(spark, d), DAY_1H)


@query("bar_manifest", """WITH s AS (SELECT DISTINCT upper(event_type) AS symbol FROM events UNION ALL SELECT upper(r_name) FROM region),
 t AS (SELECT symbol, session_date, count(*) AS n, min(minute) AS lo, max(minute) AS hi FROM c_min GROUP BY 1, 2)
SELECT s.symbol, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows, count(n) AS days, count(n) FILTER (n = 1440) AS full_days,
  min(session_date) AS min_date, max(session_date) AS max_date, arg_min(lo, session_date) AS first_minute, arg_max(hi, session_date) AS last_minute
FROM s LEFT JOIN t USING (symbol) GROUP BY 1""")
def bar_manifest(spark, d):
    symbols = market.table(spark, d, "events").select(F.upper("event_type").alias("symbol")).distinct()
    symbols = symbols.unionByName(market.table(spark, d, "region").select(F.upper("r_name").alias("symbol")))
    return Q.bar_manifest(bars(spark, d), symbols, DAY_1H)


@query("exclusion_ledger", f"""WITH v AS (SELECT instrument_id, session_date, 'minute' AS stage, unnest(string_split(reasons, ';')) AS reason FROM ({SESSION_SQL.format(src='c_min')}) WHERE reasons <> ''),
 q AS (SELECT instrument_id, session_date, 'token' AS stage, unnest(string_split(invalid_token_reason, ';')) AS reason FROM c_quality1 WHERE invalid_token_reason <> '')
SELECT * FROM v UNION ALL SELECT * FROM q""")
def exclusion_ledger(spark, d):
    b = bars(spark, d)
    minute = C.validate_session(b, 1440).withColumn("stage", F.lit("minute"))
    token = quality(spark, d, DAY_1H).select(
        "instrument_id", "session_date", F.lit("token").alias("stage"),
        F.filter(F.split("invalid_token_reason", ";"), lambda r: r != "").alias("reasons"),
    )
    return Q.exclusion_ledger(minute, token)
