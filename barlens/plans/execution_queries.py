"""Schedules, fills and cost attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd
from barlens.operators import bars as B
from barlens.operators import execution as X
from barlens.operators import history as H
from barlens.operators import universe as U
from barlens.plans.forecast_queries import profile4
from barlens.plans.inputs import bars, hour_bars
from barlens.plans.registry import cte, query
from barlens.sources import market

cte("c_priced", """SELECT *, vwap AS reference_price, sum(vwap * volume) OVER w / nullif(sum(volume) OVER w, 0) AS session_vwap, CAST(sum(volume) OVER w AS BIGINT) AS session_volume FROM {src}
WINDOW w AS (PARTITION BY instrument_id, session_date)""".format(src="c_hour"))
OB = """SELECT o.*, b.minute, b.volume, b.reference_price, b.open, b.close, b.session_vwap, b.session_volume, CASE WHEN b.minute IS NOT NULL THEN row_number() OVER k - 1 END AS k, count(b.minute) OVER w AS n,
  first(b.reference_price) OVER k AS arrival_price, CAST(sum(b.volume) OVER w AS BIGINT) AS window_volume FROM {orders} o LEFT JOIN {bars} b ON b.instrument_id = o.instrument_id AND b.session_date = o.session_date
  AND b.minute >= o.start_minute AND b.minute < o.end_minute WINDOW k AS (PARTITION BY order_id ORDER BY b.minute), w AS (PARTITION BY order_id)"""
cte("c_ob", OB.format(orders="c_orders", bars="c_priced"))


def order_buckets(spark, d):
    return X.prepare_window(market.parent_orders(spark, d), hour_bars(spark, d))


def packed_orders(spark, d):
    return X.packed_window(market.parent_orders(spark, d), hour_bars(spark, d))


def money(c, name=None):
    return rnd(F.col(c) + 1e-6, 4).alias(name or c)


def money_sql(*names):
    return ", ".join(f"round({n} + 1e-6, 4) AS {n}" for n in names)


@query("prepare_window", f"""SELECT order_id, minute, k, n, volume, window_volume, {money_sql('reference_price', 'arrival_price', 'session_vwap')},
  CASE WHEN minute IS NOT NULL THEN 'ok' WHEN (instrument_id, session_date) IN (SELECT (instrument_id, session_date) FROM c_priced) THEN 'empty_window' ELSE 'no_session' END AS status FROM c_ob""")
def prepare_window(spark, d):
    return order_buckets(spark, d).select(
        "order_id", "minute", "k", "n", "volume", "window_volume", "status", money("reference_price"), money("arrival_price"), money("session_vwap")
    )


cte("c_twap", "SELECT *, quantity // n + CASE WHEN k < quantity % n THEN 1 ELSE 0 END AS planned FROM c_ob")


@query("twap_schedule", "SELECT order_id, minute, planned FROM c_twap")
def twap_schedule(spark, d):
    return X.twap_schedule(order_buckets(spark, d)).select("order_id", "minute", "planned")


def remainder_sql(src: str, value: str, cap: str, tol: str) -> str:
    return f"""SELECT * EXCLUDE (c, base, fr, lft, turn, step, rest, freeb), step + CAST(greatest(0, least({cap} - step, rest - freeb)) AS BIGINT) AS planned FROM (
 SELECT *, quantity - sum(step) OVER (PARTITION BY order_id) AS rest, coalesce(sum({cap} - step) OVER (PARTITION BY order_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freeb FROM (
  SELECT *, base + CASE WHEN base < {cap} AND turn <= lft THEN 1 ELSE 0 END AS step FROM (
   SELECT *, quantity - sum(base) OVER (PARTITION BY order_id) AS lft, row_number() OVER (PARTITION BY order_id ORDER BY base >= {cap}, fr DESC, k) AS turn FROM (
    SELECT *, CAST(least(floor(c + {tol}), {cap}) AS BIGINT) AS base, c - floor(c) AS fr FROM (SELECT *, greatest(0.0, least({value}, {cap})) AS c FROM {src})))))"""


cte("c_orders4", "SELECT * FROM c_orders")
cte("c_bar4", """SELECT instrument_id, session_date, bucket * 240 AS minute, bucket, open, high, low, close, volume, dv / nullif(volume, 0) AS vwap FROM
 (SELECT instrument_id, session_date, CAST(minute // 240 AS INTEGER) AS bucket, arg_min(open, minute) AS open, arg_max(close, minute) AS close, max(high) AS high, min(low) AS low, CAST(sum(volume) AS BIGINT) AS volume, sum(vwap * volume) AS dv FROM c_min GROUP BY 1, 2, 3)""")
cte("c_priced4", """SELECT *, coalesce(vwap, (open + high + low + close) / 4) AS reference_price, sum(vwap * volume) OVER w / nullif(sum(volume) OVER w, 0) AS session_vwap, CAST(sum(volume) OVER w AS BIGINT) AS session_volume FROM c_bar4 WINDOW w AS (PARTITION BY instrument_id, session_date)""")
cte("c_ob4", OB.format(orders="c_orders", bars="c_priced4").replace("b.open,", "b.bucket, b.open,"))
cte("c_ob4s", """SELECT *, CASE WHEN sum(share) OVER (PARTITION BY order_id) > 0 THEN quantity * share / sum(share) OVER (PARTITION BY order_id) END AS want FROM (SELECT o.*, coalesce(round_even(f.share * 1e6, 0), 0) AS share, f.expected_volume FROM c_ob4 o LEFT JOIN c_profile4 f USING (instrument_id, session_date, bucket))""")
cte("c_ob4w", "SELECT * FROM c_ob4s WHERE want IS NOT NULL")
cte("c_vwap4", remainder_sql("c_ob4w", "want", "quantity", "1e-7") + " UNION ALL BY NAME SELECT *, NULL AS planned FROM c_ob4s WHERE want IS NULL")


def order_buckets4(spark, d):
    """Order buckets of four hours with the causal profile's shares in parts per million.

    Whole weights make the remainders of both engines equal to the last bit.
    """
    b = B.bucket_minutes(bars(spark, d), 240).withColumn("minute", F.col("bucket") * 240)
    weight = F.bround(F.col("share") * 1e6, 0).alias("share")
    f = profile4(spark, d).select("instrument_id", "session_date", "bucket", weight, "expected_volume")
    b = b.join(f, ["instrument_id", "session_date", "bucket"], "left")
    return X.packed_window(market.parent_orders(spark, d), b, extra=("bucket", "share", "expected_volume"))


@query("vwap_schedule", "SELECT order_id, minute, planned, CASE WHEN planned IS NULL THEN 'no_forecast' ELSE 'ok' END AS status FROM c_vwap4")
def vwap_schedule(spark, d):
    return X.unpack(X.vwap_schedule(order_buckets4(spark, d))).select("order_id", "minute", "planned", "status")


cte("c_obw", "SELECT *, quantity * (volume / window_volume) / sum(volume / window_volume) OVER (PARTITION BY order_id) AS want FROM c_ob WHERE window_volume > 0")
cte("c_ovwap", remainder_sql("c_obw", "want", "quantity", "1e-7"))


@query("oracle_vwap_schedule", "SELECT order_id, minute, planned, true AS evaluation_only FROM c_ovwap")
def oracle_vwap_schedule(spark, d):
    o = X.oracle_vwap_schedule(packed_orders(spark, d), allow_evaluation_only=True)
    return X.unpack(o).select("order_id", "minute", "planned", "evaluation_only")


def ac_sql(src: str, eta: str, sigma: str, lam: str) -> str:
    ratio = f"({lam} * {sigma} * {sigma} / (2 * {eta}))"
    inv = "CASE WHEN {j} = n THEN 0 ELSE quantity * exp(-kappa * ({j})) * (1 - exp(-2 * kappa * (n - ({j})))) / (1 - exp(-2 * kappa * n)) END"
    return f"""SELECT *, CASE WHEN ratio <= 1e-14 THEN quantity / n ELSE {inv.format(j='k')} - {inv.format(j='k + 1')} END AS want
FROM (SELECT *, {ratio} AS ratio, acosh(1 + {ratio}) AS kappa FROM {src})"""


cte("c_obac", ac_sql("c_ob", "1e-6", "0.01", "CASE side WHEN 'buy' THEN 0.00137 ELSE 0.0 END"))
cte("c_ac", remainder_sql("c_obac", "want", "quantity", "1e-5"))


@query("almgren_chriss_schedule", "SELECT order_id, minute, planned FROM c_ac")
def almgren_chriss_schedule(spark, d):
    """Risk-averse buys, risk-neutral sells (the equal-split limit)."""
    o = X.almgren_chriss_schedule(
        packed_orders(spark, d), eta=F.lit(1e-6), volatility=F.lit(0.01), risk_aversion=F.when(F.col("side") == "buy", 0.00137).otherwise(0.0)
    )
    return X.unpack(o).select("order_id", "minute", "planned")


# capacities that force the second pass: room is a tenth of the bucket's volume
cte("c_obcap", """SELECT * FROM (SELECT *, CAST(floor(volume / 4) AS BIGINT) AS cap, sum(CAST(floor(volume / 4) AS BIGINT)) OVER (PARTITION BY order_id) AS room, quantity / n AS want FROM c_ob)""")


@query("largest_remainder", "SELECT order_id, minute, cap, CASE WHEN room >= quantity THEN planned END AS planned, CASE WHEN room >= quantity THEN 'ok' ELSE 'infeasible' END AS status FROM (" + remainder_sql("c_obcap", "want", "cap", "1e-7") + ")")
def largest_remainder(spark, d):
    b = X.add_columns(packed_orders(spark, d), {"cap": lambda at: F.floor(at("volume") / 4)})
    want = lambda at: F.try_divide(at("quantity"), at("n"))
    return X.unpack(X.largest_remainder(b, value=want, capacity="cap", target="quantity")).select("order_id", "minute", "cap", "planned", "status")


cte("c_pov", """SELECT *, least(quantity, run) - coalesce(lag(least(quantity, run)) OVER k, 0) AS executed, least(ask, quantity - coalesce(lag(least(quantity, run)) OVER k, 0)) AS planned FROM
 (SELECT *, CAST(sum(least(ask, cap)) OVER (PARTITION BY order_id ORDER BY minute) AS BIGINT) AS run FROM (SELECT *, CAST(floor(0.2 * volume) AS BIGINT) AS ask, CAST(floor(0.1 * volume) AS BIGINT) AS cap FROM c_ob))
WINDOW k AS (PARTITION BY order_id ORDER BY minute)""")


@query("pov_fills", "SELECT order_id, minute, planned, executed FROM c_pov")
def pov_fills(spark, d):
    return X.pov_fills(order_buckets(spark, d), 0.2, 0.1).select("order_id", "minute", "planned", "executed")


cte("c_static", "SELECT *, least(planned, CAST(floor(0.1 * volume) AS BIGINT)) AS executed FROM c_twap")


@query("static_fills", "SELECT order_id, minute, planned, CAST(floor(0.1 * volume) AS BIGINT) AS capacity, executed FROM c_static")
def static_fills(spark, d):
    return X.static_fills(X.twap_schedule(order_buckets(spark, d)), 0.1).select("order_id", "minute", "planned", "capacity", "executed")


def cost_sql(src: str, h: str, eta: str) -> str:
    return f"""SELECT *, {h} AS half_spread, {eta} * executed / greatest(volume, 1.0) AS impact_per_share,
  reference_price + CASE side WHEN 'buy' THEN 1 ELSE -1 END * ({h} + {eta} * executed / greatest(volume, 1.0)) AS execution_price,
  {h} * executed AS spread_cost, {eta} * executed / greatest(volume, 1.0) * executed AS impact_cost FROM {src}"""


cte("c_cost", cost_sql("c_static", "0.01", "0.5"))


def costed(spark, d):
    return X.fill_cost(X.static_fills(X.twap_schedule(order_buckets(spark, d)), 0.1), half_spread=F.lit(0.01), impact=F.lit(0.5))


@query("fill_cost", f"SELECT order_id, minute, executed, {money_sql('impact_per_share', 'execution_price', 'spread_cost', 'impact_cost')} FROM c_cost")
def fill_cost(spark, d):
    return costed(spark, d).select("order_id", "minute", "executed", *(money(c) for c in ("impact_per_share", "execution_price", "spread_cost", "impact_cost")))


LOG_SQL = """SELECT *, CAST(sum(executed) OVER k AS BIGINT) AS cumulative_executed, quantity - CAST(sum(executed) OVER k AS BIGINT) AS inventory_after, CASE WHEN volume > 0 THEN executed / volume ELSE 0 END AS participation,
  CASE side WHEN 'buy' THEN 1 ELSE -1 END * executed * (reference_price - arrival_price) AS timing_cost, sum(spread_cost + impact_cost) OVER k AS cumulative_cost FROM {src} WINDOW k AS (PARTITION BY order_id ORDER BY minute)"""
cte("c_log", LOG_SQL.format(src="c_cost"))
cte("c_log4", LOG_SQL.format(src="(" + cost_sql("(SELECT *, CASE WHEN planned IS NULL THEN 0 ELSE least(planned, CAST(floor(0.1 * volume) AS BIGINT)) END AS executed FROM c_vwap4)", "0.01", "0.5") + ")"))


@query("execution_log", f"""SELECT order_id, minute, planned, executed, inventory_after + executed AS inventory_before, inventory_after, cumulative_executed, {money_sql('participation', 'timing_cost', 'cumulative_cost')},
  round(volume - expected_volume + 1e-6, 4) AS volume_forecast_error, CASE WHEN expected_volume IS NULL THEN 'not_available' WHEN volume > expected_volume THEN 'above' WHEN volume < expected_volume THEN 'below' ELSE 'equal' END AS volume_vs_forecast FROM c_log4""")
def execution_log(spark, d):
    fills = X.static_fills(X.vwap_schedule(order_buckets4(spark, d)), 0.1)
    log = X.execution_log(X.fill_cost(fills, half_spread=F.lit(0.01), impact=F.lit(0.5)), forecast="expected_volume")
    return log.select(
        "order_id", "minute", "planned", "executed", "inventory_before", "inventory_after", "cumulative_executed", "volume_vs_forecast",
        *(money(c) for c in ("participation", "timing_cost", "cumulative_cost", "volume_forecast_error")),
    )


SUMMARY = (
    "average_price", "arrival_price", "session_vwap", "filled_notional", "implementation_shortfall", "timing_cost", "spread_cost", "impact_cost", "total_cost",
    "completion_rate", "realized_participation", "average_participation", "maximum_participation", "opportunity_cost",
)


def summary_sql(src: str, extra: str = "") -> str:
    sign = "CASE side WHEN 'buy' THEN 1 ELSE -1 END"
    return f"""SELECT *, quantity - filled AS unfilled, CASE WHEN filled > 0 THEN filled_notional / filled END AS average_price, spread_cost + impact_cost AS total_cost, filled / quantity AS completion_rate,
  coalesce(filled / nullif(window_volume, 0), 0) AS realized_participation, {sign} * (quantity - filled) * (lst - arrival_price) AS opportunity_cost,
  CASE WHEN filled > 0 AND arrival_price > 0 THEN 10000 * {sign} * (filled_notional / filled - arrival_price) / arrival_price END AS shortfall_bps,
  CASE WHEN filled > 0 AND session_vwap > 0 THEN 10000 * {sign} * (filled_notional / filled - session_vwap) / session_vwap END AS vwap_slippage_bps FROM (
 SELECT order_id, {extra} any_value(side) AS side, any_value(quantity) AS quantity, any_value(session_vwap) AS session_vwap, any_value(arrival_price) AS arrival_price, CAST(sum(executed) AS BIGINT) AS filled,
  sum(executed * execution_price) AS filled_notional, CASE WHEN sum(executed) > 0 THEN sum({sign} * executed * (execution_price - arrival_price)) END AS implementation_shortfall,
  CASE WHEN sum(executed) > 0 THEN sum(timing_cost) END AS timing_cost, sum(spread_cost) AS spread_cost, sum(impact_cost) AS impact_cost, arg_max(reference_price, minute) AS lst, CAST(sum(volume) AS BIGINT) AS window_volume,
  avg(participation) AS average_participation, max(participation) AS maximum_participation, min(minute) AS first_minute, max(minute) AS last_minute, count(*) AS buckets FROM {src} GROUP BY order_id)"""


cte("c_tca", summary_sql("c_log"))


def summary(spark, d):
    return X.tca_summary(X.execution_log(costed(spark, d)))


@query("tca_summary", f"SELECT order_id, side, quantity, filled, unfilled, first_minute, last_minute, buckets, {money_sql(*SUMMARY)}, round(shortfall_bps + 1e-6, 3) AS shortfall_bps, round(vwap_slippage_bps + 1e-6, 3) AS vwap_slippage_bps, CASE WHEN filled > 0 THEN true END AS reconciles FROM c_tca")
def tca_summary(spark, d):
    return summary(spark, d).select(
        "order_id", "side", "quantity", "filled", "unfilled", "first_minute", "last_minute", "buckets", *(money(c) for c in SUMMARY),
        rnd(F.col("shortfall_bps") + 1e-6, 3).alias("shortfall_bps"), rnd(F.col("vwap_slippage_bps") + 1e-6, 3).alias("vwap_slippage_bps"),
        (F.abs("residual") < 1e-6).alias("reconciles"),
    )


cte("c_oracle", """SELECT order_id, CASE WHEN sum(volume) = 0 THEN 0 ELSE 0.5 * power(least(any_value(quantity), 0.1 * sum(volume)) / sum(volume), 2) * sum(volume * volume / greatest(volume, 1.0)) END AS oracle_cost FROM c_ob GROUP BY 1""")


@query("oracle_cost", f"SELECT order_id, {money_sql('oracle_cost')} FROM c_oracle")
def oracle_cost(spark, d):
    return X.oracle_cost(order_buckets(spark, d), impact=F.lit(0.5)).select("order_id", money("oracle_cost"))


@query("allocation_regret", "SELECT order_id, round(CASE WHEN oracle_cost > 0 THEN (impact_cost - oracle_cost) / greatest(oracle_cost, 1e-12) END + 1e-9, 6) AS regret FROM c_tca JOIN c_oracle USING (order_id)")
def allocation_regret(spark, d):
    b = order_buckets(spark, d)
    fills = X.fill_cost(X.static_fills(X.twap_schedule(b), 0.1), half_spread=F.lit(0.01), impact=F.lit(0.5))
    model = fills.groupBy("order_id").agg(F.sum("impact_cost").alias("impact_cost"))
    both = model.join(X.oracle_cost(b, impact=F.lit(0.5)), "order_id")
    regret = F.when(F.col("oracle_cost") > 0, X.allocation_regret(F.col("impact_cost"), F.col("oracle_cost")))
    return both.select("order_id", rnd(regret + 1e-9).alias("regret"))


# --- matched cases ---------------------------------------------------------------------------

cte("c_dayadv", """SELECT * FROM (SELECT instrument_id, session_date, avg(v) OVER w AS adv20, count(v) OVER w AS n FROM (SELECT instrument_id, session_date, sum(volume) AS v FROM c_hour GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE n = 20""")
# beside the real cases one of each date whose session does not exist
cte("c_tcabase", "SELECT instrument_id, session_date, adv20 FROM c_dayadv UNION ALL SELECT 'gone', session_date, max(adv20) FROM c_dayadv GROUP BY 2")
cte("c_tcaorders", """SELECT instrument_id || '|' || session_date || '|' || f AS order_id, instrument_id, session_date, f AS order_fraction, side, CAST(greatest(1, round_even(f * adv20, 0)) AS BIGINT) AS quantity, 600 AS start_minute, 960 AS end_minute
 FROM (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE)) f(f), (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_date ORDER BY sha256(CAST(session_date AS VARCHAR) || '|' || instrument_id))
  <= (count(*) OVER (PARTITION BY session_date) + 1) // 2 THEN 'buy' ELSE 'sell' END AS side FROM c_tcabase)""")
# what vwap follows is the profile of earlier sessions: each hour has the weight of its four hours
SHARES = "(SELECT instrument_id, session_date, bucket, round_even(share * 1e6, 0) AS share FROM c_profile4)"
cte("c_sessions", "SELECT DISTINCT instrument_id, session_date FROM c_priced")


def window_sql(orders: str) -> str:
    """Order buckets with the arrival's open, forecast shares and their mass, and the window's status."""
    return f"""SELECT o.*, first(open) OVER (PARTITION BY order_id ORDER BY minute) AS arrival_open, p.share, sum(coalesce(p.share, 0)) OVER (PARTITION BY order_id) AS mass,
  CASE WHEN minute IS NOT NULL THEN 'ok' WHEN (o.instrument_id, o.session_date) IN (SELECT (instrument_id, session_date) FROM c_sessions) THEN 'empty_window' ELSE 'no_session' END AS status
  FROM ({OB.format(orders=orders, bars="c_priced")}) o LEFT JOIN {SHARES} p ON p.instrument_id = o.instrument_id AND p.session_date = o.session_date AND p.bucket = o.minute // 240"""


def twap_sql(src: str) -> str:
    return f"SELECT *, 'twap' AS method, CASE WHEN n > 0 THEN least(quantity // n + CASE WHEN k < quantity % n THEN 1 ELSE 0 END, CAST(floor(0.1 * volume) AS BIGINT)) ELSE 0 END AS executed FROM {src}"


def vwap_sql(src: str) -> str:
    planned = remainder_sql(f"(SELECT *, quantity * coalesce(share, 0) / mass AS want FROM {src} WHERE mass > 0)", "want", "quantity", "1e-7")
    return f"""SELECT * EXCLUDE (planned, want), 'vwap' AS method, least(planned, CAST(floor(0.1 * volume) AS BIGINT)) AS executed FROM ({planned})
 UNION ALL BY NAME SELECT * REPLACE (CASE status WHEN 'ok' THEN 'no_forecast' ELSE status END AS status), 'vwap' AS method, 0 AS executed FROM {src} WHERE NOT mass > 0"""


def pov_sql(src: str) -> str:
    return f"""SELECT * EXCLUDE (run), 'pov' AS method, coalesce(least(quantity, run) - coalesce(lag(least(quantity, run)) OVER (PARTITION BY order_id ORDER BY minute), 0), 0) AS executed FROM
 (SELECT *, CAST(sum(CASE WHEN minute IS NULL THEN 0 ELSE least(floor(0.05 * volume), floor(0.1 * volume)) END) OVER (PARTITION BY order_id ORDER BY minute) AS BIGINT) AS run FROM {src})"""


cte("c_tob", window_sql("c_tcaorders"))
cte("c_t_twap", twap_sql("c_tob"))
cte("c_t_vwap", vwap_sql("c_tob"))
cte("c_t_pov", pov_sql("c_tob"))
cte("c_t_all", "SELECT * FROM c_t_twap UNION ALL BY NAME SELECT * FROM c_t_vwap UNION ALL BY NAME SELECT * FROM c_t_pov")
BY_METHOD = LOG_SQL.replace("PARTITION BY order_id", "PARTITION BY order_id, method")
CARRIED = "method, any_value(status) AS status, any_value(instrument_id) AS instrument_id, any_value(session_date) AS session_date,"
cte("c_t_sum", summary_sql("(" + BY_METHOD.format(src="(" + cost_sql("c_t_all", "arrival_open * 5e-5", "arrival_open * 1e-3") + ")") + ")", CARRIED + " any_value(order_fraction) AS order_fraction,").replace("GROUP BY order_id)", "GROUP BY order_id, method)"))
cte("c_t_oracle", """SELECT order_id, coalesce(CASE WHEN sum(volume) = 0 THEN 0 ELSE any_value(arrival_open) * 1e-3 * power(least(any_value(quantity), 0.1 * sum(volume)) / sum(volume), 2) * sum(volume * volume / greatest(volume, 1.0)) END, 0) AS oracle_cost FROM c_tob GROUP BY 1""")
cte("c_tcacase", "SELECT s.*, o.oracle_cost, (impact_cost - oracle_cost) / greatest(oracle_cost, 1e-12) AS regret FROM c_t_sum s JOIN c_t_oracle o USING (order_id)")
cte("c_tcaprimary", "SELECT * FROM c_tcacase WHERE order_fraction = 0.03 AND order_id NOT IN (SELECT order_id FROM c_tcacase WHERE status <> 'ok')")


def hour_shares(spark, d):
    """The causal profile's shares in parts per million, for each hour that of its four hours."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(180), F.lit(60))).alias("_m")
    shares = profile4(spark, d).select("instrument_id", "session_date", "bucket", F.bround(F.col("share") * 1e6, 0).alias("share"), hours)
    return shares.withColumn("minute", (F.col("bucket") * 240 + F.col("_m")).cast("int"))


def tca(spark, d):
    """Cases of three sizes, with one of each date whose session does not exist."""
    h = hour_bars(spark, d)
    day = h.groupBy("instrument_id", "session_date").agg(F.sum("volume").alias("volume"))
    adv = H.adv(day, 20).select("instrument_id", "session_date", "adv20")
    gone = adv.groupBy("session_date").agg(F.max("adv20").alias("adv20")).select(F.lit("gone").alias("instrument_id"), "session_date", "adv20")
    return X.tca_cases(h, U.balanced_sides(adv.unionByName(gone)), ("twap", "vwap", "pov"), hour_shares(spark, d), start=600, end=960)


def tca_primary(spark, d):
    """Cases of the primary size that every method could run."""
    return X.complete_cases(tca(spark, d).where("order_fraction = 0.03"))


@query("tca_cases", f"SELECT method, instrument_id, session_date, order_fraction, status, side, quantity, filled, {money_sql('impact_cost', 'spread_cost', 'oracle_cost', 'completion_rate')}, round(regret + 1e-6, 4) AS regret, round(shortfall_bps + 1e-6, 3) AS shortfall_bps FROM c_tcacase")
def tca_cases(spark, d):
    return tca(spark, d).select(
        "method", "instrument_id", "session_date", "order_fraction", "status", "side", "quantity", "filled", *(money(c) for c in ("impact_cost", "spread_cost", "oracle_cost", "completion_rate", "regret")),
        rnd(F.col("shortfall_bps") + 1e-6, 3).alias("shortfall_bps"),
    )


# --- experiment grid -------------------------------------------------------------------------

GRID = dict(sides=("buy", "sell"), quantities=(50, 400), impacts=(0.1, 0.5), risks=(0.0, 0.00137), start=480, end=1080)
# beside the real sessions one of each date that does not exist
cte("c_gridsessions", "SELECT DISTINCT instrument_id, session_date FROM c_hour UNION ALL SELECT DISTINCT 'gone', session_date FROM c_hour")
cte("c_gridorders", """SELECT instrument_id || '|' || session_date || '|' || side || '|' || quantity || '|' || impact || '|' || risk_aversion AS order_id, s.*, side, CAST(quantity AS BIGINT) AS quantity, impact, risk_aversion, 480 AS start_minute, 1080 AS end_minute
FROM c_gridsessions s, (VALUES ('buy'), ('sell')) a(side), (VALUES (50), (400)) b(quantity), (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) c(impact), (VALUES (0.0::DOUBLE), (0.00137::DOUBLE)) e(risk_aversion)""")
cte("c_gob", window_sql("c_gridorders"))
cte("c_g_twap", twap_sql("c_gob"))
cte("c_g_vwap", vwap_sql("c_gob"))
cte("c_g_acx", remainder_sql("(" + ac_sql("(SELECT * FROM c_gob WHERE n > 0)", "(impact / 100000)", "0.01", "risk_aversion") + ")", "want", "quantity", "1e-5"))
cte("c_g_ac", "SELECT * EXCLUDE (planned, want, ratio, kappa), 'almgren-chriss' AS method, least(planned, CAST(floor(0.1 * volume) AS BIGINT)) AS executed FROM c_g_acx UNION ALL BY NAME SELECT *, 'almgren-chriss' AS method, 0 AS executed FROM c_gob WHERE n = 0")
cte("c_g_pov", pov_sql("c_gob"))
cte("c_g_all", "SELECT * FROM c_g_twap UNION ALL BY NAME SELECT * FROM c_g_vwap UNION ALL BY NAME SELECT * FROM c_g_ac UNION ALL BY NAME SELECT * FROM c_g_pov")
cte("c_grid", "SELECT g.*, v.session_volatility, v.session_volume FROM (" + summary_sql("(" + BY_METHOD.format(src="(" + cost_sql("c_g_all", "0.01", "impact") + ")") + ")", CARRIED + " any_value(impact) AS impact, any_value(risk_aversion) AS risk_aversion,").replace("GROUP BY order_id)", "GROUP BY order_id, method)") + """) g LEFT JOIN (SELECT instrument_id, session_date, coalesce(stddev_pop(r), 0) AS session_volatility, CAST(sum(volume) AS BIGINT) AS session_volume FROM (
 SELECT *, ln(vwap / lag(vwap) OVER (PARTITION BY instrument_id, session_date ORDER BY minute)) AS r FROM c_hour) GROUP BY 1, 2) v USING (instrument_id, session_date)""")
cte("c_gridcomplete", "SELECT * FROM c_grid WHERE order_id NOT IN (SELECT order_id FROM c_grid WHERE status <> 'ok')")


def grid(spark, d):
    """One summary per session, side, size, impact, risk aversion and method."""
    h = hour_bars(spark, d)
    sessions = H.session_volatility(h)
    wanted = sessions.select("instrument_id", "session_date")
    wanted = wanted.unionByName(wanted.select(F.lit("gone").alias("instrument_id"), "session_date").distinct())
    b = X.prepare_window(X.experiment_grid(wanted, **GRID), h)
    b = b.join(hour_shares(spark, d).select("instrument_id", "session_date", "minute", "share"), ["instrument_id", "session_date", "minute"], "left")
    carry = ("side", "quantity", "session_vwap", "arrival_price", "instrument_id", "session_date", "impact", "risk_aversion")
    runs = X.run_methods(
        b, ("twap", "vwap", "almgren-chriss", "pov"), half_spread=F.lit(0.01), impact=F.col("impact"), volatility=F.lit(0.01),
        risk_aversion=F.col("risk_aversion"), carry=carry,
    )
    return runs.join(sessions, ["instrument_id", "session_date"], "left")


def grid_complete(spark, d):
    return X.complete_cases(grid(spark, d))


GRID_OUT = f"SELECT method, order_id, status, filled, {money_sql('total_cost', 'completion_rate')}, round(shortfall_bps + 1e-6, 3) AS shortfall_bps"


@query("experiment_grid", f"{GRID_OUT}, session_volume, {money_sql('session_volatility')} FROM c_grid")
def experiment_grid(spark, d):
    return grid(spark, d).select(
        "method", "order_id", "status", "filled", money("total_cost"), money("completion_rate"), rnd(F.col("shortfall_bps") + 1e-6, 3).alias("shortfall_bps"),
        "session_volume", money("session_volatility"),
    )


@query("grid_regimes", """SELECT method, order_id, CASE WHEN session_volume >= (SELECT median(session_volume) FROM c_gridcomplete) THEN 'high' ELSE 'low' END AS liquidity_regime,
  CASE WHEN round(session_volatility, 9) >= (SELECT median(round(session_volatility, 9)) FROM c_gridcomplete) THEN 'high' ELSE 'low' END AS volatility_regime FROM c_gridcomplete""")
def grid_regimes(spark, d):
    r = grid_complete(spark, d).select("method", "order_id", "session_volume", F.round("session_volatility", 9).alias("session_volatility"))
    return X.grid_regimes(r).select("method", "order_id", "liquidity_regime", "volatility_regime")


@query("cost_curve", """SELECT method, quantity, round(avg(total_cost), 4) AS mean_cost, count(*) AS runs FROM c_gridcomplete GROUP BY 1, 2""")
def cost_curve(spark, d):
    return grid_complete(spark, d).groupBy("method", "quantity").agg(rnd(F.avg("total_cost"), 4).alias("mean_cost"), F.count(F.lit(1)).alias("runs"))


@query("method_means", """SELECT method, round(avg(regret), 4) AS mean_regret, round(avg(completion_rate), 6) AS mean_completion, count(DISTINCT (instrument_id, session_date)) AS symbol_dates FROM c_tcaprimary GROUP BY 1""")
def method_means(spark, d):
    return tca_primary(spark, d).groupBy("method").agg(
        rnd(F.avg("regret"), 4).alias("mean_regret"), rnd(F.avg("completion_rate")).alias("mean_completion"),
        F.count_distinct(F.struct("instrument_id", "session_date")).alias("symbol_dates"),
    )


@query("worst_best", """SELECT arg_min(method, m) AS best, arg_max(method, m) AS worst FROM (SELECT method, avg(impact_cost) AS m FROM c_tcaprimary GROUP BY 1)""")
def worst_best(spark, d):
    return X.best_and_worst(tca_primary(spark, d), "impact_cost")
