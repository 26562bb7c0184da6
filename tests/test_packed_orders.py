"""Packed orders give what bucket rows give, without a window, a sort or a shuffle by order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlens.operators import execution as X

DAY = dt.date(2024, 1, 2)


def packed(spark):
    bars = spark.createDataFrame(
        [("a", DAY, m, 10.0, 11.0, 9.0, 10.5, 10.2, 7 * (1 + m % 3), float(m % 4)) for m in range(60, 72)] + [("empty", DAY, 300, 10.0, 11.0, 9.0, 10.5, 10.2, 5, 1.0)],
        "instrument_id string, session_date date, minute int, open double, high double, low double, close double, vwap double, volume bigint, share double",
    )
    orders = [(f"{i}-{q}-{e}", i, DAY, "buy", q, 60, e) for i in ("a", "empty", "gone") for q in (1, 5, 29, 60, 100000) for e in (61, 65, 72)]
    orders = spark.createDataFrame(orders, "order_id string, instrument_id string, session_date date, side string, quantity bigint, start_minute int, end_minute int")
    return X.packed_window(orders, bars, extra=("share",))


PLANS = {
    "even": lambda b: X.largest_remainder(b, value=lambda at: F.try_divide(at("quantity"), at("n")), capacity=lambda at: F.floor(at("volume") / 2), target="quantity"),
    "vwap": X.vwap_schedule,
    "oracle": lambda b: X.oracle_vwap_schedule(b, allow_evaluation_only=True),
    "almgren": lambda b: X.almgren_chriss_schedule(b, eta=F.lit(1e-6), volatility=F.lit(0.01), risk_aversion=F.lit(0.00137)),
}


@pytest.mark.parametrize("name", PLANS)
def test_packed_plans_equal_row_plans(spark, name):
    p = packed(spark)
    out = ["order_id", "k", "planned", "status"]
    got = PLANS[name](p)
    rows = sorted(map(tuple, X.unpack(got).select(*out).collect()), key=repr)
    assert rows == sorted(map(tuple, PLANS[name](X.unpack(p)).select(*out).collect()), key=repr)
    assert {r[0] for r in rows} == {r.order_id for r in p.collect()}
    filled = X.unpack(got).where("status = 'ok'").groupBy("order_id", "quantity").agg(F.sum("planned").alias("s"))
    assert filled.count() > 0 and filled.where("s IS DISTINCT FROM quantity").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_leftovers_go_to_free_room_in_order(spark):
    # floors of 0.4 are 0: one unit each for the five fractions, the other four to free room in order
    p = packed(spark).where("order_id = 'a-29-65'").withColumn("quantity", F.lit(9).cast("bigint"))
    got = X.largest_remainder(p, value=lambda at: F.lit(0.4), capacity=lambda at: F.lit(3).cast("bigint"), target="quantity").first()
    assert [b.planned for b in got.buckets] == [3, 3, 1, 1, 1]


def test_packed_log_equals_row_log(spark):
    p = packed(spark)
    log = lambda b: X.execution_log(X.fill_cost(X.static_fills(X.vwap_schedule(b), 0.5), half_spread=F.lit(0.01), impact=F.lit(0.5)), forecast="share")
    out = ["order_id", "minute", "planned", "executed", "cumulative_executed", "cumulative_cost", "inventory_before", "inventory_after", "participation", "timing_cost", "volume_vs_forecast", "status"]
    a, b = (sorted(map(tuple, log(x).select(*out).collect()), key=repr) for x in (p, X.unpack(p)))
    assert a == b and len(a) > 50
