"""Comparisons of methods keep every order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlens.operators import execution as X

DAY = dt.date(2024, 1, 2)


def bars(spark):
    schema = "instrument_id string, session_date date, minute int, open double, high double, low double, close double, vwap double, volume bigint"
    rows = [(i, DAY, m, 10.0, 11.0, 9.0, 10.5, 10.2, 100 * (1 + m % 3)) for i in ("a", "noshare") for m in range(60, 80)]
    rows += [("late", DAY, m, 10.0, 11.0, 9.0, 10.5, 10.2, 100) for m in range(300, 310)]
    rows += [("twice", DAY, 61, 10.0, 11.0, 9.0, 10.5, 10.2, 100)] * 2 + [("bad", DAY, 61, -1.0, 11.0, 9.0, 10.5, 10.2, 100)]
    return spark.createDataFrame(rows, schema)


def test_every_case_has_a_row_of_every_method(spark):
    cases = spark.createDataFrame([(i, DAY, "buy", 1000.0) for i in ("a", "noshare", "late", "twice", "bad", "gone")], "instrument_id string, session_date date, side string, adv20 double")
    shares = spark.createDataFrame([("a", DAY, m, 0.05) for m in range(60, 80)], "instrument_id string, session_date date, minute int, share double")
    runs = X.tca_cases(bars(spark), cases, ("twap", "vwap", "pov"), shares, start=60, end=80)
    got = {(r.instrument_id, r.order_fraction, r.method): r for r in runs.collect()}
    assert len(got) == 6 * 3 * 3 == runs.count()
    status = {"a": "ok", "noshare": "ok", "late": "empty_window", "twice": "duplicate_minutes", "bad": "bad_bars", "gone": "no_session"}
    for (i, f, m), r in got.items():
        want = "no_forecast" if (i, m) == ("noshare", "vwap") else status[i]
        assert (r.status, r.quantity, r.filled > 0) == (want, max(1, round(1000 * f)), want == "ok"), (i, f, m)
        assert r.completion_rate == r.filled / r.quantity and r.unfilled == r.quantity - r.filled
    complete = {(r.instrument_id, r.method) for r in X.complete_cases(runs).collect()}
    assert complete == {("a", "twap"), ("a", "vwap"), ("a", "pov")}


def test_risk_and_volatility_are_asked_for(spark):
    b = X.prepare_window(spark.createDataFrame([("o", "a", DAY, "sell", 50, 60, 80)], "order_id string, instrument_id string, session_date date, side string, quantity int, start_minute int, end_minute int"), bars(spark))
    with pytest.raises(ValueError, match="volatility"):
        X.run_methods(b, ("almgren-chriss",), half_spread=F.lit(0.0), impact=F.lit(0.1))
    runs = X.run_methods(b, ("almgren-chriss",), half_spread=F.lit(0.0), impact=F.lit(0.1), volatility=F.lit(0.02), risk_aversion=F.lit(0.5))
    assert runs.first().status == "ok"


def test_methods_of_equal_cost_are_told_apart_by_name(spark):
    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last bit
    costs = {"vwap": (0.1, 0.2, 0.3), "twap": (0.3, 0.2, 0.1), "pov": (0.05, 0.05, 0.05), "none": (None,)}
    runs = spark.createDataFrame([(m, c) for m, cs in costs.items() for c in cs], "method string, impact_cost double").coalesce(1)
    assert tuple(X.best_and_worst(runs, "impact_cost").first()) == ("pov", "twap")
    assert tuple(X.best_and_worst(runs.where("method <> 'pov'"), "impact_cost").first()) == ("twap", "twap")
    assert tuple(X.best_and_worst(runs.where("method = 'none'"), "impact_cost").first()) == (None, None)
