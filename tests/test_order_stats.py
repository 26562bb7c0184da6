"""Radix order statistics against NumPy, and what formation does with repeated deliveries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.operators import universe as U
from barlens.operators.order_stats import quantiles


def test_quantiles_of_any_doubles(spark):
    rng = np.random.default_rng(3)
    data = {
        "hot": rng.lognormal(size=5000).round(2).tolist(),
        "signs": [-1e300, -2.5, -0.0, 0.0, 3e-310, 1e300],
        "one": [7.25],
        "ties": [4.0] * 50 + [5.0] * 50,
        None: rng.normal(size=101).tolist(),
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r for r in quantiles(df, ["k"], "v", {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 1.0}).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        want = np.quantile(vs, [0.0, 0.25, 0.5, 1.0])
        assert [got[k].lo, got[k].q, got[k].m, got[k].hi] == pytest.approx(want.tolist(), rel=1e-12), k
    assert quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    whole = quantiles(df.select("v"), [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median([v for vs in data.values() for v in vs]))


def test_no_median_of_bars_in_one_aggregate(spark):
    bars = spark.createDataFrame([("a", "2024-01-02", 1.0, 1.0, 2)], "instrument_id string, session_date string, close double, vwap double, volume int")
    quality = bars.select("instrument_id", "session_date", F.lit(True).alias("minute_exact_full_session"))
    snap = bars.select("instrument_id", F.col("instrument_id").alias("symbol"), F.lit(U.COMMON).alias("security_type"))
    out = U.formation_stats(snap, bars, quality, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "median(close" not in plan and "percentile(close" not in plan
    assert out.first().median_price == 1.0


def test_a_session_delivered_twice_is_an_error(spark):
    bars = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-02")], "instrument_id string, session_date string")
    assert U.delivered_once(bars, bars.limit(0)).count() == 2
    with pytest.raises(Exception, match="delivered by more than one file: b 2024-01-02"):
        U.delivered_once(bars, bars.where("instrument_id = 'b'")).collect()


def test_a_repeated_day_counts_with_its_first_valid_row(spark):
    schema = "instrument_id string, session_date date, close double, volume bigint, vwap double, seq int, reasons array<string>"
    day = __import__("datetime").date(2024, 1, 2)
    rows = [("a", day, 9.0, 10, 9.5, 2, []), ("a", day, 8.0, 30, 8.5, 1, []), ("a", day, 1.0, 1, 1.0, 0, ["bad"])]
    snap = spark.createDataFrame([("a", "a", U.COMMON)], "instrument_id string, symbol string, security_type string")
    r = U.daily_formation(snap, spark.createDataFrame(rows, schema), 1, ingest="seq").first()
    assert (r.median_daily_price, r.median_daily_share_volume, r.median_daily_dollar_volume) == (8.0, 30.0, 255.0)
    assert "duplicate_daily_observation" in r.exclusion_reasons
