"""Streams with state: late rows, order of arrival, and what state forgets."""

import datetime as dt
import math

import numpy as np

from barlens.session import scratch_path
from barlens.streaming import jobs as S
from barlens.streaming import stateful

DAY = dt.date(2024, 1, 2)


def at(hour, minute=0, second=0):
    return dt.datetime(2024, 1, 2, hour, minute, second)


def ticks(spark, path, parts):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for n, rows in enumerate(parts):
        spark.createDataFrame([(i, t, 1, "a", v, '{"k": 2}') for i, t, v in rows], schema).coalesce(1).write.parquet(f"{path}/part={n}")
    return S.stream_ticks(spark, f"{path}/part=*", files_per_trigger=1)


def test_late_trades_are_counted_and_are_those_that_tokens_miss(spark):
    # a batch is judged by the watermark that the one before it ran with
    parts = [[(1, at(0, 10), 5.0), (2, at(0, 11), 7.0)], [(3, at(3), 9.0)], [(8, at(0, 10, 40), 6.0)], [(4, at(0, 10, 30), 99.0), (5, at(2, 45), 8.0), (6, at(2, 46), 8.5)], [(7, at(8), 1.0)]]
    path = scratch_path(spark, "late")
    stream = ticks(spark, path, parts)
    late, metrics = S.run_late(stream, "30 minutes", "late")
    assert [r.seq for r in late.collect()] == [4]
    assert sorted(tuple(r)[:3] for r in metrics.collect()) == [(0, 2, 0), (1, 1, 0), (2, 1, 0), (3, 3, 1), (4, 1, 0)]
    got = {r.token_start.hour: r for r in S.run_available(S.stream_tokens(S.stream_ticks(spark, f"{path}/part=*", files_per_trigger=1), "1 hour", "30 minutes"), "tokens").collect()}
    assert set(got) == {0, 2}, "a token needs two bars"
    assert (got[0].high, got[0].trades, got[0].observed) == (7.0, 3, 2)
    assert abs(got[0].realized_volatility - math.log(7.0 / 6.0)) < 1e-12 and got[2].trades == 2


def test_volatility_over_any_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(i, at(0) + dt.timedelta(minutes=7 * i, seconds=int(rng.integers(0, 59))), float(v)) for i, v in enumerate(rng.lognormal(size=60))]
    for parts in ([rows], [rows[:20], rows[20:21], rows[21:50], rows[50:]]):
        stream = ticks(spark, scratch_path(spark, "vol"), parts)
        with stateful.keyed_state(spark):
            got = S.run_available(stateful.stream_volatility(S.minute_bars(stream, "10 minutes"), width_minutes=60, slide_minutes=30), "vol").collect()
        end = max(t for _, t, _ in rows) - dt.timedelta(minutes=10)
        want = {}
        for k in range(-1, 20):
            start = at(0) + dt.timedelta(minutes=30 * k)
            own = [v for _, t, v in rows if start <= t < start + dt.timedelta(hours=1)]
            if own and start + dt.timedelta(hours=1) <= end:
                want[start] = (len(own), math.sqrt(sum(math.log(b / a) ** 2 for a, b in zip(own, own[1:]))))
        assert {r.window_start: (r.observed, round(r.realized_volatility, 9)) for r in got} == {k: (n, round(v, 9)) for k, (n, v) in want.items()}


def test_requests_wait_for_their_forecast(spark):
    forecast = "instrument_id string, session_date date, ts timestamp, generated_minute int, minutes array<int>, volumes array<double>"
    request = "instrument_id string, session_date date, ts timestamp, now_minute int"
    path = scratch_path(spark, "boundary")
    write = lambda kind, n, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{kind}/n={n}")
    minutes = list(range(600, 640, 5))
    # the request of minute 607 arrives before its forecast; that of 636 has a boundary without a forecast
    write("r", 0, [("a", DAY, at(10, 7), 607), ("a", DAY, at(10, 7), 607)], request)
    write("f", 0, [("a", DAY, at(10, 0), 600, minutes, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 0.0])], forecast)
    write("r", 1, [("a", DAY, at(10, 15), 615), ("a", DAY, at(10, 25), 625), ("a", DAY, at(10, 36), 636), ("b", DAY, at(10, 20), 620)], request)
    write("f", 1, [("a", DAY, at(10, 15), 615, minutes[3:], [5.0, 5.0, 0.0, 0.0, 0.0]), ("b", DAY, at(12, 0), 720, [720], [1.0])], forecast)
    read = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{kind}/n=*")
    with stateful.keyed_state(spark):
        got = S.run_available(stateful.stream_boundary_forecasts(read("f", forecast), read("r", request), update=15, delay="10 minutes"), "answers").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.minute):
        by.setdefault((r.instrument_id, r.now_minute, r.generated_minute), []).append((r.minute, r.expected_volume, round(r.share, 6)))
    assert by == {
        ("a", 607, 600): [(610, 3.0, 0.428571), (615, 4.0, 0.571429), (620, 0.0, 0.0), (625, 0.0, 0.0), (630, 0.0, 0.0), (635, 0.0, 0.0)],
        ("a", 615, 615): [(615, 5.0, 0.5), (620, 5.0, 0.5), (625, 0.0, 0.0), (630, 0.0, 0.0), (635, 0.0, 0.0)],
        ("a", 625, 615): [(625, 0.0, 0.0), (630, 0.0, 0.0), (635, 0.0, 0.0)],
    }
