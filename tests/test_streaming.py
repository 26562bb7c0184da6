"""Stream behaviour that the batch comparison cannot show."""

import datetime as dt

from barlens.session import scratch_path
from barlens.streaming import jobs as S


def write(spark, path, name, rows):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    full = [(i, dt.datetime(2024, 1, 1, h, m), 1, "a", v, '{"k": 2}') for i, h, m, v in rows]
    spark.createDataFrame(full, schema).coalesce(1).write.parquet(f"{path}/{name}")


def test_late_trades_are_dropped_and_open_tokens_wait(spark):
    path = scratch_path(spark, "late")
    write(spark, path, "part=1", [(1, 0, 10, 5.0), (2, 0, 50, 7.0)])
    write(spark, path, "part=2", [(3, 3, 0, 9.0)])
    write(spark, path, "part=3", [(4, 3, 5, 8.0)])
    # lateness is judged by the watermark of the batch before
    write(spark, path, "part=4", [(5, 0, 30, 99.0), (6, 5, 0, 4.0)])
    stream = S.stream_ticks(spark, f"{path}/part=*", files_per_trigger=1)
    got = {r.token_start.hour: r for r in S.run_available(S.stream_tokens(stream, "1 hour", "30 minutes"), "late").collect()}
    assert set(got) == {0, 3}
    assert (got[0].open, got[0].high, got[0].close, got[0].trades) == (5.0, 7.0, 7.0, 2)


def test_updates_keep_the_latest_count(spark):
    path = scratch_path(spark, "updates")
    write(spark, path, "part=1", [(1, 0, 10, 5.0), (2, 0, 50, 7.0)])
    write(spark, path, "part=2", [(3, 1, 0, 9.0)])
    stream = S.stream_ticks(spark, f"{path}/part=*", files_per_trigger=1)
    got = S.run_updates(S.stream_quality(stream), "updates", ["instrument_id", "session_date"]).collect()
    assert len(got) == 1 and got[0].observed == 3
