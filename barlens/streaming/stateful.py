"""Streaming jobs with keyed state and event-time timers.

A row changes state when it arrives, but nothing is answered before the watermark has passed the time it stands for: only then
is it sure what came before it. State holds what later answers need and goes with the timers that need it last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BAR = np.dtype([("at", "<i8"), ("high", "<f8"), ("low", "<f8"), ("close", "<f8"), ("volume", "<i8")])


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the state store that keyed state and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class BoundaryForecasts(StatefulProcessor):
    """Answers each request of a session from the forecast of the last boundary; see :func:`stream_boundary_forecasts`."""

    def __init__(self, update: int) -> None:
        self.update = update

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "generated int", "minutes array<int>, volumes array<double>")
        self.asked = handle.getMapState("asked", "at bigint", "now int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for b in rows:
            for r in b.itertuples(index=False):
                if r.now_minute is None or math.isnan(r.now_minute):
                    self.known.updateValue((int(r.generated_minute),), ([int(m) for m in r.minutes], [float(v) for v in r.volumes]))
                    timers.add(int(r.forget_ms))
                else:
                    self.asked.updateValue((int(r.at_ms),), (int(r.now_minute),))
                    timers.add(int(r.at_ms))
        for at in timers:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        asked = self.asked.getValue((at,)) if self.asked.exists() and self.asked.containsKey((at,)) else None
        if asked is None:
            self.known.clear()
            return
        self.asked.removeKey((at,))
        now = asked[0]
        generated = now - now % self.update
        # later requests look at this boundary or a later one
        for (old,) in [k for k in self.known.keys() if k[0] < generated] if self.known.exists() else []:
            self.known.removeKey((old,))
        if self.known.exists() and self.known.containsKey((generated,)):
            minutes, volumes = self.known.getValue((generated,))
            ahead = sorted((m, v) for m, v in zip(minutes, volumes) if m >= now)
            total = sum(v for _, v in ahead)
            if ahead:
                yield pd.DataFrame(
                    {
                        "instrument_id": key[0], "session_date": key[1], "now_minute": now, "generated_minute": generated,
                        "minute": [m for m, _ in ahead], "expected_volume": [v for _, v in ahead],
                        "share": [v / total if total > 0 else 0.0 for _, v in ahead], "expected_total": total,
                    }
                )

    def close(self) -> None:
        pass


def stream_boundary_forecasts(forecasts: DataFrame, requests: DataFrame, *, update: int = 15, delay: str, keep: str = "1 day") -> DataFrame:
    """What :func:`barlens.operators.forecast.truncate_forecast` returns, from a stream of forecasts and one of requests.

    ``forecasts`` has ``instrument_id, session_date, ts, generated_minute, minutes, volumes``, one row for each forecast with the
    time it was made; ``requests`` has ``instrument_id, session_date, ts, now_minute``. A request is answered once the watermark
    has passed it, so a forecast that arrives later than its requests still counts; it sees the forecast of its boundary only,
    future minutes only, with shares that add up to one again. Equal requests are answered once, those without a forecast not
    at all. A session's last forecast is forgotten ``keep`` after it was made.
    """
    given = forecasts.select(
        "instrument_id", "session_date", "ts", F.col("generated_minute").cast("int").alias("generated_minute"), "minutes", "volumes",
        F.lit(None).cast("int").alias("now_minute"), F.lit(None).cast("bigint").alias("at_ms"), F.unix_millis(F.col("ts") + F.expr(f"INTERVAL {keep}")).alias("forget_ms"),
    )
    asked = requests.select(
        "instrument_id", "session_date", "ts", F.lit(None).cast("int").alias("generated_minute"), F.lit(None).cast("array<int>").alias("minutes"),
        F.lit(None).cast("array<double>").alias("volumes"), F.col("now_minute").cast("int").alias("now_minute"), F.unix_millis("ts").alias("at_ms"), F.lit(None).cast("bigint").alias("forget_ms"),
    )
    return given.unionByName(asked).withWatermark("ts", delay).groupBy("instrument_id", "session_date").transformWithStateInPandas(
        statefulProcessor=BoundaryForecasts(update),
        outputStructType="instrument_id string, session_date date, now_minute int, generated_minute int, minute int, expected_volume double, share double, expected_total double",
        outputMode="Append",
        timeMode="EventTime",
    )


class RealizedVolatility(StatefulProcessor):
    """Closes of the last ``width`` milliseconds in order, looked at every ``slide``; see :func:`stream_volatility`."""

    def __init__(self, width: int, slide: int) -> None:
        self.width, self.slide = width, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one packed value, since each timer looks at all of it
        self.bars = handle.getValueState("bars", "packed binary")

    def held(self) -> np.ndarray:
        return np.frombuffer(self.bars.get()[0], BAR) if self.bars.exists() else np.empty(0, BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, ends = [self.held()], set()
        for b in rows:
            made = np.empty(len(b), BAR)
            for name in BAR.names:
                made[name] = b[name].to_numpy()
            new.append(made)
            first = (made["at"] // self.slide + 1) * self.slide
            ends.update(int(e) for back in range(-(-self.width // self.slide)) for e in np.unique(first[first + back * self.slide <= made["at"] + self.width]) + back * self.slide)
        self.bars.update((np.sort(np.concatenate(new), order="at").tobytes(),))
        for end in ends:
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        held = self.held()
        own = held[(held["at"] >= end - self.width) & (held["at"] < end)]
        rest = held[held["at"] >= end - self.width + self.slide]
        if not len(rest):
            self.bars.clear()
        elif len(rest) < len(held):
            self.bars.update((rest.tobytes(),))
        if len(own):
            steps = np.diff(np.log(own["close"]))
            yield pd.DataFrame(
                {
                    "instrument_id": [key[0]], "window_start": [pd.Timestamp(end - self.width, unit="ms")], "volume": [int(own["volume"].sum())],
                    "price_range": [float(own["high"].max() - own["low"].min())],
                    "realized_volatility": [math.sqrt(math.fsum(steps * steps))], "observed": [len(own)],
                }
            )

    def close(self) -> None:
        pass


def stream_volatility(bars: DataFrame, *, width_minutes: int, slide_minutes: int) -> DataFrame:
    """Volume, price range and realised volatility of the last ``width_minutes``, every ``slide_minutes``.

    ``bars`` are the closed minute bars of :func:`barlens.streaming.jobs.minute_bars`, so a key's state is bounded by the minutes
    of a window and not by its trades. A window is answered when the watermark passes its end; bars that no later window holds
    expire with it.
    """
    return bars.select("instrument_id", "ts", F.unix_millis("minute_start").alias("at"), "high", "low", "close", "volume").groupBy("instrument_id").transformWithStateInPandas(
        statefulProcessor=RealizedVolatility(width_minutes * 60_000, slide_minutes * 60_000),
        outputStructType="instrument_id string, window_start timestamp, volume bigint, price_range double, realized_volatility double, observed bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
