"""Building bars: ticks to bars, bars to coarser buckets, bars to tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.schema import SessionSpec, require_columns


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value for several order columns.

    A struct cannot live in a hash aggregation buffer, so ordering by one makes
    Spark sort every task's input first. A (timestamp, integer) pair packs into
    a decimal, which can: the step between two microseconds is wider than the
    range of a bigint.
    """
    if len(order) == 1:
        return F.col(order[0])
    types = dict(df.dtypes)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    instant = types[order[0]] == "timestamp" or (types[order[0]] == "timestamp_ntz" and zone in ("UTC", "Etc/UTC"))
    if len(order) == 2 and instant and types[order[1]] in ("bigint", "int"):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(18,0)")
        step = F.lit("20000000000000000000").cast("decimal(20,0)")
        return (micros * step + F.col(order[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*order)


def ticks_to_bars(ticks: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """OHLCV bars from trades. One shuffle; every aggregate combines map-side.

    ``order`` must order the trades of a bar totally, since rows have no order
    of their own.
    """
    require_columns(ticks, [*by, *order, "price", "size"])
    first = order_key(ticks, order)
    size = F.sum(F.col("size").cast("bigint"))
    return ticks.groupBy(*by).agg(
        F.min_by("price", first).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", first).alias("close"),
        size.alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(
            F.try_divide(F.sum(F.col("price") * F.col("size")), F.when(size > 0, size)), F.avg("price")
        ).alias("vwap"),
    )


def bucket_bars(bars: DataFrame, minutes: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars of 1, 5, 15, ... minutes from bars with a ``ts``."""
    start = F.window("ts", f"{minutes} minutes")["start"]
    return (
        bars.groupBy(*keys, start.alias("ts_bucket"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("trade_count").alias("trade_count"),
        )
        .withColumnRenamed("ts_bucket", "ts")
    )


def bucket_minutes(bars: DataFrame, minutes: int, keys: Sequence[str] = ("instrument_id", "session_date")) -> DataFrame:
    """Same as :func:`bucket_bars` on the session grid: ``bucket`` counts from the open."""
    return bars.groupBy(*keys, F.floor(F.col("minute") / minutes).cast("int").alias("bucket")).agg(
        F.min_by("open", "minute").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "minute").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        (F.sum(F.col("vwap") * F.col("volume")) / F.when(F.sum("volume") > 0, F.sum("volume"))).alias("vwap"),
    )


def token_bars(
    bars: DataFrame,
    spec: SessionSpec,
    keys: Sequence[str] = ("instrument_id", "session_date"),
    *,
    exact: bool = False,
) -> DataFrame:
    """Fixed-width tokens with the realised volatility inside each token.

    Bars must be unique per (keys, minute), so a token holds at most
    ``token_minutes`` rows and the window stays small. The observed variant
    keeps tokens with ``min_obs`` bars and volume; the exact variant keeps all
    and floors the VWAP denominator at 1.
    """
    token = F.floor(F.col("minute") / spec.token_minutes).cast("int")
    w = Window.partitionBy(*keys, "token").orderBy("minute")
    step = F.ln("close") - F.lag(F.ln("close")).over(w)
    volume = F.sum("volume")
    dollar = F.sum(F.col("vwap") * F.col("volume"))
    out = (
        bars.where(F.col("minute").between(0, spec.minutes - 1))
        .withColumn("token", token)
        .withColumn("_sq", step * step)
        .groupBy(*keys, "token")
        .agg(
            F.min_by("open", "minute").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "minute").alias("close"),
            volume.alias("volume"),
            F.sum("trade_count").alias("trade_count"),
            dollar.alias("dollar_volume"),
            (dollar / (F.greatest(volume, F.lit(1)) if exact else F.when(volume > 0, volume))).alias("vwap"),
            F.sqrt(F.coalesce(F.sum("_sq"), F.lit(0.0))).alias("realized_volatility"),
            F.count(F.lit(1)).alias("observed"),
        )
        .withColumn("token_end_minute", (F.col("token") + 1) * spec.token_minutes)
    )
    return out if exact else out.where((F.col("observed") >= spec.min_obs) & (F.col("volume") > 0))


def session_bars(bars: DataFrame, keys: Sequence[str] = ("instrument_id", "session_date"), at: str = "minute") -> DataFrame:
    """One bar per session from finer bars ordered by ``at``."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        F.max(at).alias(f"last_{at}"),
    )
