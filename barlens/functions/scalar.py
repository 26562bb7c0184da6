"""Scalar column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.schema import PRICE_COLUMNS, SessionSpec


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ln(x: Column | str) -> Column:
    """``ln`` that is NULL outside its domain."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def is_finite(x: Column | str) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def side_sign(side: Column | str) -> Column:
    """+1 for buys, -1 for sells, an error for anything else."""
    side = col(side)
    return (
        F.when(side == "buy", F.lit(1))
        .when(side == "sell", F.lit(-1))
        .otherwise(F.raise_error(F.lit("side must be 'buy' or 'sell'")).cast("int"))
    )


def slippage_bps(price: Column, benchmark: Column, sign: Column) -> Column:
    """Signed basis points against a benchmark; NULL without a usable benchmark."""
    return F.when(
        price.isNotNull() & (benchmark > 0), F.lit(10000.0) * sign * (price - benchmark) / benchmark
    )


def reference_price(vwap: str = "vwap", ohlc: Sequence[str] = PRICE_COLUMNS) -> Column:
    """VWAP where usable, else the mean of open, high, low and close."""
    mean = sum((F.col(c) for c in ohlc[1:]), F.col(ohlc[0])) / F.lit(len(ohlc))
    return F.when(is_finite(vwap) & (F.col(vwap) > 0), F.col(vwap)).otherwise(mean)


def ohlc_broken() -> Column:
    """True when high or low contradicts the other prices of the bar."""
    return (F.col("high") < F.greatest("open", "close", "low")) | (
        F.col("low") > F.least("open", "close", "high")
    )


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in pairs)))


def calendar_fields(d: Column | str) -> dict[str, Column]:
    """Weekday (Monday 0), month and period-end flags of a date."""
    d = col(d)
    end = F.last_day(d) == d
    return {
        "weekday": F.weekday(d),
        "month": F.month(d),
        "is_month_end": end,
        "is_quarter_end": end & (F.month(d) % 3 == 0),
    }


def month_chunks(start: Column | str, end: Column | str) -> Column:
    """Array of ``(chunk_start, chunk_end)`` covering an inclusive range month by month."""
    start, end = col(start), col(end)
    months = F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month"))
    return F.when(
        start <= end,
        F.transform(
            months,
            lambda m: F.struct(
                F.greatest(m, start).alias("chunk_start"),
                F.least(F.last_day(m), end).alias("chunk_end"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<chunk_start:date,chunk_end:date>>"))


def security_id(cik: Column | str, symbol: Column | str) -> Column:
    """Stable identity of a share class."""
    return F.concat(
        F.lit("sec-cik-"),
        F.lpad(col(cik).cast("string"), 10, "0"),
        F.lit("-"),
        F.replace(F.upper(col(symbol)), F.lit("."), F.lit("-")),
    )


def hash_id(*parts: Column | str, length: int = 20, sep: str = "|") -> Column:
    """Prefix of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *(col(p).cast("string") for p in parts)), 256), 1, length)


def hash_index(key: Column, size: Column) -> Column:
    """Deterministic draw in ``[0, size)``: the leading 60 bits of SHA-256 modulo size."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("bigint"), size)


def right_align(values: Column, width: int) -> Column:
    """Last ``width`` elements, padded on the left with zeros."""
    tail = F.slice(values, F.greatest(F.size(values) - width + 1, F.lit(1)), width)
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(tail), F.lit(0)))
    return F.concat(pad, tail)


def right_align_mask(values: Column, width: int) -> Column:
    """Validity of each slot of :func:`right_align`."""
    n = F.least(F.size(values), F.lit(width))
    return F.transform(
        F.sequence(F.lit(1), F.lit(width)), lambda i: i > (F.lit(width) - n)
    )


def with_session(df: DataFrame, spec: SessionSpec, ts: str = "ts") -> DataFrame:
    """Add ``session_date`` and ``minute`` (minutes since the open) in the session's zone."""
    local = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        local = F.convert_timezone(F.lit(zone), F.lit(spec.tz), local.cast("timestamp_ntz"))
    return df.withColumn("session_date", F.to_date(local)).withColumn(
        "minute", F.hour(local) * 60 + F.minute(local) - F.lit(spec.open_minute)
    )


def rnd(x: Column | str, digits: int = 6) -> Column:
    return F.round(col(x).cast("double"), digits)


def rnd_ratio(x: Column | str, digits: int = 6) -> Column:
    """Rounding for quotients of short decimals, kept off exact half-way ties."""
    return F.round(col(x).cast("double") + F.lit(1e-9), digits)
