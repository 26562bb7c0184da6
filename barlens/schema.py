"""Canonical schemas and the session grid they live on."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The column names and types of the provider schema.
BAR_SCHEMA = T.StructType(
    [
        T.StructField("instrument_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("trade_count", T.LongType()),
        T.StructField("vwap", T.DoubleType()),
    ]
)
BAR_COLUMNS = tuple(BAR_SCHEMA.fieldNames())
PRICE_COLUMNS = ("open", "high", "low", "close")
NUMERIC_COLUMNS = ("open", "high", "low", "close", "volume", "trade_count", "vwap")
REQUIRED_VALUES = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class SessionSpec:
    """A trading session: local minutes since midnight, zone and token width."""

    open_minute: int = 570
    close_minute: int = 960
    tz: str = "America/New_York"
    token_minutes: int = 15
    min_obs: int = 2

    @property
    def minutes(self) -> int:
        return self.close_minute - self.open_minute

    @property
    def tokens(self) -> int:
        return self.minutes // self.token_minutes


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail naming every absent column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
