"""Ticks, bars and orders derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.operators.bars import ticks_to_bars

# The instruments of the event stream and the first session date.
INSTRUMENTS = ("click", "error", "purchase", "signup", "view")
FIRST_SESSION = "2024-01-01"
SESSION_DAYS = 30


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ticks(spark: SparkSession, root: str, *, positive: bool = True) -> DataFrame:
    """``events`` as trades: price is ``value`` and size the ``k`` property."""
    out = table(spark, root, "events").select(
        F.col("event_type").alias("instrument_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("size"),
    )
    return out.where("price > 0") if positive else out


def intraday_bars(spark: SparkSession, root: str, minutes: int = 1) -> DataFrame:
    """Bars of the 24-hour session per instrument and date."""
    t = ticks(spark, root)
    minute = F.hour("ts") * 60 + F.minute("ts")
    return ticks_to_bars(
        t.withColumn("session_date", F.to_date("ts"))
        .withColumn("minute", (minute - minute % minutes).cast("int")),
        by=["instrument_id", "session_date", "minute"],
        order=["ts", "seq"],
    ).withColumn("symbol", F.upper("instrument_id"))


def daily_bars(spark: SparkSession, root: str) -> DataFrame:
    """``lineitem`` as trades of the part's brand, one bar per ship date."""
    li = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.to_date("l_shipdate").alias("session_date"),
    )
    part = table(spark, root, "part").select("p_partkey", F.col("p_brand").alias("instrument_id"))
    trades = li.join(part, li.l_partkey == part.p_partkey).withColumns(
        {"price": F.col("l_extendedprice") / F.col("l_quantity"), "size": F.col("l_quantity").cast("int")}
    )
    return ticks_to_bars(
        trades,
        by=["instrument_id", "session_date"],
        order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    ).withColumn("symbol", F.upper(F.replace(F.col("instrument_id"), F.lit("#"), F.lit("."))))


def instrument_of(key: Column) -> Column:
    """Spread integer keys over the event instruments."""
    names = F.array(*(F.lit(n) for n in INSTRUMENTS))
    return F.element_at(names, (F.pmod(key, F.lit(len(INSTRUMENTS))) + 1).cast("int"))


def parent_orders(spark: SparkSession, root: str) -> DataFrame:
    """``orders`` as parent orders on the event instruments' sessions."""
    k = F.col("o_orderkey")
    return table(spark, root, "orders").select(
        k.alias("order_id"),
        instrument_of(k).alias("instrument_id"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.greatest(F.floor(F.col("o_totalprice") / 1000), F.lit(1)).cast("bigint").alias("quantity"),
        F.date_add(F.lit(FIRST_SESSION).cast("date"), (F.floor(k / 5) % SESSION_DAYS).cast("int")).alias("session_date"),
        (F.lit(240) * (k % 3)).cast("int").alias("start_minute"),
        (F.lit(240) * (k % 3) + 480 + F.lit(60) * (k % 7)).cast("int").alias("end_minute"),
    )


def embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Embedding rows with the array widened to double."""
    return table(spark, root, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
