"""Structured Streaming counterparts of the batch operators.

Each function takes a streaming DataFrame of trades (``instrument_id, ts, seq,
price, size``, with ``ts`` a TIMESTAMP) and returns a streaming DataFrame. State
is bounded by the watermark everywhere but in :func:`stream_quality`, whose
state is one counter row per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barlens.operators.bars import order_key
from barlens.session import scratch_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_ticks(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream of trades with a positive price."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).where("value > 0").select(
        F.col("event_type").alias("instrument_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("size"),
    )


def minute_bars(ticks: DataFrame, delay: str) -> DataFrame:
    """Minute bars, emitted once the watermark has passed their end; later trades are dropped (see :func:`run_late`).

    ``ts`` is the last instant of the minute: what later operators take for the bar's event time.
    """
    first = order_key(ticks, ["ts", "seq"])
    size = F.sum(F.col("size").cast("bigint"))
    made = ticks.withWatermark("ts", delay).groupBy("instrument_id", F.window("ts", "1 minute")).agg(
        F.min_by("price", first).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", first).alias("close"),
        size.alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(F.try_divide(F.sum(F.col("price") * F.col("size")), F.when(size > 0, size)), F.avg("price")).alias("vwap"),
    )
    return made.select("instrument_id", F.window_time("window").alias("ts"), F.col("window.start").alias("minute_start"), "open", "high", "low", "close", "volume", "trade_count", "vwap")


def stream_tokens(ticks: DataFrame, width: str, delay: str, *, min_obs: int = 2) -> DataFrame:
    """Token bars as :func:`barlens.operators.bars.token_bars` makes them, emitted once the watermark has passed their end.

    Trades become minute bars first, so a token holds no more than its minutes; tokens without ``min_obs`` bars or volume go.
    """
    closes = F.transform(F.array_sort(F.collect_list(F.struct("minute_start", F.ln("close").alias("c")))), lambda x: x["c"])
    tokens = minute_bars(ticks, delay).groupBy("instrument_id", F.window("ts", width)).agg(
        F.min_by("open", "minute_start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "minute_start").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trades"),
        F.sum(F.col("vwap") * F.col("volume")).alias("_dollar"),
        closes.alias("_closes"),
        F.count(F.lit(1)).alias("observed"),
    )
    n = F.size("_closes")
    squares = F.zip_with(F.slice("_closes", F.lit(2), n), F.slice("_closes", F.lit(1), n - 1), lambda b, a: (b - a) * (b - a))
    return tokens.where((F.col("observed") >= min_obs) & (F.col("volume") > 0)).select(
        "instrument_id", F.col("window.start").alias("token_start"), "open", "high", "low", "close", "volume", "trades",
        (F.col("_dollar") / F.col("volume")).alias("vwap"), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x)).alias("realized_volatility"), "observed",
    )


def stream_dedupe(ticks: DataFrame, delay: str, keys: tuple[str, ...] = ("instrument_id", "seq")) -> DataFrame:
    """First copy of each trade within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_quality(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running observation counts per session (update mode); a session's state goes ``delay`` after its end."""
    counted = ticks.withWatermark("ts", delay).groupBy("instrument_id", F.window("ts", "1 day").alias("_day")).agg(
        F.count(F.lit(1)).alias("observed"),
        F.sum((F.col("size") <= 0).cast("bigint")).alias("empty_trades"),
        F.max("ts").alias("last_ts"),
    )
    return counted.select("instrument_id", F.to_date("_day.start").alias("session_date"), "observed", "empty_trades", "last_ts")


def stream_gap_sessions(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of trades without a gap of ``gap`` or more."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("instrument_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("trades"))
        .select("instrument_id", F.col("session_window.start").alias("run_start"), F.col("session_window.end").alias("run_end"), "trades")
    )


def stream_profile_join(ticks: DataFrame, profile: DataFrame, *, token_minutes: int) -> DataFrame:
    """Each trade with the static forecast of its token (``instrument_id, session_date, bucket``)."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    placed = ticks.withColumns(
        {"session_date": F.to_date("ts"), "bucket": F.floor(minute / token_minutes).cast("int")}
    )
    return placed.join(profile, ["instrument_id", "session_date", "bucket"])


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there in append mode and return the written rows."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Process what is there in update mode and return the last row of every key.

    A batch writes its own folder and overwrites it when it is replayed, so a
    retried batch cannot leave copies.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest))


def run_late(ticks: DataFrame, delay: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The trades that :func:`minute_bars` drops, and ``(batch, rows, late, max_ts)`` for each batch.

    Runs beside the query that makes the bars, on the same batches. A trade is late if its minute ended no later than the
    watermark that the batch before ran with: the latest time of the batches before that one, less ``delay``. Counts are observed while the late rows are written; a
    batch that is replayed overwrites its own files.
    """
    spark = ticks.sparkSession
    path = scratch_path(spark, label)
    kept = "rows bigint, late bigint, max_ts timestamp, batch int"
    spark.range(0).select(F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("late"), F.lit(None).cast("timestamp").alias("max_ts")).write.parquet(f"{path}/metrics/batch=-1")
    spark.createDataFrame([], ticks.schema).write.parquet(f"{path}/late/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(kept).parquet(f"{path}/metrics").where(F.col("batch") < number - 1).agg(F.max("max_ts")).first()[0]
        mark = F.date_trunc("millisecond", F.lit(before) - F.expr(f"INTERVAL {delay}"))
        late = F.coalesce(F.window("ts", "1 minute")["end"] <= mark, F.lit(False)) if before else F.lit(False)
        seen = Observation()
        marked = batch.withColumn("_late", late).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"), F.max("ts").alias("max_ts"))
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        got = seen.get
        row = spark.range(1).select(F.lit(got["rows"]).cast("bigint").alias("rows"), F.lit(got["late"]).cast("bigint").alias("late"), F.lit(got["max_ts"]).cast("timestamp").alias("max_ts"))
        row.write.mode("overwrite").parquet(f"{path}/metrics/batch={number}")

    query = ticks.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    metrics = spark.read.schema(kept).parquet(f"{path}/metrics").where("batch >= 0")
    return spark.read.schema(ticks.schema).parquet(f"{path}/late").select(*ticks.columns), metrics.select("batch", "rows", "late", "max_ts")
