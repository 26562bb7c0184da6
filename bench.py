"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Each query runs once to warm the JVM's code and
is then timed to a written result (the noop sink computes every row and column).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

HEADLINE = (
    "clean_bars", "validate_bars", "validate_session", "bucket_bars", "token_agg", "session_quality", "session_quality_hourly",
    "exclusion_ledger", "split_adjust", "daily_formation", "select_universe", "history_features", "seasonal_ewma", "token_features",
    "static_dataset", "dynamic_dataset", "profile_forecast_mean", "profile_forecast_ewma", "twap_schedule", "vwap_schedule",
    "almgren_chriss_schedule", "pov_fills", "execution_log", "tca_summary", "tca_cases", "experiment_grid", "complete_case",
    "block_bootstrap", "regime_thresholds", "empirical_cdf", "distribution_summary", "latent_diagnostics", "sliced_wasserstein",
    "stream_tokens",
)


def minute_rows(spark, instruments: int, days: int):
    """Generated minute bars with gaps, for the rows-per-second figure of the quality scan."""
    n = instruments * days * 390
    i = F.col("id")
    minute = (i % 390).cast("int")
    day = (F.floor(i / 390) % days).cast("int")
    px = F.lit(100.0) + (i % 97) / 100
    return spark.range(n).where(F.pmod(F.xxhash64("id"), F.lit(50)) != 0).select(
        F.concat(F.lit("id-"), F.floor(i / (390 * days)).cast("string")).alias("instrument_id"),
        F.concat(F.lit("S"), F.floor(i / (390 * days)).cast("string")).alias("symbol"),
        F.date_add(F.lit("2021-01-04").cast("date"), day).alias("session_date"),
        minute.alias("minute"),
        px.alias("open"), (px + 0.05).alias("high"), (px - 0.05).alias("low"), px.alias("close"),
        (minute + 1).cast("bigint").alias("volume"), (minute + 2).cast("bigint").alias("trade_count"), px.alias("vwap"),
    )


def main() -> None:
    from barlens.operators.quality import session_quality
    from barlens.plans import load
    from barlens.schema import SessionSpec
    from barlens.session import build_session, scratch_path

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load().QUERIES
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    queries = {}
    for name in HEADLINE:
        run(registry[name](spark, root))
        start = time.perf_counter()
        run(registry[name](spark, root))
        queries[name] = round(time.perf_counter() - start, 3)
    path = scratch_path(spark, "minutes")
    minute_rows(spark, 200, 100).repartition(int(cpus)).write.parquet(path)
    bars = spark.read.parquet(path)
    rows = bars.count()
    run(session_quality(bars, SessionSpec()))
    start = time.perf_counter()
    run(session_quality(bars, SessionSpec()))
    spent = time.perf_counter() - start
    queries["quality_scan_minute_bars"] = round(spent, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
                "sf": os.path.basename(root.rstrip("/")), "quality_scan_rows": rows, "quality_scan_rows_per_sec": round(rows / spent),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
