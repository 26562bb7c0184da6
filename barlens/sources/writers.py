"""Sinks. Each writes with the DataFrame writers and returns what it wrote where useful."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.schema import require_columns
from barlens.sources.readers import KEY


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("mode", "symbol"), *, rows_per_task: int = 1_000_000) -> None:
    """Partitioned Parquet; a value with more rows than a task should write is spread over as many tasks as it needs."""
    hot = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("_tasks")).where("_tasks > 1")
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.coalesce("_tasks", F.lit(1)))
    spread = df.join(hot, list(by), "left").withColumn("_s", salt).repartition(*by, "_s").select(*df.columns)
    spread.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_bars(bars: DataFrame, path: str, *, rows: int = 1_000_000) -> None:
    """Bars for scans by symbol: ordered by the upper-cased symbol, which has Bloom filters, ``rows`` a file at most.

    Rows are dealt by ranges of symbol and time, so a symbol of any size spreads over as many files as it fills.
    """
    keyed = bars.withColumn(KEY, F.upper("symbol"))
    order = [KEY, *(["ts"] if "ts" in bars.columns else [])]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows).option(
        f"parquet.bloom.filter.enabled#{KEY}", "true"
    ).parquet(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Session sequences by year and instrument, zstd compressed."""
    dated = sequences.withColumn("year", F.year("session_date"))
    dated.repartition("year", "instrument_id").write.option("compression", "zstd").partitionBy("year", "instrument_id").parquet(path)


def write_csv_manifest(manifest: DataFrame, path: str) -> None:
    """Small manifest (a row per symbol) as CSV with a header."""
    manifest.write.csv(path, header=True)


def write_results(results: DataFrame, aggregate: DataFrame, paired: DataFrame, config: DataFrame, path: str) -> None:
    """Experiment outputs: results and the two summary tables, plus the configuration."""
    results.write.parquet(f"{path}/results")
    aggregate.write.csv(f"{path}/aggregate", header=True)
    paired.write.csv(f"{path}/paired", header=True)
    config.write.json(f"{path}/config")


def universe_json(members: DataFrame, exclusions: DataFrame, size: int) -> DataFrame:
    """One JSON row of the ranked members and exclusions with an identity hash.

    ``members`` has exactly ``size`` rows (checked here, with ranks 1..size);
    exclusions are counted per reason, so both lists are bounded.
    """
    listed = F.sort_array(F.collect_list(F.struct("rank", "instrument_id", "liquidity_group")))
    m = members.agg(
        listed.alias("members"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("rank").alias("ranks"),
        F.min("rank").alias("lo"),
        F.max("rank").alias("hi"),
    )
    ok = (F.col("n") == size) & (F.col("ranks") == size) & (F.col("lo") == 1) & (F.col("hi") == size)
    checked = F.when(ok, F.col("members")).otherwise(
        F.raise_error(F.lit("universe must hold ranks 1..N exactly once")).cast(m.schema["members"].dataType)
    )
    why = exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("reason", "n"))).alias("e")
    ).scalar()
    out = m.select(checked.alias("members")).withColumn("exclusions", why)
    identity = F.sha2(F.to_json("members"), 256)
    return out.withColumn("identity", identity).select(
        "identity", F.to_json(F.struct("members", "exclusions")).alias("manifest")
    )


def write_universe(members: DataFrame, exclusions: DataFrame, size: int, path: str) -> None:
    universe_json(members, exclusions, size).write.json(path)


# The report tables and the columns each must carry.
REPORT_TABLES: Mapping[str, tuple[str, ...]] = {
    "dataset_folds_exclusions": ("fold_id", "partition", "included", "excluded"),
    "representation_accessibility": ("geometry", "horizon", "capacity", "mean_error"),
    "forecasting": ("method", "seed", "as_of_token", "log_remaining_volume_mae", "conditional_curve_error"),
    "execution": ("method", "baseline", "mean_difference", "matched_cases"),
}


def write_report_tables(tables: Mapping[str, DataFrame], path: str, required: Mapping[str, Sequence[str]] = REPORT_TABLES) -> None:
    """All required tables with their columns, as Parquet and JSON."""
    absent = sorted(set(required) - set(tables))
    if absent:
        raise ValueError(f"missing report tables: {absent}")
    for name, columns in required.items():
        df = require_columns(tables[name], columns)
        df.write.parquet(f"{path}/{name}.parquet")
        # the JSON copy is taken from the written table, not computed again
        df.sparkSession.read.parquet(f"{path}/{name}.parquet").write.json(f"{path}/{name}.json")


def numbered_members(members: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ranks 1..N of an already limited member list."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
