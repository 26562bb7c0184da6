"""Point-in-time identity: symbols, corporate actions, snapshots, folds, pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.scalar import is_finite, reasons, security_id

# The three expanding evaluation folds.
LOCKED_FOLDS = (
    ("fold-1", "2022-01-03", "2023-12-29", "2024-01-02", "2024-03-28", "2024-04-01", "2024-06-28"),
    ("fold-2", "2022-01-03", "2024-06-28", "2024-07-01", "2024-09-30", "2024-10-01", "2024-12-31"),
    ("fold-3", "2022-01-03", "2024-12-31", "2025-01-02", "2025-06-30", "2025-07-01", "2025-12-31"),
)
FOLD_COLUMNS = (
    "fold_id", "train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end",
)


def folds_table(spark: SparkSession, folds: Sequence[Sequence[str]] = LOCKED_FOLDS) -> DataFrame:
    text = spark.createDataFrame([tuple(f) for f in folds], list(FOLD_COLUMNS))
    return text.select("fold_id", *(F.col(c).cast("date").alias(c) for c in FOLD_COLUMNS[1:]))


def partition_of(d: Column) -> Column:
    """Partition of a date under the fold in the same row, NULL outside it."""
    return (
        F.when(d.between(F.col("train_start"), F.col("train_end")), "train")
        .when(d.between(F.col("validation_start"), F.col("validation_end")), "validation")
        .when(d.between(F.col("test_start"), F.col("test_end")), "test")
    )


def fold_partition(df: DataFrame, folds: DataFrame, date: str = "session_date") -> DataFrame:
    """Each row once per fold that covers its date.

    Folds are a handful of rows: they travel as one array literal instead of a
    join side.
    """
    packed = folds.agg(F.collect_list(F.struct(*FOLD_COLUMNS)).alias("f"))
    return (
        df.select("*", F.inline(packed.scalar()))
        .withColumn("partition", partition_of(F.col(date)))
        .where(F.col("partition").isNotNull())
        .drop(*FOLD_COLUMNS[1:])
    )


def resolve_symbol(observed: DataFrame, intervals: DataFrame) -> DataFrame:
    """Status of each observed ``(instrument_id, session_date, symbol)``.

    The bars are first reduced to sessions, so the interval join works on
    calendar-sized groups whatever the bar counts are.
    """
    sessions = observed.select("instrument_id", "session_date", "symbol").distinct()
    iv = intervals.select("instrument_id", F.upper("symbol").alias("sourced"), "start", "end")
    hit = (
        (sessions.instrument_id == iv.instrument_id)
        & (iv.start <= sessions.session_date)
        & (sessions.session_date <= iv.end)
    )
    return (
        sessions.join(iv, hit, "left")
        .groupBy(sessions.instrument_id, "session_date", "symbol")
        .agg(F.count("sourced").alias("matches"), F.min("sourced").alias("sourced"))
        .withColumn(
            "status",
            F.when(F.col("matches") == 0, "none")
            .when(F.col("matches") > 1, "ambiguous")
            .when(F.col("sourced") != F.upper("symbol"), "mismatch")
            .otherwise("ok"),
        )
    )


def check_actions(actions: DataFrame) -> DataFrame:
    """Typed corporate actions with the violations of each row."""
    typed = actions.select(
        "instrument_id",
        F.col("effective_date").try_cast("date").alias("effective_date"),
        F.col("available_at").try_cast("timestamp_ntz").alias("available_at"),
        F.col("factor").try_cast("double").alias("factor"),
        "source",
    )
    copies = typed.groupBy("instrument_id", "effective_date").agg(F.count(F.lit(1)).alias("_copies"))
    return (
        typed.join(copies, ["instrument_id", "effective_date"], "left")
        .withColumn(
            "violations",
            reasons(
                (F.col("effective_date").isNull() | F.col("available_at").isNull(), "date"),
                (~is_finite("factor") | (F.col("factor") <= 0), "factor"),
                (F.coalesce(F.trim("source"), F.lit("")) == "", "source"),
                (F.col("_copies") > 1, "duplicate"),
            ),
        )
        .drop("_copies")
    )


def split_factor(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Product of the factors known *and* effective for each session, 1 when none.

    ``sessions`` carries ``observed_at`` and ``as_of``; the two clocks stay
    separate conditions of one equi join on the instrument.
    """
    a = actions.select(F.col("instrument_id").alias("_id"), "effective_date", "available_at", "factor")
    known = (
        (sessions.instrument_id == a._id)
        & (a.available_at <= sessions.as_of)
        & (a.effective_date.cast("timestamp_ntz") <= sessions.observed_at)
    )
    return (
        sessions.join(a, known, "left")
        .groupBy("instrument_id", "session_date")
        .agg(F.coalesce(F.product("factor"), F.lit(1.0)).alias("split_factor"))
    )


def split_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices over the factor, volume times it; ``vwap * volume`` is unchanged."""
    joined = bars.join(factors, ["instrument_id", "session_date"], "left")
    f = F.coalesce("split_factor", F.lit(1.0))
    adjusted = joined.select(
        *(c for c in bars.columns if c not in ("open", "high", "low", "close", "vwap", "volume")),
        *((F.col(c) / f).alias(c) for c in ("open", "high", "low", "close", "vwap")),
        (F.col("volume") * f).alias("volume"),
        (F.col("vwap") * F.col("volume")).alias("_dollar"),
    )
    gap = F.abs(F.col("vwap") * F.col("volume") - F.col("_dollar"))
    return adjusted.withColumn(
        "notional_preserved", gap <= F.lit(1e-8) + F.lit(1e-12) * F.abs("_dollar")
    ).drop("_dollar")


def snapshot_asof(history: DataFrame, at: str) -> DataFrame:
    """Membership rows in force and already recorded at an instant."""
    t = F.lit(at).cast("timestamp_ntz")
    return history.where(
        (F.col("date_added") <= t)
        & (F.col("created_at") <= t)
        & (F.col("date_removed").isNull() | (F.col("date_removed") > t))
    ).select(
        security_id("cik", "symbol").alias("instrument_id"), "cik", F.upper("symbol").alias("symbol")
    )


def symbol_intervals(history: DataFrame, at: str, target_end: str) -> DataFrame:
    """Alias intervals of every snapshot member; later symbols only for single-class CIKs."""
    members = snapshot_asof(history, at).distinct()
    classes = members.groupBy("cik").agg(
        F.count(F.lit(1)).alias("classes"), F.min("instrument_id").alias("instrument_id")
    )
    later = (
        history.where(
            (F.col("created_at") > F.lit(at).cast("timestamp_ntz"))
            & (F.col("created_at") <= F.lit(target_end).cast("timestamp_ntz"))
        )
        .join(classes.where("classes = 1").select("cik", "instrument_id"), "cik")
        .select("instrument_id", F.upper("symbol").alias("symbol"), F.col("created_at").alias("at"))
    )
    changes = members.select("instrument_id", "symbol", F.lit(at).cast("timestamp_ntz").alias("at")).unionByName(later)
    first = changes.groupBy("instrument_id", F.to_date("at").alias("start"), "symbol").agg(F.min("at").alias("at"))
    # of several symbols on one date only the last keeps a non-empty interval
    per_day = first.groupBy("instrument_id", "start").agg(F.max_by("symbol", F.struct("at", "symbol")).alias("symbol"))
    nxt = F.lead("start").over(Window.partitionBy("instrument_id").orderBy("start"))
    return (
        per_day.withColumn("end", F.coalesce(F.date_sub(nxt, 1), F.lit(target_end).cast("date")))
        .where("start <= end")
        .select("instrument_id", "symbol", "start", "end")
    )


def alias_gaps(instruments: DataFrame, sessions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Instrument sessions that do not have exactly one sourced symbol."""
    dates = sessions.agg(F.collect_list("session_date").alias("d"))
    grid = instruments.select("instrument_id", F.explode(dates.scalar()).alias("session_date"))
    iv = intervals.select(F.col("instrument_id").alias("_id"), "start", "end")
    hit = (grid.instrument_id == iv._id) & F.col("session_date").between(iv.start, iv.end)
    return (
        grid.join(iv, hit, "left")
        .groupBy("instrument_id", "session_date")
        .agg(F.count("_id").alias("symbols"))
        .where("symbols <> 1")
    )


def overlap_check(intervals: DataFrame) -> DataFrame:
    """Intervals that start on or before the end of the one before them.

    The neighbour is found inside the start month; the first interval of a
    month looks at the last one of the previous month that has any. A crowded
    instrument therefore spreads over its months.
    """
    order = ["start", "end", "symbol"]
    rows = intervals.select("instrument_id", *order, F.trunc("start", "MM").alias("_month"))
    inside = Window.partitionBy("instrument_id", "_month").orderBy(*order)
    months = rows.groupBy("instrument_id", "_month").agg(F.max(F.struct(*order)).alias("_last"))
    carried = months.select(
        "instrument_id",
        "_month",
        F.lag(F.col("_last.end")).over(Window.partitionBy("instrument_id").orderBy("_month")).alias("_carried"),
    )
    prior = F.coalesce(F.lag("end").over(inside), F.when(F.row_number().over(inside) == 1, F.col("_carried")))
    return (
        rows.join(carried, ["instrument_id", "_month"])
        .withColumn("prior_end", prior)
        .where("start <= prior_end")
        .select("instrument_id", *order, "prior_end")
    )


def align_benchmark(tokens: DataFrame, benchmark: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Instrument tokens with the benchmark's values at the same token."""
    b = benchmark.select("session_date", "token", *(F.col(c).alias(f"benchmark_{c}") for c in columns))
    return tokens.join(b, ["session_date", "token"])


def benchmark_exclusions(tokens: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Sessions the benchmark does not cover."""
    s = tokens.select("instrument_id", "session_date").distinct()
    return s.join(benchmark.select("session_date").distinct(), "session_date", "left_anti")


def join_by_sample(samples: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Samples with their embedding and whether it is missing or repeated."""
    copies = embeddings.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )
    return samples.join(copies, "sample_id", "left").withColumn(
        "status",
        F.when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "duplicate").otherwise("ok"),
    )


def complete_case(
    rows: DataFrame, *, baseline: str, candidate: str, value: str, identity: Sequence[str], method: str = "method"
) -> DataFrame:
    """Both methods of each identity side by side from a single aggregation."""
    m = F.col(method)
    pick = lambda which: F.max(F.when(m == which, F.col(value)))
    have = lambda which: F.count(F.when(m == which, 1))
    return (
        rows.where(m.isin(baseline, candidate))
        .groupBy(*identity)
        .agg(
            pick(baseline).alias("baseline_value"),
            pick(candidate).alias("candidate_value"),
            have(baseline).alias("baseline_rows"),
            have(candidate).alias("candidate_rows"),
        )
        .withColumn("difference", F.col("candidate_value") - F.col("baseline_value"))
    )


def complete_case_counts(cases: DataFrame) -> DataFrame:
    """Matched, dropped and repeated identities of :func:`complete_case`."""
    b, c = F.col("baseline_rows"), F.col("candidate_rows")
    n = lambda cond: F.sum(cond.cast("bigint"))
    return cases.agg(
        F.sum(b).alias("baseline_rows"),
        F.sum(c).alias("candidate_rows"),
        n((b == 1) & (c == 1)).alias("matched_rows"),
        n((b >= 1) & (c == 0)).alias("dropped_baseline_rows"),
        n((b == 0) & (c >= 1)).alias("dropped_candidate_rows"),
        n((b > 1) | (c > 1)).alias("duplicated_identities"),
    )


def pair_strategies(results: DataFrame, *, baseline: str, pair: Sequence[str], value: str) -> DataFrame:
    """Every other strategy against the baseline on the same identity; an identity that a strategy has twice is an error."""
    twice = F.raise_error(F.lit("a strategy repeats an identity")).cast("double")
    only = F.when(F.count(F.lit(1)) == 1, F.max(value)).otherwise(twice)
    base = results.where(F.col("strategy") == baseline).groupBy(*pair).agg(only.alias("baseline_value"))
    other = results.where(F.col("strategy") != baseline).groupBy("strategy", *pair).agg(only.alias("candidate_value"))
    return other.join(base, list(pair)).withColumn(
        "difference", F.col("candidate_value") - F.col("baseline_value")
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a one-to-one expectation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def adv_lookup(cases: DataFrame, adv: DataFrame, fraction: float) -> DataFrame:
    """Order size from the single ADV row of the case; other cases drop out."""
    one = (
        adv.groupBy("instrument_id", "session_date")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("adv20").alias("adv20"))
        .where("_n = 1")
        .drop("_n")
    )
    size = F.bround(F.lit(fraction) * F.col("adv20"), 0).cast("bigint")
    return cases.join(one, ["instrument_id", "session_date"]).withColumn("quantity", F.greatest(F.lit(1), size))


def common_cases(rows: DataFrame, case: Sequence[str], method: str) -> DataFrame:
    """Rows of the cases that every method has."""
    methods = rows.agg(F.count_distinct(method).alias("m"))
    full = rows.groupBy(*case).agg(F.count_distinct(method).alias("_m")).where(F.col("_m") == methods.scalar())
    return rows.join(full.drop("_m"), list(case), "left_semi")
