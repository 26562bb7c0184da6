"""Session quality at minute, token and execution-window resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.scalar import reasons
from barlens.operators.clean import SESSION, row_flags
from barlens.schema import NUMERIC_COLUMNS, SessionSpec


def token_grid(bars: DataFrame, spec: SessionSpec, keys: Sequence[str] = SESSION) -> DataFrame:
    """Observed bars and volume per token that has any."""
    return (
        bars.where(F.col("minute").between(0, spec.minutes - 1))
        .groupBy(*keys, F.floor(F.col("minute") / spec.token_minutes).cast("int").alias("token"))
        .agg(F.count(F.lit(1)).alias("observed"), F.sum("volume").alias("volume"))
    )


def token_counts(bars: DataFrame, spec: SessionSpec, keys: Sequence[str] = SESSION) -> DataFrame:
    """Dense token counts per session, empty tokens included."""
    counts = token_grid(bars, spec, keys)
    m = F.map_from_entries(F.collect_list(F.struct("token", "observed")))
    slots = F.sequence(F.lit(0), F.lit(spec.tokens - 1))
    return (
        counts.groupBy(*keys)
        .agg(m.alias("_m"))
        .withColumn("counts", F.transform(slots, lambda t: F.coalesce(F.col("_m")[t], F.lit(0).cast("bigint"))))
        .select(*keys, F.posexplode("counts").alias("token", "observed"))
        .withColumn("gap", F.lit(spec.token_minutes) - F.col("observed"))
    )


def session_quality(
    bars: DataFrame,
    spec: SessionSpec,
    *,
    calendar: DataFrame | None = None,
    window: tuple[int, int] = (60, 360),
    keys: Sequence[str] = SESSION,
) -> DataFrame:
    """Independent quality facts of every observed session.

    Bars are reduced map-side to runs of up to 60 minutes: which minutes were
    seen is one bit mask per run, so distinct minutes need no row per minute
    and copies of a bar cannot pile up behind one key. Runs merge to tokens and
    tokens to sessions. Only the first aggregate reads bar-sized data, and all
    its buffers are fixed-width.
    """
    flags = row_flags()
    lo, hi = window
    run = max(g for g in range(1, 61) if spec.token_minutes % g == 0)
    bars = bars.select(*keys, "minute", "symbol", *NUMERIC_COLUMNS)
    if calendar is not None:
        cal = calendar.select("session_date", F.col("minutes").alias("_minutes"), "early_close")
        bars = bars.join(cal, "session_date", "left")
    else:
        bars = bars.withColumns({"_minutes": F.lit(spec.minutes), "early_close": F.lit(False)})
    on_grid = F.coalesce(F.col("minute").between(0, F.col("_minutes") - 1), F.lit(False))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("minute", F.lit(run)).cast("int"))
    masks = {
        "seen": bit,
        "on_grid": F.when(on_grid, bit),
        "in_window": F.when(F.col("minute").between(lo, hi - 1), bit),
    }
    per_run = bars.groupBy(*keys, "symbol", F.floor(F.col("minute") / run).cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("volume").alias("volume"),
        F.sum(F.when(on_grid, 0).otherwise(1)).alias("off_grid"),
        F.max("_minutes").alias("_minutes"),
        F.max("early_close").alias("early_close"),
        *(F.bit_or(m).alias(k) for k, m in masks.items()),
        *(F.max(v).alias(k) for k, v in flags.items()),
    )
    # one row per run again, whatever the symbols say
    whole = per_run.groupBy(*keys, "run").agg(
        F.sum("n").alias("n"),
        F.sum("volume").alias("volume"),
        F.sum("off_grid").alias("off_grid"),
        F.max("_minutes").alias("_minutes"),
        F.max("early_close").alias("early_close"),
        F.min("symbol").alias("lo"),
        F.max("symbol").alias("hi"),
        *(F.bit_count(F.coalesce(F.bit_or(k), F.lit(0).cast("bigint"))).alias(k) for k in masks),
        *(F.max(k).alias(k) for k in flags),
    )
    first = F.col("run") * run
    in_spec = first.between(0, spec.minutes - 1)
    per_token = whole.groupBy(*keys, F.when(in_spec, F.floor(first / spec.token_minutes).cast("int")).alias("token")).agg(
        F.sum("n").alias("n"),
        F.sum("volume").alias("volume"),
        F.sum("seen").alias("distinct_minutes"),
        F.sum("on_grid").alias("on_grid"),
        F.sum("off_grid").alias("off_grid"),
        F.sum("in_window").alias("in_window"),
        F.max("_minutes").alias("_minutes"),
        F.max("early_close").alias("early_close"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *(F.max(k).alias(k) for k in flags),
    )
    token_ok = F.col("token").isNotNull() & (F.col("n") >= spec.min_obs) & (F.col("volume") > 0)
    s = per_token.groupBy(*keys).agg(
        F.sum("n").alias("observed_minute_count"),
        F.sum("distinct_minutes").alias("_distinct"),
        F.sum("on_grid").alias("_on_grid"),
        F.sum("off_grid").alias("_off_grid"),
        F.sum("in_window").alias("_in_window"),
        F.max("_minutes").alias("_minutes"),
        F.max("early_close").alias("early_close"),
        F.min("lo").alias("_lo"),
        F.max("hi").alias("symbol"),
        F.sum(token_ok.cast("int")).alias("_valid_tokens"),
        # bounded: one entry per token of the session
        F.sort_array(
            F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "n", "volume")))
        ).alias("_tokens"),
        *(F.max(k).alias(k) for k in flags),
    )
    structural = reasons(
        (F.col("observed_minute_count") > F.col("_distinct"), "duplicate_timestamp"),
        (F.col("_lo") != F.col("symbol"), "multiple_symbols"),
        (F.col("nonfinite"), "nonfinite_bar_values"),
        (F.col("bad_price"), "nonpositive_price"),
        (F.col("negative"), "negative_volume_or_trade_count"),
        (F.col("ohlc"), "invalid_ohlc"),
        (F.col("_off_grid") > 0, F.concat(F.lit("off_grid_minutes:"), F.col("_off_grid").cast("string"))),
    )
    slots = F.sequence(F.lit(0), F.lit(spec.tokens - 1))
    label = lambda t: F.lpad(t.cast("string"), 2, "0")
    held = F.map_from_entries(
        F.transform("_tokens", lambda e: F.struct(e["token"], F.struct(e["n"].alias("n"), e["volume"].alias("v"))))
    )
    few = F.transform(
        F.filter(slots, lambda t: F.coalesce(F.col("_held")[t]["n"], F.lit(0).cast("bigint")) < spec.min_obs),
        lambda t: F.concat(F.lit("token_"), label(t), F.lit(f"_observed_bars_lt_{spec.min_obs}")),
    )
    dry = F.transform(
        F.filter(
            slots,
            lambda t: (F.coalesce(F.col("_held")[t]["n"], F.lit(0).cast("bigint")) >= spec.min_obs)
            & (F.col("_held")[t]["v"] <= 0),
        ),
        lambda t: F.concat(F.lit("token_"), label(t), F.lit("_nonpositive_volume")),
    )
    none = F.array().cast("array<string>")
    s = s.withColumn("_structural", structural).withColumn("_held", held)
    clean = F.size("_structural") == 0
    s = s.withColumn(
        "_reasons",
        F.concat(
            "_structural",
            F.when(F.col("early_close"), F.array(F.lit(f"early_close_not_primary_{spec.tokens}_token_session")))
            .when(clean, F.concat(few, dry))
            .otherwise(none),
        ),
    )
    counts = F.transform(slots, lambda t: F.coalesce(F.col("_held")[t]["n"], F.lit(0).cast("bigint")))
    counts = F.when(F.col("early_close"), F.array().cast("array<bigint>")).otherwise(counts)
    valid = F.when(clean & ~F.col("early_close"), F.col("_valid_tokens")).otherwise(0)
    return s.select(
        *keys,
        "symbol",
        (clean & (F.col("_on_grid") == F.col("_minutes")) & (F.col("observed_minute_count") == F.col("_minutes"))).alias(
            "minute_exact_full_session"
        ),
        ((F.size("_reasons") == 0) & (valid == spec.tokens)).alias("token_valid_full_session"),
        (clean & (F.col("_in_window") == hi - lo)).alias("tca_window_exact"),
        "early_close",
        (F.col("_minutes") - F.col("_on_grid")).cast("bigint").alias("provider_gap_count"),
        "observed_minute_count",
        valid.cast("bigint").alias("valid_token_count"),
        F.array_join("_reasons", ";").alias("invalid_token_reason"),
        counts.alias("token_observed_bar_counts"),
        F.transform(counts, lambda c: F.lit(spec.token_minutes) - c).alias("token_provider_gap_counts"),
    )


def scan_receipt(quality: DataFrame) -> DataFrame:
    """Totals of a quality scan."""
    flag = lambda c: F.sum(F.col(c).cast("bigint"))
    return quality.agg(
        F.sum("observed_minute_count").alias("minute_rows"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("valid_token_count").alias("valid_tokens"),
        flag("minute_exact_full_session").alias("minute_exact"),
        flag("token_valid_full_session").alias("token_valid"),
        flag("tca_window_exact").alias("window_exact"),
        flag("early_close").alias("early_closes"),
        F.sum("provider_gap_count").alias("gaps"),
    )


def grid_fill(quality: DataFrame, instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every instrument on every expected session; absent ones get a marked record.

    The calendar is folded into one bounded array (one entry per session date)
    and exploded per instrument.
    """
    dates = calendar.agg(
        F.sort_array(F.collect_list(F.struct("session_date", "minutes", "early_close"))).alias("d")
    )
    grid = instruments.select("instrument_id", F.inline(dates.scalar()))
    q = quality.drop("early_close", "symbol")
    filled = grid.join(q, ["instrument_id", "session_date"], "left")
    absent = F.col("observed_minute_count").isNull()
    no = F.lit(False)
    return filled.select(
        "instrument_id",
        "session_date",
        "early_close",
        F.coalesce("minute_exact_full_session", no).alias("minute_exact_full_session"),
        F.coalesce("token_valid_full_session", no).alias("token_valid_full_session"),
        F.coalesce("tca_window_exact", no).alias("tca_window_exact"),
        F.when(absent, F.col("minutes")).otherwise(F.col("provider_gap_count")).alias("provider_gap_count"),
        F.coalesce("observed_minute_count", F.lit(0)).alias("observed_minute_count"),
        F.coalesce("valid_token_count", F.lit(0)).alias("valid_token_count"),
        F.when(absent, "missing_provider_session").otherwise(F.col("invalid_token_reason")).alias("invalid_token_reason"),
    )


def daily_counts(bars: DataFrame, spec: SessionSpec, keys: Sequence[str] = ("session_date",)) -> DataFrame:
    """Bars per date and whether the day is full."""
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("bar_count")).withColumn(
        "is_full_day", F.col("bar_count") == spec.minutes
    )


def bar_manifest(bars: DataFrame, symbols: DataFrame, spec: SessionSpec) -> DataFrame:
    """Coverage per symbol; a symbol without bars is a row of zeros."""
    days = bars.groupBy("symbol", "session_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("minute").alias("first_minute"),
        F.max("minute").alias("last_minute"),
    )
    stats = days.groupBy("symbol").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("days"),
        F.sum((F.col("n") == spec.minutes).cast("bigint")).alias("full_days"),
        F.min("session_date").alias("min_date"),
        F.max("session_date").alias("max_date"),
        F.min_by("first_minute", "session_date").alias("first_minute"),
        F.max_by("last_minute", "session_date").alias("last_minute"),
    )
    return symbols.select("symbol").join(stats, "symbol", "left").fillna(0, ["rows", "days", "full_days"])


def exclusion_ledger(*stages: DataFrame) -> DataFrame:
    """``(instrument_id, session_date, stage, reason)`` rows of every rejecting stage."""
    out = None
    for s in stages:
        part = s.select("instrument_id", "session_date", "stage", F.explode("reasons").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out
