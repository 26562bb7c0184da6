"""Row cleaning and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.scalar import is_finite, ohlc_broken, reasons, with_session
from barlens.schema import (
    BAR_COLUMNS,
    NUMERIC_COLUMNS,
    PRICE_COLUMNS,
    REQUIRED_VALUES,
    SessionSpec,
    require_columns,
)

SESSION = ("instrument_id", "session_date")

# The reasons a daily bar is rejected for, in the order they are checked.
DAILY_REASONS = {
    "date": "daily timestamp is not an expected XNYS session",
    "finite": "daily values must be finite",
    "price": "daily prices must be positive",
    "activity": "daily volume and trade count must be positive",
    "ohlc": "daily OHLC high/low invariants are violated",
    "identity": "daily stable identity and symbol are required",
}


def regular_hours(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Rows inside the half-open session."""
    return bars.where((F.col("minute") >= 0) & (F.col("minute") < spec.minutes))


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last row per key in ingest order, combined map-side instead of windowed."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(*(F.max_by(c, seq).alias(c) for c in rest))


def clean_bars(raw: DataFrame, spec: SessionSpec, *, seq: str = "seq") -> DataFrame:
    """Canonical bars: projected, upper-case symbol, last duplicate kept, in hours."""
    columns = [c for c in BAR_COLUMNS if c != "instrument_id"]
    require_columns(raw, [*columns, seq])
    ts = F.col("ts")
    if dict(raw.dtypes)["ts"] == "string":
        ts = F.try_to_timestamp("ts")
    canonical = (
        raw.select(*columns, seq).withColumn("symbol", F.upper("symbol")).withColumn("ts", ts)
    )
    return regular_hours(with_session(keep_last(canonical, ["symbol", "ts"], seq), spec), spec)


def slice_bars(bars: DataFrame, symbol: str, date: str, start: int, end: int) -> DataFrame:
    """Bars of one symbol and date with ``start <= minute < end``."""
    if start >= end:
        raise ValueError("start must precede end")
    return bars.where(
        (F.upper("symbol") == symbol.upper())
        & (F.col("session_date") == F.lit(date).cast("date"))
        & (F.col("minute") >= start)
        & (F.col("minute") < end)
    )


def validate_bars(bars: DataFrame) -> DataFrame:
    """Per symbol counts of rule breaks and the overall verdict.

    Sorted timestamps fail to increase exactly where they repeat, so both
    counts come from the rows left after grouping by timestamp.
    """
    nulls = {f"null_{c}": F.sum(F.col(c).isNull().cast("int")) for c in REQUIRED_VALUES}
    per_ts = bars.groupBy("symbol", "ts").agg(
        F.count(F.lit(1)).alias("n"),
        *(v.alias(k) for k, v in nulls.items()),
        F.sum(F.coalesce((F.col("volume") <= 0).cast("int"), F.lit(0))).alias("bad_volume"),
    )
    out = per_ts.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_timestamps"),
        *(F.sum(k).alias(k) for k in nulls),
        F.sum("bad_volume").alias("non_positive_volume_rows"),
    )
    broken = sum((F.col(k) for k in nulls), F.col("duplicate_timestamps") + F.col("non_positive_volume_rows"))
    return out.withColumn("non_increasing_timestamps", F.col("duplicate_timestamps")).withColumn(
        "is_valid", (broken == 0) & (F.col("n_rows") > 0)
    )


def row_flags() -> dict[str, Column]:
    """Value rules of one bar, evaluated inside the scan stage."""
    finite = F.lit(True)
    for c in NUMERIC_COLUMNS:
        finite = finite & is_finite(c)
    price = F.lit(False)
    for c in (*PRICE_COLUMNS, "vwap"):
        price = price | (F.col(c) <= 0)
    return {
        "nonfinite": ~finite,
        "bad_price": finite & price,
        "negative": finite & ((F.col("volume") < 0) | (F.col("trade_count") < 0)),
        "ohlc": finite & ohlc_broken(),
    }


def finite_check(bars: DataFrame) -> DataFrame:
    """Reasons per row; non-finite values short-circuit the other rules."""
    f = row_flags()
    return bars.withColumn(
        "reasons",
        reasons(
            (f["nonfinite"], "nonfinite_bar_values"),
            (f["bad_price"], "nonpositive_price"),
            (f["negative"], "negative_volume_or_trade_count"),
            (f["ohlc"], "invalid_ohlc"),
        ),
    )


def session_facts(bars: DataFrame, keys: Sequence[str] = SESSION, at: str = "minute") -> DataFrame:
    """Per-session counts and value flags; duplicates collapse in a first pass."""
    flags = {k: F.max(v) for k, v in row_flags().items()}
    per_minute = bars.groupBy(*keys, at).agg(
        F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in flags.items())
    )
    return per_minute.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count(at).alias("n_distinct"),
        F.sum(F.when(F.col(at).isNull(), F.col("n")).otherwise(0)).alias("bad_ts"),
        *(F.max(k).alias(k) for k in flags),
    )


def validate_session(bars: DataFrame, expected: int, keys: Sequence[str] = SESSION, at: str = "minute") -> DataFrame:
    """Exclusion reasons per session; a missing minute is a missing row, never zero."""
    facts = session_facts(bars, keys, at)
    return facts.select(
        *keys,
        "n_rows",
        reasons(
            (F.col("bad_ts") > 0, "invalid_timestamp"),
            (F.col("n_rows") - F.col("bad_ts") > F.col("n_distinct"), "duplicate_timestamp"),
            (
                F.col("n_rows") != expected,
                F.concat(F.lit(f"rows_expected_{expected}_got_"), F.col("n_rows").cast("string")),
            ),
            (F.col("nonfinite"), "nonfinite_bar_values"),
            (F.col("bad_price"), "nonpositive_price"),
            (F.col("negative"), "negative_volume_or_trade_count"),
            (F.col("ohlc"), "invalid_ohlc"),
        ).alias("reasons"),
    )


def grid_difference(bars: DataFrame, calendar: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Missing and extra minutes per session against the calendar grid.

    ``calendar`` holds ``session_date, minutes, early_close``; the grid of a
    date is the range ``[0, minutes)``, so membership is a comparison and the
    grid itself never has to be joined.
    """
    seen = bars.select(*keys, "minute").distinct()
    return (
        seen.join(calendar, "session_date", "left")
        .groupBy(*keys)
        .agg(
            F.max("minutes").alias("expected"),
            F.max("early_close").alias("early_close"),
            F.sum((F.col("minute").between(0, F.col("minutes") - 1)).cast("int")).alias("on_grid"),
            F.count(F.lit(1)).alias("observed"),
        )
        .select(
            *keys,
            "expected",
            "early_close",
            (F.col("expected") - F.coalesce("on_grid", F.lit(0))).alias("missing_minutes"),
            (F.col("observed") - F.coalesce("on_grid", F.lit(0))).alias("extra_minutes"),
        )
    )


def validate_exact_grid(bars: DataFrame, calendar: DataFrame, spec: SessionSpec) -> DataFrame:
    """:func:`validate_session` plus exact equality with the calendar's grid."""
    base = validate_session(bars, spec.minutes)
    ids = bars.groupBy(*SESSION).agg(F.min("symbol").alias("_lo"), F.max("symbol").alias("_hi"))
    grid = grid_difference(bars, calendar)
    off = (F.col("missing_minutes") > 0) | (F.col("extra_minutes") > 0)
    extra = reasons(
        (F.col("_lo") != F.col("_hi"), "multiple_symbols"),
        (F.col("expected").isNull(), "not_a_session"),
        (F.col("early_close"), "early_close_excluded"),
        (
            off,
            F.concat(
                F.lit("grid_mismatch(missing="), F.col("missing_minutes").cast("string"),
                F.lit(",extra="), F.col("extra_minutes").cast("string"), F.lit(")"),
            ),
        ),
    )
    return base.join(ids, list(SESSION)).join(grid, list(SESSION)).select(
        *SESSION, "n_rows", "missing_minutes", "extra_minutes",
        F.concat("reasons", extra).alias("reasons"),
    )


def classify_session(observed: Column, early_close: Column, minutes: int = 390) -> Column:
    """Use of a session: primary, labelled robustness, or excluded."""
    return (
        F.when((observed == minutes) & ~early_close, "primary_regular")
        .when(early_close & (observed > 0) & (observed < minutes), "robustness_early_close")
        .otherwise("excluded_incomplete_or_ambiguous")
    )


def validate_daily(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Reasons per daily bar; non-finite values hide the value rules after them."""
    f = row_flags()
    marked = daily.join(
        calendar.select("session_date", F.lit(True).alias("_expected")), "session_date", "left"
    )
    blank = (F.coalesce(F.trim("instrument_id"), F.lit("")) == "") | (F.coalesce(F.trim("symbol"), F.lit("")) == "")
    inactive = ~f["nonfinite"] & ((F.col("volume") <= 0) | (F.col("trade_count") <= 0))
    return marked.withColumn(
        "reasons",
        reasons(
            (F.col("_expected").isNull(), DAILY_REASONS["date"]),
            (f["nonfinite"], DAILY_REASONS["finite"]),
            (f["bad_price"], DAILY_REASONS["price"]),
            (inactive, DAILY_REASONS["activity"]),
            (f["ohlc"], DAILY_REASONS["ohlc"]),
            (~f["nonfinite"] & blank, DAILY_REASONS["identity"]),
        ),
    ).drop("_expected")


def duplicate_valid_days(validated: DataFrame) -> DataFrame:
    """Identities that occur more than once among the valid daily bars."""
    return (
        validated.where(F.size("reasons") == 0)
        .groupBy("instrument_id", "session_date")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def order_valid(orders: DataFrame) -> DataFrame:
    """Normalised parent orders with their violations."""
    symbol = F.upper(F.trim("symbol"))
    side = F.lower(F.trim("side"))
    quantity = F.col("quantity").cast("double")
    return orders.withColumns({"symbol": symbol, "side": side}).withColumn(
        "violations",
        reasons(
            (F.col("symbol").isNull() | (F.col("symbol") == ""), "symbol"),
            (~F.col("side").isin("buy", "sell"), "side"),
            (quantity.isNull() | (quantity <= 0) | (quantity != F.floor(quantity)), "quantity"),
            (F.col("start_minute") >= F.col("end_minute"), "window"),
        ),
    )


def normalize_chunk(response: DataFrame, instrument_id: str | Column, symbol: str | Column, spec: SessionSpec) -> DataFrame:
    """Provider rows cut to regular hours and stamped with the requested identity."""
    iid = F.lit(instrument_id) if isinstance(instrument_id, str) else instrument_id
    sym = F.lit(symbol) if isinstance(symbol, str) else symbol
    hours = regular_hours(with_session(response, spec), spec)
    return hours.withColumns({"instrument_id": iid, "symbol": F.upper(sym)})


def check_available(rows: DataFrame, keys: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Counts of point-in-time breaks in a feature table."""
    dup = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("available_at") > F.col("as_of")).cast("int")).alias("late"),
        F.sum((F.col("target_at") < F.col("as_of")).cast("int")).alias("early_target"),
    )
    null_id = F.lit(False)
    for k in keys:
        null_id = null_id | F.col(k).isNull()
    out = dup.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("features_after_as_of"),
        F.coalesce(F.sum("early_target"), F.lit(0)).alias("targets_before_as_of"),
        F.coalesce(F.sum(F.when(null_id, F.col("n")).otherwise(0)), F.lit(0)).alias("null_identities"),
    )
    if expected_rows is None:
        return out
    return out.withColumn("row_count_matches", F.col("rows") == expected_rows)


def check_forecast(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of the forecast invariants, one row per forecast.

    Columns: ``bucket, generated_bucket, expected_volume, share,
    expected_total, cutoff, session_date``.
    """
    close = lambda a, b: F.abs(a - b) <= F.lit(1e-8) * F.greatest(F.lit(1.0), F.abs(b))
    g = forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum((F.col("bucket") < F.col("generated_bucket")).cast("int")).alias("past"),
        F.sum((~is_finite("expected_volume") | (F.col("expected_volume") < 0)).cast("int")).alias("bad_volume"),
        F.sum("expected_volume").alias("total"),
        F.max("expected_total").alias("declared"),
        F.sum("share").alias("shares"),
        F.max(F.abs("share")).alias("largest"),
        F.max((F.col("cutoff") >= F.col("session_date")).cast("int")).alias("leak"),
    )
    return g.select(
        *keys,
        "buckets",
        reasons(
            (F.col("past") > 0, "past_bucket"),
            (F.col("bad_volume") > 0, "bad_volume"),
            (~close(F.col("total"), F.col("declared")), "total_mismatch"),
            (~(close(F.col("shares"), F.lit(1.0)) | (F.col("largest") == 0)), "shares_not_normalised"),
            (F.col("leak") == 1, "cutoff_not_before_session"),
        ).alias("violations"),
    )


def check_tokens(tokens: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Sequence invariants from the long token table: order, contiguity, cutoff."""
    w = Window.partitionBy(*keys).orderBy("token")
    stepped = tokens.withColumns(
        {
            "_gap": F.col("token") - F.coalesce(F.lag("token").over(w), F.lit(-1)) != 1,
            "_back": F.coalesce(F.col("available_minute") <= F.lag("available_minute").over(w), F.lit(False)),
        }
    )
    return stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.max("_gap").alias("has_gap"),
        F.max("_back").alias("availability_not_increasing"),
        F.max(F.coalesce(F.col("cutoff") >= F.col("session_date"), F.lit(False))).alias("cutoff_leak"),
    )


def check_samples(samples: DataFrame) -> DataFrame:
    """Per sample: context strictly before the as-of token, targets at or after it."""
    return samples.withColumns(
        {
            "context_ok": (F.col("context_start") >= 0)
            & (F.col("context_start") < F.col("context_end"))
            & (F.col("context_end") <= F.col("as_of_token")),
            "targets_ok": F.forall("target_indices", lambda i: i >= F.col("as_of_token")),
            "any_target": F.exists("target_mask", lambda m: m),
        }
    )


def check_embedding(rows: DataFrame, size: int, required: Sequence[str] = ()) -> DataFrame:
    """Violations of each embedding row: size, finiteness, metadata, cutoff."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    pairs = [(F.size("embedding") != size, "size"), (bad, "nonfinite")]
    pairs += [(F.col(c).isNull(), f"missing_{c}") for c in required]
    if {"cutoff", "session_date"} <= set(rows.columns):
        pairs.append((F.col("cutoff") >= F.col("session_date"), "cutoff_not_before_session"))
    return rows.withColumn("violations", reasons(*pairs))


def check_folds(membership: DataFrame, folds: DataFrame) -> DataFrame:
    """Fold membership against the fold's own dates, and the fold's chronology."""
    from barlens.operators.identity import partition_of

    once = membership.groupBy("fold_id", "instrument_id", "session_date").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("partition").alias("_lo"),
        F.max("partition").alias("_hi"),
    )
    joined = once.join(folds, "fold_id", "left").withColumn("_due", partition_of(F.col("session_date")))
    wrong = F.col("_due").isNull() | (F.col("_lo") != F.col("_due")) | (F.col("_hi") != F.col("_due"))
    ordered = (
        (F.col("train_end") < F.col("validation_start"))
        & (F.col("validation_end") < F.col("test_start"))
    )
    return joined.groupBy("fold_id").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
        F.sum(F.when(wrong, F.col("copies")).otherwise(0)).alias("partition_mismatches"),
        F.min(F.coalesce(ordered, F.lit(False))).alias("chronological"),
    )
