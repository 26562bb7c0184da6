"""Causal volume forecasts in table form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(df: DataFrame, case: Sequence[str], logit: str, *, valid: Column | None = None, name: str = "share") -> DataFrame:
    """Max-shifted softmax over the valid rows of a case, 0 elsewhere."""
    w = Window.partitionBy(*case)
    x = F.col(logit) if valid is None else F.when(valid, F.col(logit))
    e = F.exp(x - F.max(x).over(w))
    return df.withColumn("_e", e).withColumn(
        name, F.coalesce(F.col("_e") / F.sum("_e").over(w), F.lit(0.0))
    ).drop("_e")


SESSION = ("instrument_id", "session_date")


def session_matrix(bars: DataFrame, minutes: int = 1, keys: Sequence[str] = SESSION) -> DataFrame:
    """Volume per session and bucket, kept long."""
    bucket = F.floor(F.col("minute") / minutes).cast("int")
    return bars.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("volume").alias("volume"))


def _complete_sessions(matrix: DataFrame, buckets: range, keys: Sequence[str]) -> DataFrame:
    """Per session: volumes in request order, whether all are there, and their total."""
    slots = F.sequence(F.lit(buckets.start), F.lit(buckets.stop - 1))
    entries = F.map_from_entries(F.collect_list(F.when(_inside(buckets), F.struct("bucket", "volume"))))
    per = matrix.groupBy(*keys).agg(entries.alias("_m"))
    return per.withColumn("_v", F.transform(slots, lambda b: F.col("_m")[b].cast("double"))).select(
        *keys,
        "_v",
        F.forall("_v", lambda v: v.isNotNull()).alias("_complete"),
        F.aggregate("_v", F.lit(0.0), lambda a, v: a + v).alias("_total"),
    )


def _inside(buckets: range) -> Column:
    return F.col("bucket").between(buckets.start, buckets.stop - 1)


def _combine(estimator: str, values: str, window, alpha: float) -> Column:
    from barlens.operators.history import ewma_of, median_of

    listed = F.collect_list(values).over(window)
    if estimator == "mean":
        return F.avg(values).over(window)
    if estimator == "median":
        return median_of(listed)
    if estimator == "previous":
        return F.try_element_at(listed, F.lit(-1))
    if estimator == "ewma":
        return ewma_of(listed, 1.0 - alpha)
    raise ValueError(f"unknown estimator {estimator!r}")


def _finish(rows: DataFrame, keys: Sequence[str], estimator: str, lookback: int, alpha: float, series: Sequence[str]) -> DataFrame:
    """Combine each bucket's series over the preceding ``lookback`` complete sessions.

    ``_key`` numbers complete sessions; a session that is not complete carries
    the number the next complete one would get, and a NULL value, so that it
    can be forecast without ever becoming history. Sessions without volume keep
    their number but not their value: they use up lookback.
    """
    w = Window.partitionBy(*series).orderBy("_key").rangeBetween(-lookback, -1)
    drawn = rows.withColumns(
        {
            "_shape": _combine(estimator, "_share", w, alpha),
            "expected_total": _combine(estimator, "_total", w, alpha),
            "history_sessions": F.count("_share").over(w),
            "cutoff": F.max(F.when(F.col("_share").isNotNull(), F.col("session_date"))).over(w),
        }
    ).where("_target AND history_sessions > 0")
    mass = F.sum(F.greatest("_shape", F.lit(0.0))).over(Window.partitionBy(*keys))
    share = F.greatest("_shape", F.lit(0.0)) / mass
    return drawn.select(
        *keys,
        "bucket",
        share.alias("share"),
        (F.col("expected_total") * share).alias("expected_volume"),
        "expected_total",
        "history_sessions",
        "cutoff",
        (F.col("history_sessions") < 5).alias("short_history"),
    )


def profile_forecast(
    matrix: DataFrame,
    buckets: range,
    *,
    estimator: str = "mean",
    lookback: int = 20,
    alpha: float = 0.25,
) -> DataFrame:
    """Forecast of every session from the sessions strictly before it.

    All targets are computed together: the history of a bucket is a range
    frame over its own series, so no session is copied to the targets it
    feeds. Sessions without any prior complete session yield no rows.
    """
    keys = list(SESSION)
    sessions = _complete_sessions(matrix, buckets, keys)
    order = Window.partitionBy("instrument_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    slots = sessions.withColumn("_key", F.coalesce(F.sum(F.col("_complete").cast("int")).over(order), F.lit(0)) + 1).select(
        *keys, "_complete", "_total", "_key", F.posexplode("_v").alias("_i", "_volume"), F.lit(True).alias("_target")
    )
    usable = F.col("_complete") & (F.col("_total") > 0)
    rows = slots.withColumns(
        {
            "bucket": F.col("_i") + buckets.start,
            "_share": F.when(usable, F.col("_volume") / F.col("_total")),
            "_total": F.when(usable, F.col("_total")),
        }
    )
    return _finish(rows, keys, estimator, lookback, alpha, ["instrument_id", "bucket"])


def profile_pooled(
    matrix: DataFrame,
    buckets: range,
    *,
    estimator: str = "mean",
    lookback: int = 20,
    alpha: float = 0.25,
) -> DataFrame:
    """One profile per date from the latest sessions of all instruments before it.

    Only the last ``lookback`` complete sessions of a date can ever be used, so
    each date is cut to those before the series are formed; the series then
    grow with the calendar and not with the number of instruments.
    """
    keys = list(SESSION)
    first = matrix.groupBy(*keys).agg(F.min("bucket").alias("_first"))
    sessions = _complete_sessions(matrix, buckets, keys).join(first, keys)
    latest = Window.partitionBy("session_date").orderBy(F.col("_first").desc(), F.col("instrument_id").desc())
    tail = sessions.where("_complete").withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= lookback)
    # at most `lookback` sessions per date are numbered here
    whole = Window.partitionBy(F.lit(0))
    numbered = tail.withColumn(
        "_key", F.row_number().over(whole.orderBy("session_date", "_first", "instrument_id"))
    )
    per_date = numbered.groupBy("session_date").agg(F.count(F.lit(1)).alias("_n"))
    dates = matrix.select("session_date").distinct().join(per_date, "session_date", "left")
    before = whole.orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    targets = dates.select(
        "session_date", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int").alias("_key")
    )
    share = F.when(F.col("_total") > 0, F.col("_volume") / F.col("_total"))
    history = numbered.select(
        "session_date", "_key", "_total", F.posexplode("_v").alias("_i", "_volume")
    ).select(
        "session_date", "_key", (F.col("_i") + buckets.start).alias("bucket"), share.alias("_share"),
        F.when(F.col("_total") > 0, F.col("_total")).alias("_total"), F.lit(False).alias("_target"),
    )
    asked = targets.select(
        "session_date", "_key",
        F.explode(F.sequence(F.lit(buckets.start), F.lit(buckets.stop - 1))).alias("bucket"),
        F.lit(None).cast("double").alias("_share"), F.lit(None).cast("double").alias("_total"),
        F.lit(True).alias("_target"),
    )
    return _finish(history.unionByName(asked), ["session_date"], estimator, lookback, alpha, ["bucket"])


def oracle_forecast(matrix: DataFrame, buckets: range, keys: Sequence[str] = SESSION) -> DataFrame:
    """Realised volumes as a forecast, labelled evaluation-only; needs every bucket."""
    w = Window.partitionBy(*keys)
    inside = matrix.where(_inside(buckets)).withColumns(
        {"_n": F.count(F.lit(1)).over(w), "expected_total": F.sum("volume").over(w)}
    )
    return inside.where(F.col("_n") == len(buckets)).select(
        *keys,
        "bucket",
        F.col("volume").alias("expected_volume"),
        F.coalesce(F.try_divide("volume", "expected_total"), F.lit(0.0)).alias("share"),
        "expected_total",
        F.lit(True).alias("evaluation_only"),
    )


def predictions_to_forecast(rows: DataFrame, case: Sequence[str], prediction: str = "predicted_volume") -> DataFrame:
    """Predictions clipped at zero with shares; a case without volume has zero shares."""
    volume = F.greatest(F.col(prediction), F.lit(0.0))
    total = F.sum(volume).over(Window.partitionBy(*case))
    return rows.withColumns(
        {"expected_volume": volume, "expected_total": total}
    ).withColumn("share", F.when(F.col("expected_total") > 0, F.col("expected_volume") / F.col("expected_total")).otherwise(0.0))


def within_token_profile(bars: DataFrame, cutoff: str, width: int, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Share of each minute inside a token from sessions up to ``cutoff`` only."""
    means = (
        bars.where(F.col("session_date") <= F.lit(cutoff).cast("date"))
        .groupBy(*keys, F.pmod("minute", F.lit(width)).cast("int").alias("minute_in_token"))
        .agg(F.avg("volume").alias("_mean"))
    )
    w = Window.partitionBy(*keys)
    return (
        means.withColumns({"_n": F.count("_mean").over(w), "_sum": F.sum("_mean").over(w)})
        .where((F.col("_n") == width) & (F.col("_sum") > 0))
        .select(*keys, "minute_in_token", (F.col("_mean") / F.col("_sum")).alias("within_share"))
    )


def expand_forecast(tokens: DataFrame, within: DataFrame, *, width: int, minutes: int | None = None, case: Sequence[str]) -> DataFrame:
    """Token shares spread over minutes, cut to the first ``minutes``, renormalised.

    ``tokens`` has the case columns, ``instrument_id``, ``token``, ``share``
    and ``expected_total``.
    """
    spread = tokens.join(within, "instrument_id").withColumn("minute", F.col("token") * width + F.col("minute_in_token"))
    if minutes is not None:
        first = F.min("minute").over(Window.partitionBy(*case))
        spread = spread.withColumn("_f", first).where(F.col("minute") < F.col("_f") + minutes).drop("_f")
    raw = F.col("share") * F.col("within_share")
    w = Window.partitionBy(*case)
    share = raw / F.sum(raw).over(w)
    return spread.select(
        *case, "minute", share.alias("share"), (F.col("expected_total") * share).alias("expected_volume")
    )


def truncate_forecast(forecasts: DataFrame, requests: DataFrame, *, update: int = 15, case: Sequence[str] = SESSION) -> DataFrame:
    """Latest boundary forecast seen from each request, future minutes only."""
    at = requests.withColumn("generated_minute", F.col("now_minute") - F.pmod("now_minute", F.lit(update)))
    hit = at.join(forecasts, [*case, "generated_minute"]).where(F.col("minute") >= F.col("now_minute"))
    w = Window.partitionBy(*case, "now_minute")
    total = F.sum("expected_volume").over(w)
    return hit.select(
        *case, "now_minute", "generated_minute", "minute", "expected_volume",
        F.when(total > 0, F.col("expected_volume") / total).otherwise(0.0).alias("share"),
        total.alias("expected_total"),
    )


def seed_mean_forecast(forecasts: DataFrame, case: Sequence[str], seeds: int = 3) -> DataFrame:
    """Mean of exactly ``seeds`` forecasts of one case and bucket."""
    mean = (
        forecasts.groupBy(*case, "bucket")
        .agg(
            F.avg("expected_volume").alias("expected_volume"),
            F.count_distinct("seed").alias("_seeds"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .where((F.col("_seeds") == seeds) & (F.col("_rows") == seeds))
        .drop("_seeds", "_rows")
    )
    total = F.sum("expected_volume").over(Window.partitionBy(*case))
    return mean.withColumn("expected_total", total).withColumn(
        "share", F.when(F.col("expected_total") > 0, F.col("expected_volume") / F.col("expected_total")).otherwise(0.0)
    )


def share_from_logits(shape: DataFrame, scale: DataFrame, case: Sequence[str]) -> DataFrame:
    """Shares from logits and totals from log residuals around the causal baseline."""
    s = softmax(shape, case, "logit", valid=F.col("valid"))
    total = F.greatest((F.lit(1.0) + F.col("baseline")) * F.exp("residual") - 1.0, F.lit(0.0))
    return s.join(scale.withColumn("expected_total", total), list(case)).withColumn(
        "expected_volume", F.col("expected_total") * F.col("share")
    )
