"""Windows over sessions and tokens.

Groups here are one instrument's sessions, one instrument's values of one
token, or one session's buckets: their length is bounded by the calendar or by
the session grid, never by the number of trades or bars behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.scalar import safe_ln


def adv(daily: DataFrame, sessions: int = 20, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Mean volume of exactly the ``sessions`` days before each day."""
    w = Window.partitionBy(*keys).orderBy("session_date").rowsBetween(-sessions, -1)
    return (
        daily.withColumns({f"adv{sessions}": F.avg("volume").over(w), "_n": F.count("volume").over(w)})
        .where(F.col("_n") == sessions)
        .drop("_n")
    )


def median_of(values: Column) -> Column:
    """Median of a bounded array; windows do not accept ``percentile``."""
    s = F.array_sort(values)
    n = F.size(s)
    lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def history_features(sessions: DataFrame, length: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Facts of the previous sessions, strictly before the session of the row."""
    by = Window.partitionBy(*keys).orderBy("session_date")
    past = by.rowsBetween(-length, -1)
    # the oldest session of the history has no predecessor inside it
    inner = by.rowsBetween(-(length - 1), -1)
    back = lambda c: F.lag(c).over(by)
    step = safe_ln(F.col("close") / back("close"))
    return sessions.withColumn("_r", step).withColumns(
        {
            "history_sessions": F.count("volume").over(past),
            "previous_session_total_volume": back("volume").cast("double"),
            "rolling_adv": F.avg("volume").over(past),
            "rolling_median_volume": median_of(F.collect_list(F.col("volume").cast("double")).over(past)),
            "rolling_volatility": F.coalesce(F.stddev_pop("_r").over(inner), F.lit(0.0)),
            "previous_session_return": safe_ln(back("close") / back("open")),
            "previous_session_range": (back("high") - back("low")) / back("open"),
            "previous_session_trade_count": F.coalesce(back("trade_count"), F.lit(0)).cast("double"),
            "previous_session_date": back("session_date"),
        }
    ).drop("_r")


def intraday_features(buckets: DataFrame, keys: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """What is known when bucket ``k`` opens: only buckets before it are used."""
    by = Window.partitionBy(*keys).orderBy("bucket")
    step = safe_ln(F.col("close") / F.lag("close").over(by))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        buckets.withColumns({"_r": step, "k": F.row_number().over(by) - 1, "n": n})
        .withColumns(
            {
                "elapsed_session_fraction": F.col("k") / F.col("n"),
                "observed_cumulative_volume": F.coalesce(
                    F.sum("volume").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ).cast("double"),
                "recent_bucket_volume": F.lag("volume").over(by).cast("double"),
                "recent_realized_volatility": F.coalesce(
                    F.stddev_pop("_r").over(by.rowsBetween(-5, -1)), F.lit(0.0)
                ),
                "remaining_volume": F.sum("volume").over(by.rowsBetween(0, Window.unboundedFollowing)),
                "session_volume": F.sum("volume").over(Window.partitionBy(*keys)),
                "previous_bucket": F.lag("bucket").over(by),
            }
        )
        .drop("_r")
    )


def ewma_of(values: Column, decay: float) -> Column:
    """Exponentially weighted mean of a bounded array, latest element last."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate(
        values,
        start,
        lambda a, x: F.struct((a["s"] * decay + x).alias("s"), (a["w"] * decay + 1.0).alias("w")),
    )
    return F.try_divide(total["s"], total["w"])


def seasonal_ewma(
    tokens: DataFrame,
    *,
    sessions: int = 20,
    token_count: int,
    keys: Sequence[str] = ("instrument_id",),
    values: Sequence[str] = ("volume", "dollar_volume", "trade_count"),
) -> DataFrame:
    """Per token EWMA of the prior sessions and ADV of their daily totals.

    Sessions must hold all ``token_count`` tokens, so the rows before a token
    in its own series are exactly the preceding sessions. ``previous_close`` is
    the close of the session before, which is known for the first session
    returned too, as it is taken before sessions without history are left out.
    """
    series = Window.partitionBy(*keys, "token").orderBy("session_date").rowsBetween(-sessions, -1)
    decay = 1.0 - 2.0 / (sessions + 1.0)
    whole = tokens.groupBy(*keys, "session_date").agg(
        F.count(F.lit(1)).alias("_tokens"), F.sum("volume").alias("_daily"), F.max_by("close", "token").alias("_close")
    ).where(F.col("_tokens") == token_count)
    days = Window.partitionBy(*keys).orderBy("session_date")
    daily = whole.withColumns(
        {
            "adv20": F.avg("_daily").over(days.rowsBetween(-sessions, -1)),
            "cutoff": F.lag("session_date").over(days),
            "previous_close": F.lag("_close").over(days),
        }
    ).drop("_tokens", "_daily", "_close")
    full = tokens.join(daily, [*keys, "session_date"])
    return full.withColumns(
        {f"expected_{c}": ewma_of(F.collect_list(F.col(c).cast("double")).over(series), decay) for c in values}
    ).where(F.col("cutoff").isNotNull())


FEATURES = (
    "return_to_prior_close", "return_to_open", "high_low_range", "realized_vol", "volume_surprise",
    "dollar_surprise", "trade_surprise", "cumulative_volume_ratio", "volume_to_adv", "surprise_change",
    "vwap_to_prior_close", "log_adv", "time_sin", "time_cos", "time_fraction",
    "benchmark_return", "benchmark_volume_surprise", "benchmark_realized_vol",
)


def token_features(baseline: DataFrame, benchmark: DataFrame, *, token_count: int, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """The 18 causal features of each token.

    ``baseline`` is :func:`seasonal_ewma` output; ``benchmark`` the same for the
    benchmark. Token 0 looks back at the previous session's close for the
    instrument but at the benchmark's own first open.
    """
    by = Window.partitionBy(*keys, "session_date").orderBy("token")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    b = benchmark.select(
        "session_date",
        "token",
        safe_ln(
            F.col("close")
            / F.coalesce(F.lag("close").over(Window.partitionBy("session_date").orderBy("token")), first_open())
        ).alias("benchmark_return"),
        (F.log1p("volume") - F.log1p("expected_volume")).alias("benchmark_volume_surprise"),
        F.col("realized_volatility").alias("benchmark_realized_vol"),
    )
    t = baseline.join(b, ["session_date", "token"])
    prior = F.coalesce(F.lag("close").over(by), F.col("previous_close"))
    surprise = F.log1p("volume") - F.log1p("expected_volume")
    t = t.withColumns({"_prior": prior, "volume_surprise": surprise})
    angle = F.lit(2.0) * F.pi() * (F.col("token") + 0.5) / token_count
    return t.withColumns(
        {
            "return_to_prior_close": safe_ln(F.col("close") / F.col("_prior")),
            "return_to_open": safe_ln(F.col("close") / F.col("open")),
            "high_low_range": safe_ln(F.col("high") / F.col("low")),
            "realized_vol": F.col("realized_volatility"),
            "dollar_surprise": F.log1p("dollar_volume") - F.log1p("expected_dollar_volume"),
            "trade_surprise": F.log1p("trade_count") - F.log1p("expected_trade_count"),
            "cumulative_volume_ratio": F.ln(
                (F.sum("volume").over(run) + 1.0) / (F.sum("expected_volume").over(run) + 1.0)
            ),
            "volume_to_adv": F.log1p(F.col("volume") / F.greatest(F.col("adv20") / token_count, F.lit(1.0))),
            "surprise_change": F.col("volume_surprise") - F.coalesce(F.lag("volume_surprise").over(by), F.lit(0.0)),
            "vwap_to_prior_close": safe_ln(F.col("vwap") / F.col("_prior")),
            "log_adv": F.log1p("adv20"),
            "time_sin": F.sin(angle),
            "time_cos": F.cos(angle),
            "time_fraction": (F.col("token") + 1) / F.lit(token_count),
        }
    ).drop("_prior", "previous_close")


def first_open() -> Column:
    """First open of the session, for the benchmark's opening token."""
    return F.first("open").over(Window.partitionBy("session_date").orderBy("token"))


def prior_mean(tokens: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Mean of all earlier sessions per token and the session's running mean so far."""
    series = Window.partitionBy(*keys, "token").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys, "session_date").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumns(
        {"prior_mean": F.avg("volume").over(series), "observed_mean": F.avg("volume").over(so_far)}
    )


def cumulative_curve(rows: DataFrame, case: Sequence[str], at: str, share: str, name: str = "cumulative") -> DataFrame:
    """Running share of each case (a case holds one session's buckets)."""
    w = Window.partitionBy(*case).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(share).over(w))


def holm(hypotheses: DataFrame, family: Sequence[str] = ("family",), p: str = "p_value", key: str = "hypothesis") -> DataFrame:
    """Holm step-down adjustment inside each family of hypotheses."""
    by = Window.partitionBy(*family).orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    stepped = hypotheses.withColumn("_s", (m - F.row_number().over(by) + 1) * F.col(p))
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("adjusted_p", F.least(F.lit(1.0), F.max("_s").over(run))).drop("_s")


def session_volatility(bars: DataFrame, keys: Sequence[str] = ("instrument_id", "session_date"), at: str = "minute") -> DataFrame:
    """Population deviation of the session's log returns of VWAP, close where absent."""
    px = F.coalesce("vwap", "close")
    w = Window.partitionBy(*keys).orderBy(at)
    step = safe_ln(px / F.lag(px).over(w))
    return bars.withColumn("_r", step).groupBy(*keys).agg(
        F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("session_volatility"),
        F.sum("volume").alias("session_volume"),
    )
