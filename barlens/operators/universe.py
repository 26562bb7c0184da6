"""Formation statistics, universe selection and acquisition planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.scalar import month_chunks, reasons
from barlens.operators.order_stats import quantiles
from barlens.operators.ranking import average_ranks, exact_quantiles, row_numbers, unpivot
from barlens.session import settle

COMMON = "ordinary_common_stock"


def daily_dollar_volume(bars: DataFrame, quality: DataFrame) -> DataFrame:
    """Dollar volume of each minute-exact session."""
    exact = quality.where("minute_exact_full_session").select("instrument_id", "session_date")
    return (
        bars.groupBy("instrument_id", "session_date")
        .agg(F.sum(F.col("vwap") * F.col("volume")).alias("dollar_volume"))
        .join(exact, ["instrument_id", "session_date"], "left_semi")
    )


def formation_stats(
    snapshot: DataFrame,
    bars: DataFrame,
    quality: DataFrame,
    expected_sessions: int,
    *,
    min_price: float = 5.0,
    min_completeness: float = 0.95,
) -> DataFrame:
    """Per candidate medians and completeness over its exact sessions only.

    The median of an instrument's minutes comes from radix refinement, so no task sorts or holds them; its days are bounded by
    the formation window.
    """
    exact = quality.where("minute_exact_full_session").select("instrument_id", "session_date")
    kept = bars.join(exact, ["instrument_id", "session_date"], "left_semi")
    price = quantiles(kept, ["instrument_id"], "close", {"median_price": 0.5})
    dollars = daily_dollar_volume(bars, quality).groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.median("dollar_volume").alias("median_daily_dollar_volume")
    )
    out = snapshot.join(price, "instrument_id", "left").join(dollars, "instrument_id", "left")
    out = out.select(
        "instrument_id",
        F.upper("symbol").alias("symbol"),
        "security_type",
        F.coalesce("median_price", F.lit(0.0)).alias("median_price"),
        (F.coalesce("sessions", F.lit(0)) / F.lit(expected_sessions)).alias("session_completeness"),
        F.coalesce("median_daily_dollar_volume", F.lit(0.0)).alias("median_daily_dollar_volume"),
    )
    return out.withColumn(
        "reasons",
        reasons(
            (F.col("security_type") != COMMON, "not_ordinary_common_stock"),
            (F.col("median_price") < min_price, "median_price_below_5"),
            (F.col("session_completeness") < min_completeness, "formation_session_completeness_below_95_percent"),
            (F.col("median_daily_dollar_volume") <= 0, "nonpositive_median_daily_dollar_volume"),
        ),
    )


def duplicate_sessions_across_files(bars: DataFrame) -> DataFrame:
    """Sessions delivered by more than one chunk file."""
    tagged = bars.withColumn("_file", F.input_file_name())
    return (
        tagged.groupBy("instrument_id", "session_date")
        .agg(F.count_distinct("_file").alias("files"))
        .where("files > 1")
    )


def delivered_once(bars: DataFrame, repeated: DataFrame) -> DataFrame:
    """``bars`` unchanged; reading them is an error if any session was delivered more than once."""
    first = repeated.agg(F.min(F.concat_ws(" ", "instrument_id", F.col("session_date").cast("string")))).scalar()
    fault = F.raise_error(F.concat(F.lit("session delivered by more than one file: "), first)).cast("boolean")
    return bars.where(F.when(first.isNull(), F.lit(True)).otherwise(fault))


def daily_formation(
    snapshot: DataFrame,
    validated: DataFrame,
    expected_sessions: int,
    *,
    min_price: float = 5.0,
    min_completeness: float = 0.95,
    ingest: str | None = None,
) -> DataFrame:
    """Candidates from validated daily bars (``reasons`` per bar), with JSON reasons.

    A day delivered more than once counts with its first valid row in ``ingest`` order (without one, in that of its values).
    """
    valid = F.size("reasons") == 0
    row = F.when(valid, F.struct("close", "volume", "vwap"))
    order = F.when(valid, F.col(ingest)) if ingest else row
    per_day = validated.groupBy("instrument_id", "session_date").agg(
        F.sum((F.size("reasons") == 0).cast("int")).alias("_valid"),
        F.collect_set("reasons").alias("_why"),
        F.min_by(row, order).alias("_row"),
    ).select("*", "_row.*")
    ok = F.col("_valid") > 0
    repeated = F.when(F.col("_valid") > 1, F.array(F.lit("duplicate_daily_observation"))).otherwise(
        F.array().cast("array<string>")
    )
    # reasons come from a fixed vocabulary, so the sets stay small
    stats = per_day.groupBy("instrument_id").agg(
        F.sum(ok.cast("bigint")).alias("observed"),
        F.median(F.when(ok, F.col("close"))).alias("p"),
        F.median(F.when(ok, F.col("volume"))).alias("v"),
        F.median(F.when(ok, F.col("vwap") * F.col("volume"))).alias("dv"),
        F.min(F.when(ok, F.col("session_date"))).alias("first_valid_formation_date"),
        F.max(F.when(ok, F.col("session_date"))).alias("last_valid_formation_date"),
        F.flatten(F.collect_set(F.concat(F.flatten("_why"), repeated))).alias("_invalid"),
    )
    zero = F.lit(0.0)
    out = snapshot.join(stats, "instrument_id", "left").select(
        "instrument_id",
        F.upper("symbol").alias("formation_symbol"),
        "security_type",
        F.lit(expected_sessions).alias("expected_daily_sessions"),
        F.coalesce("observed", F.lit(0)).alias("observed_valid_daily_sessions"),
        (F.coalesce("observed", F.lit(0)) / F.lit(expected_sessions)).alias("daily_completeness"),
        F.coalesce("p", zero).alias("median_daily_price"),
        F.coalesce("v", zero).alias("median_daily_share_volume"),
        F.coalesce("dv", zero).alias("median_daily_dollar_volume"),
        "first_valid_formation_date",
        "last_valid_formation_date",
        F.coalesce("_invalid", F.array().cast("array<string>")).alias("_invalid"),
    )
    rules = reasons(
        (F.col("security_type") != COMMON, "not_ordinary_common_stock"),
        (F.col("median_daily_price") < min_price, "median_daily_price_below_5"),
        (F.col("daily_completeness") < min_completeness, "daily_completeness_below_95_percent"),
        (F.col("median_daily_dollar_volume") <= 0, "nonpositive_median_daily_dollar_volume"),
    )
    every = F.array_sort(F.array_distinct(F.concat("_invalid", rules)))
    return out.withColumn("exclusion_reasons", F.to_json(every)).drop("_invalid")


def eligible(candidates: DataFrame, *, min_price: float = 5.0, min_completeness: float = 0.95) -> Column:
    price = "median_daily_price" if "median_daily_price" in candidates.columns else "median_price"
    whole = "daily_completeness" if "daily_completeness" in candidates.columns else "session_completeness"
    ok = (
        (F.col("security_type") == COMMON)
        & (F.col(price) >= min_price)
        & (F.col(whole) >= min_completeness)
        & (F.length("instrument_id") > 0)
    )
    if "in_sp500_on_formation_date" in candidates.columns:
        ok = ok & F.coalesce(F.col("in_sp500_on_formation_date"), F.lit(False))
    return ok & (F.col("median_daily_dollar_volume") > 0) if price == "median_daily_price" else ok


def select_universe(candidates: DataFrame, size: int = 100, **rules: float) -> DataFrame:
    """Top ``size`` eligible candidates by dollar volume, ranked, in five groups.

    The sort and limit run as a distributed top-k; only ``size`` rows are
    numbered. Too few members is an error when the result is computed.
    """
    top = (
        candidates.where(eligible(candidates, **rules))
        .orderBy(F.col("median_daily_dollar_volume").desc(), "instrument_id")
        .limit(size)
    )
    whole = Window.partitionBy(F.lit(0))
    ranked = top.withColumn(
        "rank", F.row_number().over(whole.orderBy(F.col("median_daily_dollar_volume").desc(), "instrument_id"))
    ).withColumn("_n", F.count(F.lit(1)).over(whole))
    short = F.raise_error(F.concat(F.lit("too few universe members: "), F.col("_n").cast("string")))
    return ranked.withColumn("rank", F.when(F.col("_n") == size, F.col("rank")).otherwise(short.cast("int"))).withColumn(
        "liquidity_group", F.least(F.lit(5), F.floor((F.col("rank") - 1) * 5 / size) + 1).cast("int")
    ).drop("_n")


def liquidity_spaced(universe: DataFrame, size: int) -> DataFrame:
    """Members at evenly spaced ranks; ``universe`` must have ranks 1..n."""
    n = universe.agg(F.count(F.lit(1)).alias("n")).scalar()
    at = F.bround(F.col("i") * (F.col("n") - 1) / (size - 1), 0).cast("int") + 1
    spots = universe.sparkSession.range(size).select(F.col("id").alias("i"), n.alias("n")).select(at.alias("rank"))
    return universe.join(spots, "rank")


def balanced_sides(cases: DataFrame) -> DataFrame:
    """Buy for the first half of a date's instruments in hash order, sell for the rest.

    A date holds at most the selected instruments, so its window is small.
    """
    key = F.sha2(F.concat_ws("|", F.col("session_date").cast("string"), "instrument_id"), 256)
    by = Window.partitionBy("session_date")
    n = F.count(F.lit(1)).over(by)
    return cases.withColumn(
        "side",
        F.when(F.row_number().over(by.orderBy(key)) <= F.floor((n + 1) / 2), "buy").otherwise("sell"),
    )


def rank_liquidity(candidates: DataFrame) -> DataFrame:
    """Exact liquidity rank of all candidates, largest first, ties by id."""
    return row_numbers(
        candidates,
        [],
        ["median_daily_dollar_volume", "instrument_id"],
        descending=["median_daily_dollar_volume"],
        name="liquidity_rank",
    )


def candidate_comparison(minute: DataFrame, daily: DataFrame, quality: DataFrame) -> DataFrame:
    """Minute-based and daily-based candidates next to their mean session quality."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    q = quality.where(~F.col("early_close")).groupBy("instrument_id").agg(
        mean("token_valid_full_session").alias("token_completeness"),
        mean("minute_exact_full_session").alias("minute_completeness"),
        mean("tca_window_exact").alias("window_completeness"),
        mean("observed_minute_count").alias("average_observed_minute_count"),
        F.sum("provider_gap_count").alias("provider_gaps"),
    )
    m = minute.select("instrument_id", F.col("session_completeness").alias("minute_session_completeness"))
    return (
        m.join(daily, "instrument_id")
        .join(q, "instrument_id")
        .withColumns(
            {
                "minute_eligible": F.col("minute_session_completeness") >= 0.95,
                "daily_eligible": eligible(daily),
                "token_band": completeness_band(F.col("token_completeness")),
            }
        )
    )


def completeness_band(x: Column) -> Column:
    return F.when(x >= 0.95, "high").when(x >= 0.80, "medium").otherwise("low")


def correlations(df: DataFrame, targets: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Pearson and Spearman correlation of each target with each measure.

    Ranks are tie-averaged over distinct values found by a range-partitioned
    sort, so the table is never gathered to be ranked. A missing value leaves
    its row out of the pairs that need it, and of no other. Ranks and pairs read
    one written table, so ``df`` is derived once.
    """
    ranked = settle(df.select(*targets, *measures))
    long = unpivot(ranked, [], [*targets, *measures], "column", "value").where("value is not null")
    ranks = average_ranks(long, ["column"], "value", "rank")
    for c in (*targets, *measures):
        r = ranks.where(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}"))
        ranked = ranked.join(r, c, "left")
    out = None
    aggregates = []
    for t in targets:
        for m in measures:
            aggregates.append(F.corr(t, m).alias(f"p|{t}|{m}"))
            aggregates.append(F.corr(f"_r_{t}", f"_r_{m}").alias(f"s|{t}|{m}"))
    wide = ranked.agg(*aggregates)
    rows = F.array(
        *(
            F.struct(
                F.lit(t).alias("target"),
                F.lit(m).alias("measure"),
                F.col(f"`p|{t}|{m}`").alias("pearson"),
                F.col(f"`s|{t}|{m}`").alias("spearman"),
            )
            for t in targets
            for m in measures
        )
    )
    out = wide.select(F.inline(rows))
    return out


# The reported distribution points.
POINTS = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def distribution_summary(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Moments and quantiles of each measure, one row per measure."""
    long = unpivot(df, [], measures, "measure", "value")
    moments = long.groupBy("measure").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return moments.join(exact_quantiles(long, ["measure"], "value", POINTS), "measure")


def reason_counts(candidates: DataFrame, column: str = "exclusion_reasons") -> DataFrame:
    """Candidates per exclusion reason from the JSON column."""
    each = F.explode(F.from_json(column, "array<string>"))
    return candidates.select(each.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("candidates"))


def acquisition_chunks(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Monthly requests of every alias interval clipped to a period."""
    s = F.greatest(F.col("start"), F.lit(start).cast("date"))
    e = F.least(F.col("end"), F.lit(end).cast("date"))
    return intervals.select("instrument_id", "symbol", F.inline(month_chunks(s, e)))


def acquisition_plan(
    intervals: DataFrame,
    calendar: DataFrame,
    start: str,
    end: str,
    *,
    rows_per_session: int = 390,
    raw_bytes: int = 80,
    processed_bytes: int = 120,
) -> DataFrame:
    """Request, row and byte bounds of a period in one row."""
    sessions = calendar.where(F.col("session_date").between(start, end)).agg(F.count(F.lit(1)).alias("n")).scalar()
    per = acquisition_chunks(intervals, start, end).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("requests"))
    out = per.agg(F.count(F.lit(1)).alias("instruments"), F.coalesce(F.sum("requests"), F.lit(0)).alias("monthly_requests"))
    rows = F.col("instruments") * F.col("sessions") * rows_per_session
    return (
        out.withColumn("sessions", sessions)
        .withColumn("rows_upper", rows)
        .withColumn("bytes_upper", F.col("rows_upper") * (raw_bytes + processed_bytes))
    )


def chunk_coverage(chunks: DataFrame, bars: DataFrame, quality: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each chunk's delivered rows against what it declared and the calendar.

    Bars are counted per session before they meet the chunks.
    """
    per_session = bars.groupBy("instrument_id", "session_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("symbol").alias("lo"), F.max("symbol").alias("hi")
    ).join(
        quality.select("instrument_id", "session_date", F.col("minute_exact_full_session").alias("exact")),
        ["instrument_id", "session_date"],
        "left",
    )
    c = chunks.withColumnRenamed("instrument_id", "_id")
    s = per_session
    inside = (c._id == s.instrument_id) & s.session_date.between(c.chunk_start, c.chunk_end)
    got = c.join(s, inside, "left").groupBy("_id", "chunk_start", "chunk_end").agg(
        F.max("declared_rows").alias("declared_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sum(F.coalesce(F.col("exact"), F.lit(False)).cast("bigint")).alias("observed_exact_sessions"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    days = calendar.agg(F.sort_array(F.collect_list("session_date")).alias("d")).scalar()
    expected = F.size(F.filter("_days", lambda d: d.between(F.col("chunk_start"), F.col("chunk_end"))))
    return (
        got.withColumn("_days", days)
        .withColumn("expected_sessions", expected)
        .select(
            F.col("_id").alias("instrument_id"),
            "chunk_start",
            "chunk_end",
            "rows",
            "observed_exact_sessions",
            "expected_sessions",
            reasons(
                ((F.col("rows") != F.col("declared_rows")) | (F.col("rows") <= 0), "row_count"),
                (F.col("lo") != F.col("hi"), "symbol"),
                (F.col("expected_sessions") <= 0, "no_expected_session"),
            ).alias("violations"),
        )
    )


def resource_estimate(
    counts: DataFrame, *, instruments: int, token_count: int = 26, min_context: int = 4, bands: int = 4, embedding_size: int = 644
) -> DataFrame:
    """Row and byte bounds from standard-session counts per fold and partition.

    ``counts`` has ``fold_id, partition, sessions``. Origins per session are
    ``token_count - min_context``; a train session keeps one origin per band.
    """
    origins = token_count - min_context
    held = sum(token_count - k for k in range(min_context, token_count))
    n = F.col("sessions")
    train = F.col("partition") == "train"
    return counts.groupBy("fold_id").agg(
        F.sum(F.when(train, n * instruments * 2).otherwise(0)).alias("training_origins"),
        F.sum(n * instruments * origins).alias("scale_rows"),
        F.sum(F.when(train, n * instruments * bands * origins).otherwise(0)).alias("shape_train_rows"),
        F.sum(F.when(~train, n * instruments * held).otherwise(0)).alias("shape_held_out_rows"),
        F.sum(n * instruments * origins * 6).alias("embedding_rows"),
        F.sum(n * instruments * origins * 6 * embedding_size * 4).alias("embedding_bytes"),
    )
