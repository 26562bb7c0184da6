"""Point-in-time datasets, splits, sequences and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.scalar import calendar_fields, hash_id, reasons, right_align_mask
from barlens.operators import bars as B
from barlens.operators import history as H
from barlens.operators.identity import fold_partition, resolve_symbol, split_adjust, split_factor
from barlens.operators.quality import session_quality
from barlens.operators.ranking import exact_quantiles, unpivot
from barlens.schema import SessionSpec
from barlens.session import settle

SESSION = ("symbol", "session_date")
# Context length, first as-of token, horizons and the as-of bands of a session.
CONTEXT = 8
MIN_CONTEXT = 4
HORIZONS = (1, 2, 4, 8)
BANDS = ((4, 9), (10, 15), (16, 20), (21, 25))


def session_filter(buckets: DataFrame, calendar: DataFrame, minutes: int, *, full: int = 390, keep_early: bool = False) -> DataFrame:
    """Reason a session cannot be used, NULL when it can.

    ``calendar``: ``session_date, minutes``. Bucketed sessions are counted
    first, so the calendar meets one row per session.
    """
    n = buckets.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"))
    want = F.ceil(F.col("minutes") / minutes)
    early = F.lit(False) if keep_early else F.col("minutes") < full
    return n.join(calendar.select("session_date", "minutes"), "session_date", "left").select(
        *SESSION,
        F.when(F.col("minutes").isNull(), "not_exchange_session")
        .when(early, "early_close_excluded")
        .when(
            F.col("n") != want,
            F.concat(F.lit("incomplete_session:"), F.col("n").cast("string"), F.lit("_of_"), want.cast("string"), F.lit("_buckets")),
        )
        .alias("reason"),
    )


def _ts(date: Column, bucket: Column, minutes: int) -> Column:
    return date.cast("timestamp_ntz") + F.make_interval(mins=(bucket * minutes).cast("int"))


HISTORY_FEATURES = (
    "previous_session_total_volume", "rolling_adv", "rolling_median_volume", "rolling_volatility",
    "previous_session_return", "previous_session_range", "previous_session_trade_count",
)


def _history(buckets: DataFrame, length: int) -> DataFrame:
    sessions = B.session_bars(buckets, SESSION, at="bucket")
    with_past = H.history_features(sessions, length)
    by = Window.partitionBy("symbol").orderBy("session_date")
    return with_past.withColumn("_prev_bucket", F.lag("last_bucket").over(by)).where(
        F.col("previous_session_date").isNotNull()
    ).select(*SESSION, *HISTORY_FEATURES, "previous_session_date", "_prev_bucket")


def static_dataset(buckets: DataFrame, minutes: int, *, length: int = 20) -> DataFrame:
    """One row per bucket of every session that has a session before it."""
    past = _history(buckets, length)
    by = Window.partitionBy(*SESSION).orderBy("bucket")
    whole = Window.partitionBy(*SESSION)
    total = F.sum("volume").over(whole)
    rows = buckets.withColumns(
        {"_total": total, "_first": F.first("bucket").over(by), "target_bucket_index": F.row_number().over(by) - 1}
    ).join(past, list(SESSION))
    share = F.coalesce(F.try_divide("volume", "_total"), F.lit(0.0))
    cal = calendar_fields("session_date")
    return rows.select(
        F.concat_ws("|", "symbol", F.col("session_date").cast("string"), F.lit("static")).alias("sample_id"),
        F.lit("static").alias("mode"),
        *SESSION,
        _ts(F.col("session_date"), F.col("_first"), minutes).alias("as_of"),
        _ts(F.col("session_date"), F.col("bucket"), minutes).alias("target_at"),
        "target_bucket_index",
        cal["weekday"].cast("double").alias("weekday"),
        cal["month"].cast("double").alias("month"),
        *HISTORY_FEATURES,
        F.log1p("_total").alias("target_log_total_volume"),
        share.alias("target_volume_share"),
        F.col("_total").cast("double").alias("target_remaining_volume"),
        share.alias("target_conditional_share"),
        _ts(F.col("previous_session_date"), F.col("_prev_bucket"), minutes).alias("available_at"),
    )


def future_triangle(buckets: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Each bucket with every bucket from itself to the end of its session.

    The future is a window over the session, exploded in place: no join, and
    the fan-out is bounded by the buckets of a session.
    """
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    future = F.collect_list(F.struct(F.col("bucket").alias("target_bucket"), F.col("volume").alias("target_volume"))).over(ahead)
    return buckets.withColumn("_future", future).select("*", F.posexplode("_future").alias("offset", "_t")).select(
        *[c for c in buckets.columns], "offset", "_t.*"
    )


INTRADAY_FEATURES = (
    "elapsed_session_fraction", "observed_cumulative_volume", "recent_bucket_volume", "recent_realized_volatility",
)


def dynamic_dataset(buckets: DataFrame, minutes: int, *, length: int = 20) -> DataFrame:
    """Decision ``k`` >= 1 joined to every target ``j >= k`` of its session."""
    past = _history(buckets, length)
    live = H.intraday_features(buckets)
    rows = future_triangle(live).where("k >= 1").join(past, list(SESSION))
    cal = calendar_fields("session_date")
    share = lambda d: F.coalesce(F.try_divide("target_volume", d), F.lit(0.0))
    return rows.select(
        F.concat_ws(
            "|", "symbol", F.col("session_date").cast("string"), F.lit("dynamic"), F.lpad(F.col("k").cast("string"), 4, "0")
        ).alias("sample_id"),
        F.lit("dynamic").alias("mode"),
        *SESSION,
        _ts(F.col("session_date"), F.col("bucket"), minutes).alias("as_of"),
        _ts(F.col("session_date"), F.col("target_bucket"), minutes).alias("target_at"),
        (F.col("k") + F.col("offset")).alias("target_bucket_index"),
        cal["weekday"].cast("double").alias("weekday"),
        cal["month"].cast("double").alias("month"),
        *HISTORY_FEATURES,
        *INTRADAY_FEATURES,
        F.log1p("session_volume").alias("target_log_total_volume"),
        share("session_volume").alias("target_volume_share"),
        F.col("remaining_volume").cast("double").alias("target_remaining_volume"),
        share("remaining_volume").alias("target_conditional_share"),
        _ts(F.col("session_date"), F.col("previous_bucket"), minutes).alias("available_at"),
    )


def build_dataset(
    buckets: DataFrame, calendar: DataFrame, minutes: int, *, mode: str = "static", full: int = 390, keep_early: bool = False, length: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Rows over usable sessions only, and the sessions left out with their reason.

    Sessions are filtered first, so that an early close or an incomplete session
    is neither a row nor part of another session's history. A symbol's first
    usable session has no history and is listed too. The verdicts are one row
    per session and meet the buckets in one semi join.
    """
    if mode not in ("static", "dynamic"):
        raise ValueError(f"unknown mode {mode!r}")
    verdict = session_filter(buckets, calendar, minutes, full=full, keep_early=keep_early)
    usable = verdict.where("reason is null").select(*SESSION)
    rows = (static_dataset if mode == "static" else dynamic_dataset)(buckets.join(usable, list(SESSION), "left_semi"), minutes, length=length)
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("session_date")) == 1
    early = usable.withColumn("_first", first).where("_first").select(*SESSION, F.lit("insufficient_history").alias("reason"))
    return rows, verdict.where("reason is not null").unionByName(early)


def walk_forward(
    rows: DataFrame, *, train: int, validation: int, test: int, step: int, embargo: int = 0, date: str = "session_date"
) -> DataFrame:
    """``(fold_id, session_date, partition)`` of expanding folds over the distinct dates.

    Only the distinct dates (bounded by the calendar) are numbered. No room for
    a single fold is an error when the result is computed.
    """
    dates = rows.select(F.col(date).alias("session_date")).distinct()
    whole = Window.partitionBy(F.lit(0))
    d = dates.withColumns(
        {"_i": F.row_number().over(whole.orderBy("session_date")) - 1, "_n": F.count(F.lit(1)).over(whole)}
    )
    span = train + validation + test + 2 * embargo
    folds = F.floor((F.col("_n") - span) / step).cast("int")
    short = F.raise_error(F.concat(F.lit("too few session dates for one fold: "), F.col("_n").cast("string")))
    last = F.when(F.col("_n") >= span, folds).otherwise(short.cast("int"))
    each = d.withColumn("_f", F.explode(F.sequence(F.lit(0), last)))
    end = F.lit(train) + F.col("_f") * step
    v0 = end + embargo
    t0 = v0 + validation + embargo
    i = F.col("_i")
    part = (
        F.when(i < end, "train")
        .when((i >= v0) & (i < v0 + validation), "validation")
        .when((i >= t0) & (i < t0 + test), "test")
    )
    fold = F.concat(F.lit("fold-"), F.lpad((F.col("_f") + 1).cast("string"), 3, "0"))
    return each.select(fold.alias("fold_id"), "session_date", part.alias("partition")).where("partition is not null")


def sample_index(
    sessions: DataFrame, *, min_context: int = MIN_CONTEXT, horizons: Sequence[int] = HORIZONS, context: int = CONTEXT
) -> DataFrame:
    """As-of samples of sequences (``session_id, fold_id, partition, cutoff, valid_count``)."""
    at = F.col("as_of_token")
    s = sessions.where(F.col("valid_count") > min_context).withColumn(
        "as_of_token", F.explode(F.sequence(F.lit(min_context), (F.col("valid_count") - 1).cast("int")))
    )
    ahead = F.array(*(F.lit(h) for h in horizons))
    s = s.withColumns(
        {
            "context_start": F.greatest(F.lit(0), at - context),
            "context_end": at,
            "target_indices": F.transform(ahead, lambda h: at + h - 1),
            "sample_id": hash_id("session_id", "fold_id", "partition", "as_of_token", F.col("cutoff").cast("string")),
        }
    )
    return s.withColumn("target_mask", F.transform("target_indices", lambda i: i < F.col("valid_count"))).where(
        F.exists("target_mask", lambda m: m)
    )


def session_arrays(tokens: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per session with its tokens in order; a session has a fixed number of tokens."""
    packed = F.sort_array(F.collect_list(F.struct("token", *columns)))
    return tokens.groupBy(*keys).agg(packed.alias("tokens"))


def context_window(samples: DataFrame, arrays: DataFrame, features: Sequence[str], *, context: int = CONTEXT) -> DataFrame:
    """Right-aligned, zero-padded context per sample with its mask."""
    j = samples.join(arrays, "session_id")
    seen = F.slice("tokens", F.col("context_start") + 1, F.col("context_end") - F.col("context_start"))
    pad = F.array_repeat(F.array(*(F.lit(0.0) for _ in features)), context - F.size(seen))
    values = F.transform(seen, lambda t: F.array(*(t[f].cast("double") for f in features)))
    return j.withColumns(
        {"context": F.concat(pad, values), "context_mask": right_align_mask(seen, context)}
    ).drop("tokens")


def raw_features(windows: DataFrame, features: Sequence[str], *, context: int = CONTEXT) -> DataFrame:
    """Context and mask as flat named columns next to the metadata."""
    flat = [
        F.col("context")[i][k].alias(f"t{i}_{name}") for i in range(context) for k, name in enumerate(features)
    ]
    mask = [F.col("context_mask")[i].cast("int").alias(f"mask_{i}") for i in range(context)]
    keep = [c for c in windows.columns if c not in ("context", "context_mask")]
    return windows.select(*keep, *flat, *mask)


def shape_origins(samples: DataFrame, bands: Sequence[tuple[int, int]] = BANDS) -> DataFrame:
    """One hash-chosen origin per session and band with its inclusion probability."""
    band = None
    for i, (lo, hi) in enumerate(bands):
        cond = F.col("as_of_token").between(lo, hi)
        band = F.when(cond, i) if band is None else band.when(cond, i)
    group = Window.partitionBy("session_id", "_band")
    turn = F.row_number().over(group.orderBy(F.sha2("sample_id", 256)))
    return (
        samples.withColumn("_band", band)
        .where(F.col("_band").isNotNull())
        .withColumns({"_turn": turn, "inclusion_probability": F.lit(1.0) / F.count(F.lit(1)).over(group)})
        .where("_turn = 1")
        .withColumnRenamed("_band", "band")
        .drop("_turn")
    )


def train_positions(samples: DataFrame, *, epoch: int, seed: int, picks: int = 2) -> DataFrame:
    """``picks`` as-of positions per session and epoch, chosen by hash order."""
    key = F.sha2(F.concat_ws("|", "sample_id", F.lit(str(epoch)), F.lit(str(seed))), 256)
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy(key))
    return samples.withColumn("_turn", turn).where(F.col("_turn") <= picks).drop("_turn")


def _future(array: str, field: str) -> Column:
    """Field of the tokens from the as-of token on."""
    n = F.size(array) - F.col("as_of_token")
    return F.transform(F.slice(array, F.col("as_of_token") + 1, n), lambda t: t[field].cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def scale_rows(samples: DataFrame, arrays: DataFrame) -> DataFrame:
    """One row per sample with future volume; tokens carry ``volume`` and ``baseline``.

    Session arrays meet their samples once and the sums run inside the row.
    """
    j = samples.join(arrays, "session_id")
    return j.withColumns(
        {
            "future": F.arrays_zip(_future("tokens", "volume").alias("v"), _future("tokens", "baseline").alias("b")),
            "target_total": _sum(_future("tokens", "volume")),
            "baseline_remaining_volume": _sum(_future("tokens", "baseline")),
        }
    ).where("target_total > 0").drop("tokens")


def shape_rows(scale: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """One row per future token with shares and sampling weights.

    With ``origins`` only those samples are kept, weighted by the inverse of
    their inclusion probability.
    """
    base = scale.withColumn("inclusion_probability", F.lit(1.0))
    if origins is not None:
        base = scale.join(origins.select("sample_id", "inclusion_probability"), "sample_id")
    w = F.lit(1.0) / F.col("inclusion_probability")
    base = base.withColumns({"case_weight": w, "row_weight": w / F.size("future")})
    keep = [c for c in base.columns if c != "future"]
    return base.select(*keep, F.posexplode("future").alias("_i", "_t")).select(
        *keep,
        (F.col("as_of_token") + F.col("_i")).alias("target_bucket"),
        (F.col("_i") + 1).alias("horizon_offset"),
        (F.col("_t.v") / F.col("target_total")).alias("target_share"),
        F.when(F.col("baseline_remaining_volume") > 0, F.col("_t.b") / F.col("baseline_remaining_volume"))
        .otherwise(F.raise_error(F.lit("causal baseline must be positive")).cast("double"))
        .alias("baseline_share"),
    )


def curve_gap(pairs: Column, total_a: Column, total_b: Column, *, mean: bool) -> Column:
    """Sum (or mean) of absolute gaps between two cumulative share curves of one row."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("g"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["a"] + t["v"] / total_a
        b = acc["b"] + t["b"] / total_b
        return F.struct(a.alias("a"), b.alias("b"), (acc["g"] + F.abs(a - b)).alias("g"))

    gap = F.aggregate(pairs, start, step)["g"]
    return gap / F.size(pairs) if mean else gap


def regime_frame(samples: DataFrame, arrays: DataFrame, *, surprise: str = "volume_surprise", volatility: str = "realized_vol") -> DataFrame:
    """Statistics of the last observed token and the baseline's curve error per sample."""
    j = samples.join(arrays, "session_id")
    last = F.element_at("tokens", F.col("as_of_token"))
    j = j.withColumns({"volume_surprise": last[surprise], "realized_volatility": last[volatility]})
    s = j.withColumns(
        {
            "_pairs": F.arrays_zip(_future("tokens", "volume").alias("v"), _future("tokens", "baseline").alias("b")),
            "_a": _sum(_future("tokens", "volume")),
            "_b": _sum(_future("tokens", "baseline")),
        }
    ).where("_a > 0 and _b > 0")
    gap = curve_gap(F.col("_pairs"), F.col("_a"), F.col("_b"), mean=True)
    return s.withColumn("curve_error", gap).drop("tokens", "_pairs", "_a", "_b")


QUANTILES = {"lo": 0.005, "q1": 0.25, "median": 0.5, "q3": 0.75, "hi": 0.995}


def fit_normalizer(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Clip bounds, centre and scale per feature from TRAIN rows, by exact quantiles."""
    long = unpivot(train, [], features, "feature", "value")
    q = exact_quantiles(long, ["feature"], "value", QUANTILES)
    return q.withColumn("scale", F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-6)))


def robust_normalize(rows: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Clip, centre and scale; NULL padding becomes 0. The fit travels as one map literal."""
    return _apply_fit(rows.withColumn("_fit", fitted.agg(_pack_fit()).scalar()), features)


def _pack_fit() -> Column:
    """All features' fits in one map (there are as many entries as features)."""
    return F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi", "median", "scale"))))


def _apply_fit(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    scaled = {}
    for f in features:
        p = F.col("_fit")[f]
        x = F.greatest(p["lo"], F.least(p["hi"], F.col(f)))
        scaled[f] = F.when(F.col(f).isNull(), 0.0).otherwise((x - p["median"]) / p["scale"])
    return rows.withColumns(scaled).drop("_fit")


def causal_ledger(sessions: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Cutoff of every session: the session before it."""
    by = Window.partitionBy(*keys).orderBy("session_date")
    c = sessions.select(*keys, "session_date").distinct().withColumn("cutoff", F.lag("session_date").over(by))
    return c.where("cutoff is not null").withColumn("causal", F.col("cutoff") < F.col("session_date"))


def validate_corpus(bars: DataFrame, spec: SessionSpec, intervals: DataFrame, allowed: DataFrame, *, window: tuple[int, int]) -> DataFrame:
    """Valid and invalid sessions with every reason: identity, symbol and quality."""
    q = session_quality(bars, spec, window=window)
    r = resolve_symbol(bars, intervals).groupBy("instrument_id", "session_date").agg(
        F.count(F.lit(1)).alias("symbols"), F.max("status").alias("status"), F.min("status").alias("_status")
    )
    ids = allowed.select("instrument_id").distinct().withColumn("_allowed", F.lit(True))
    j = q.join(r, ["instrument_id", "session_date"]).join(ids, "instrument_id", "left")
    why = reasons(
        (F.col("_allowed").isNull(), "unknown_instrument"),
        (F.col("symbols") != 1, "multiple_symbols"),
        ((F.col("status") != "ok") | (F.col("_status") != "ok"), F.concat(F.lit("symbol_"), F.col("status"))),
        (~F.col("token_valid_full_session"), "token_quality"),
    )
    return j.select("instrument_id", "session_date", why.alias("reasons")).withColumn("valid", F.size("reasons") == 0)


def build_sequences(
    bars: DataFrame,
    spec: SessionSpec,
    *,
    benchmark: str,
    intervals: DataFrame,
    actions: DataFrame,
    folds: DataFrame,
    window: tuple[int, int],
    sessions: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Normalised token features per fold and the sessions left out, with reasons.

    Quality and identity decide which sessions are used; the split factor of a
    session is resolved at its own last bar; seasonal history is strictly
    earlier; the normaliser sees TRAIN rows of its fold only.
    """
    ids = bars.select("instrument_id").distinct()
    checked = settle(validate_corpus(bars, spec, intervals, ids, window=window))
    stock = F.col("instrument_id") != benchmark
    last = bars.groupBy("instrument_id", "session_date").agg(F.max("minute").alias("_m"))
    at = F.col("session_date").cast("timestamp_ntz") + F.make_interval(mins=F.col("_m").cast("int"))
    factors = split_factor(last.withColumns({"observed_at": at, "as_of": at}).drop("_m"), actions)
    kept = bars.join(checked.where("valid"), ["instrument_id", "session_date"], "left_semi")
    # the token table is what every later step reads, so the bars are read once for it
    tokens = settle(B.token_bars(split_adjust(kept, factors), spec))
    seasonal = H.seasonal_ewma(tokens, sessions=sessions, token_count=spec.tokens)
    bench = seasonal.where(~stock)
    feats = settle(H.token_features(seasonal.where(stock), bench, token_count=spec.tokens))
    member = fold_partition(feats, folds)
    train = member.where("partition = 'train'")
    long = unpivot(train, ["fold_id"], H.FEATURES, "feature", "value")
    q = exact_quantiles(long, ["fold_id", "feature"], "value", QUANTILES)
    fits = q.withColumn("scale", F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-6)))
    out = _apply_fit(member.join(fits.groupBy("fold_id").agg(_pack_fit().alias("_fit")), "fold_id"), H.FEATURES)
    quality_out = checked.where("not valid").select("instrument_id", "session_date", "reasons")
    used = tokens.where(stock).select("instrument_id", "session_date").distinct()
    no_bench = used.join(bench.select("session_date").distinct(), "session_date", "left_anti").select(
        "instrument_id", "session_date", F.array(F.lit("benchmark_missing")).alias("reasons")
    )
    return out, quality_out.unionByName(no_bench)


def content_fingerprint(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], *, digits: int = 6) -> DataFrame:
    """SHA-256 of a session's distinct rows and their counts, in sorted order.

    Copies are counted before rows are gathered, so the gathered list is
    bounded by the session's distinct rows.
    """
    types = dict(rows.dtypes)
    text = F.concat_ws(
        ",",
        *(
            F.coalesce(
                (F.format_number(F.col(c), digits) if types[c] in ("double", "float") else F.col(c).cast("string")),
                F.lit("null"),
            )
            for c in columns
        ),
    )
    counted = rows.groupBy(*keys, text.alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    line = F.concat_ws("#", "_row", F.col("_n").cast("string"))
    return counted.groupBy(*keys).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint")
    )


def dataset_manifest(rows: DataFrame, exclusions: DataFrame, config: str) -> DataFrame:
    """Size, identities and date range of a dataset in one row."""
    excluded = exclusions.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("sample_id").alias("samples"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("session_date").alias("min_date"),
        F.max("session_date").alias("max_date"),
    ).withColumns({"exclusions": excluded, "dataset_id": F.substring(F.sha2(F.lit(config), 256), 1, 12)})


