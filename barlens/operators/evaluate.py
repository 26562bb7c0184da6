"""Evaluation statistics, resampling and regimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.functions.draws import draw, normal, repetition_keys, seeds
from barlens.operators.ranking import exact_quantiles, unpivot, with_positions


def empirical_cdf(df: DataFrame, strata: Sequence[str], value: str, *, ties: Sequence[str], name: str) -> DataFrame:
    """Mid-rank CDF position inside each stratum, ties in the order of ``ties``."""
    placed = with_positions(df, strata, [value, *ties])
    return placed.withColumn(name, (F.col("_before") + 0.5) / F.col("_n")).drop("_before", "_n")


def regression_metrics(rows: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Mean absolute and root mean squared error per group."""
    e = F.col(predicted) - F.col(actual)
    return rows.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("rows")
    )


def shape_metrics(rows: DataFrame, case: Sequence[str], at: str, actual: str, predicted: str, *, eps: float = 1e-12) -> DataFrame:
    """Share errors of each case, both curves normalised first.

    The summed CDF gap is reported under its two customary names.
    """
    whole = Window.partitionBy(*case)
    run = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    norm = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(eps))
    r = rows.withColumns({"_a": norm(actual), "_p": norm(predicted)})
    r = r.withColumn("_gap", F.abs(F.sum("_a").over(run) - F.sum("_p").over(run)))
    e = F.col("_p") - F.col("_a")
    return r.groupBy(*case).agg(
        F.avg(F.abs(e)).alias("share_mae"),
        F.sqrt(F.avg(e * e)).alias("share_rmse"),
        (-F.sum(F.col("_a") * F.ln(F.col("_p") + eps))).alias("cross_entropy"),
        F.sum(F.col("_a") * F.ln((F.col("_a") + eps) / (F.col("_p") + eps))).alias("kl_divergence"),
        F.sum("_gap").alias("cumulative_curve_error"),
        F.sum("_gap").alias("wasserstein_bucket_distance"),
    )


def forecast_errors(rows: DataFrame, case: Sequence[str], at: str, actual: str, predicted: str) -> DataFrame:
    """Per case: log remaining-volume error and the *mean* CDF gap of the two curves."""
    whole = Window.partitionBy(*case)
    run = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    cdf = lambda c: F.try_divide(F.sum(c).over(run), F.sum(c).over(whole))
    r = rows.withColumn("_gap", F.abs(cdf(predicted) - cdf(actual)))
    return r.groupBy(*case).agg(
        F.sum(actual).alias("actual_remaining"),
        F.sum(predicted).alias("predicted_remaining"),
        F.avg("_gap").alias("curve_error"),
    ).withColumn("log_volume_error", F.abs(F.log1p("predicted_remaining") - F.log1p("actual_remaining")))


def forecast_metrics(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means of the per-case errors; a NULL seed stays its own group."""
    return errors.groupBy(*by).agg(
        F.avg("log_volume_error").alias("log_remaining_volume_mae"),
        F.avg("curve_error").alias("conditional_curve_error"),
        F.count(F.lit(1)).alias("cases"),
    )


def case_mean_by_date(rows: DataFrame, value: str, model: Sequence[str]) -> DataFrame:
    """Mean per model and date, so that each date weighs the same afterwards."""
    return rows.groupBy(*model, "date").agg(F.avg(value).alias(value))


def strategy_summary(results: DataFrame, value: str, *, by: Sequence[str] = ("strategy",), extra: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation and exact quantiles per strategy, however many rows it has."""
    moments = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        *(F.avg(c).alias(f"mean_{c}") for c in extra),
    )
    q = exact_quantiles(results, by, value, {"q10": 0.1, "median": 0.5, "q90": 0.9})
    return moments.join(q, list(by), "left")


def paired_differences(pairs: DataFrame, *, by: Sequence[str] = ("strategy",), value: str = "difference") -> DataFrame:
    """Count, mean, median and win rate (difference below zero) of paired rows."""
    m = pairs.groupBy(*by).agg(
        F.count(value).alias("paired_count"),
        F.avg(value).alias("mean_difference"),
        F.avg((F.col(value) < 0).cast("double")).alias("win_rate"),
    )
    return m.join(exact_quantiles(pairs, by, value, {"median_difference": 0.5}), list(by), "left")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with a 0-based position ``_pos`` and group size ``_size``."""
    return with_positions(df, by, order, before="_pos", total="_size")


#: Rows of a leaf of the split tree, at most; repetitions whose draws a task holds at once.
LEAF, AT_ONCE = 256, 250


def _split(count: np.ndarray, share: float, z: np.ndarray) -> np.ndarray:
    """How many of ``count`` draws fall into the left ``share`` of a node of more than LEAF rows.

    The normal limit of the binomial, less the variance that rounding adds.
    """
    left = np.floor(count * share + np.sqrt(np.maximum(count * share * (1 - share) - 1 / 12, 0)) * z + 0.5)
    return np.clip(left, 0, count).astype(np.int64)


class _Resampled:
    """Resampled sums of one group in one task; see :func:`bootstrap_mean`."""

    def __init__(self, first: int, second: int, size: int, repetitions: int) -> None:
        self.one, self.two = repetition_keys(first, second, np.arange(repetitions, dtype=np.int64))
        self.size, self.leaves = size, -(-size // LEAF)
        self.sums, self.path = np.zeros(repetitions), {}

    def leaf(self, number: int) -> tuple[int, np.ndarray]:
        """The node of a leaf and its draws in every repetition; splits of the last path are kept."""
        a, b, node, path = 0, self.leaves, 1, {}
        edge = lambda i: i * self.size // self.leaves
        count = np.full(len(self.one), self.size, np.int64)
        while b - a > 1:
            mid = (a + b) // 2
            left = self.path.get(node)
            if left is None:
                left = _split(count, (edge(mid) - edge(a)) / (edge(b) - edge(a)), normal(self.one, self.two, node))
            path[node] = left
            a, b, node, count = (a, mid, 2 * node, left) if number < mid else (mid, b, 2 * node + 1, count - left)
        self.path = path
        return node, count

    def add(self, positions: np.ndarray, values: np.ndarray) -> None:
        leaf_of = ((positions + 1) * self.leaves - 1) // self.size
        for number in np.unique(leaf_of):
            own = leaf_of == number
            start = number * self.size // self.leaves
            width = (number + 1) * self.size // self.leaves - start
            weight = np.zeros(width)
            weight[positions[own] - start] = values[own]
            node, count = self.leaf(int(number))
            for r in range(0, len(count), AT_ONCE):
                some = count[r : r + AT_ONCE]
                rep = np.repeat(np.arange(len(some)), some)
                j = np.arange(len(rep)) - np.repeat(np.cumsum(some) - some, some)
                drawn = draw(self.one[r : r + AT_ONCE][rep], self.two[r : r + AT_ONCE][rep], node, j) % width
                self.sums[r : r + AT_ONCE] += np.bincount(rep, weight[drawn], minlength=len(some))


def bootstrap_mean(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, repetitions: int = 2000, confidence: float = 0.95, seed: int = 17
) -> DataFrame:
    """Percentile interval of the resampled mean per group.

    A repetition draws as many rows as the group has. How often it draws each row comes down a binary tree over the rows'
    positions: a node's draws are split between its halves by a hash-driven draw, and a leaf (of LEAF rows at most) places its
    own draws one by one. A task walks to the leaves of its own rows only and sums what they add to every repetition, so nothing
    is as long as a group and one number a task, group and repetition moves. Groups of up to LEAF rows are drawn exactly; splits
    of larger ones use the normal limit of the binomial. Draws depend on the group's key, ``seed``, repetition and position.
    """
    rows = numbered(df.where(F.col(value).isNotNull()), by, order)
    first, second = seeds(F.concat_ws("|", *(F.col(c).cast("string") for c in by), F.lit(str(seed))))
    rows = rows.select(*by, "_pos", "_size", F.col(value).cast("double").alias("_v"), first.alias("_one"), second.alias("_two")).sortWithinPartitions(*by, "_pos")
    keys = list(by)
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("_rep", T.IntegerType()), T.StructField("_size", T.LongType()), T.StructField("_sum", T.DoubleType())])

    def resample(batches):
        held = {}

        def flush():
            for (_, _, size), (names, r) in held.items():
                n = len(r.sums)
                yield pd.DataFrame({**{c: [v] * n for c, v in zip(keys, names)}, "_rep": np.arange(n, dtype=np.int32), "_size": [size] * n, "_sum": r.sums})
            held.clear()

        for b in batches:
            for key, g in b.groupby(["_one", "_two", "_size"], sort=False):
                if key not in held:
                    if len(held) >= 64:
                        yield from flush()
                    held[key] = ([g[c].iloc[0] for c in keys], _Resampled(*map(int, key), repetitions))
                held[key][1].add(g["_pos"].to_numpy(), g["_v"].to_numpy())
        yield from flush()

    means = rows.mapInPandas(resample, schema).groupBy(*by, "_rep").agg((F.sum("_sum") / F.first("_size")).alias("_mean"))
    return _interval(means, by, confidence).withColumnsRenamed({"_lower": "ci_lower", "_upper": "ci_upper"})


def _interval(means: DataFrame, by: Sequence[str], confidence: float) -> DataFrame:
    """Percentile interval over the repetitions (a fixed number of rows per group)."""
    tail = (1 - confidence) / 2
    return means.groupBy(*by).agg(
        F.percentile("_mean", F.lit(tail)).alias("_lower"), F.percentile("_mean", F.lit(1 - tail)).alias("_upper")
    )


#: Repetitions of a series that one row of the block bootstrap stands for.
REPETITIONS = 100


def block_bootstrap(
    dates: DataFrame,
    *,
    by: Sequence[str] = (),
    value: str = "difference",
    fold: str = "fold_id",
    blocks: Sequence[int] = (5,),
    repetitions: int = 10_000,
    confidence: float = 0.95,
    seed: int = 13,
) -> DataFrame:
    """Moving-block bootstrap of date values; blocks never cross folds.

    Input is one value per (by, fold, date). A block's sum is a difference of running sums. A series has one value a date, so
    its running sums fit one row; every row of a task has them once with a range of repetitions, whose blocks are drawn and
    looked up by index. Block ``j`` starts at ``draw(by|fold|L|seed, repetition, j) mod (n - L + 1)``.
    """
    series = [*by, fold]
    v = dates.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v")))).alias("_v"))
    setup = v.select(*series, F.transform("_v", lambda x: x["v"]).alias("_v"), F.explode(F.array(*(F.lit(b) for b in blocks))).alias("block_length"))
    first, second = seeds(F.concat_ws("|", *(F.col(c).cast("string") for c in series), F.col("block_length").cast("string"), F.lit(str(seed))))
    setup = setup.withColumns({"_one": first, "_two": second, "_from": F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1), F.lit(REPETITIONS)))})
    parts = max(1, min(dates.sparkSession.sparkContext.defaultParallelism * 4, -(-repetitions // REPETITIONS)))
    dealt = setup.repartition(parts, *series, "block_length", "_from")
    keys = list(by)
    schema = T.StructType([*(dealt.schema[c] for c in by), *(T.StructField(n, t) for n, t in (("block_length", T.IntegerType()), ("_rep", T.IntegerType()), ("_sum", T.DoubleType()), ("_size", T.LongType())))])

    def resample(batches):
        for b in batches:
            for row in b.to_dict("records"):
                values = np.asarray(row["_v"], float)
                n = len(values)
                upto, width = np.r_[0.0, np.cumsum(values)], min(row["block_length"], n)
                rep = np.arange(row["_from"], min(row["_from"] + REPETITIONS, repetitions), dtype=np.int64)
                one, two = repetition_keys(row["_one"], row["_two"], rep)
                j = np.arange(-(-n // width))
                take = np.minimum(width, n - j * width)
                start = draw(one[:, None], two[:, None], 1, j) % (n - width + 1)
                total = (upto[start + take] - upto[start]).sum(1)
                yield pd.DataFrame({**{c: [row[c]] * len(rep) for c in keys}, "block_length": row["block_length"], "_rep": rep, "_sum": total, "_size": n})

    group = [*by, "block_length"]
    means = dealt.mapInPandas(resample, schema).groupBy(*group, "_rep").agg((F.sum("_sum") / F.sum("_size")).alias("_mean"))
    ci = _interval(means, group, confidence)
    x = F.col(value)
    base = dates.groupBy(*by).agg(
        F.count(x).alias("paired_dates"),
        F.avg(x).alias("mean_difference"),
        # one value per date and fold: bounded by the calendar
        F.median(x).alias("median_difference"),
        F.avg((x < 0).cast("double")).alias("date_win_rate"),
        F.coalesce(F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))), F.lit(0.0)).alias("standardized_effect"),
    )
    ci = ci.withColumnsRenamed({"_lower": "ci_lower", "_upper": "ci_upper"})
    return ci.join(base, list(by)) if by else _with_row(ci, base)


def _with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Columns of a one-row table on every row."""
    packed = one.select(F.struct(*one.columns).alias("r")).scalar()
    return df.withColumn("_r", packed).select(*df.columns, "_r.*")


def seed_claim(effects: DataFrame, by: Sequence[str]) -> DataFrame:
    """True when all seeds point the same way and the averaged interval excludes zero."""
    e = F.col("mean_difference")
    return effects.groupBy(*by).agg(
        ((F.bool_and(e < 0) | F.bool_and(e > 0)) & ((F.max("ci_upper") < 0) | (F.min("ci_lower") > 0))).alias("supported"),
        F.count(F.lit(1)).alias("seeds"),
    )


def thresholds(train: DataFrame, columns: Sequence[str], q: float = 0.9) -> DataFrame:
    """One row with the TRAIN quantile of each column, exact at any size."""
    long = unpivot(train, [], columns, "what", "value")
    fitted = exact_quantiles(long, ["what"], "value", {"t": q})
    return fitted.agg(*(F.max(F.when(F.col("what") == c, F.col("t"))).alias(c) for c in columns))


def _flags(rows: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn("_t", fitted.select(F.struct(*columns).alias("t")).scalar())


def label_regimes(rows: DataFrame, fitted: DataFrame, names: dict[str, str]) -> DataFrame:
    """Flag columns ``names[column]`` at or above the threshold; ordinary is none of them."""
    out = _flags(rows, fitted, list(names)).withColumns(
        {flag: F.col(c) >= F.col("_t")[c] for c, flag in names.items()}
    )
    any_flag = F.lit(False)
    for flag in names.values():
        any_flag = any_flag | F.col(flag)
    return out.withColumn("ordinary", ~any_flag).drop("_t")


def unusual_sessions(rows: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Composite that needs to be strictly above any threshold."""
    over = F.lit(False)
    out = _flags(rows, fitted, columns)
    for c in columns:
        over = over | (F.col(c) > F.col("_t")[c])
    return out.withColumn("unusual_session", over).withColumn(
        "regime", F.when(F.col("unusual_session"), "unusual").otherwise("ordinary")
    ).drop("_t")


def difficulty_components(rows: DataFrame, case: Sequence[str], at: str, actual: str, baseline: str) -> DataFrame:
    """Absolute log level error and mean CDF gap of a causal baseline per case."""
    e = forecast_errors(rows, case, at, actual, baseline)
    return e.withColumnsRenamed({"log_volume_error": "level_error", "curve_error": "shape_error"})


def difficulty_table(errors: DataFrame, stratum: str, key: str) -> DataFrame:
    """CDF ranks of both errors per stratum and weights of mean one."""
    lv = empirical_cdf(errors.select(key, stratum, "level_error"), [stratum], "level_error", ties=[key], name="level_cdf_rank")
    sh = empirical_cdf(errors.select(key, stratum, "shape_error"), [stratum], "shape_error", ties=[key], name="shape_cdf_rank")
    both = errors.join(lv.select(key, "level_cdf_rank"), key).join(sh.select(key, "shape_cdf_rank"), key)
    rank = (F.col("level_cdf_rank") + F.col("shape_cdf_rank")) * 0.5
    # mid-ranks of a stratum average exactly one half, so the mean of 0.5 + rank is one
    return both.withColumn("weight", F.lit(0.5) + rank)


def volume_surprise(actual: str, expected: str):
    return F.log1p(actual) - F.log1p(expected)


def complete_horizon(as_of, *, tokens: int = 26, min_context: int = 4, longest: int = 8):
    """Origins whose longest horizon is still inside the session."""
    return (as_of >= min_context) & (as_of + longest - 1 < tokens)


def execution_table(ledger: DataFrame, baselines: DataFrame, value: str, identity: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Each method's means next to its matched difference from its own baseline.

    ``baselines`` maps method to baseline; the pairing is one join for all
    methods.
    """
    means = ledger.groupBy("method").agg(F.count(F.lit(1)).alias("cases"), *(F.avg(m).alias(m) for m in measures))
    cand = ledger.join(baselines, "method").select("method", "baseline", *identity, F.col(value).alias("_c"))
    base = ledger.select(F.col("method").alias("baseline"), *identity, F.col(value).alias("_b"))
    paired = cand.join(base, ["baseline", *identity]).groupBy("method", "baseline").agg(
        F.count(F.lit(1)).alias("matched_cases"), F.avg(F.col("_c") - F.col("_b")).alias("mean_difference")
    )
    sizes = means.select(F.col("method").alias("baseline"), F.col("cases").alias("_base_cases"))
    return (
        means.join(paired, "method")
        .join(sizes, "baseline")
        .withColumns(
            {
                "dropped_candidate": F.col("cases") - F.col("matched_cases"),
                "dropped_baseline": F.col("_base_cases") - F.col("matched_cases"),
            }
        )
        .drop("_base_cases", "cases")
    )
