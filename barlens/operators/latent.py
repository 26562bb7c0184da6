"""Diagnostics over tables of embedding rows (arrays of a fixed size)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.functions.scalar import reasons
from barlens.session import settle

# Stabiliser of logarithms and ratios.
EPS = 1e-12


def compose_embedding(current: Column, predicted: Column, available: Column) -> Column:
    """Current latent, predictions zeroed where unavailable, then the availability flags."""
    masked = F.zip_with(predicted, available, lambda p, m: F.transform(p, lambda x: F.when(m, x).otherwise(0.0)))
    return F.concat(current, F.flatten(masked), F.transform(available, lambda m: m.cast("double")))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def squared_gap(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def by_dimension(rows: DataFrame, vector: str = "embedding", tolerance: float = 0.0) -> DataFrame:
    """Moments and activation of each dimension; only one row per dimension is shuffled per task."""
    x = F.coalesce(F.nanvl(F.col("x"), F.lit(0.0)), F.lit(0.0))
    return (
        rows.select(F.posexplode(vector).alias("dim", "x"))
        .groupBy("dim")
        .agg(
            F.avg(x).alias("mean"),
            F.var_pop(x).alias("variance"),
            F.avg((F.abs(x) > tolerance).cast("double")).alias("activation"),
        )
    )


def latent_diagnostics(rows: DataFrame, vector: str = "embedding", tolerance: float = 0.0) -> DataFrame:
    """Support, sparsity and variance facts in one row (rank: :func:`effective_rank`).

    Row facts are array expressions; quantiles run over the active count (at
    most ``d + 1`` distinct values) and over the ``d`` activation rates, so
    both are bounded by the embedding size.
    """
    v = F.transform(vector, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    d = F.size(vector).cast("double")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    per_row = rows.select(
        finite.alias("finite"),
        d.alias("d"),
        F.size(F.filter(v, lambda x: F.abs(x) > tolerance)).alias("active"),
        _sum(F.transform(v, F.abs)).alias("l1"),
        F.sqrt(_sum(F.transform(v, lambda x: x * x))).alias("l2"),
    )
    hoyer = (F.sqrt("d") - F.col("l1") / F.greatest(F.col("l2"), F.lit(EPS))) / (F.sqrt("d") - 1)
    r = per_row.agg(
        F.min(F.col("finite").cast("double")).alias("finite"),
        F.avg(1 - F.col("active") / F.col("d")).alias("zero_fraction"),
        F.avg(hoyer).alias("mean_hoyer_sparsity"),
        F.avg("active").alias("mean_active_dimensions"),
        F.percentile("active", F.lit(0.5)).alias("median_active_dimensions"),
        F.percentile("active", F.lit(0.95)).alias("p95_active_dimensions"),
    )
    p = F.col("activation")
    entropy = -p * F.ln(p + EPS) - (1 - p) * F.ln(1 - p + EPS)
    share = lambda c: F.avg(c.cast("double"))
    c = by_dimension(rows, vector, tolerance).agg(
        F.avg("variance").alias("mean_variance"),
        share(p > 0).alias("active_dimension_fraction"),
        share(p == 0).alias("dead_dimension_fraction"),
        share(p == 1).alias("always_on_dimension_fraction"),
        F.avg(entropy).alias("mean_support_entropy"),
        F.percentile("activation", F.lit(0.05)).alias("activation_frequency_q05"),
        F.percentile("activation", F.lit(0.5)).alias("activation_frequency_q50"),
        F.percentile("activation", F.lit(0.95)).alias("activation_frequency_q95"),
    )
    packed = c.select(F.struct(*c.columns).alias("c")).scalar()
    return r.withColumn("_c", packed).select(*r.columns, "_c.*")


def effective_rank(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """exp of the entropy of the principal variance shares.

    The covariance is a tree aggregation over the rows; only the ``d x d``
    matrix reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    d = rows.select(F.size(vector)).first()[0]
    vectors = rows.select(array_to_vector(vector).alias("v"))
    shares = np.asarray(PCA(k=d, inputCol="v", outputCol="p").fit(vectors).explainedVariance)
    rank = float(np.exp(-np.sum(shares * np.log(shares + EPS))))
    return rows.sparkSession.createDataFrame([(d, rank)], "dimensions int, effective_rank double")


def sparse_gate(diagnostics: DataFrame, target: float = 0.75) -> DataFrame:
    """Failed acceptance rules of a sparse representation."""
    return diagnostics.withColumn(
        "failures",
        reasons(
            (F.abs(F.col("zero_fraction") - target) > 0.05, "zero_fraction_off_target"),
            (F.col("active_dimension_fraction") < 0.8, "too_few_active_dimensions"),
            (F.col("dead_dimension_fraction") >= 0.2, "too_many_dead_dimensions"),
            (F.col("finite") != 1.0, "nonfinite_values"),
        ),
    )


def support_pairs(rows: DataFrame, group: str, order: str, vector: str, regime: str) -> DataFrame:
    """Consecutive rows of a group with their support overlap (a group is one session)."""
    w = Window.partitionBy(group).orderBy(order)
    bits = F.transform(vector, lambda x: (x > 0).cast("int"))
    r = rows.select(group, order, bits.alias("b"), F.col(regime).cast("string").alias("target"))
    r = r.withColumns({"a": F.lag("b").over(w), "source": F.lag("target").over(w)}).where("a is not null")
    count = lambda x, y: F.size(
        F.filter(F.zip_with("a", "b", lambda p, q: (p == x) & (q == y)), lambda m: m)
    )
    r = r.select(
        group, order, "source", "target",
        count(0, 0).alias("n00"), count(0, 1).alias("n01"), count(1, 0).alias("n10"), count(1, 1).alias("n11"),
    )
    union = F.col("n01") + F.col("n10") + F.col("n11")
    return r.withColumn("jaccard", F.when(union > 0, F.col("n11") / union).otherwise(1.0))


def support_summary(pairs: DataFrame, group: str) -> DataFrame:
    """Mean of the groups' mean overlap and the summed dimension transitions."""
    g = pairs.groupBy(group).agg(F.avg("jaccard").alias("j"), *(F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")))
    return g.agg(
        F.avg("j").alias("mean_consecutive_support_jaccard"),
        F.avg(1 - F.col("j")).alias("support_transition_rate"),
        F.sum("n00").alias("inactive_to_inactive"),
        F.sum("n01").alias("inactive_to_active"),
        F.sum("n10").alias("active_to_inactive"),
        F.sum("n11").alias("active_to_active"),
    )


def chance_overlap(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean over groups of the overlap independent supports would have.

    Groups of a single row have no transition and do not count.
    """
    m = rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(
        F.avg((F.col("x") > 0).cast("double")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    g = m.where("n >= 2").groupBy(group).agg(
        (F.sum(F.col("m") * F.col("m")) / F.greatest(F.sum(2 * F.col("m") - F.col("m") * F.col("m")), F.lit(EPS))).alias("c")
    )
    return g.agg(F.avg("c").alias("chance_support_jaccard"))


def regime_transitions(pairs: DataFrame, group: str) -> DataFrame:
    """Transition counts in long form; the overlap of staying in a regime is a mean of group means."""
    counts = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("transitions"))
    stay = (
        pairs.where("source = target")
        .groupBy(group, "source")
        .agg(F.avg("jaccard").alias("j"))
        .groupBy("source")
        .agg(F.avg("j").alias("support_jaccard"))
        .withColumn("target", F.col("source"))
    )
    return counts.join(stay, ["source", "target"], "left")


def identity_ratio(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction error over mean identity error."""
    return errors.groupBy(*by).agg(
        (F.avg("prediction_error") / F.greatest(F.avg("identity_error"), F.lit(EPS))).alias("identity_ratio")
    )


def latent_scale(train: DataFrame, vector: str = "embedding") -> DataFrame:
    """Covariance trace of TRAIN latents (sample variance) and its share per dimension."""
    per = train.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(
        F.var_samp("x").alias("v"), F.avg("x").alias("m")
    )
    return per.agg(
        F.sum("v").alias("covariance_trace"),
        (F.sum("v") / F.count(F.lit(1))).alias("per_dimension_variance"),
        F.count(F.lit(1)).alias("dimensions"),
        # one value per dimension
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("mean"),
    )


def latent_baselines(pairs: DataFrame, scale: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """NMSE of predicting zero, the TRAIN mean and the context for ``(context, target)`` rows."""
    fit = scale.select(F.struct("covariance_trace", "mean").alias("s")).scalar()
    t = F.col("target")
    zeros = F.transform(t, lambda x: F.lit(0.0))
    r = pairs.withColumn("_s", fit)
    trace = F.col("_s")["covariance_trace"]
    return r.groupBy(*by).agg(
        F.avg(squared_gap(t, zeros) / trace).alias("zero_nmse"),
        F.avg(squared_gap(t, F.col("_s")["mean"]) / trace).alias("train_mean_nmse"),
        F.avg(squared_gap(t, F.col("context")) / trace).alias("persistence_nmse"),
    )


def latent_nmse(pairs: DataFrame, scale: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared latent error over the TRAIN covariance trace."""
    trace = scale.select("covariance_trace").scalar()
    return pairs.withColumn("_t", trace).groupBy(*by).agg(
        F.avg(squared_gap(F.col(actual), F.col(predicted)) / F.col("_t")).alias("nmse")
    )


def probe_views(vector: Column) -> dict[str, Column]:
    """Support bits, magnitudes of the active values, and the full latent."""
    return {
        "support": F.transform(vector, lambda x: (x != 0).cast("double")),
        "magnitude": F.transform(vector, lambda x: F.when(x != 0, F.abs(x)).otherwise(0.0)),
        "full": vector,
    }


def class_scores(predictions: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Balanced accuracy and macro F1 from confusion counts."""
    cells = predictions.groupBy(*by, F.col(label).cast("int").alias("l"), F.col(predicted).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    each = cells.select(*by, F.col("n"), F.inline(F.array(
        F.struct(F.col("l").alias("c"), F.lit(1).alias("actual"), F.lit(0).alias("guessed"), (F.col("l") == F.col("p")).cast("int").alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).alias("actual"), F.lit(1).alias("guessed"), F.lit(0).alias("hit")),
    )))
    k = each.groupBy(*by, "c").agg(
        F.sum(F.col("n") * F.col("actual")).alias("a"), F.sum(F.col("n") * F.col("guessed")).alias("g"), F.sum(F.col("n") * F.col("hit")).alias("h")
    )
    return k.groupBy(*by).agg(
        F.avg(F.when(F.col("a") > 0, F.col("h") / F.col("a"))).alias("balanced_accuracy"),
        F.avg(F.lit(2.0) * F.col("h") / (F.col("a") + F.col("g"))).alias("macro_f1"),
    )


def logistic_probe(train: DataFrame, test: DataFrame, vector: str, label: str = "label", iterations: int = 500, c: float = 1.0) -> DataFrame:
    """Test predictions of a logistic model fitted on TRAIN rows only.

    The penalty is half the squared weights against ``c`` times the summed
    losses, on the features as they are.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    as_rows = lambda df: df.withColumn("_x", array_to_vector(vector)).withColumn("_y", F.col(label).cast("double"))
    penalty = 1.0 / (c * max(train.count(), 1))  # Spark averages the losses
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=iterations, regParam=penalty, elasticNetParam=0.0, standardization=False).fit(as_rows(train))
    return model.transform(as_rows(test)).drop("_x", "_y", "rawPrediction", "probability")


def gram(rows: DataFrame, features: str, targets: str) -> DataFrame:
    """Sums of products of ``[1, features, targets]`` in long form ``(i, j, value)``.

    Each task reduces its Arrow batches to one ``p x p`` matrix with a matrix
    product; only those matrices are shuffled. Index 0 is the constant.
    """

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["f"].to_numpy())
                y = np.stack(pdf["t"].to_numpy())
                z = np.column_stack((np.ones(len(x)), x, y))
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": [r.tolist() for r in total]})

    parts = rows.select(F.col(features).alias("f"), F.col(targets).alias("t")).mapInPandas(partial, "i long, row array<double>")
    return parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))


def ridge_solve(sums: DataFrame, features: int, alphas: Sequence[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """Centred ridge solutions ``(slopes, intercepts)`` per alpha from the ``p x p`` sums.

    The matrix has a fixed size whatever the row count.
    """
    flat = sums.toPandas()
    size = int(flat["i"].max()) + 1
    m = np.zeros((size, size))
    m[flat["i"], flat["j"]] = flat["value"]
    n = m[0, 0]
    mx, my = m[0, 1 : features + 1] / n, m[0, features + 1 :] / n
    xx = m[1 : features + 1, 1 : features + 1] - n * np.outer(mx, mx)
    xy = m[1 : features + 1, features + 1 :] - n * np.outer(mx, my)
    out = {}
    for a in alphas:
        slope = np.linalg.solve(xx + a * np.eye(features), xy)
        out[a] = (slope, my - mx @ slope)
    return out


def linear_scores(rows: DataFrame, features: str, targets: str, slope: np.ndarray, intercept: np.ndarray, by: Sequence[str] = (), scale: Sequence[float] | None = None) -> DataFrame:
    """NMSE, MAE and RMSE per target of a linear map, evaluated in the JVM.

    ``scale`` holds each target's variance on TRAIN; without it the variance of
    the rows scored is used.
    """
    k = len(intercept)
    columns = F.array(*(F.array(*(F.lit(float(v)) for v in slope[:, t])) for t in range(k)))
    base = F.array(*(F.lit(float(v)) for v in intercept))
    dot = lambda w: _sum(F.zip_with(features, w, lambda x, c: x * c))
    predicted = F.zip_with(F.transform(columns, dot), base, lambda a, b: a + b)
    both = rows.select(*by, F.posexplode(F.arrays_zip(F.col(targets).alias("y"), predicted.alias("p"))).alias("target", "z"))
    e = F.col("z.p") - F.col("z.y")
    spread = F.var_samp("z.y") if scale is None else F.get(F.array(*(F.lit(float(v)) for v in scale)), F.col("target"))
    return both.groupBy(*by, "target").agg(
        (F.avg(e * e) / F.greatest(spread, F.lit(EPS))).alias("nmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def ridge_probe(
    train: DataFrame, validation: DataFrame, test: DataFrame, features: str, targets: str, *, size: int, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0)
) -> DataFrame:
    """Ridge fitted on TRAIN, alpha chosen on validation, scored per target on test."""
    fits = ridge_solve(gram(train, features, targets), size, alphas)
    spread = train.select(F.posexplode(targets).alias("target", "y")).groupBy("target").agg(F.var_pop("y").alias("v")).orderBy("target").collect()
    scale = [r["v"] for r in spread]
    scored = []
    for a in alphas:
        mean = linear_scores(validation, features, targets, *fits[a], scale=scale).agg(F.avg("nmse")).first()[0]
        scored.append((mean, a))
    best = min(scored)[1]
    return linear_scores(test, features, targets, *fits[best], scale=scale).withColumn("alpha", F.lit(best))


def hash_normal(key: str) -> float:
    """Standard normal number determined by a text key (two hash uniforms, Box-Muller)."""
    u = [
        (int(hashlib.sha256(f"{key}|{s}".encode()).hexdigest()[:15], 16) + 1) / 1152921504606846977.0 for s in ("a", "b")
    ]
    return math.sqrt(-2.0 * math.log(u[0])) * math.cos(2.0 * math.pi * u[1])


def hash_normal_column(key: Column) -> Column:
    """The same rule as a column."""
    u = lambda s: (F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(s)), 256), 1, 15), 16, 10).cast("double") + 1.0) / F.lit(
        1152921504606846977.0
    )
    return F.sqrt(F.lit(-2.0) * F.ln(u("a"))) * F.cos(F.lit(2.0) * F.pi() * u("b"))


def projection_matrix(rows: int, columns: int, seed: int) -> np.ndarray:
    """Unit-norm Gaussian columns determined by the seed."""
    m = np.array([[hash_normal(f"{seed}|{i}|{j}") for j in range(columns)] for i in range(rows)])
    return m / np.maximum(np.linalg.norm(m, axis=0, keepdims=True), EPS)


def project(rows: DataFrame, vector: str, matrix: np.ndarray, name: str = "projected") -> DataFrame:
    """Matrix product of every row with a fixed matrix, batch by batch."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def product(batches):
        for pdf in batches:
            if len(pdf):
                pdf[name] = list(np.stack(pdf[vector].to_numpy()) @ matrix)
                yield pdf

    return rows.mapInPandas(product, schema)


#: Sorted values of one direction that a task holds of each sample, rows projected at once, and rows that set the ranges.
RUN, PROJECTED, SAMPLE = 1 << 20, 2048, 1 << 16


def sliced_wasserstein(rows: DataFrame, key: str, vector: str, *, size: int, directions: int, seed: int, run: int = RUN) -> DataFrame:
    """Mean squared gap between sorted projections of the rows and of a normal sample, per direction.

    A batch leaves one row for each direction and value range, with its projections packed and sorted, so rows, not single
    values, are shuffled, and once. A task merges the runs of both samples in its range. Their ranks follow from the counts
    below the range; what ranks they share is compared on the spot, and only what stands opposite another range moves again,
    in pieces cut at multiples of ``run`` ranks. Ranges are cut at quantiles of at most SAMPLE rows; they bound a task's work
    and do not touch the result. The driver sees counts and range bounds only.
    """
    spark = rows.sparkSession
    matrix = projection_matrix(size, directions, seed)
    sample_key = lambda i: F.concat_ws("|", F.lit(str(seed + 1)), F.col(key).cast("string"), i.cast("string"))
    dims = F.sequence(F.lit(0), F.lit(size - 1))
    both = rows.select(key, F.col(vector).alias("v"), F.transform(dims, lambda i: hash_normal_column(sample_key(i))).alias("t"))
    n = rows.count()
    ranges = max(1, -(-n // run))
    bounds = None
    if ranges > 1:
        few = both.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // min(SAMPLE, 64 * ranges)))) == 0).limit(2 * SAMPLE).toPandas()
        seen = np.concatenate([np.stack(few[c].to_numpy()) for c in ("v", "t")]) @ matrix if len(few) else np.zeros((1, directions))
        bounds = np.quantile(seen, np.arange(1, ranges) / ranges, axis=0)

    def runs(batches):
        for whole in batches:
            for at in range(0, len(whole), PROJECTED):
                b = whole.iloc[at : at + PROJECTED]
                x, y = (np.sort(np.stack(b[c].to_numpy()) @ matrix, axis=0) for c in ("v", "t"))
                for d in range(0, directions, 64):
                    out = []
                    for k in range(d, min(d + 64, directions)):
                        cuts = [[0, *(np.searchsorted(s[:, k], bounds[:, k]) if ranges > 1 else ()), len(b)] for s in (x, y)]
                        for r in range(ranges):
                            (i, j), (u, w) = (c[r : r + 2] for c in cuts)
                            if j > i or w > u:
                                out.append((k, r, x[i:j, k], y[u:w, k]))
                    yield pd.DataFrame(out, columns=["direction", "range", "x", "y"])

    packed = both.select("v", "t").mapInPandas(runs, "direction int, range int, x array<double>, y array<double>")
    parts = max(min(directions * ranges, 4 * spark.sparkContext.defaultParallelism), n * directions // (8 * run))
    if ranges > 1:
        packed = settle(packed)
        below = Window.partitionBy("direction").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        counts = packed.groupBy("direction", "range").agg(*(F.sum(F.size(c)).alias(f"n{c}") for c in "xy"))
        starts = counts.select("direction", "range", *(F.coalesce(F.sum(f"n{c}").over(below), F.lit(0)).alias(f"{c}_from") for c in "xy"))
        dealt = packed.repartition(parts, "direction", "range").join(starts, ["direction", "range"])
    else:
        dealt = packed.repartition(parts, "direction", "range").withColumns({f"{c}_from": F.lit(0).cast("bigint") for c in "xy"})

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        sides = [(np.sort(np.concatenate(g[c].to_numpy())), int(g[f"{c}_from"].iloc[0])) for c in "xy"]
        first = max(start for _, start in sides)
        last = max(first, min(start + len(v) for v, start in sides))
        x, y = (v[first - start : last - start] for v, start in sides)
        out = [(float(((x - y) ** 2).sum()), len(x), None, None, None, None)]
        for side, (v, start) in enumerate(sides):
            end = start + len(v)
            for i, j in ((start, min(first, end)), (max(last, start), end)):
                for piece in range(i // run, -(-j // run) if j > i else 0):
                    lo, hi = max(i, piece * run), min(j, (piece + 1) * run)
                    out.append((0.0, 0, piece, side, lo, v[lo - start : hi - start]))
        made = pd.DataFrame(out, columns=["total", "n", "piece", "side", "at", "values"]).astype({"piece": "Int64", "side": "Int64", "at": "Int64"})
        made.insert(0, "direction", g["direction"].iloc[0])
        return made

    def matched(g: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.concatenate(g[g["side"] == side].sort_values("at")["values"].to_numpy()) for side in (0, 1))
        return pd.DataFrame({"direction": [g["direction"].iloc[0]], "total": [float(((x - y) ** 2).sum())], "n": [len(x)]})

    made = dealt.groupBy("direction", "range").applyInPandas(merged, "direction int, total double, n bigint, piece bigint, side int, at bigint, values array<double>")
    totals = made.select("direction", "total", "n")
    if ranges > 1:
        made = settle(made)
        rest = made.where("piece is not null").groupBy("direction", "piece").applyInPandas(matched, "direction int, total double, n bigint")
        totals = made.select("direction", "total", "n").unionAll(rest)
    return totals.groupBy("direction").agg((F.sum("total") / F.sum("n")).alias("squared_distance"), F.sum("n").alias("rows"))


def select_lambda(candidates: DataFrame, runs: int = 2) -> DataFrame:
    """Coefficient with the least mean error among those whose every run passed; ties to the smaller.

    A coefficient without all its runs, or no coefficient that passed, is an error.
    """
    per = candidates.groupBy("coefficient").agg(
        F.avg("error").alias("error"),
        F.bool_and(F.col("gate") == "PASS").alias("passed"),
        F.count_distinct("geometry").alias("runs"),
    )
    short = F.raise_error(F.lit("a coefficient lacks runs")).cast("boolean")
    ok = F.when(F.col("runs") == runs, F.col("passed")).otherwise(short)
    best = per.withColumn("ok", ok).agg(
        F.min_by(F.when(F.col("ok"), F.col("coefficient")), F.when(F.col("ok"), F.struct("error", "coefficient"))).alias("coefficient"),
        F.count_if("ok").alias("eligible"),
    )
    none = F.raise_error(F.lit("no coefficient passed")).cast("double")
    return best.withColumn("coefficient", F.when(F.col("eligible") > 0, F.col("coefficient")).otherwise(none))
