"""Model fitting on point-in-time tables with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.operators.evaluate import regression_metrics
from barlens.operators.forecast import softmax
from barlens.operators.order_stats import quantiles
from barlens.operators.ranking import unpivot
from barlens.session import settle

#: Fits that run at the same time: each is a chain of Spark jobs, most of them too small for a cluster.
PARALLEL = 4
#: Settings of the boosted models: Spark's trees have no penalty on leaf values, a least gain of splits stands for it.
BOOSTED = tuple({"max_depth": d, "min_rows": n, "min_gain": g} for d, n, g in product((4, 5), (50, 200), (0.0, 1e-4)))


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact TRAIN medians of columns; a missing value (NULL or NaN) takes that of its column, 0 where there is none."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns = self.getInputCols()
        known = dataset.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns))
        got = {r["column"]: r["median"] for r in quantiles(unpivot(known, [], columns, "column", "value"), ["column"], "value", {"median": 0.5}).collect()}
        model = MedianImputerModel()._set(inputCols=columns, outputCols=self.getOutputCols(), medians=[float(got.get(c, 0.0)) for c in columns])
        return self._copyValues(model)


class MedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills columns with fitted medians; its parameters are all it consists of, so it is saved with them."""

    medians = Param(Params._dummy(), "medians", "a median for each input column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill = lambda c, m: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m))
        return dataset.withColumns({o: fill(c, m) for c, o, m in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians))})


def at_once(spark, work: Callable[[Any], Any], items: Sequence[Any], parallel: int = PARALLEL) -> list[Any]:
    """``work`` of every item in order, a few at a time: the driver's threads submit jobs, the cluster does the work."""
    with ThreadPoolExecutor(max(1, min(parallel, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def mean_baseline(train: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """TRAIN mean of the target."""
    return train.groupBy(*by).agg(F.avg(target).alias("prediction"), F.count(target).alias("rows"))


def regression_pipeline(family: str, features: Sequence[str], target: str, *, weight: str | None = None, **params) -> Pipeline:
    """Median impute, standardise, then ``ridge``, ``elastic_net`` or ``gbt``.

    ``alpha`` of a ridge weighs the penalty against the summed squares; Spark
    averages them and measures the target in deviations, so a ridge needs the
    number of training ``rows`` and the target's ``spread`` (:func:`fitted`
    takes both from the rows). A boosted
    model with ``valid`` (a column that marks validation rows) stops when these
    gain less than ``tolerance`` from a round.
    """
    filled = [f"{f}__filled" for f in features]
    stages = [
        MedianImputer(inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
    ]
    extra = {"weightCol": weight} if weight else {}
    if family == "ridge":
        model = LinearRegression(featuresCol="_x", labelCol=target, elasticNetParam=0.0, regParam=params.get("alpha", 0.1) / params["rows"] * params["spread"], **extra)
    elif family == "elastic_net":
        model = LinearRegression(
            featuresCol="_x", labelCol=target, regParam=params.get("alpha", 0.1), elasticNetParam=params.get("l1_ratio", 0.5), **extra
        )
    elif family == "gbt":
        model = GBTRegressor(
            featuresCol="_x", labelCol=target, maxDepth=params.get("max_depth", 3), maxIter=params.get("iterations", 10),
            stepSize=params.get("step", 0.1), seed=params.get("seed", 13), minInstancesPerNode=params.get("min_rows", 1),
            minInfoGain=params.get("min_gain", 0.0), subsamplingRate=params.get("sample", 1.0), **extra,
        )
        if "valid" in params:
            model = model.setValidationIndicatorCol(params["valid"]).setParams(validationTol=params.get("tolerance", 0.01))
    else:
        raise ValueError(f"unknown model family {family!r}")
    return Pipeline(stages=[*stages, model])


def fitted(train: DataFrame, family: str, features: Sequence[str], target: str, **params) -> PipelineModel:
    """The model of a family fitted to ``train``."""
    if family == "ridge":
        r = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
        params = {**params, "rows": r["n"], "spread": r["s"]}
    return regression_pipeline(family, features, target, **params).fit(train)


def predict(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(rows).select(*keep, "prediction")


def fit_predict(
    rows: DataFrame, train: Column | str, test: Column | str, family: str, features: Sequence[str], target: str, keep: Sequence[str], **params
) -> DataFrame:
    """Predictions for the rows that meet ``test`` of a model fitted to those that meet ``train``.

    A fit passes over its rows many times (medians, moments, solver): one written table of the needed columns serves all
    passes and the scoring, so that ``rows`` are derived once.
    """
    marks = {name: F.expr(c) if isinstance(c, str) else c for name, c in (("_train", train), ("_test", test))}
    needed = list(dict.fromkeys([*keep, *features, target]))
    table = settle(rows.withColumns(marks).where("_train or _test").select(*needed, "_train", "_test"))
    model = fitted(table.where("_train").drop("_train", "_test"), family, features, target, **params)
    return predict(model, table.where("_test"), keep)


def walk_forward_train(
    rows: DataFrame,
    membership: DataFrame,
    *,
    family: str,
    features: Sequence[str],
    target: str,
    grid: Sequence[Mapping[str, float]],
    keep: Sequence[str] = ("sample_id",),
    refit_on_validation: bool = True,
    parallel: int = PARALLEL,
) -> tuple[DataFrame, DataFrame]:
    """Test predictions of every fold, and a row of metrics for each, the setting chosen by validation RMSE.

    ``membership`` maps dates to (fold, partition); a fold with an empty partition
    is an error. Every fit and score is a Spark job; ``parallel`` folds and
    settings run at the same time, over one written table. Metrics: validation
    RMSE, test MAE and RMSE, the rows of each partition, the chosen setting.
    """
    spark = rows.sparkSession
    columns = list(dict.fromkeys([*keep, *features, target]))
    # one written table serves every fit; a lost executor does not recompute the features
    tagged = settle(rows.join(membership, "session_date").select(*columns, "fold_id", "partition"))
    sizes: dict[Any, dict[str, int]] = {}
    for r in membership.select("fold_id").distinct().collect():
        sizes[r["fold_id"]] = dict.fromkeys(("train", "validation", "test"), 0)
    for r in tagged.groupBy("fold_id", "partition").count().collect():
        sizes[r["fold_id"]][r["partition"]] = r["count"]
    if empty := sorted(str(f) for f, n in sizes.items() if not min(n[p] for p in ("train", "validation", "test"))):
        raise ValueError(f"folds with an empty partition: {empty}")
    part = lambda fold, *names: tagged.where((F.col("fold_id") == fold) & F.col("partition").isin(*names))

    def score(job: tuple[Any, Mapping[str, float]]) -> float:
        fold, params = job
        model = fitted(part(fold, "train"), family, features, target, **params)
        return regression_metrics(model.transform(part(fold, "validation")), [], target, "prediction").first()["rmse"]

    folds = sorted(sizes)
    jobs = [(f, g) for f in folds for g in grid]
    rmse = dict(zip(((f, i) for f in folds for i in range(len(grid))), at_once(spark, score, jobs, parallel)))
    best = {f: min(range(len(grid)), key=lambda i: rmse[f, i]) for f in folds}

    def final(fold: Any) -> PipelineModel:
        names = ("train", "validation") if refit_on_validation else ("train",)
        return fitted(part(fold, *names), family, features, target, **grid[best[fold]])

    out = None
    for fold, model in zip(folds, at_once(spark, final, folds, parallel)):
        p = model.transform(part(fold, "test")).select("fold_id", *keep, F.col(target).alias("actual"), "prediction")
        p = p.withColumn("chosen", F.lit(str(dict(grid[best[fold]]))))
        out = p if out is None else out.unionByName(p)
    of = lambda values: F.element_at(F.create_map(*(x for f in folds for x in (F.lit(f), F.lit(values(f))))), F.col("fold_id"))
    metrics = regression_metrics(out, ["fold_id", "chosen"], "actual", "prediction").select(
        "fold_id", of(lambda f: rmse[f, best[f]]).alias("validation_rmse"), F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"),
        *(of(lambda f, p=p: sizes[f][p]).cast("bigint").alias(f"{p}_rows") for p in ("train", "validation", "test")), "chosen",
    )
    return out, metrics


def scale_shape_gbt(
    scale_train: DataFrame,
    shape_train: DataFrame,
    scale_test: DataFrame,
    shape_test: DataFrame,
    features: Sequence[str],
    shape_features: Sequence[str],
    scale_validation: DataFrame,
    shape_validation: DataFrame,
    grid: Sequence[Mapping[str, float]] = BOOSTED,
    *,
    case: Sequence[str] = ("sample_id",),
    iterations: int = 2000,
    step: float = 0.03,
    tolerance: float = 0.001,
    parallel: int = PARALLEL,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boosted trees for the log residual of the total and the log share of each bucket.

    Every setting of ``grid`` is fitted to both, each until a round no longer helps its validation rows. The scale is chosen by
    its mean absolute log error there, the shape on its own by the mean gap between cumulative curves of a case's shares.
    Returns scale rows with ``residual``, shape rows with ``logit``, and ``(setting, scale_mae, shape_error, scale_rounds,
    shape_rounds, scale_chosen, shape_chosen)`` for each setting.
    """
    spark = scale_train.sparkSession
    y = F.log1p("target_total") - F.log1p("baseline_remaining_volume")
    z = F.ln(F.col("target_share") + 1e-6)

    def both(train: DataFrame, valid: DataFrame, name: str, value) -> DataFrame:
        tag = lambda df, v: df.withColumns({name: value, "_valid": F.lit(v)})
        columns = [c for c in train.columns if c in valid.columns]
        return settle(tag(train.select(*columns), False).unionByName(tag(valid.select(*columns), True)))

    scale, shape = both(scale_train, scale_validation, "_y", y), both(shape_train, shape_validation, "_z", z)

    def fit(job: tuple[str, Mapping[str, float]]) -> tuple[PipelineModel, float, int]:
        kind, g = job
        rows, cols, target, weight = (scale, features, "_y", None) if kind == "scale" else (shape, shape_features, "_z", "row_weight")
        model = regression_pipeline("gbt", cols, target, weight=weight, valid="_valid", iterations=iterations, step=step, tolerance=tolerance, **g).fit(rows)
        held = model.transform(rows.where("_valid"))
        if kind == "scale":
            error = held.agg(F.avg(F.abs(F.col("prediction") - F.col("_y")))).first()[0]
        else:
            error = _curve_error(held, case).first()[0]
        return model, error, model.stages[-1].getNumTrees

    fits = at_once(spark, fit, [(k, g) for k in ("scale", "shape") for g in grid], parallel)
    scales, shapes = fits[: len(grid)], fits[len(grid) :]
    chosen = [min(range(len(grid)), key=lambda i, f=f: f[i][1]) for f in (scales, shapes)]
    made = [
        F.struct(F.lit(str(dict(g))).alias("setting"), F.lit(a[1]).alias("scale_mae"), F.lit(b[1]).alias("shape_error"), F.lit(a[2]).alias("scale_rounds"), F.lit(b[2]).alias("shape_rounds"), F.lit(i == chosen[0]).alias("scale_chosen"), F.lit(i == chosen[1]).alias("shape_chosen"))
        for i, (g, a, b) in enumerate(zip(grid, scales, shapes))
    ]
    clean = lambda df, name: df.withColumnRenamed("prediction", name).drop(
        "_raw", "_x", *(c for c in df.columns if c.endswith("__filled"))
    )
    results = spark.range(1).select(F.inline(F.array(*made)))
    return clean(scales[chosen[0]][0].transform(scale_test), "residual"), clean(shapes[chosen[1]][0].transform(shape_test), "logit"), results


def _curve_error(rows: DataFrame, case: Sequence[str]) -> DataFrame:
    """Mean over cases of the mean gap between cumulative predicted and actual shares."""
    shares = softmax(rows, case, "prediction", name="_share")
    pairs = shares.groupBy(*case).agg(F.sort_array(F.collect_list(F.struct("target_bucket", (F.col("_share") - F.col("target_share")).alias("gap")))).alias("_p"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("total"))
    total = F.aggregate("_p", start, lambda a, x: F.struct((a["at"] + x["gap"]).alias("at"), (a["total"] + F.abs(a["at"] + x["gap"])).alias("total")))["total"]
    return pairs.agg(F.avg(total / F.size("_p")))


def frozen_vocabulary(train: DataFrame, column: str, output: str):
    """Category index fitted on TRAIN, alphabetical; unseen categories are an error on use."""
    return StringIndexer(inputCol=column, outputCol=output, handleInvalid="error", stringOrderType="alphabetAsc").fit(train)
