"""Fits against NumPy, saved models, folds at once, and the choice of settings."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from barlens.operators import models as M
from barlens.session import scratch_path


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.exponential(size=n)
    y = 3 * x - z + rng.normal(size=n) * 0.1 + 5
    day = dt.date(2024, 1, 1)
    rows = [(i, day + dt.timedelta(days=i % 30), float(a) if i % 7 else None, float(b) if i % 11 else float("nan"), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return rows, spark.createDataFrame(rows, "sample_id int, session_date date, x double, z double, y double")


def test_ridge_is_the_closed_form_and_survives_saving(spark):
    rows, df = table(spark)
    model = M.fitted(df, "ridge", ["x", "z"], "y", alpha=40.0)
    x = np.array([[np.nan if v is None else v for v in r[2:4]] for r in rows], float)
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    u = (x - x.mean(0)) / x.std(0, ddof=1)
    y = np.array([r[4] for r in rows])
    w = np.linalg.solve(u.T @ u + 40.0 * np.diag(u.var(0)), u.T @ (y - y.mean()))
    want = dict(zip(range(len(rows)), u @ w + y.mean()))
    got = {r.sample_id: r.prediction for r in M.predict(model, df, ["sample_id"]).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert model.stages[0].getOrDefault("medians") == pytest.approx(np.nanmedian(np.array([[np.nan if v is None else v for v in r[2:4]] for r in rows], float), 0).tolist())
    path = scratch_path(spark, "model")
    model.write().save(path)
    again = {r.sample_id: r.prediction for r in M.predict(PipelineModel.load(path), df, ["sample_id"]).collect()}
    assert again == got


def test_one_fit_and_its_scores_derive_the_rows_once(spark, monkeypatch):
    from barlens.plans import source_queries

    seen, made = spark.sparkContext.accumulator(0), source_queries.daily(spark, "/root/testdata/sf0.001")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(source_queries, "daily", lambda spark, d: made.mapInArrow(counted, made.schema))
    got = source_queries.ridge_two_features(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == made.where("session_date >= date '1998-01-01'").count() > 0
    assert seen.value == made.count()


def test_columns_without_values_are_filled_with_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), (None, 3.0)], "a double, b double")
    out = M.MedianImputer(inputCols=["a", "b"], outputCols=["p", "q"]).fit(df).transform(df)
    assert [(r.p, r.q) for r in out.collect()] == [(0.0, 1.0), (0.0, 2.0), (0.0, 3.0)]


def folds(spark, days=30):
    day = dt.date(2024, 1, 1)
    name = lambda d, k: "train" if d < 12 + k else "validation" if d < 18 + k else "test"
    return spark.createDataFrame([(day + dt.timedelta(days=d), f"f{k}", name(d, k)) for k in (0, 3) for d in range(days)], "session_date date, fold_id string, partition string")


def test_folds_at_once_equal_folds_one_by_one(spark):
    _, df = table(spark)
    run = lambda parallel: M.walk_forward_train(df, folds(spark), family="ridge", features=["x", "z"], target="y", grid=({"alpha": 0.01}, {"alpha": 1e6}), parallel=parallel)
    (p, m), (q, n) = run(4), run(1)
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert key(p) == key(q) and key(m) == key(n)
    for r in m.collect():
        own = [x for x in p.collect() if x.fold_id == r.fold_id]
        e = np.array([x.prediction - x.actual for x in own])
        assert (r.test_mae, r.test_rmse, r.test_rows) == (pytest.approx(abs(e).mean()), pytest.approx(np.sqrt((e**2).mean())), len(own))
        assert r.chosen == "{'alpha': 0.01}" and r.train_rows > 0 and r.validation_rmse < 1.5


def test_a_fold_with_an_empty_partition_is_an_error(spark):
    _, df = table(spark)
    with pytest.raises(ValueError, match=r"empty partition: \['f0', 'f3'\]"):
        M.walk_forward_train(df, folds(spark, days=17), family="ridge", features=["x", "z"], target="y", grid=({"alpha": 0.01},))


def test_scale_and_shape_choose_apart_and_stop_early(spark):
    # the scale needs splits of few rows, the shape only one of many: deep trees with small leaves overfit its noise
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = int(rng.integers(0, 12))
        total = float(np.exp(2.0 * (x % 2) + 1))
        late = i % 2
        shares = np.array([0.2, 0.3, 0.5]) if late else np.array([0.5, 0.3, 0.2])
        shares = shares * np.exp(rng.normal(size=3) * 0.3)
        shares /= shares.sum()
        rows += [(i, float(x), float(late), total, 1.0, k, float(k), float(s), 1.0, "train" if i < 240 else "validation" if i < 320 else "test") for k, s in enumerate(shares)]
    shape = spark.createDataFrame(rows, "sample_id int, x double, late double, target_total double, baseline_remaining_volume double, target_bucket int, horizon double, target_share double, row_weight double, part string").cache()
    scale = shape.where("target_bucket = 0")
    at = lambda df, p: df.where(F.col("part") == p)
    grid = ({"max_depth": 1, "min_rows": 60}, {"max_depth": 5, "min_rows": 2})
    residual, logit, results = M.scale_shape_gbt(
        at(scale, "train"), at(shape, "train"), at(scale, "test"), at(shape, "test"), ("x",), ("late", "horizon"), at(scale, "validation"), at(shape, "validation"), grid, iterations=40, step=0.3, tolerance=0.01
    )
    got = results.collect()
    assert [r.scale_chosen for r in got] == [False, True] and sum(r.shape_chosen for r in got) == 1
    assert min(r.scale_mae for r in got) == got[1].scale_mae and all(r.scale_rounds < 40 and r.shape_rounds < 40 for r in got)
    e = residual.select(F.avg(F.abs(F.col("residual") - (F.log1p("target_total") - F.log1p(F.lit(1.0)))))).first()[0]
    assert e < 0.25 and logit.count() == 240 and len(M.BOOSTED) == 8
