"""Resampling, sorted runs and positions against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.operators import evaluate as E
from barlens.operators import latent as L
from barlens.operators.ranking import exact_quantiles, with_positions

M = 1 << 32


def mix(x):
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) % M
    return x ^ (x >> 16)


def keys(text, rep):
    h = hashlib.sha256(text.encode()).hexdigest()
    return [mix((int(h[i : i + 8], 16) + rep * 0x9E3779B9) % M) for i in (0, 8)]


def draw(one, two, node, j):
    return mix((mix((mix((one + node) % M) + j) % M) + two) % M)


def resampled(values, text, rep):
    """Mean of one repetition: every leaf's draws, split from the root down."""
    one, two = keys(text, rep)
    n, total = len(values), 0.0
    leaves = -(-n // E.LEAF)
    edge = lambda i: i * n // leaves
    stack, drawn = [(1, 0, leaves, n)], 0
    while stack:
        node, a, b, c = stack.pop()
        if b - a == 1:
            drawn += c
            total += sum(values[edge(a) + draw(one, two, node, j) % (edge(b) - edge(a))] for j in range(c))
            continue
        m = (a + b) // 2
        p = (edge(m) - edge(a)) / (edge(b) - edge(a))
        u, v = ((draw(one, two, node, M - 1 - k) + 1) / (M + 1) for k in (1, 0))
        z = math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
        left = min(c, max(0, math.floor(c * p + math.sqrt(max(c * p * (1 - p) - 1 / 12, 0)) * z + 0.5)))
        stack += [(2 * node, a, m, left), (2 * node + 1, m, b, c - left)]
    assert drawn == n
    return total / n


def test_bootstrap_mean_equals_its_rule(spark, monkeypatch):
    rng = np.random.default_rng(0)
    sizes = {"a": 1, "b": 7, "hot": 3000, "c": 257}
    data = {g: rng.normal(size=n).round(3).tolist() for g, n in sizes.items()}
    rows = [(g, i, v) for g, vs in data.items() for i, v in enumerate(vs)] + [("b", 99, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    got = {r.g: (r.ci_lower, r.ci_upper) for r in E.bootstrap_mean(df, ["g"], ["i"], "v", repetitions=30, seed=3).collect()}
    for g, vs in data.items():
        means = [resampled(vs, f"{g}|3", r) for r in range(30)]
        assert got[g] == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=1e-9), g
    assert E.bootstrap_mean(df.limit(0), ["g"], ["i"], "v", repetitions=5).count() == 0


def test_bootstrap_mean_spreads_as_the_mean_does(spark):
    values = np.random.default_rng(1).normal(size=4000)
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(values)], "g string, i int, v double")
    r = E.bootstrap_mean(df, ["g"], ["i"], "v").first()
    half = 1.96 * values.std() / math.sqrt(len(values))
    assert (r.ci_upper - r.ci_lower) / 2 == pytest.approx(half, rel=0.08)
    assert (r.ci_upper + r.ci_lower) / 2 == pytest.approx(values.mean(), abs=0.1 * half)


def test_block_bootstrap_equals_its_rule(spark):
    rng = np.random.default_rng(2)
    folds = {"f1": rng.normal(size=23), "f2": rng.normal(size=3)}
    df = spark.createDataFrame([("s", f, i, float(v)) for f, vs in folds.items() for i, v in enumerate(vs)], "s string, fold_id string, date int, difference double")
    got = {r.block_length: r for r in E.block_bootstrap(df, by=["s"], blocks=(1, 5), repetitions=250, seed=13).collect()}
    for length in (1, 5):
        means = []
        for rep in range(250):
            sample = []
            for f, vs in folds.items():
                one, two = keys(f"s|{f}|{length}|13", rep)
                w, own = min(length, len(vs)), []
                while len(own) < len(vs):
                    at = draw(one, two, 1, len(own) // w) % (len(vs) - w + 1)
                    own += vs[at : at + w].tolist()
                sample += own[: len(vs)]
            means.append(np.mean(sample))
        assert (got[length].ci_lower, got[length].ci_upper) == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=1e-9)
        assert got[length].paired_dates == 26


@pytest.mark.parametrize(("run", "shift"), [(1 << 20, 0.0), (60, 0.0), (60, 9.0), (7, 0.5)])
def test_sliced_wasserstein_in_any_number_of_ranges(spark, run, shift):
    v = np.random.default_rng(4).normal(size=(400, 6)) + shift
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, v array<double>").repartition(5)
    got = {r.direction: r for r in L.sliced_wasserstein(df, "id", "v", size=6, directions=9, seed=21, run=run).collect()}
    m = L.projection_matrix(6, 9, 21)
    t = np.array([[L.hash_normal(f"22|{i}|{k}") for k in range(6)] for i in range(400)])
    want = ((np.sort(v @ m, 0) - np.sort(t @ m, 0)) ** 2).mean(0)
    assert [got[k].squared_distance for k in range(9)] == pytest.approx(want.tolist(), rel=1e-9)
    assert {r.rows for r in got.values()} == {400}


def test_positions_are_those_of_a_window(spark):
    rows = [(g, i % 40, i) for g, n in (("hot", 900), ("b", 3), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(9)
    got = with_positions(df, ["g"], ["x", "i"], descending=["x"]).collect()
    w = Window.partitionBy("g").orderBy(F.desc("x"), "i")
    want = df.select("g", "x", "i", (F.row_number().over(w) - 1).alias("_before"), F.count("*").over(Window.partitionBy("g")).alias("_n")).collect()
    key = lambda r: (r.g or "", r.x, r.i, r._before, r._n)
    assert sorted(map(key, got)) == sorted(map(key, want))
    q = {r.g: r.m for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert q["hot"] == np.median([i % 40 for i in range(900)]) and q["b"] == 1
