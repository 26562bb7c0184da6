"""Evaluation statistics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions.draws import MASK, draw_sql, keys_sql
from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import evaluate as E
from barlens.operators import identity as I
from barlens.plans.dataset_queries import regimes, samples, sequence_tokens
from barlens.plans.execution_queries import tca_primary
from barlens.plans.forecast_queries import matrix4, profile4
from barlens.plans.history_queries import full_tokens
from barlens.plans.identity_queries import ledger
from barlens.plans.registry import cte, query
from barlens.sources import market

# actual against profile, per 4-hour bucket
cte("c_fa", "SELECT p.instrument_id, p.session_date, p.bucket, m.volume AS actual, p.expected_volume AS predicted, p.share FROM c_profile4 p JOIN c_b4 m USING (instrument_id, session_date, bucket)")


def actual_forecast(spark, d):
    key = ["instrument_id", "session_date", "bucket"]
    m = matrix4(spark, d).withColumnRenamed("volume", "actual")
    return profile4(spark, d).select(*key, F.col("expected_volume").alias("predicted"), "share").join(m, key)


@query("regression_metrics", "SELECT instrument_id, round(avg(abs(predicted - actual)) + 1e-9, 6) AS mae, round(sqrt(avg(power(predicted - actual, 2))) + 1e-9, 6) AS rmse, count(*) AS rows FROM c_fa GROUP BY 1")
def regression_metrics(spark, d):
    m = E.regression_metrics(actual_forecast(spark, d), ["instrument_id"], "actual", "predicted")
    return m.withColumns({"mae": rnd_ratio("mae"), "rmse": rnd_ratio("rmse")})


SHAPE = ("share_mae", "share_rmse", "cross_entropy", "kl_divergence", "cumulative_curve_error", "wasserstein_bucket_distance")


@query("shape_metrics", """WITH n AS (SELECT *, actual / greatest(sum(actual) OVER w, 1e-12) AS a, predicted / greatest(sum(predicted) OVER w, 1e-12) AS p FROM c_fa WINDOW w AS (PARTITION BY instrument_id, session_date)),
 g AS (SELECT *, abs(sum(a) OVER r - sum(p) OVER r) AS gap FROM n WINDOW r AS (PARTITION BY instrument_id, session_date ORDER BY bucket))
SELECT instrument_id, session_date, round(avg(abs(p - a)) + 1e-9, 6) AS share_mae, round(sqrt(avg(power(p - a, 2))), 6) AS share_rmse, round(-sum(a * ln(p + 1e-12)), 6) AS cross_entropy, round(sum(a * ln((a + 1e-12) / (p + 1e-12))), 6) AS kl_divergence,
  round(sum(gap) + 1e-9, 6) AS cumulative_curve_error, round(sum(gap) + 1e-9, 6) AS wasserstein_bucket_distance FROM g GROUP BY 1, 2""")
def shape_metrics(spark, d):
    m = E.shape_metrics(actual_forecast(spark, d), ["instrument_id", "session_date"], "bucket", "actual", "predicted")
    return m.withColumns({c: (rnd if c in ("share_rmse", "cross_entropy", "kl_divergence") else rnd_ratio)(c) for c in SHAPE})


ERR = """SELECT {case}, sum(actual) AS actual_remaining, sum(predicted) AS predicted_remaining, avg(gap) AS curve_error, abs(ln(1 + sum(predicted)) - ln(1 + sum(actual))) AS log_volume_error FROM (
 SELECT *, abs(sum(predicted) OVER r / nullif(sum(predicted) OVER w, 0) - sum(actual) OVER r / nullif(sum(actual) OVER w, 0)) AS gap FROM {src} WINDOW w AS (PARTITION BY {case}), r AS (PARTITION BY {case} ORDER BY {at})) GROUP BY {case}"""
cte("c_fe", ERR.format(case="instrument_id, session_date", at="bucket", src="c_fa"))


@query("forecast_metrics", "SELECT instrument_id, round(avg(log_volume_error), 6) AS log_remaining_volume_mae, round(avg(curve_error), 6) AS conditional_curve_error, count(*) AS cases FROM c_fe GROUP BY 1")
def forecast_metrics(spark, d):
    e = E.forecast_errors(actual_forecast(spark, d), ["instrument_id", "session_date"], "bucket", "actual", "predicted")
    m = E.forecast_metrics(e, ["instrument_id"])
    return m.withColumns({c: rnd(c) for c in ("log_remaining_volume_mae", "conditional_curve_error")})


# method ledger: three methods forecast every sample's remaining volume
cte("c_fl_rows", """SELECT s.sample_id, s.as_of_token, q.token, m.method, m.seed, CAST(q.volume AS DOUBLE) AS actual, CASE m.method WHEN 'count' THEN q.baseline * 45 WHEN 'flat' THEN 50 + m.seed ELSE q.volume / 2 + 20 END::DOUBLE AS predicted
FROM c_samples s JOIN c_seq q ON q.session_id = s.session_id AND q.token >= s.as_of_token, (VALUES ('count', NULL), ('flat', 13), ('flat', 29), ('half', NULL)) m(method, seed) WHERE m.method <> 'half' OR s.as_of_token < 15""")
cte("c_fl", ERR.format(case="method, seed, sample_id, as_of_token", at="token", src="c_fl_rows"))


def ledger_rows(spark, d):
    """Long actual/predicted rows; one method covers only the earlier origins."""
    s = samples(spark, d).select("sample_id", "session_id", "as_of_token", "valid_count")
    s = s.withColumn("token", F.explode(F.expr("sequence(as_of_token, cast(valid_count as int) - 1)")))
    q = sequence_tokens(spark, d).select("session_id", "token", "volume", "baseline")
    none = F.lit(None).cast("int")
    methods = F.array(
        *(F.struct(F.lit(m).alias("method"), seed.alias("seed")) for m, seed in (("count", none), ("flat", F.lit(13)), ("flat", F.lit(29)), ("half", none)))
    )
    j = s.join(q, ["session_id", "token"]).select("*", F.inline(methods)).where("method <> 'half' or as_of_token < 15")
    predicted = (
        F.when(F.col("method") == "count", F.col("baseline") * 45.0)
        .when(F.col("method") == "flat", F.lit(50.0) + F.col("seed"))
        .otherwise(F.col("volume") * 0.5 + 20)
    )
    return j.select("method", "seed", "sample_id", "as_of_token", "token", F.col("volume").cast("double").alias("actual"), predicted.alias("predicted"))


def forecast_ledger_df(spark, d):
    return E.forecast_errors(ledger_rows(spark, d), ["method", "seed", "sample_id", "as_of_token"], "token", "actual", "predicted")


@query("forecast_ledger", "SELECT method, seed, sample_id, as_of_token, actual_remaining, predicted_remaining, round(log_volume_error, 6) AS log_volume_error, round(curve_error + 1e-9, 6) AS curve_error FROM c_fl")
def forecast_ledger(spark, d):
    return forecast_ledger_df(spark, d).withColumns({"log_volume_error": rnd("log_volume_error"), "curve_error": rnd_ratio("curve_error")})


@query("forecast_table", """WITH k AS (SELECT sample_id FROM c_fl GROUP BY 1 HAVING count(DISTINCT method || '_' || coalesce(seed, -1)) = 4)
SELECT method, seed, as_of_token, round(avg(log_volume_error), 6) AS log_remaining_volume_mae, round(avg(curve_error), 6) AS conditional_curve_error, count(*) AS cases FROM c_fl WHERE sample_id IN (SELECT sample_id FROM k) GROUP BY 1, 2, 3""")
def forecast_table(spark, d):
    e = forecast_ledger_df(spark, d).withColumn("key", F.concat_ws("_", "method", F.coalesce("seed", F.lit(-1)).cast("string")))
    m = E.forecast_metrics(I.common_cases(e, ["sample_id"], "key"), ["method", "seed", "as_of_token"])
    return m.withColumns({c: rnd(c) for c in ("log_remaining_volume_mae", "conditional_curve_error")})


@query("accessibility_curve", """SELECT l_returnflag AS geometry, l_linenumber AS horizon, l_linestatus AS capacity, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS size, round(avg(l_discount), 6) AS mean_error, count(*) AS rows FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4""")
def accessibility_curve(spark, d):
    """Mean error by geometry, horizon, capacity and size."""
    li = market.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_linestatus", "l_partkey", "l_discount")
    p = market.table(spark, d, "part").select("p_partkey", "p_size")
    j = li.join(p, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(
        F.col("l_returnflag").alias("geometry"), F.col("l_linenumber").alias("horizon"), F.col("l_linestatus").alias("capacity"), F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("size")
    ).agg(rnd(F.avg("l_discount")).alias("mean_error"), F.count(F.lit(1)).alias("rows"))


@query("case_mean_by_date", "SELECT method, date, round(avg(value), 6) AS value FROM c_ledger GROUP BY 1, 2")
def case_mean_by_date(spark, d):
    return E.case_mean_by_date(ledger(spark, d), "value", ["method"]).withColumn("value", rnd("value"))


@query("strategy_summary", """SELECT l_returnflag AS strategy, count(*) AS run_count, round(avg(l_extendedprice), 2) AS mean, round(stddev_samp(l_extendedprice), 2) AS std, round(quantile_cont(l_extendedprice, 0.1) + 1e-6, 4) AS q10,
  round(median(l_extendedprice) + 1e-6, 4) AS median, round(quantile_cont(l_extendedprice, 0.9) + 1e-6, 4) AS q90, round(avg(l_tax), 6) AS mean_l_tax FROM lineitem GROUP BY 1""")
def strategy_summary(spark, d):
    li = market.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("strategy"), "l_extendedprice", "l_tax")
    s = E.strategy_summary(li, "l_extendedprice", extra=["l_tax"])
    return s.withColumns({"mean": rnd("mean", 2), "std": rnd("std", 2), "mean_l_tax": rnd("mean_l_tax"), **{q: rnd(F.col(q) + 1e-6, 4) for q in ("q10", "median", "q90")}})


cte("c_pairs", "SELECT c.method AS strategy, c.date, c.instrument_id, c.value - b.value AS difference FROM c_ledger c JOIN c_ledger b ON b.method = 'N' AND b.date = c.date AND b.instrument_id = c.instrument_id WHERE c.method <> 'N'")


def pairs(spark, d):
    r = ledger(spark, d).withColumnRenamed("method", "strategy")
    return I.pair_strategies(r, baseline="N", pair=["date", "instrument_id"], value="value").withColumn("difference", F.round("difference", 6))


@query("paired_differences", """SELECT strategy, count(*) AS paired_count, round(avg(round(difference, 6)), 5) AS mean_difference, round(avg(CASE WHEN round(difference, 6) < 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(median(round(difference, 6)) + 1e-9, 5) AS median_difference FROM c_pairs GROUP BY 1""")
def paired_differences(spark, d):
    p = E.paired_differences(pairs(spark, d))
    return p.withColumns({"mean_difference": rnd("mean_difference", 5), "win_rate": rnd("win_rate"), "median_difference": rnd_ratio("median_difference", 5)})


cte("c_bydate", "SELECT strategy, date, avg(round(difference, 6)) AS difference FROM c_pairs GROUP BY 1, 2")


def by_date(spark, d):
    return pairs(spark, d).groupBy("strategy", "date").agg(F.avg("difference").alias("difference"))


@query("bootstrap_mean", f"""WITH RECURSIVE v AS (SELECT strategy, difference AS v, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY strategy) AS n FROM c_bydate),
 r AS (SELECT strategy, n, (n + {E.LEAF - 1}) // {E.LEAF} AS leaves, rep.range AS rep, {keys_sql("strategy || '|17'", "rep.range")} FROM (SELECT strategy, max(n) AS n FROM v GROUP BY 1), range(2000) rep),
 t AS (SELECT strategy, rep, n, leaves, one, two, 1::BIGINT AS node, 0::BIGINT AS a, leaves AS b, n AS c FROM r
  UNION ALL SELECT strategy, rep, n, leaves, one, two, 2 * node + s.s, CASE s.s WHEN 0 THEN a ELSE m END, CASE s.s WHEN 0 THEN m ELSE b END, CASE s.s WHEN 0 THEN l ELSE c - l END
  FROM (SELECT *, (a + b) // 2 AS m, (m * n // leaves - a * n // leaves) / (b * n // leaves - a * n // leaves) AS p, {draw_sql("node", str(MASK - 1), "u")}, {draw_sql("node", str(MASK), "w")},
    sqrt(-2 * ln((u + 1) / {MASK + 2})) * cos(2 * pi() * (w + 1) / {MASK + 2}) AS z, CAST(greatest(0, least(c, floor(c * p + sqrt(greatest(c * p * (1 - p) - 1.0::DOUBLE / 12, 0)) * z + 0.5))) AS BIGINT) AS l FROM t WHERE b - a > 1), (VALUES (0), (1)) s(s)),
 w AS (SELECT strategy, rep, n, leaves, a, one, two, node, unnest(range(c)) AS j FROM t WHERE b - a = 1),
 d AS (SELECT strategy, rep, a * n // leaves AS start, {draw_sql("node", "j", "u")}, start + u % ((a + 1) * n // leaves - start) AS pos FROM w),
 m AS (SELECT d.strategy, rep, sum(v.v) / max(v.n) AS mean FROM d JOIN v ON v.strategy = d.strategy AND v.pos = d.pos GROUP BY 1, 2)
SELECT strategy, round(quantile_cont(mean, 0.025), 6) AS ci_lower, round(quantile_cont(mean, 0.975), 6) AS ci_upper FROM m GROUP BY 1""")
def bootstrap_mean(spark, d):
    """Interval of the mean date difference (dates are the resampled unit)."""
    b = E.bootstrap_mean(by_date(spark, d), ["strategy"], ["date"], "difference")
    return b.withColumns({"ci_lower": rnd("ci_lower"), "ci_upper": rnd("ci_upper")})


FOLD_DATES = 'CASE WHEN date <= DATE \'1997-12-31\' THEN \'early\' ELSE \'late\' END'
cte("c_fd", f"SELECT strategy, {FOLD_DATES} AS fold_id, date, difference FROM c_bydate")


def fold_dates(spark, d):
    return by_date(spark, d).withColumn("fold_id", F.when(F.col("date") <= F.lit("1997-12-31").cast("date"), "early").otherwise("late"))


def block_sql(lengths: str, reps: int) -> str:
    return f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY strategy, fold_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY strategy, fold_id) AS n FROM c_fd),
 e AS (SELECT strategy, fold_id, pos + 1 AS pos, sum(difference) OVER (PARTITION BY strategy, fold_id ORDER BY pos) AS upto FROM v UNION ALL SELECT DISTINCT strategy, fold_id, 0, 0 FROM v),
 s AS (SELECT strategy, fold_id, max(n) AS n, l.l AS block_length, least(l.l, max(n)) AS w FROM v, (VALUES {lengths}) l(l) GROUP BY 1, 2, l.l),
 k AS (SELECT strategy, fold_id, block_length, n, w, rep.range AS rep, {keys_sql("strategy || '|' || fold_id || '|' || block_length || '|13'", "rep.range")} FROM s, range({reps}) rep),
 b AS (SELECT *, unnest(range(CAST(ceil(n / w) AS BIGINT))) AS j FROM k),
 c AS (SELECT strategy, fold_id, block_length, rep, least(w, n - j * w) AS take, {draw_sql("1", "j", "u")}, u % (n - w + 1) AS st FROM b),
 x AS (SELECT c.strategy, c.block_length, rep, sum(hi.upto - lo.upto) AS total, sum(take) AS taken FROM c JOIN e lo ON lo.strategy = c.strategy AND lo.fold_id = c.fold_id AND lo.pos = c.st
  JOIN e hi ON hi.strategy = c.strategy AND hi.fold_id = c.fold_id AND hi.pos = c.st + c.take GROUP BY 1, 2, 3),
 m AS (SELECT strategy, block_length, rep, total / taken AS mean FROM x),
 q AS (SELECT strategy, block_length, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY 1, 2)
SELECT q.strategy, q.block_length, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, count(*) AS paired_dates, round(avg(difference), 6) AS mean_difference, round(median(difference), 6) AS median_difference,
  round(avg(CASE WHEN difference < 0 THEN 1.0 ELSE 0 END), 6) AS date_win_rate, round(avg(difference) / stddev_samp(difference), 6) AS standardized_effect FROM q JOIN c_fd USING (strategy) GROUP BY q.strategy, q.block_length, lo, hi"""


BOOT = ("ci_lower", "ci_upper", "mean_difference", "median_difference", "date_win_rate", "standardized_effect")


@query("block_bootstrap", block_sql("(5)", 10_000))
def block_bootstrap(spark, d):
    b = E.block_bootstrap(fold_dates(spark, d), by=["strategy"], blocks=(5,))
    return b.withColumns({c: rnd(c) for c in BOOT})


@query("block_sensitivity", block_sql("(1), (5), (10)", 10_000))
def block_sensitivity(spark, d):
    b = E.block_bootstrap(fold_dates(spark, d), by=["strategy"], blocks=(1, 5, 10))
    return b.withColumns({c: rnd(c) for c in BOOT})


@query("seed_claim", """SELECT p_type AS candidate, bool_and(m < 0) OR bool_and(m > 0) AS same_direction, (bool_and(m < 0) OR bool_and(m > 0)) AND (max(m + s) < 0 OR min(m - s) > 0) AS supported, count(*) AS seeds FROM
 (SELECT p_type, l_linenumber AS seed, avg(l_discount) - 0.0499 AS m, stddev_samp(l_discount) / 100 AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY 1""")
def seed_claim(spark, d):
    """Line numbers as seeds, part types as candidates."""
    li = market.table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_discount")
    p = market.table(spark, d, "part").select("p_partkey", "p_type")
    e = li.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("candidate"), F.col("l_linenumber").alias("seed")).agg(
        (F.avg("l_discount") - 0.0499).alias("mean_difference"), (F.stddev_samp("l_discount") / 100).alias("s")
    )
    e = e.withColumns({"ci_lower": F.col("mean_difference") - F.col("s"), "ci_upper": F.col("mean_difference") + F.col("s")})
    m = F.col("mean_difference")
    same = e.groupBy("candidate").agg((F.bool_and(m < 0) | F.bool_and(m > 0)).alias("same_direction"))
    return E.seed_claim(e, ["candidate"]).join(same, "candidate")


@query("execution_table", """WITH b AS (SELECT * FROM (VALUES ('twap', 'vwap'), ('pov', 'vwap'), ('vwap', 'vwap')) t(method, baseline)), p AS (SELECT c.method, b.baseline, count(*) AS matched_cases, avg(c.regret - d.regret) AS md FROM c_tcaprimary c JOIN b USING (method) JOIN c_tcaprimary d ON d.method = b.baseline AND d.order_id = c.order_id GROUP BY 1, 2),
 n AS (SELECT method, count(*) AS cases, avg(regret) AS regret, avg(impact_cost) AS impact_cost, avg(completion_rate) AS completion_rate FROM c_tcaprimary GROUP BY 1)
SELECT n.method, p.baseline, round(n.regret, 4) AS regret, round(n.impact_cost, 4) AS impact_cost, round(n.completion_rate, 6) AS completion_rate, matched_cases, round(md, 4) AS mean_difference, n.cases - matched_cases AS dropped_candidate, bn.cases - matched_cases AS dropped_baseline
FROM n JOIN p ON p.method = n.method JOIN n bn ON bn.method = p.baseline""")
def execution_table(spark, d):
    base = spark.createDataFrame([("twap", "vwap"), ("pov", "vwap"), ("vwap", "vwap")], "method string, baseline string")
    t = E.execution_table(tca_primary(spark, d), base, "regret", ["order_id"], ["regret", "impact_cost", "completion_rate"])
    return t.withColumns({"regret": rnd("regret", 4), "impact_cost": rnd("impact_cost", 4), "completion_rate": rnd("completion_rate"), "mean_difference": rnd("mean_difference", 4)})


REG = ("volume_surprise", "realized_volatility", "curve_error")
cte("c_reg", 'SELECT sample_id, session_id, as_of_token, "partition", ' + ", ".join(f"round({c} + 1e-10, 8) AS {c}" for c in REG) + " FROM c_regime")
cte("c_thr", "SELECT " + ", ".join(f"quantile_cont({c}, 0.9) AS t_{c}" for c in REG) + """ FROM c_reg WHERE "partition" = 'train'""")


def regime_rows(spark, d):
    """Regime statistics, rounded so that both engines see equal values at the thresholds."""
    return regimes(spark, d).select("sample_id", "session_id", "as_of_token", "partition", *(F.round(F.col(c) + 1e-10, 8).alias(c) for c in REG))


@query("regime_thresholds", "SELECT " + ", ".join(f"round(t_{c} + 1e-10, 6) AS {c}" for c in REG) + " FROM c_thr")
def regime_thresholds(spark, d):
    t = E.thresholds(regime_rows(spark, d).where("partition = 'train'"), REG)
    return t.select(*(rnd(F.col(c) + 1e-10).alias(c) for c in REG))


@query("label_regimes", "SELECT sample_id, volume_surprise >= t_volume_surprise AS high_volume_surprise, realized_volatility >= t_realized_volatility AS high_volatility, curve_error >= t_curve_error AS abnormal_shape, NOT (volume_surprise >= t_volume_surprise OR realized_volatility >= t_realized_volatility OR curve_error >= t_curve_error) AS ordinary FROM c_reg, c_thr")
def label_regimes(spark, d):
    r = regime_rows(spark, d)
    t = E.thresholds(r.where("partition = 'train'"), REG)
    names = dict(zip(REG, ("high_volume_surprise", "high_volatility", "abnormal_shape")))
    return E.label_regimes(r, t, names).select("sample_id", *names.values(), "ordinary")


@query("unusual_sessions", "SELECT sample_id, u AS unusual_session, CASE WHEN u THEN 'unusual' ELSE 'ordinary' END AS regime FROM (SELECT sample_id, volume_surprise > t_volume_surprise OR realized_volatility > t_realized_volatility OR curve_error > t_curve_error AS u FROM c_reg, c_thr)")
def unusual_sessions(spark, d):
    r = regime_rows(spark, d)
    t = E.thresholds(r.where("partition = 'train'"), REG)
    return E.unusual_sessions(r, t, REG).select("sample_id", "unusual_session", "regime")


@query("baseline_regime", "SELECT sample_id, curve_error >= t_curve_error AS unusual_market, NOT curve_error >= t_curve_error AS ordinary_market FROM c_reg, c_thr")
def baseline_regime(spark, d):
    r = regime_rows(spark, d)
    t = E.thresholds(r.where("partition = 'train'"), ["curve_error"])
    return E.label_regimes(r, t, {"curve_error": "unusual_market"}).select("sample_id", "unusual_market", F.col("ordinary").alias("ordinary_market"))


cte("c_move", """SELECT r.*, abs(b.ret) AS benchmark_move FROM c_reg r JOIN (SELECT CAST(session_date AS VARCHAR) AS d, token, round(ln(close / open) + 1e-10, 8) AS ret FROM (SELECT session_date, row_number() OVER (PARTITION BY session_date ORDER BY minute) - 1 AS token, open, close FROM c_hour WHERE instrument_id = 'click')) b
 ON b.d = right(r.session_id, 10) AND b.token = r.as_of_token - 1""")


@query("probe_states", """WITH t AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.9) AS t_{c}" for c in (*REG, "benchmark_move")) + """ FROM c_move WHERE "partition" = 'train')
SELECT sample_id, volume_surprise >= t_volume_surprise AS high_volume_surprise, realized_volatility >= t_realized_volatility AS high_volatility, curve_error >= t_curve_error AS abnormal_shape, benchmark_move >= t_benchmark_move AS large_benchmark_move,
  NOT (volume_surprise >= t_volume_surprise OR realized_volatility >= t_realized_volatility OR curve_error >= t_curve_error OR benchmark_move >= t_benchmark_move) AS ordinary FROM c_move, t""")
def probe_states(spark, d):
    from barlens.plans.inputs import hour_bars

    order = Window.partitionBy("session_date").orderBy("minute")
    b = hour_bars(spark, d).where("instrument_id = 'click'").select(
        F.col("session_date").cast("string").alias("day"), F.row_number().over(order).alias("as_of_token"),
        F.abs(F.round(F.ln(F.col("close") / F.col("open")) + 1e-10, 8)).alias("benchmark_move"),
    )
    r = regime_rows(spark, d).withColumn("day", F.right("session_id", F.lit(10))).join(b, ["day", "as_of_token"])
    cols = [*REG, "benchmark_move"]
    t = E.thresholds(r.where("partition = 'train'"), cols)
    names = dict(zip(cols, ("high_volume_surprise", "high_volatility", "abnormal_shape", "large_benchmark_move")))
    return E.label_regimes(r, t, names).select("sample_id", *names.values(), "ordinary")


# difficulty: future tokens of every origin against the mean of all earlier sessions
cte("c_diffrows", """SELECT t.instrument_id, t.session_date, a.range AS as_of, t.token, t.volume AS actual, coalesce(t.prior_mean, o.observed_mean) AS baseline FROM c_prior t, range(1, 6) a
 JOIN c_prior o ON true WHERE o.instrument_id = t.instrument_id AND o.session_date = t.session_date AND o.token = a.range AND t.token >= a.range""")
cte("c_diff", ERR.replace("predicted", "baseline").format(case="instrument_id, session_date, as_of", at="token", src="c_diffrows"))


def difficulty(spark, d):
    """Level and shape error per (instrument, session, origin)."""
    from barlens.operators.history import prior_mean

    t = prior_mean(full_tokens(spark, d))
    future = t.select("instrument_id", "session_date", "token", F.col("volume").alias("actual"), "prior_mean").withColumn(
        "as_of", F.explode(F.expr("sequence(1, cast(token as int))"))
    ).where("token >= 1")
    seen = t.select("instrument_id", "session_date", F.col("token").alias("as_of"), "observed_mean")
    rows = future.join(seen, ["instrument_id", "session_date", "as_of"]).withColumn("baseline", F.coalesce("prior_mean", "observed_mean"))
    return E.difficulty_components(rows, ["instrument_id", "session_date", "as_of"], "token", "actual", "baseline")


@query("difficulty_components", "SELECT instrument_id, session_date, as_of, round(log_volume_error, 6) AS level_error, round(curve_error + 1e-9, 6) AS shape_error FROM c_diff")
def difficulty_components(spark, d):
    return difficulty(spark, d).select("instrument_id", "session_date", "as_of", rnd("level_error").alias("level_error"), rnd_ratio("shape_error").alias("shape_error"))


cte("c_dtab", """SELECT *, instrument_id || '|' || session_date || '|' || as_of AS k FROM (SELECT instrument_id, session_date, as_of, round(log_volume_error + 1e-10, 8) AS level_error, round(curve_error + 1e-10, 8) AS shape_error FROM c_diff)""")
cte("c_dw", """SELECT *, (row_number() OVER (PARTITION BY as_of ORDER BY level_error, k) - 0.5) / count(*) OVER (PARTITION BY as_of) AS level_cdf_rank, (row_number() OVER (PARTITION BY as_of ORDER BY shape_error, k) - 0.5) / count(*) OVER (PARTITION BY as_of) AS shape_cdf_rank FROM c_dtab""")


def difficulty_rows(spark, d):
    e = difficulty(spark, d).select(
        "instrument_id", "session_date", "as_of", F.round(F.col("level_error") + 1e-10, 8).alias("level_error"), F.round(F.col("shape_error") + 1e-10, 8).alias("shape_error")
    )
    e = e.withColumn("k", F.concat_ws("|", "instrument_id", F.col("session_date").cast("string"), F.col("as_of").cast("string")))
    return E.difficulty_table(e, "as_of", "k")


@query("difficulty_table", "SELECT k, as_of, round(level_cdf_rank, 6) AS level_cdf_rank, round(shape_cdf_rank, 6) AS shape_cdf_rank, round(level_error, 5) AS level_error, round(shape_error, 5) AS shape_error FROM c_dw")
def difficulty_table(spark, d):
    return difficulty_rows(spark, d).select("k", "as_of", rnd("level_cdf_rank").alias("level_cdf_rank"), rnd("shape_cdf_rank").alias("shape_cdf_rank"), rnd("level_error", 5).alias("level_error"), rnd("shape_error", 5).alias("shape_error"))


@query("difficulty_weights", "SELECT k, round((0.5 + (level_cdf_rank + shape_cdf_rank) / 2) / (SELECT avg(0.5 + (level_cdf_rank + shape_cdf_rank) / 2) FROM c_dw), 6) AS weight FROM c_dw")
def difficulty_weights(spark, d):
    return difficulty_rows(spark, d).select("k", rnd("weight").alias("weight"))


@query("volume_surprise", "SELECT instrument_id, session_date, bucket, round(ln(1 + actual) - ln(1 + predicted), 6) AS surprise FROM c_fa")
def volume_surprise(spark, d):
    return actual_forecast(spark, d).select("instrument_id", "session_date", "bucket", rnd(E.volume_surprise("actual", "predicted")).alias("surprise"))


@query("complete_horizon", "SELECT sample_id, as_of_token FROM c_samples WHERE as_of_token >= 4 AND as_of_token + 7 < 26")
def complete_horizon(spark, d):
    return samples(spark, d).where(E.complete_horizon(F.col("as_of_token"))).select("sample_id", "as_of_token")
