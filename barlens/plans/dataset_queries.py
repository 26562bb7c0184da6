"""Datasets, splits, samples and sequences."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import bars as B
from barlens.operators import clean as C
from barlens.operators import datasets as D
from barlens.operators import history as H
from barlens.plans.history_queries import HISTORY, INTRADAY, INTRADAY_SQL, features
from barlens.plans.identity_queries import actions, intervals
from barlens.plans.inputs import DAY_4H, bars, calendar, daily, hour_bars
from barlens.plans.registry import CTES, cte, query
from barlens.sources import market


def buckets4(spark, d):
    return B.bucket_minutes(bars(spark, d), 240, ("symbol", "session_date"))


@query("session_filter", """SELECT symbol, session_date, CASE WHEN minutes IS NULL THEN 'not_exchange_session' WHEN minutes < 1440 THEN 'early_close_excluded'
  WHEN n <> minutes // 60 THEN 'incomplete_session:' || n || '_of_' || minutes // 60 || '_buckets' END AS reason
FROM (SELECT symbol, session_date, count(*) AS n FROM c_b60 GROUP BY 1, 2) LEFT JOIN c_calendar USING (session_date)""")
def session_filter(spark, d):
    b = B.bucket_minutes(bars(spark, d), 60, ("symbol", "session_date"))
    return D.session_filter(b, calendar(spark), 60, full=1440)


TS = "CAST({d} AS TIMESTAMP) + to_minutes(CAST({b} * 240 AS BIGINT))"
HIST = ", ".join(f"round(h.{c} + 1e-9, 6) AS {c}" for c in HISTORY)
HIST4 = "(SELECT *, lag(last_bucket) OVER (PARTITION BY symbol ORDER BY session_date) AS pb FROM c_hist JOIN (SELECT symbol, session_date, max(bucket) AS last_bucket FROM c_b4 GROUP BY 1, 2) USING (symbol, session_date))"
cte("c_static_ds", f"""SELECT b.symbol || '|' || b.session_date || '|static' AS sample_id, b.symbol, b.session_date, {TS.format(d='b.session_date', b='(min(b.bucket) OVER w)')} AS as_of, {TS.format(d='b.session_date', b='b.bucket')} AS target_at,
  row_number() OVER (PARTITION BY b.symbol, b.session_date ORDER BY b.bucket) - 1 AS target_bucket_index, CAST(isodow(b.session_date) - 1 AS DOUBLE) AS weekday, {HIST}, round(ln(1 + sum(b.volume) OVER w), 6) AS target_log_total_volume,
  round(b.volume / sum(b.volume) OVER w + 1e-9, 6) AS target_volume_share, CAST(sum(b.volume) OVER w AS DOUBLE) AS target_remaining_volume, {TS.format(d='h.previous_session_date', b='h.pb')} AS available_at
FROM c_b4 b JOIN {HIST4} h ON h.symbol = b.symbol AND h.session_date = b.session_date WHERE h.previous_session_date IS NOT NULL WINDOW w AS (PARTITION BY b.symbol, b.session_date)""")


@query("static_dataset", "SELECT * FROM c_static_ds")
def static_dataset(spark, d):
    return _static(D.static_dataset(buckets4(spark, d), 240))


def _static(rows):
    return rows.select(
        "sample_id", "symbol", "session_date", "as_of", "target_at", "target_bucket_index", "weekday", *(rnd_ratio(c).alias(c) for c in HISTORY),
        rnd("target_log_total_volume").alias("target_log_total_volume"), rnd_ratio("target_volume_share").alias("target_volume_share"), "target_remaining_volume", "available_at",
    )


# the composed build: the same rows over the sessions that the calendar and their completeness allow
cte("c_verdict4", """SELECT symbol, session_date, CASE WHEN minutes IS NULL THEN 'not_exchange_session' WHEN minutes < 1440 THEN 'early_close_excluded'
  WHEN n <> minutes // 240 THEN 'incomplete_session:' || n || '_of_' || minutes // 240 || '_buckets' END AS reason
FROM (SELECT symbol, session_date, count(*) AS n FROM c_b4 GROUP BY 1, 2) LEFT JOIN c_calendar USING (session_date)""")
cte("c_b4v", "SELECT b.* FROM c_b4 b JOIN (SELECT symbol, session_date FROM c_verdict4 WHERE reason IS NULL) v ON v.symbol = b.symbol AND v.session_date = b.session_date")
_usable = lambda sql: re.sub(r"\bc_(b4|sess|hist)\b", r"c_\1v", sql)
cte("c_sessv", "SELECT s.* FROM c_sess s JOIN (SELECT symbol, session_date FROM c_verdict4 WHERE reason IS NULL) v ON v.symbol = s.symbol AND v.session_date = s.session_date")
cte("c_histv", _usable(CTES["c_hist"]))


@query("build_dataset", _usable(CTES["c_static_ds"]))
def build_dataset(spark, d):
    return _static(D.build_dataset(buckets4(spark, d), calendar(spark), 240, full=1440)[0])


@query("build_dataset_exclusions", """SELECT symbol, session_date, reason FROM c_verdict4 WHERE reason IS NOT NULL
UNION ALL SELECT symbol, min(session_date), 'insufficient_history' FROM c_verdict4 WHERE reason IS NULL GROUP BY symbol""")
def build_dataset_exclusions(spark, d):
    return D.build_dataset(buckets4(spark, d), calendar(spark), 240, full=1440)[1]


@query("dynamic_dataset", f"""SELECT i.symbol || '|' || i.session_date || '|dynamic|' || lpad(CAST(i.k AS VARCHAR), 4, '0') AS sample_id, {TS.format(d='i.session_date', b='i.bucket')} AS as_of,
  {TS.format(d='i.session_date', b='j.bucket')} AS target_at, j.k AS target_bucket_index, {", ".join(f"round(i.{c}, 6) AS {c}" for c in INTRADAY)}, {HIST},
  round(j.volume / i.session_volume + 1e-9, 6) AS target_volume_share, CAST(i.remaining_volume AS DOUBLE) AS target_remaining_volume, round(coalesce(j.volume / nullif(i.remaining_volume, 0), 0) + 1e-9, 6) AS target_conditional_share,
  {TS.format(d='i.session_date', b='i.previous_bucket')} AS available_at
FROM c_intra4 i JOIN c_intra4 j ON j.symbol = i.symbol AND j.session_date = i.session_date AND j.k >= i.k JOIN {HIST4} h ON h.symbol = i.symbol AND h.session_date = i.session_date WHERE i.k >= 1 AND h.previous_session_date IS NOT NULL""")
def dynamic_dataset(spark, d):
    return D.dynamic_dataset(buckets4(spark, d), 240).select(
        "sample_id", "as_of", "target_at", "target_bucket_index", *(rnd(c).alias(c) for c in INTRADAY), *(rnd_ratio(c).alias(c) for c in HISTORY),
        rnd_ratio("target_volume_share").alias("target_volume_share"), "target_remaining_volume", rnd_ratio("target_conditional_share").alias("target_conditional_share"), "available_at",
    )


@query("future_triangle", """SELECT i.symbol, i.session_date, i.bucket, j.bucket AS target_bucket, j.volume AS target_volume FROM c_b60 i JOIN c_b60 j ON j.symbol = i.symbol AND j.session_date = i.session_date AND j.bucket >= i.bucket""")
def future_triangle(spark, d):
    b = B.bucket_minutes(bars(spark, d), 60, ("symbol", "session_date"))
    return D.future_triangle(b).select("symbol", "session_date", "bucket", "target_bucket", "target_volume")


@query("check_available", """SELECT CAST(count(*) AS BIGINT) AS rows, count(*) - count(DISTINCT (sample_id, target_at)) AS duplicates, count(*) FILTER (late) AS features_after_as_of, count(*) FILTER (target_at < as_of) AS targets_before_as_of, CAST(0 AS BIGINT) AS null_identities
FROM (SELECT *, CASE WHEN weekday = 4 THEN as_of + INTERVAL 1 DAY ELSE available_at END > as_of AS late FROM c_static_ds)""")
def check_available(spark, d):
    """The static dataset with Friday features made a day late."""
    s = D.static_dataset(buckets4(spark, d), 240)
    late = F.when(F.col("weekday") == 4, F.col("as_of") + F.expr("interval 1 day")).otherwise(F.col("available_at"))
    return C.check_available(s.withColumn("available_at", late), ["sample_id", "target_at"])


@query("walk_forward", """WITH d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM c_min)),
 f AS (SELECT d.*, g.range AS f FROM d, range(0, 100) g WHERE g.range <= (n - 22) // 5 AND n >= 22)
SELECT * FROM (SELECT 'fold-' || lpad(CAST(f + 1 AS VARCHAR), 3, '0') AS fold_id, session_date, CASE WHEN i < 10 + f * 5 THEN 'train' WHEN i >= 11 + f * 5 AND i < 16 + f * 5 THEN 'validation' WHEN i >= 17 + f * 5 AND i < 22 + f * 5 THEN 'test' END AS "partition" FROM f) WHERE "partition" IS NOT NULL""")
def walk_forward(spark, d):
    return D.walk_forward(hour_bars(spark, d), train=10, validation=5, test=5, step=5, embargo=1)


# hourly bars as tokens: a session's tokens are its observed hours in order
cte("c_seq", """SELECT instrument_id || '-' || session_date AS session_id, instrument_id, session_date, row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY minute) - 1 AS token, volume, trade_count AS baseline,
  ln(1 + volume) - ln(1 + trade_count) AS volume_surprise, ln(high / low) AS realized_vol FROM c_hour""")
cte("c_seqs", """SELECT session_id, CASE WHEN dayofmonth(session_date) <= 15 THEN 'train' WHEN dayofmonth(session_date) <= 22 THEN 'validation' ELSE 'test' END AS "partition", CAST(session_date - 1 AS DATE) AS cutoff, count(*) AS n FROM c_seq GROUP BY 1, 2, 3""")
cte("c_samples", """SELECT substr(sha256(session_id || '|fold-1|' || "partition" || '|' || a || '|' || cutoff), 1, 20) AS sample_id, session_id, "partition", cutoff, n, CAST(a AS INTEGER) AS as_of_token, CAST(greatest(0, a - 8) AS INTEGER) AS context_start, CAST(a AS INTEGER) AS context_end
FROM (SELECT *, unnest(range(4, n)) AS a FROM c_seqs)""")


def sequence_tokens(spark, d):
    h = hour_bars(spark, d)
    order = Window.partitionBy("instrument_id", "session_date").orderBy("minute")
    return h.select(
        F.concat_ws("-", "instrument_id", F.col("session_date").cast("string")).alias("session_id"), "instrument_id", "session_date",
        (F.row_number().over(order) - 1).alias("token"), "volume", F.col("trade_count").alias("baseline"),
        (F.log1p("volume") - F.log1p("trade_count")).alias("volume_surprise"), F.ln(F.col("high") / F.col("low")).alias("realized_vol"),
    )


def samples(spark, d):
    day = F.dayofmonth("session_date")
    s = sequence_tokens(spark, d).groupBy("session_id", "session_date").agg(F.count(F.lit(1)).alias("valid_count"))
    s = s.withColumns(
        {
            "fold_id": F.lit("fold-1"),
            "partition": F.when(day <= 15, "train").when(day <= 22, "validation").otherwise("test"),
            "cutoff": F.date_sub("session_date", 1),
        }
    ).drop("session_date")
    return D.sample_index(s)


@query("sample_index", """SELECT sample_id, session_id, "partition", as_of_token, context_start, context_end, list_aggregate([as_of_token, as_of_token + 1, as_of_token + 3, as_of_token + 7], 'string_agg', ',') AS targets,
  list_aggregate([as_of_token < n, as_of_token + 1 < n, as_of_token + 3 < n, as_of_token + 7 < n], 'string_agg', ',') AS mask FROM c_samples""")
def sample_index(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return samples(spark, d).select(
        "sample_id", "session_id", "partition", "as_of_token", "context_start", "context_end", text("target_indices").alias("targets"), text("target_mask").alias("mask")
    )


@query("check_sample", """SELECT count(*) AS samples, count(*) FILTER (context_end > context_start) AS context_ok, count(*) AS targets_ok, count(*) FILTER (as_of_token < n) AS any_target FROM c_samples""")
def check_sample(spark, d):
    n = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    return C.check_samples(samples(spark, d)).agg(F.count(F.lit(1)).alias("samples"), n("context_ok"), n("targets_ok"), n("any_target"))


@query("check_tokens", """SELECT instrument_id, session_date, count(*) AS tokens, bool_or(hour - coalesce(lag, -1) <> 1) AS has_gap, false AS availability_not_increasing, dayofmonth(session_date) = 13 AS cutoff_leak
FROM (SELECT *, minute // 60 AS hour, lag(minute // 60) OVER (PARTITION BY instrument_id, session_date ORDER BY minute) AS lag FROM c_hour) GROUP BY 1, 2""")
def check_tokens(spark, d):
    t = hour_bars(spark, d).select(
        "instrument_id", "session_date", (F.col("minute") / 60).cast("int").alias("token"), (F.col("minute") + 60).alias("available_minute"),
        F.when(F.dayofmonth("session_date") == 13, F.col("session_date")).otherwise(F.date_sub("session_date", 1)).alias("cutoff"),
    )
    return C.check_tokens(t)


@query("causal_ledger", """SELECT *, cutoff < session_date AS causal FROM (SELECT instrument_id, session_date, lag(session_date) OVER (PARTITION BY instrument_id ORDER BY session_date) AS cutoff FROM c_daily) WHERE cutoff IS NOT NULL""")
def causal_ledger(spark, d):
    return D.causal_ledger(daily(spark, d))


WINDOW_COLS = ("volume", "volume_surprise", "realized_vol")


def arrays(spark, d):
    return D.session_arrays(sequence_tokens(spark, d), ["volume", "baseline", "volume_surprise", "realized_vol"])


cte("c_window", """SELECT s.sample_id, s.as_of_token, slot.range AS slot, q.token IS NOT NULL AS mask, coalesce(CAST(q.volume AS DOUBLE), 0) AS volume, coalesce(q.volume_surprise, 0) AS volume_surprise, coalesce(q.realized_vol, 0) AS realized_vol
FROM c_samples s CROSS JOIN range(0, 8) slot LEFT JOIN c_seq q ON q.session_id = s.session_id AND q.token = s.as_of_token - 8 + slot.range""")


@query("context_window", """SELECT sample_id, CAST(slot AS INTEGER) AS slot, mask, volume, round(volume_surprise, 6) AS volume_surprise, round(realized_vol, 6) AS realized_vol FROM c_window""")
def context_window(spark, d):
    w = D.context_window(samples(spark, d), arrays(spark, d), WINDOW_COLS)
    z = F.posexplode(F.arrays_zip(F.col("context").alias("c"), F.col("context_mask").alias("m"))).alias("slot", "z")
    return w.select("sample_id", z).select(
        "sample_id", "slot", F.col("z.m").alias("mask"), F.col("z.c")[0].alias("volume"), rnd(F.col("z.c")[1]).alias("volume_surprise"), rnd(F.col("z.c")[2]).alias("realized_vol")
    )


@query("raw_features", "SELECT sample_id, " + ", ".join(f"max(round({c}, 6)) FILTER (slot = {i}) AS t{i}_{c}" for i in range(8) for c in WINDOW_COLS) + ", "
       + ", ".join(f"max(CAST(mask AS INTEGER)) FILTER (slot = {i}) AS mask_{i}" for i in range(8)) + " FROM c_window GROUP BY 1")
def raw_features(spark, d):
    w = D.context_window(samples(spark, d).select("sample_id", "session_id", "context_start", "context_end"), arrays(spark, d), WINDOW_COLS)
    r = D.raw_features(w.drop("session_id", "context_start", "context_end"), WINDOW_COLS)
    return r.select("sample_id", *(rnd(c).alias(c) if c[0] == "t" else F.col(c) for c in r.columns if c != "sample_id"))


cte("c_origins", """SELECT sample_id, session_id, as_of_token, band, 1.0 / cnt AS p FROM (SELECT *, row_number() OVER (PARTITION BY session_id, band ORDER BY sha256(sample_id)) AS r, count(*) OVER (PARTITION BY session_id, band) AS cnt FROM
 (SELECT *, CASE WHEN as_of_token <= 9 THEN 0 WHEN as_of_token <= 15 THEN 1 WHEN as_of_token <= 20 THEN 2 WHEN as_of_token <= 25 THEN 3 END AS band FROM c_samples WHERE "partition" = 'train')) WHERE r = 1""")


def origins(spark, d):
    return D.shape_origins(samples(spark, d).where("partition = 'train'"))


@query("shape_origins", "SELECT sample_id, session_id, as_of_token, band, round(p, 6) AS inclusion_probability FROM c_origins")
def shape_origins(spark, d):
    return origins(spark, d).select("sample_id", "session_id", "as_of_token", "band", rnd("inclusion_probability").alias("inclusion_probability"))


@query("train_positions", """SELECT session_id, sample_id, as_of_token FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sha256(sample_id || '|3|13')) AS r FROM c_samples WHERE "partition" = 'train') WHERE r <= 2""")
def train_positions(spark, d):
    t = samples(spark, d).where("partition = 'train'")
    return D.train_positions(t, epoch=3, seed=13).select("session_id", "sample_id", "as_of_token")


cte("c_scale", """SELECT s.sample_id, s.session_id, s."partition", s.as_of_token, sum(q.volume) AS total, sum(q.baseline) AS base, count(*) AS width FROM c_samples s JOIN c_seq q ON q.session_id = s.session_id AND q.token >= s.as_of_token GROUP BY 1, 2, 3, 4 HAVING sum(q.volume) > 0""")


def scale(spark, d):
    return D.scale_rows(samples(spark, d), arrays(spark, d))


@query("scale_rows", """SELECT sample_id, as_of_token, CAST(total AS DOUBLE) AS target_total, CAST(base AS DOUBLE) AS baseline_remaining_volume FROM c_scale""")
def scale_rows(spark, d):
    return scale(spark, d).select("sample_id", "as_of_token", "target_total", "baseline_remaining_volume")


@query("scale_shape_rows", """SELECT s.sample_id, q.token AS target_bucket, q.token - s.as_of_token + 1 AS horizon_offset, round(q.volume / s.total + 1e-9, 6) AS target_share, round(q.baseline / s.base + 1e-9, 6) AS baseline_share, round(1 / o.p, 6) AS case_weight, round(1 / o.p / s.width, 6) AS row_weight
FROM c_scale s JOIN c_origins o USING (sample_id) JOIN c_seq q ON q.session_id = s.session_id AND q.token >= s.as_of_token""")
def scale_shape_rows(spark, d):
    s = scale(spark, d).where("partition = 'train'")
    return D.shape_rows(s, origins(spark, d)).select(
        "sample_id", "target_bucket", "horizon_offset", rnd_ratio("target_share").alias("target_share"), rnd_ratio("baseline_share").alias("baseline_share"),
        rnd("case_weight").alias("case_weight"), rnd("row_weight").alias("row_weight"),
    )


cte("c_regime", """SELECT s.sample_id, s."partition", s.session_id, s.as_of_token, l.volume_surprise, l.realized_vol AS realized_volatility, g.curve_error FROM c_samples s JOIN c_seq l ON l.session_id = s.session_id AND l.token = s.as_of_token - 1
JOIN (SELECT sample_id, avg(abs(a - b)) AS curve_error FROM (SELECT s.sample_id, sum(q.volume) OVER w / s.total AS a, sum(q.baseline) OVER w / s.base AS b FROM c_scale s JOIN c_seq q ON q.session_id = s.session_id AND q.token >= s.as_of_token
  WINDOW w AS (PARTITION BY s.sample_id ORDER BY q.token)) GROUP BY 1) g ON g.sample_id = s.sample_id""")


def regimes(spark, d):
    return D.regime_frame(samples(spark, d), arrays(spark, d))


@query("regime_frame", "SELECT sample_id, as_of_token, round(volume_surprise, 6) AS volume_surprise, round(realized_volatility, 6) AS realized_volatility, round(curve_error, 6) AS curve_error FROM c_regime")
def regime_frame(spark, d):
    return regimes(spark, d).select("sample_id", "as_of_token", *(rnd(c).alias(c) for c in ("volume_surprise", "realized_volatility", "curve_error")))


NORM = ("rolling_adv", "previous_session_total_volume", "previous_session_trade_count")


def norm_sql() -> str:
    fits = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for c in NORM for n, p in D.QUANTILES.items())
    outs = ", ".join(
        f"round(CASE WHEN {c} IS NULL THEN 0 ELSE (greatest({c}_lo, least({c}_hi, {c})) - {c}_median) / greatest({c}_q3 - {c}_q1, 1e-6) END + 1e-9, 6) AS {c}" for c in NORM
    )
    return f"""WITH f AS (SELECT {fits} FROM c_hist_daily WHERE session_date < DATE '1998-01-01') SELECT h.symbol, h.session_date, {outs} FROM c_hist_daily h, f"""


@query("robust_normalize", norm_sql())
def robust_normalize(spark, d):
    h = H.history_features(daily(spark, d))
    fitted = D.fit_normalizer(h.where("session_date < date '1998-01-01'"), NORM)
    return D.robust_normalize(h, fitted, NORM).select("symbol", "session_date", *(rnd_ratio(c).alias(c) for c in NORM))


EVENT_FOLDS = (("f1", "2024-01-02", "2024-01-15", "2024-01-16", "2024-01-20", "2024-01-21", "2024-01-25"), ("f2", "2024-01-02", "2024-01-20", "2024-01-21", "2024-01-25", "2024-01-26", "2024-01-30"))


def sequences(spark, d):
    from barlens.operators.identity import folds_table

    named = bars(spark, d).withColumn("symbol", F.when((F.col("instrument_id") == "click") & (F.col("session_date") > F.lit("2024-01-15").cast("date")), "CLK").otherwise(F.col("symbol")))
    return D.build_sequences(
        named, DAY_4H, benchmark="signup", intervals=intervals(spark), actions=actions(spark), folds=folds_table(spark, EVENT_FOLDS), window=(600, 900)
    )


@query("build_sequences")
def build_sequences(spark, d):
    s, _ = sequences(spark, d)
    return s.select("fold_id", "partition", "instrument_id", "session_date", "token", *(rnd_ratio(c, 5).alias(c) for c in H.FEATURES))


@query("build_sequences_exclusions", """WITH st AS (SELECT s.instrument_id, s.session_date, CASE WHEN count(i.symbol) = 0 THEN 'none' WHEN count(i.symbol) > 1 THEN 'ambiguous' WHEN min(upper(i.symbol)) <> s.symbol THEN 'mismatch' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT instrument_id, session_date, CASE WHEN instrument_id = 'click' AND session_date > DATE '2024-01-15' THEN 'CLK' ELSE symbol END AS symbol FROM c_min) s
  LEFT JOIN c_intervals i ON i.instrument_id = s.instrument_id AND s.session_date BETWEEN i."start" AND i."end" GROUP BY s.instrument_id, s.session_date, s.symbol),
 k AS (SELECT q.instrument_id, q.session_date, concat_ws(';', CASE WHEN status <> 'ok' THEN 'symbol_' || status END, CASE WHEN NOT token_valid_full_session THEN 'token_quality' END) AS reasons FROM c_quality4 q JOIN st USING (instrument_id, session_date)),
 b AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS r FROM k WHERE instrument_id = 'signup' AND reasons = '')
SELECT * FROM k WHERE reasons <> '' UNION ALL
SELECT instrument_id, session_date, 'benchmark_missing' FROM k WHERE reasons = '' AND instrument_id <> 'signup' AND session_date NOT IN (SELECT session_date FROM b WHERE r > 1)""")
def build_sequences_exclusions(spark, d):
    """Sessions left out: identity, token quality, or no benchmark history at that date."""
    _, x = sequences(spark, d)
    return x.select("instrument_id", "session_date", F.array_join("reasons", ";").alias("reasons"))


@query("validate_corpus", """SELECT q.instrument_id, q.session_date, concat_ws(';', CASE WHEN q.instrument_id = 'signup' THEN 'unknown_instrument' END, CASE WHEN r.status <> 'ok' THEN 'symbol_' || r.status END,
  CASE WHEN NOT token_valid_full_session THEN 'token_quality' END) AS reasons FROM c_quality1 q JOIN (SELECT s.instrument_id, s.session_date, CASE WHEN count(i.symbol) = 0 THEN 'none' WHEN count(i.symbol) > 1 THEN 'ambiguous' WHEN min(upper(i.symbol)) <> s.symbol THEN 'mismatch' ELSE 'ok' END AS status
FROM (SELECT DISTINCT instrument_id, session_date, symbol FROM c_min) s LEFT JOIN c_intervals i ON i.instrument_id = s.instrument_id AND s.session_date BETWEEN i."start" AND i."end" GROUP BY s.instrument_id, s.session_date, s.symbol) r USING (instrument_id, session_date)""")
def validate_corpus(spark, d):
    from barlens.plans.inputs import DAY_1H

    allowed = market.table(spark, d, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("instrument_id"))
    v = D.validate_corpus(bars(spark, d), DAY_1H, intervals(spark), allowed, window=(600, 900))
    return v.select("instrument_id", "session_date", F.array_join("reasons", ";").alias("reasons"))


@query("content_fingerprint", r"""SELECT session_date, sha256(string_agg(r || '#' || n, chr(10) ORDER BY r || '#' || n)) AS fingerprint FROM (SELECT session_date, instrument_id || ',' || volume || ',' || trade_count AS r, count(*) AS n FROM c_daily GROUP BY 1, 2) GROUP BY 1""")
def content_fingerprint(spark, d):
    return D.content_fingerprint(daily(spark, d), ["session_date"], ["instrument_id", "volume", "trade_count"])


@query("dataset_manifest", """SELECT count(*) AS rows, count(DISTINCT sample_id) AS samples, count(DISTINCT symbol) AS symbols, min(session_date) AS min_date, max(session_date) AS max_date,
  (SELECT count(*) FROM c_quality1 WHERE NOT token_valid_full_session) AS exclusions, substr(sha256('static|240|20'), 1, 12) AS dataset_id FROM c_static_ds""")
def dataset_manifest(spark, d):
    from barlens.plans.clean_queries import quality
    from barlens.plans.inputs import DAY_1H

    rejected = quality(spark, d, DAY_1H).where("not token_valid_full_session")
    return D.dataset_manifest(D.static_dataset(buckets4(spark, d), 240), rejected, "static|240|20")
