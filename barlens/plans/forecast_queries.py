"""Volume forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import bars as B
from barlens.operators import clean as C
from barlens.operators import forecast as P
from barlens.plans.inputs import DAY_1H, DAY_4H, bars
from barlens.plans.registry import cte, query
from barlens.sources import market

AGG = {
    "mean": "avg({x})",
    "median": "median({x})",
    "previous": "arg_max({x}, p.hd)",
    "ewma": "sum({x} * pow(0.75, r - 1)) / sum(pow(0.75, r - 1))",
}


def profile_sql(estimator: str, src: str, width: int) -> str:
    agg = AGG[estimator]
    return f"""SELECT instrument_id, session_date, bucket, greatest(shape, 0) / sum(greatest(shape, 0)) OVER (PARTITION BY instrument_id, session_date) AS share,
  total AS expected_total, total * greatest(shape, 0) / sum(greatest(shape, 0)) OVER (PARTITION BY instrument_id, session_date) AS expected_volume, n AS history_sessions, cutoff, n < 5 AS short_history
FROM (SELECT p.instrument_id, p.td AS session_date, m.bucket, {agg.format(x='m.volume / p.total')} AS shape, {agg.format(x='p.total')} AS total, count(*) AS n, max(p.hd) AS cutoff
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, td ORDER BY hd DESC) AS r FROM
     (SELECT t.instrument_id, t.session_date AS td, h.session_date AS hd, h.total, row_number() OVER (PARTITION BY t.instrument_id, t.session_date ORDER BY h.session_date DESC) AS rn
      FROM (SELECT DISTINCT instrument_id, session_date FROM {src}) t
      JOIN (SELECT instrument_id, session_date, sum(volume) AS total FROM {src} GROUP BY 1, 2 HAVING count(*) = {width}) h ON h.instrument_id = t.instrument_id AND h.session_date < t.session_date)
     WHERE rn <= 20 AND total > 0) p JOIN {src} m ON m.instrument_id = p.instrument_id AND m.session_date = p.hd GROUP BY 1, 2, 3)"""


OUT = """SELECT instrument_id, session_date, bucket, round(share + 1e-9, 6) AS share, round(expected_volume + 1e-6, 4) AS expected_volume, history_sessions, cutoff, short_history FROM """


def out(df, keys=("instrument_id", "session_date")):
    return df.select(
        *keys, "bucket", rnd_ratio("share").alias("share"), rnd(F.col("expected_volume") + 1e-6, 4).alias("expected_volume"),
        "history_sessions", "cutoff", "short_history",
    )


def matrix4(spark, d):
    return P.session_matrix(bars(spark, d), 240)


@query("session_matrix", "SELECT instrument_id, session_date, bucket, volume FROM c_b60")
def session_matrix(spark, d):
    return P.session_matrix(bars(spark, d), 60)


@query("profile_forecast_mean", f"{OUT} ({profile_sql('mean', 'c_b60', 24)})")
def profile_forecast_mean(spark, d):
    """Hourly: most sessions are incomplete at small scale and must not become history."""
    return out(P.profile_forecast(P.session_matrix(bars(spark, d), 60), range(24), estimator="mean"))


for _e in ("median", "ewma", "previous"):

    def _run(spark, d, e=_e):
        return out(P.profile_forecast(matrix4(spark, d), range(6), estimator=e))

    query(f"profile_forecast_{_e}", f"{OUT} ({profile_sql(_e, 'c_b4', 6)})")(_run)

cte("c_profile4", profile_sql("mean", "c_b4", 6))


def profile4(spark, d):
    return P.profile_forecast(matrix4(spark, d), range(6), estimator="mean")


@query("profile_pooled", """WITH s AS (SELECT instrument_id, session_date, sum(volume) AS total, min(bucket) AS f FROM c_b4 GROUP BY 1, 2 HAVING count(*) = 6),
 h AS (SELECT t.session_date AS td, s.*, row_number() OVER (PARTITION BY t.session_date ORDER BY s.session_date DESC, f DESC, s.instrument_id DESC) AS rn
   FROM (SELECT DISTINCT session_date FROM c_b4) t JOIN s ON s.session_date < t.session_date),
 r AS (SELECT h.td AS session_date, m.bucket, avg(m.volume / h.total) AS shape, avg(h.total) AS total, count(*) AS n, max(h.session_date) AS cutoff FROM h JOIN c_b4 m USING (instrument_id, session_date) WHERE rn <= 12 AND h.total > 0 GROUP BY 1, 2)
SELECT session_date, bucket, round(shape / sum(shape) OVER (PARTITION BY session_date) + 1e-9, 6) AS share, round(total * shape / sum(shape) OVER (PARTITION BY session_date) + 1e-6, 4) AS expected_volume,
  n AS history_sessions, cutoff, n < 5 AS short_history FROM r""")
def profile_pooled(spark, d):
    return out(P.profile_pooled(matrix4(spark, d), range(6), estimator="mean", lookback=12), ("session_date",))


@query("oracle_forecast", """SELECT instrument_id, session_date, bucket, volume AS expected_volume, round(volume / sum(volume) OVER w + 1e-9, 6) AS share, true AS evaluation_only
FROM c_b60 WINDOW w AS (PARTITION BY instrument_id, session_date) QUALIFY count(*) OVER w = 24""")
def oracle_forecast(spark, d):
    o = P.oracle_forecast(P.session_matrix(bars(spark, d), 60), range(24))
    return o.select("instrument_id", "session_date", "bucket", "expected_volume", rnd_ratio("share").alias("share"), "evaluation_only")


@query("predictions_to_forecast", """SELECT instrument_id, session_date, bucket, v AS expected_volume, CAST(sum(v) OVER w AS DOUBLE) AS expected_total, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 0 END + 1e-9, 6) AS share
FROM (SELECT *, CAST(greatest(volume - 100, 0) AS DOUBLE) AS v FROM c_b60) WINDOW w AS (PARTITION BY instrument_id, session_date)""")
def predictions_to_forecast(spark, d):
    """Volume minus 100 as a prediction that is often negative."""
    m = P.session_matrix(bars(spark, d), 60).withColumn("predicted_volume", (F.col("volume") - 100).cast("double"))
    o = P.predictions_to_forecast(m, ["instrument_id", "session_date"])
    return o.select("instrument_id", "session_date", "bucket", "expected_volume", "expected_total", rnd_ratio("share").alias("share"))


cte("c_within", """SELECT instrument_id, CAST(minute % 15 AS INTEGER) AS minute_in_token, avg(volume) / sum(avg(volume)) OVER (PARTITION BY instrument_id) AS within_share
FROM c_min WHERE session_date <= DATE '2024-01-20' GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY instrument_id) = 15""")


@query("within_token_profile", "SELECT instrument_id, minute_in_token, round(within_share + 1e-9, 6) AS within_share FROM c_within")
def within_token_profile(spark, d):
    return P.within_token_profile(bars(spark, d), "2024-01-20", 15).withColumn("within_share", rnd_ratio("within_share"))


# token shares for expansion: each session's own 4-hour shares, spread as if tokens were 15 minutes wide
@query("expand_forecast", """WITH t AS (SELECT instrument_id, session_date, bucket, volume / sum(volume) OVER w AS share, sum(volume) OVER w AS total FROM c_b4 WINDOW w AS (PARTITION BY instrument_id, session_date)),
 e AS (SELECT t.instrument_id, session_date, bucket * 15 + minute_in_token AS minute, share * within_share AS raw, total FROM t JOIN c_within USING (instrument_id)),
 f AS (SELECT *, min(minute) OVER (PARTITION BY instrument_id, session_date) AS lo FROM e)
SELECT instrument_id, session_date, CAST(minute AS INTEGER) AS minute, round(raw / sum(raw) OVER w + 1e-9, 6) AS share, round(total * raw / sum(raw) OVER w + 1e-6, 4) AS expected_volume FROM f WHERE minute < lo + 80 WINDOW w AS (PARTITION BY instrument_id, session_date)""")
def expand_forecast(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("instrument_id", "session_date")
    t = matrix4(spark, d).withColumns(
        {"token": F.col("bucket"), "share": F.col("volume") / F.sum("volume").over(w), "expected_total": F.sum("volume").over(w)}
    )
    within = P.within_token_profile(bars(spark, d), "2024-01-20", 15)
    o = P.expand_forecast(t, within, width=15, minutes=80, case=["instrument_id", "session_date"])
    return o.withColumns({"share": rnd_ratio("share"), "expected_volume": rnd(F.col("expected_volume") + 1e-6, 4)})


@query("truncate_forecast", """WITH f AS (SELECT instrument_id, session_date, g.range * 240 AS generated_minute, minute, volume * (1 + g.range) AS v FROM c_hour, range(6) g WHERE minute >= g.range * 240),
 q AS (SELECT DISTINCT instrument_id, session_date, minute AS now_minute FROM c_hour),
 j AS (SELECT q.*, f.generated_minute, f.minute, f.v FROM q JOIN f ON f.instrument_id = q.instrument_id AND f.session_date = q.session_date AND f.generated_minute = q.now_minute - q.now_minute % 240 AND f.minute >= q.now_minute)
SELECT instrument_id, session_date, now_minute, CAST(generated_minute AS INTEGER) AS generated_minute, minute, CAST(v AS DOUBLE) AS expected_volume,
  round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 0 END + 1e-9, 6) AS share FROM j WINDOW w AS (PARTITION BY instrument_id, session_date, now_minute)""")
def truncate_forecast(spark, d):
    """Forecasts refreshed every four hours, asked for at every hour that has bars."""
    from barlens.plans.inputs import hour_bars

    h = hour_bars(spark, d).select("instrument_id", "session_date", "minute", "volume")
    g = h.withColumn("g", F.explode(F.sequence(F.lit(0), F.floor(F.col("minute") / 240).cast("int"))))
    forecasts = g.select(
        "instrument_id", "session_date", (F.col("g") * 240).alias("generated_minute"), "minute",
        (F.col("volume") * (F.col("g") + 1)).cast("double").alias("expected_volume"),
    )
    requests = h.select("instrument_id", "session_date", F.col("minute").alias("now_minute"))
    return P.truncate_forecast(forecasts, requests, update=240).drop("expected_total").withColumn("share", rnd_ratio("share"))


@query("seed_mean_forecast", """SELECT instrument_id, session_date, bucket, round(ev, 6) AS expected_volume, round(CASE WHEN sum(ev) OVER w > 0 THEN ev / sum(ev) OVER w ELSE 0 END + 1e-9, 6) AS share FROM
 (SELECT instrument_id, session_date, bucket, (volume + trade_count + 7 * bucket) / 3 AS ev FROM c_b4) WINDOW w AS (PARTITION BY instrument_id, session_date)""")
def seed_mean_forecast(spark, d):
    """Three seeds per case: volume, trade count and a ramp."""
    b = B.bucket_minutes(bars(spark, d), 240)
    seeds = F.array(
        F.struct(F.lit(13).alias("seed"), F.col("volume").cast("double").alias("expected_volume")),
        F.struct(F.lit(29).alias("seed"), F.col("trade_count").cast("double").alias("expected_volume")),
        F.struct(F.lit(47).alias("seed"), (F.col("bucket") * 7).cast("double").alias("expected_volume")),
    )
    f = b.select("instrument_id", "session_date", "bucket", F.inline(seeds))
    o = P.seed_mean_forecast(f, ["instrument_id", "session_date"])
    return o.select("instrument_id", "session_date", "bucket", rnd("expected_volume").alias("expected_volume"), rnd_ratio("share").alias("share"))


@query("share_from_logits", """WITH s AS (SELECT instrument_id, session_date, bucket, ln(1 + volume) AS x, trade_count >= 10 AS valid FROM c_b4),
 e AS (SELECT *, CASE WHEN valid THEN exp(x - max(x) FILTER (valid) OVER w) END AS e FROM s WINDOW w AS (PARTITION BY instrument_id, session_date)),
 t AS (SELECT instrument_id, session_date, greatest((1 + sum(trade_count)) * exp(ln(1 + max(volume)) / 10) - 1, 0) AS total FROM c_b4 GROUP BY 1, 2)
SELECT instrument_id, session_date, bucket, round(coalesce(e / sum(e) OVER w, 0), 6) AS share, round(total, 4) AS expected_total FROM e JOIN t USING (instrument_id, session_date) WINDOW w AS (PARTITION BY instrument_id, session_date)""")
def share_from_logits(spark, d):
    b = B.bucket_minutes(bars(spark, d), 240)
    shape = b.select("instrument_id", "session_date", "bucket", F.log1p("volume").alias("logit"), (F.col("trade_count") >= 10).alias("valid"))
    scale = b.groupBy("instrument_id", "session_date").agg(
        F.sum("trade_count").alias("baseline"), (F.log1p(F.max("volume")) / 10).alias("residual")
    )
    o = P.share_from_logits(shape, scale, ["instrument_id", "session_date"])
    return o.select("instrument_id", "session_date", "bucket", rnd("share").alias("share"), rnd("expected_total", 4).alias("expected_total"))


@query("check_forecast", """SELECT violations, count(*) AS forecasts FROM (SELECT f.instrument_id, f.session_date, concat_ws(';', CASE WHEN min(bucket) < 2 THEN 'past_bucket' END,
  CASE WHEN dayofmonth(f.session_date) > 20 THEN 'total_mismatch' END, CASE WHEN dayofmonth(f.session_date) > 25 THEN 'cutoff_not_before_session' END) AS violations
  FROM c_profile4 f WHERE f.bucket >= CASE WHEN dayofmonth(session_date) > 10 THEN 2 ELSE 0 END GROUP BY 1, 2) GROUP BY 1""")
def check_forecast(spark, d):
    """Profiles with planted faults: past buckets, wrong totals and late cutoffs by date."""
    day = F.dayofmonth("session_date")
    f = profile4(spark, d).where(F.col("bucket") >= F.when(day > 10, 2).otherwise(0))
    from pyspark.sql import Window

    w = Window.partitionBy("instrument_id", "session_date")
    f = f.withColumn("share", F.col("share") / F.sum("share").over(w)).withColumn("expected_total", F.sum("expected_volume").over(w))
    f = f.withColumns(
        {
            "generated_bucket": F.lit(2),
            "expected_total": F.when(day > 20, F.col("expected_total") + 5).otherwise(F.col("expected_total")),
            "cutoff": F.when(day > 25, F.col("session_date")).otherwise(F.col("cutoff")),
        }
    )
    o = C.check_forecast(f, ["instrument_id", "session_date"]).withColumn("violations", F.array_join("violations", ";"))
    return o.groupBy("violations").agg(F.count(F.lit(1)).alias("forecasts"))
