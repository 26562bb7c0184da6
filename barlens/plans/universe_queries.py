"""Formation, universe, sampling and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import clean as C
from barlens.operators import quality as Q
from barlens.operators import universe as U
from barlens.plans.identity_queries import intervals
from barlens.plans.inputs import calendar, daily, hour_bars, weekdays
from barlens.plans.registry import cte, query
from barlens.schema import SessionSpec
from barlens.sources import market

# hours as the "minutes" of a 24-slot session: at small scale some sessions are exact
HOURS = SessionSpec(0, 24, "UTC", 4, 2)
cte("c_slot", "SELECT instrument_id, symbol, session_date, CAST(minute // 60 AS INTEGER) AS minute, open, high, low, close, volume, trade_count, vwap FROM c_hour")
cte("c_exact", "SELECT instrument_id, session_date FROM c_slot GROUP BY 1, 2 HAVING count(*) = 24")


def slots(spark, d):
    return hour_bars(spark, d).withColumn("minute", (F.col("minute") / 60).cast("int"))


def slot_quality(spark, d):
    return Q.session_quality(slots(spark, d), HOURS, window=(10, 15))


def event_snapshot(spark, d):
    ids = market.table(spark, d, "events").select(F.col("event_type").alias("instrument_id")).distinct()
    kind = F.when(F.col("instrument_id") == "view", "fund").otherwise(U.COMMON)
    return ids.select("instrument_id", F.col("instrument_id").alias("symbol"), kind.alias("security_type"))


@query("daily_dollar_volume", """SELECT instrument_id, session_date, round(sum(vwap * volume), 2) AS dollar_volume FROM c_slot
WHERE (instrument_id, session_date) IN (SELECT (instrument_id, session_date) FROM c_exact) GROUP BY 1, 2""")
def daily_dollar_volume(spark, d):
    out = U.daily_dollar_volume(slots(spark, d), slot_quality(spark, d))
    return out.withColumn("dollar_volume", rnd("dollar_volume", 2))


FORMATION_SQL = """WITH b AS (SELECT * FROM c_slot WHERE (instrument_id, session_date) IN (SELECT (instrument_id, session_date) FROM c_exact)),
 p AS (SELECT instrument_id, median(close) AS px FROM b GROUP BY 1), v AS (SELECT instrument_id, count(*) AS n, median(dv) AS dv FROM (SELECT instrument_id, session_date, sum(vwap * volume) AS dv FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT s.instrument_id, upper(s.instrument_id) AS symbol, round(coalesce(px, 0), 6) AS median_price, round(coalesce(n, 0) / 30, 6) AS session_completeness, round(coalesce(dv, 0) + 1e-6, 2) AS median_daily_dollar_volume,
  concat_ws(';', CASE WHEN s.instrument_id = 'view' THEN 'not_ordinary_common_stock' END, CASE WHEN coalesce(px, 0) < 5 THEN 'median_price_below_5' END,
   CASE WHEN coalesce(n, 0) / 30 < 0.95 THEN 'formation_session_completeness_below_95_percent' END, CASE WHEN coalesce(dv, 0) <= 0 THEN 'nonpositive_median_daily_dollar_volume' END) AS reasons
FROM (SELECT DISTINCT event_type AS instrument_id FROM events) s LEFT JOIN p USING (instrument_id) LEFT JOIN v USING (instrument_id)"""


def formation_out(df):
    return df.select(
        "instrument_id", "symbol", rnd("median_price").alias("median_price"), rnd("session_completeness").alias("session_completeness"),
        rnd(F.col("median_daily_dollar_volume") + 1e-6, 2).alias("median_daily_dollar_volume"), F.array_join("reasons", ";").alias("reasons"),
    )


@query("formation_stats", FORMATION_SQL)
def formation_stats(spark, d):
    return formation_out(U.formation_stats(event_snapshot(spark, d), slots(spark, d), slot_quality(spark, d), 30))


@query("formation_stats_chunked", FORMATION_SQL)
def formation_stats_chunked(spark, d):
    """The same statistics from a corpus written as chunk files; no session may span two chunks."""
    from barlens.session import scratch_path

    path = scratch_path(spark, "chunks")
    week = F.weekofyear("session_date").alias("week")
    slots(spark, d).select("*", week).repartition("instrument_id", "week").write.partitionBy("instrument_id", "week").parquet(path)
    corpus = spark.read.parquet(path).drop("week")
    corpus = U.delivered_once(corpus, U.duplicate_sessions_across_files(corpus))
    quality = Q.session_quality(corpus, HOURS, window=(10, 15))
    return formation_out(U.formation_stats(event_snapshot(spark, d), corpus, quality, 30))


N_WEEKDAYS = 1826
cte("c_form", f"""SELECT p_brand AS instrument_id, upper(p_brand) AS formation_symbol, CASE WHEN p_brand LIKE '%7' THEN 'fund' ELSE 'ordinary_common_stock' END AS security_type,
  count(*) FILTER (reasons = '') AS observed, count(*) FILTER (reasons = '') / {N_WEEKDAYS} AS daily_completeness, coalesce(median(close) FILTER (reasons = ''), 0) AS px,
  coalesce(median(volume) FILTER (reasons = ''), 0) AS v, coalesce(median(vwap * volume) FILTER (reasons = ''), 0) AS dv, min(session_date) FILTER (reasons = '') AS first_valid_formation_date,
  max(session_date) FILTER (reasons = '') AS last_valid_formation_date, list(DISTINCT reasons) FILTER (reasons <> '') AS bad
FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN c_daily_checked ON instrument_id = p_brand GROUP BY 1""")
cte("c_cand", """SELECT *, to_json(list_sort(list_filter(list_concat(coalesce(bad, []), [CASE WHEN security_type <> 'ordinary_common_stock' THEN 'not_ordinary_common_stock' END,
  CASE WHEN px < 5 THEN 'median_daily_price_below_5' END, CASE WHEN daily_completeness < 0.4 THEN 'daily_completeness_below_95_percent' END,
  CASE WHEN dv <= 0 THEN 'nonpositive_median_daily_dollar_volume' END]), lambda r: r IS NOT NULL)))::VARCHAR AS exclusion_reasons FROM c_form""")


def brand_snapshot(spark, d):
    ids = market.table(spark, d, "part").select(F.col("p_brand").alias("instrument_id")).distinct()
    kind = F.when(F.col("instrument_id").endswith("7"), "fund").otherwise(U.COMMON)
    return ids.select("instrument_id", F.col("instrument_id").alias("symbol"), kind.alias("security_type"))


def candidates(spark, d):
    checked = C.validate_daily(daily(spark, d), weekdays(spark))
    return U.daily_formation(brand_snapshot(spark, d), checked, N_WEEKDAYS, min_completeness=0.4)


@query("daily_formation", """SELECT instrument_id, formation_symbol, security_type, observed AS observed_valid_daily_sessions, round(daily_completeness, 6) AS daily_completeness,
  round(px, 6) AS median_daily_price, round(v, 6) AS median_daily_share_volume, round(dv + 1e-6, 2) AS median_daily_dollar_volume, first_valid_formation_date, last_valid_formation_date, exclusion_reasons FROM c_cand""")
def daily_formation(spark, d):
    return candidates(spark, d).select(
        "instrument_id", "formation_symbol", "security_type", "observed_valid_daily_sessions", rnd("daily_completeness").alias("daily_completeness"),
        rnd("median_daily_price").alias("median_daily_price"), rnd("median_daily_share_volume").alias("median_daily_share_volume"),
        rnd(F.col("median_daily_dollar_volume") + 1e-6, 2).alias("median_daily_dollar_volume"), "first_valid_formation_date", "last_valid_formation_date", "exclusion_reasons",
    )


cte("c_universe", """SELECT *, CAST(row_number() OVER (ORDER BY dv DESC, instrument_id) AS INTEGER) AS rank FROM c_cand
WHERE security_type = 'ordinary_common_stock' AND px >= 5 AND daily_completeness >= 0.3 AND dv > 0 QUALIFY rank <= 10""")


def universe(spark, d):
    return U.select_universe(candidates(spark, d), 10, min_completeness=0.3)


@query("select_universe", "SELECT instrument_id, rank, CAST(least(5, (rank - 1) * 5 // 10 + 1) AS INTEGER) AS liquidity_group, round(dv + 1e-6, 2) AS median_daily_dollar_volume FROM c_universe")
def select_universe(spark, d):
    return universe(spark, d).select("instrument_id", "rank", "liquidity_group", rnd(F.col("median_daily_dollar_volume") + 1e-6, 2).alias("median_daily_dollar_volume"))


cte("c_spaced", "SELECT u.* FROM c_universe u JOIN (SELECT CAST(round_even(range * 9 / 3, 0) AS INTEGER) + 1 AS rank FROM range(4)) USING (rank)")


@query("liquidity_spaced", "SELECT instrument_id, rank FROM c_spaced")
def liquidity_spaced(spark, d):
    return U.liquidity_spaced(universe(spark, d), 4).select("instrument_id", "rank")


@query("balanced_sides", """SELECT session_date, instrument_id, CASE WHEN row_number() OVER (PARTITION BY session_date ORDER BY sha256(CAST(session_date AS VARCHAR) || '|' || instrument_id))
  <= (count(*) OVER (PARTITION BY session_date) + 1) // 2 THEN 'buy' ELSE 'sell' END AS side FROM c_daily""")
def balanced_sides(spark, d):
    return U.balanced_sides(daily(spark, d).select("session_date", "instrument_id"))


cte("c_partcand", """SELECT CAST(l_partkey AS VARCHAR) AS instrument_id, median(l_extendedprice) AS median_daily_dollar_volume, avg(l_quantity) AS activity, count(DISTINCT l_shipdate) AS days,
  CAST(count(DISTINCT l_shipdate) >= 30 AS INTEGER) AS eligible, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS completeness, sum(l_tax) AS tax FROM lineitem GROUP BY 1""")


def part_candidates(spark, d):
    li = market.table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_tax")
    # a part has few ship dates; a distinct count would first group its prices by date for the median
    days = F.size(F.collect_set("l_shipdate")).cast("bigint")
    g = li.groupBy(F.col("l_partkey").cast("string").alias("instrument_id")).agg(
        F.median("l_extendedprice").alias("median_daily_dollar_volume"), F.avg("l_quantity").alias("activity"),
        days.alias("days"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("completeness"),
        F.sum("l_tax").alias("tax"),
    )
    return g.withColumn("eligible", (F.col("days") >= 30).cast("int"))


@query("rank_liquidity", "SELECT instrument_id, row_number() OVER (ORDER BY median_daily_dollar_volume DESC, instrument_id) AS liquidity_rank FROM c_partcand")
def rank_liquidity(spark, d):
    return U.rank_liquidity(part_candidates(spark, d)).select("instrument_id", "liquidity_rank")


def corr_sql() -> str:
    rows = []
    for t in ("eligible", "completeness"):
        for m in ("log_dollar", "activity", "days"):
            rows.append(f"SELECT '{t}' AS target, '{m}' AS measure, round(corr({t}, {m}), 6) AS pearson, round(corr(r_{t}, r_{m}), 6) AS spearman FROM r")
    avg = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in ("eligible", "completeness", "log_dollar", "activity", "days"))
    base = "SELECT eligible, round(completeness, 6) AS completeness, round(ln(1 + median_daily_dollar_volume), 9) AS log_dollar, round(activity, 6) AS activity, days FROM c_partcand"
    return f"WITH b AS ({base}), r AS (SELECT *, {avg} FROM b) " + " UNION ALL ".join(rows)


@query("correlations", corr_sql())
def correlations(spark, d):
    c = part_candidates(spark, d).select(
        F.col("eligible").cast("double").alias("eligible"), F.round("completeness", 6).alias("completeness"),
        F.round(F.log1p("median_daily_dollar_volume"), 9).alias("log_dollar"), F.round("activity", 6).alias("activity"),
        F.col("days").cast("double").alias("days"),
    )
    out = U.correlations(c, ["eligible", "completeness"], ["log_dollar", "activity", "days"])
    return out.withColumns({"pearson": rnd("pearson"), "spearman": rnd("spearman")})


def dist_sql() -> str:
    parts = []
    for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        q = ", ".join(f"round(quantile_cont({m}, {p}) + 1e-9, 6) AS {n}" for n, p in U.POINTS.items())
        parts.append(f"SELECT '{m}' AS measure, count({m}) AS count, round(avg({m}), 4) AS mean, round(stddev_samp({m}), 4) AS std, min({m}) AS min, max({m}) AS max, {q} FROM lineitem")
    return " UNION ALL ".join(parts)


@query("distribution_summary", dist_sql())
def distribution_summary(spark, d):
    m = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = U.distribution_summary(market.table(spark, d, "lineitem").select(*m), m)
    return out.select(
        "measure", "count", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), "min", "max",
        *(rnd_ratio(q).alias(q) for q in U.POINTS),
    )


@query("reason_counts", "SELECT reason, count(*) AS candidates FROM (SELECT unnest(from_json(exclusion_reasons, '[\"VARCHAR\"]')) AS reason FROM c_cand) GROUP BY 1")
def reason_counts(spark, d):
    return U.reason_counts(candidates(spark, d))


@query("completeness_bands", """SELECT CASE WHEN completeness >= 0.95 THEN 'high' WHEN completeness >= 0.8 THEN 'medium' ELSE 'low' END AS band, count(*) AS candidates, count(DISTINCT instrument_id) AS instruments FROM
 (SELECT instrument_id, session_date, count(*) / 24 AS completeness FROM c_slot GROUP BY 1, 2) GROUP BY 1""")
def completeness_bands(spark, d):
    g = slots(spark, d).groupBy("instrument_id", "session_date").agg((F.count(F.lit(1)) / 24).alias("completeness"))
    return g.groupBy(U.completeness_band(F.col("completeness")).alias("band")).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("instrument_id").alias("instruments")
    )


@query("acquisition_plan", """WITH ch AS (SELECT instrument_id, count(*) AS requests FROM (SELECT o_custkey AS instrument_id, unnest(generate_series(date_trunc('month', greatest(s, DATE '1996-02-10'))::TIMESTAMP,
   least(e, DATE '1999-11-20')::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1) WHERE greatest(s, DATE '1996-02-10') <= least(e, DATE '1999-11-20')) GROUP BY 1)
SELECT count(*) AS instruments, CAST(sum(requests) AS BIGINT) AS monthly_requests, (SELECT count(*) FROM c_weekdays WHERE session_date BETWEEN DATE '1996-02-10' AND DATE '1999-11-20') AS sessions,
  count(*) * (SELECT count(*) FROM c_weekdays WHERE session_date BETWEEN DATE '1996-02-10' AND DATE '1999-11-20') * 390 AS rows_upper,
  count(*) * (SELECT count(*) FROM c_weekdays WHERE session_date BETWEEN DATE '1996-02-10' AND DATE '1999-11-20') * 390 * 200 AS bytes_upper FROM ch""")
def acquisition_plan(spark, d):
    iv = market.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("instrument_id")).agg(
        F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end")
    ).withColumn("symbol", F.col("instrument_id").cast("string"))
    return U.acquisition_plan(iv, weekdays(spark), "1996-02-10", "1999-11-20")


@query("chunk_coverage", """WITH ch AS (SELECT * FROM (SELECT DISTINCT instrument_id FROM c_slot) i CROSS JOIN (VALUES (DATE '2024-01-01', DATE '2024-01-10', 0), (DATE '2024-01-11', DATE '2024-01-20', 1), (DATE '2024-01-21', DATE '2024-01-31', 0)) v(chunk_start, chunk_end, off)),
 s AS (SELECT instrument_id, session_date, count(*) AS n, count(*) = 24 AS exact FROM c_slot GROUP BY 1, 2)
SELECT ch.instrument_id, chunk_start, chunk_end, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (exact) AS observed_exact_sessions,
  CAST((SELECT count(*) FROM c_calendar WHERE session_date BETWEEN chunk_start AND chunk_end) AS INTEGER) AS expected_sessions, CASE WHEN max(off) = 1 THEN 'row_count' ELSE '' END AS violations
FROM ch JOIN s ON s.instrument_id = ch.instrument_id AND session_date BETWEEN chunk_start AND chunk_end GROUP BY 1, 2, 3""")
def chunk_coverage(spark, d):
    """Ten-day chunks; the middle one declares a row too many."""
    b = slots(spark, d)
    n = b.groupBy("instrument_id", "session_date").agg(F.count(F.lit(1)).alias("n"))
    day = F.dayofmonth("session_date")
    first = F.when(day <= 10, 1).when(day <= 20, 11).otherwise(21)
    start = F.make_date(F.lit(2024), F.lit(1), first)
    end = F.when(day <= 10, F.lit("2024-01-10")).when(day <= 20, F.lit("2024-01-20")).otherwise(F.lit("2024-01-31")).cast("date")
    chunks = n.groupBy("instrument_id", start.alias("chunk_start"), end.alias("chunk_end")).agg(F.sum("n").alias("declared_rows"))
    chunks = chunks.withColumn("declared_rows", F.col("declared_rows") + (F.dayofmonth("chunk_start") == 11).cast("int"))
    out = U.chunk_coverage(chunks, b, slot_quality(spark, d), calendar(spark))
    return out.withColumn("violations", F.array_join("violations", ";"))


@query("resource_estimate", """WITH n AS (SELECT fold_id, "partition" AS p, count(DISTINCT session_date) AS s FROM c_member GROUP BY 1, 2)
SELECT fold_id, CAST(sum(CASE WHEN p = 'train' THEN s * 200 ELSE 0 END) AS BIGINT) AS training_origins, CAST(sum(s * 2200) AS BIGINT) AS scale_rows, CAST(sum(CASE WHEN p = 'train' THEN s * 8800 ELSE 0 END) AS BIGINT) AS shape_train_rows,
  CAST(sum(CASE WHEN p <> 'train' THEN s * 25300 ELSE 0 END) AS BIGINT) AS shape_held_out_rows, CAST(sum(s * 13200) AS BIGINT) AS embedding_rows, CAST(sum(s * 13200 * 2576) AS BIGINT) AS embedding_bytes FROM n GROUP BY 1""")
def resource_estimate(spark, d):
    from barlens.operators.identity import fold_partition
    from barlens.plans.identity_queries import folds

    member = fold_partition(daily(spark, d).select("session_date").distinct(), folds(spark))
    counts = member.groupBy("fold_id", "partition").agg(F.count(F.lit(1)).alias("sessions"))
    return U.resource_estimate(counts, instruments=100)
