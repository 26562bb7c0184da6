"""Joins: identity, corporate actions, snapshots, folds, pairings, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import bars as B
from barlens.operators import identity as I
from barlens.operators import universe as U
from barlens.operators.order_stats import quantiles
from barlens.plans.clean_queries import quality
from barlens.plans.inputs import DAY_4H, bars, calendar, daily, hour_bars
from barlens.plans.registry import cte, query
from barlens.sources import market

INTERVALS = """SELECT * FROM VALUES
 ('click', 'CLICK', date '2024-01-01', date '2024-01-15'), ('click', 'CLK', date '2024-01-16', date '2024-01-30'),
 ('error', 'ERROR', date '2024-01-01', date '2024-01-30'), ('error', 'ERR', date '2024-01-10', date '2024-01-12'),
 ('purchase', 'PURCHASE', date '2024-01-05', date '2024-01-30'), ('signup', 'SIGNUP', date '2024-01-01', date '2024-01-30'),
 ('view', 'VIEWS', date '2024-01-01', date '2024-01-30')"""
cte("c_intervals", INTERVALS.replace("SELECT * FROM VALUES", 'SELECT * FROM (VALUES').rstrip() + ') t(instrument_id, symbol, "start", "end")')


def intervals(spark):
    return spark.sql(f"{INTERVALS} AS t(instrument_id, symbol, start, end)")


ACTIONS = """SELECT * FROM VALUES
 ('click', date '2024-01-05', 2.0, timestamp_ntz '2024-01-04 12:00:00'), ('click', date '2024-01-20', 3.0, timestamp_ntz '2024-01-22 09:00:00'),
 ('error', date '2024-01-10', 0.5, timestamp_ntz '2024-01-10 00:00:00'), ('view', date '2024-02-10', 7.0, timestamp_ntz '2024-01-02 00:00:00'),
 ('signup', date '2024-01-12', 4.0, timestamp_ntz '2024-01-12 18:00:00'), ('signup', date '2024-01-25', 0.25, timestamp_ntz '2024-01-20 00:00:00')"""
cte(
    "c_actions",
    ACTIONS.replace("SELECT * FROM VALUES", "SELECT instrument_id, effective_date, CAST(factor AS DOUBLE) AS factor, available_at FROM (VALUES").replace("timestamp_ntz", "timestamp")
    + ") t(instrument_id, effective_date, factor, available_at)",
)


def actions(spark):
    out = spark.sql(f"{ACTIONS} AS t(instrument_id, effective_date, factor, available_at)")
    return out.withColumn("factor", F.col("factor").cast("double"))


@query("resolve_symbol", """SELECT s.instrument_id, s.session_date, s.symbol, count(i.symbol) AS matches, min(upper(i.symbol)) AS sourced,
  CASE WHEN count(i.symbol) = 0 THEN 'none' WHEN count(i.symbol) > 1 THEN 'ambiguous' WHEN min(upper(i.symbol)) <> s.symbol THEN 'mismatch' ELSE 'ok' END AS status
FROM (SELECT DISTINCT instrument_id, session_date, symbol FROM c_min) s
LEFT JOIN c_intervals i ON i.instrument_id = s.instrument_id AND s.session_date BETWEEN i."start" AND i."end" GROUP BY 1, 2, 3""")
def resolve_symbol(spark, d):
    return I.resolve_symbol(bars(spark, d), intervals(spark))


cte("c_factors", """SELECT s.instrument_id, s.session_date, coalesce(product(a.factor), 1.0) AS split_factor
FROM (SELECT instrument_id, session_date, CAST(session_date AS TIMESTAMP) + to_minutes(max(minute)) AS at FROM c_min GROUP BY 1, 2) s
LEFT JOIN c_actions a ON a.instrument_id = s.instrument_id AND a.available_at <= s.at AND CAST(a.effective_date AS TIMESTAMP) <= s.at GROUP BY 1, 2""")


def factors(spark, d):
    last = bars(spark, d).groupBy("instrument_id", "session_date").agg(F.max("minute").alias("minute"))
    at = F.expr("cast(session_date as timestamp_ntz) + make_interval(0, 0, 0, 0, 0, minute)")
    return I.split_factor(last.withColumns({"observed_at": at, "as_of": at}), actions(spark))


@query("split_factor", "SELECT instrument_id, session_date, round(split_factor, 6) AS split_factor FROM c_factors")
def split_factor(spark, d):
    return factors(spark, d).withColumn("split_factor", rnd("split_factor"))


@query("split_adjust", """SELECT instrument_id, session_date, minute, round(open / split_factor + 1e-9, 6) AS open, round(close / split_factor + 1e-9, 6) AS close,
  round(volume * split_factor, 6) AS volume, true AS notional_preserved FROM c_min JOIN c_factors USING (instrument_id, session_date)""")
def split_adjust(spark, d):
    return I.split_adjust(bars(spark, d), factors(spark, d)).select(
        "instrument_id", "session_date", "minute", rnd_ratio("open").alias("open"), rnd_ratio("close").alias("close"),
        rnd("volume").alias("volume"), "notional_preserved",
    )


# constituent history: every customer order opens a listing row of one of two share classes
cte("c_history", """SELECT CAST(o_custkey AS VARCHAR) AS cik, 's' || o_custkey || '.' || chr(CAST(97 + (o_orderkey // 8) % 2 AS INTEGER)) AS symbol,
  o_orderdate - INTERVAL 10 DAY AS date_added, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 400 DAY END AS date_removed FROM orders""")


def history(spark, d):
    o = market.table(spark, d, "orders")
    letter = F.char((F.lit(97) + F.floor(F.col("o_orderkey") / 8) % 2).cast("int"))
    return o.select(
        F.col("o_custkey").cast("string").alias("cik"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("."), letter).alias("symbol"),
        (F.col("o_orderdate") - F.expr("interval 10 days")).alias("date_added"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 400 days")).alias("date_removed"),
    )


cte("c_snapshot", """SELECT 'sec-cik-' || lpad(cik, 10, '0') || '-' || replace(upper(symbol), '.', '-') AS instrument_id, cik, upper(symbol) AS symbol FROM c_history
WHERE date_added <= TIMESTAMP '1998-01-01' AND created_at <= TIMESTAMP '1998-01-01' AND (date_removed IS NULL OR date_removed > TIMESTAMP '1998-01-01')""")


@query("snapshot_asof", "SELECT * FROM c_snapshot")
def snapshot_asof(spark, d):
    return I.snapshot_asof(history(spark, d), "1998-01-01")


@query("symbol_intervals", """WITH m AS (SELECT DISTINCT * FROM c_snapshot),
 one AS (SELECT cik, min(instrument_id) AS instrument_id FROM m GROUP BY 1 HAVING count(*) = 1),
 ch AS (SELECT instrument_id, symbol, DATE '1998-01-01' AS "start" FROM m UNION
        SELECT one.instrument_id, upper(symbol), CAST(created_at AS DATE) FROM c_history h JOIN one USING (cik)
        WHERE created_at > TIMESTAMP '1998-01-01' AND created_at <= TIMESTAMP '2000-12-31'),
 o AS (SELECT *, lead("start") OVER (PARTITION BY instrument_id ORDER BY "start", symbol) AS nxt FROM ch)
SELECT instrument_id, symbol, "start", coalesce(CAST(nxt - 1 AS DATE), DATE '2000-12-31') AS "end" FROM o
WHERE "start" <= coalesce(nxt - 1, DATE '2000-12-31')""")
def symbol_intervals(spark, d):
    return I.symbol_intervals(history(spark, d), "1998-01-01", "2000-12-31")


@query("alias_gaps", """SELECT g.instrument_id, g.session_date, count(i.symbol) AS symbols
FROM (SELECT i.instrument_id, c.session_date FROM (SELECT DISTINCT event_type AS instrument_id FROM events) i CROSS JOIN c_calendar c) g
LEFT JOIN c_intervals i ON i.instrument_id = g.instrument_id AND g.session_date BETWEEN i."start" AND i."end" GROUP BY 1, 2 HAVING count(i.symbol) <> 1""")
def alias_gaps(spark, d):
    ids = market.table(spark, d, "events").select(F.col("event_type").alias("instrument_id")).distinct()
    return I.alias_gaps(ids, calendar(spark), intervals(spark))


@query("overlap_check", """SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS instrument_id, CAST(o_orderdate AS DATE) AS "start",
  CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS "end", CAST(o_orderkey AS VARCHAR) AS symbol,
  lag(CAST(o_orderdate + INTERVAL 30 DAY AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS prior_end FROM orders)
WHERE "start" <= prior_end""")
def overlap_check(spark, d):
    iv = market.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("instrument_id"),
        F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("end"),
        F.col("o_orderkey").cast("string").alias("symbol"),
    )
    return I.overlap_check(iv)


@query("read_actions_checks", """WITH a AS (SELECT 'c' || o_custkey AS instrument_id, CAST(o_orderdate AS DATE) AS effective_date,
   o_orderdate AS available_at, round(o_totalprice / 1000 - 100, 3) AS factor, CASE o_orderstatus WHEN 'P' THEN ' ' ELSE 'filing' END AS source FROM orders)
SELECT violations, count(*) AS actions FROM (SELECT concat_ws(';', CASE WHEN factor <= 0 THEN 'factor' END, CASE WHEN trim(source) = '' THEN 'source' END,
  CASE WHEN count(*) OVER (PARTITION BY instrument_id, effective_date) > 1 THEN 'duplicate' END) AS violations FROM a) GROUP BY 1""")
def read_actions_checks(spark, d):
    a = market.table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("instrument_id"),
        F.to_date("o_orderdate").cast("string").alias("effective_date"),
        F.col("o_orderdate").cast("string").alias("available_at"),
        F.round(F.col("o_totalprice") / 1000 - 100, 3).cast("string").alias("factor"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise("filing").alias("source"),
    )
    out = I.check_actions(a).withColumn("violations", F.array_join("violations", ";"))
    return out.groupBy("violations").agg(F.count(F.lit(1)).alias("actions"))


FOLDS = (
    ("f1", "1995-01-02", "1997-12-31", "1998-01-01", "1998-06-30", "1998-07-01", "1998-12-31"),
    ("f2", "1995-01-02", "1998-12-31", "1999-01-01", "1999-06-30", "1999-07-01", "1999-12-31"),
    ("f3", "1995-01-02", "1999-12-31", "2000-01-01", "2000-06-30", "2000-07-01", "2000-12-31"),
)
FOLD_ROWS = ", ".join("('" + "', '".join(f) + "')" for f in FOLDS)
cte("c_folds", "SELECT fold_id, " + ", ".join(f"CAST({c} AS DATE) AS {c}" for c in I.FOLD_COLUMNS[1:]) + f" FROM (VALUES {FOLD_ROWS}) t({', '.join(I.FOLD_COLUMNS)})")
LOCKED_ROWS = ", ".join("('" + "', '".join(f) + "')" for f in I.LOCKED_FOLDS)
PART = """CASE WHEN {d} BETWEEN train_start AND train_end THEN 'train' WHEN {d} BETWEEN validation_start AND validation_end THEN 'validation'
 WHEN {d} BETWEEN test_start AND test_end THEN 'test' END"""
cte("c_member", f"""SELECT * FROM (SELECT d.instrument_id, d.session_date, f.fold_id, {PART.format(d='d.session_date')} AS "partition"
 FROM c_daily d CROSS JOIN c_folds f) WHERE "partition" IS NOT NULL""")


def folds(spark):
    return I.folds_table(spark, FOLDS)


@query("fold_partition", 'SELECT fold_id, "partition", count(*) AS sessions, count(DISTINCT instrument_id) AS instruments FROM c_member GROUP BY 1, 2')
def fold_partition(spark, d):
    member = I.fold_partition(daily(spark, d).select("instrument_id", "session_date"), folds(spark))
    return member.groupBy("fold_id", "partition").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("instrument_id").alias("instruments")
    )


@query("locked_folds", f"""WITH f AS (SELECT fold_id, {", ".join(f"CAST({c} AS DATE) AS {c}" for c in I.FOLD_COLUMNS[1:])} FROM (VALUES {LOCKED_ROWS}) t({', '.join(I.FOLD_COLUMNS)})),
 s AS (SELECT CAST(o_orderdate + INTERVAL 9800 DAY AS DATE) AS d FROM orders)
SELECT fold_id, p AS "partition", count(*) AS orders FROM (SELECT fold_id, {PART.format(d='d')} AS p FROM s CROSS JOIN f) WHERE p IS NOT NULL GROUP BY 1, 2""")
def locked_folds(spark, d):
    """Order dates moved into the folds' years."""
    o = market.table(spark, d, "orders").select(F.date_add(F.to_date("o_orderdate"), 9800).alias("session_date"))
    return I.fold_partition(o, I.folds_table(spark)).groupBy("fold_id", "partition").agg(F.count(F.lit(1)).alias("orders"))


@query("check_folds", f"""WITH m AS (SELECT fold_id, 'c' || o_custkey AS instrument_id, CAST(o_orderdate AS DATE) AS session_date,
   CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS p, f.* FROM orders CROSS JOIN c_folds f),
 k AS (SELECT fold_id, instrument_id, session_date, count(*) AS n, min(p) AS lo, max(p) AS hi, any_value({PART.format(d='session_date')}) AS due FROM m GROUP BY 1, 2, 3)
SELECT fold_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
  CAST(sum(CASE WHEN due IS NULL OR lo <> due OR hi <> due THEN n ELSE 0 END) AS BIGINT) AS partition_mismatches, true AS chronological FROM k GROUP BY 1""")
def check_folds(spark, d):
    from barlens.operators.clean import check_folds as check

    m = market.table(spark, d, "orders").select(
        F.explode(F.array(*(F.lit(f[0]) for f in FOLDS))).alias("fold_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("instrument_id"),
        F.to_date("o_orderdate").alias("session_date"),
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validation").otherwise("test").alias("partition"),
    )
    return check(m, folds(spark))


@query("partition_counts", """WITH x AS (SELECT f.fold_id, count(*) AS excluded FROM c_daily_checked d CROSS JOIN c_folds f WHERE reasons <> '' GROUP BY 1)
SELECT m.fold_id, m."partition", count(*) AS included, max(x.excluded) AS excluded FROM c_member m JOIN c_daily_checked d USING (instrument_id, session_date) JOIN x ON x.fold_id = m.fold_id
WHERE d.reasons = '' GROUP BY 1, 2""")
def partition_counts(spark, d):
    from barlens.operators.clean import validate_daily
    from barlens.plans.inputs import weekdays

    checked = validate_daily(daily(spark, d), weekdays(spark)).select(
        "instrument_id", "session_date", (F.size("reasons") == 0).alias("ok")
    )
    f = folds(spark)
    included = I.fold_partition(checked.where("ok"), f).groupBy("fold_id", "partition").agg(F.count(F.lit(1)).alias("included"))
    excluded = f.select("fold_id", checked.where("not ok").agg(F.count(F.lit(1)).alias("n")).scalar().alias("excluded"))
    return included.join(excluded, "fold_id")


# method ledger: three methods price every order from its line items
cte("c_ledger", """SELECT l_returnflag AS method, CAST(l_shipdate AS DATE) AS date, p_brand AS instrument_id, avg(l_discount * 100) AS value, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")


def ledger(spark, d):
    """Cost per return flag (the method), ship date and brand."""
    li = market.table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_partkey", "l_discount")
    p = market.table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_returnflag").alias("method"), F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("instrument_id")
    ).agg(F.avg(F.col("l_discount") * 100).alias("value"), F.count(F.lit(1)).alias("n"))


cte("c_cases", """SELECT date, instrument_id, max(value) FILTER (method = 'N') AS baseline_value, max(value) FILTER (method = 'R') AS candidate_value,
  count(*) FILTER (method = 'N') AS b, count(*) FILTER (method = 'R') AS c FROM c_ledger WHERE method IN ('N', 'R') GROUP BY 1, 2""")


@query("complete_case", """SELECT CAST(sum(b) AS BIGINT) AS baseline_rows, CAST(sum(c) AS BIGINT) AS candidate_rows, count(*) FILTER (b = 1 AND c = 1) AS matched_rows,
  count(*) FILTER (c = 0) AS dropped_baseline_rows, count(*) FILTER (b = 0) AS dropped_candidate_rows, CAST(0 AS BIGINT) AS duplicated_identities FROM c_cases""")
def complete_case(spark, d):
    cases = I.complete_case(ledger(spark, d), baseline="N", candidate="R", value="value", identity=["date", "instrument_id"])
    return I.complete_case_counts(cases)


@query("pair_strategies", """SELECT c.method AS strategy, c.date, c.instrument_id, round(c.value - b.value, 6) AS difference
FROM c_ledger c JOIN c_ledger b ON b.method = 'N' AND b.date = c.date AND b.instrument_id = c.instrument_id WHERE c.method <> 'N'""")
def pair_strategies(spark, d):
    r = ledger(spark, d).withColumnRenamed("method", "strategy")
    return I.pair_strategies(r, baseline="N", pair=["date", "instrument_id"], value="value").select(
        "strategy", "date", "instrument_id", rnd("difference").alias("difference")
    )


@query("align_benchmark", """SELECT t.instrument_id, t.session_date, t.token, t.close, b.close AS benchmark_close FROM c_tok60 t
JOIN c_tok60 b ON b.instrument_id = 'click' AND b.session_date = t.session_date AND b.token = t.token WHERE t.instrument_id <> 'click'""")
def align_benchmark(spark, d):
    from barlens.plans.inputs import DAY_1H

    t = B.token_bars(bars(spark, d), DAY_1H)
    out = I.align_benchmark(t.where("instrument_id <> 'click'"), t.where("instrument_id = 'click'"), ["close"])
    return out.select("instrument_id", "session_date", "token", "close", "benchmark_close")


@query("benchmark_exclusions", """SELECT DISTINCT d.instrument_id, d.session_date FROM c_daily d
WHERE NOT EXISTS (SELECT 1 FROM c_daily b WHERE b.instrument_id = 'Brand#1' AND b.session_date = d.session_date)""")
def benchmark_exclusions(spark, d):
    t = daily(spark, d)
    return I.benchmark_exclusions(t, t.where("instrument_id = 'Brand#1'")).select("instrument_id", "session_date")


@query("join_embedding", """SELECT status, count(*) AS samples FROM (SELECT doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM (SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer) s LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = s.doc_id) GROUP BY 1""")
def join_embedding(spark, d):
    s = market.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"))
    e = market.embeddings(spark, d).select(F.col("vec_id").cast("string").alias("sample_id"), "embedding")
    return I.join_by_sample(s, e).groupBy("status").agg(F.count(F.lit(1)).alias("samples"))


@query("forecast_actual_join", """SELECT t.instrument_id || '|' || t.session_date AS case_id, t.token AS target_bucket,
  round(t.volume / sum(t.volume) OVER (PARTITION BY t.instrument_id, t.session_date) + 1e-9, 6) AS actual_share,
  round(t.trade_count / sum(t.trade_count) OVER (PARTITION BY t.instrument_id, t.session_date) + 1e-9, 6) AS forecast_share FROM c_tok t""")
def forecast_actual_join(spark, d):
    from pyspark.sql import Window

    t = B.token_bars(bars(spark, d), DAY_4H).withColumn("case_id", F.concat_ws("|", "instrument_id", F.col("session_date").cast("string")))
    w = Window.partitionBy("case_id")
    actual = t.select("case_id", F.col("token").alias("target_bucket"), rnd_ratio(F.col("volume") / F.sum("volume").over(w)).alias("actual_share"))
    forecast = t.select("case_id", F.col("token").alias("target_bucket"), rnd_ratio(F.col("trade_count") / F.sum("trade_count").over(w)).alias("forecast_share"))
    return actual.join(forecast, ["case_id", "target_bucket"])


cte("c_adv", """SELECT * FROM (SELECT instrument_id, session_date, volume, avg(volume) OVER w AS adv20, count(volume) OVER w AS n FROM c_daily
 WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE n = 20""")


@query("adv20", "SELECT instrument_id, session_date, volume, round(adv20, 6) AS adv20 FROM c_adv")
def adv20(spark, d):
    from barlens.operators.history import adv

    return adv(daily(spark, d)).select("instrument_id", "session_date", "volume", rnd("adv20").alias("adv20"))


@query("adv_lookup", """SELECT c.instrument_id, c.session_date, c.side, CAST(greatest(1, round_even(0.03 * a.adv20, 0)) AS BIGINT) AS quantity
FROM (SELECT DISTINCT instrument_id, session_date, 'buy' AS side FROM c_daily) c JOIN c_adv a USING (instrument_id, session_date)""")
def adv_lookup(spark, d):
    from barlens.operators.history import adv

    t = daily(spark, d)
    cases = t.select("instrument_id", "session_date", F.lit("buy").alias("side")).distinct()
    return I.adv_lookup(cases, adv(t), 0.03).select("instrument_id", "session_date", "side", "quantity")


@query("union_all", """SELECT session_date, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars FROM
 (SELECT session_date, volume FROM c_hour UNION ALL SELECT session_date, volume FROM c_daily) GROUP BY 1""")
def union_all(spark, d):
    h = hour_bars(spark, d).select("session_date", "volume")
    return h.unionByName(daily(spark, d).select("session_date", "volume")).groupBy("session_date").agg(
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars")
    )


@query("common_cases", """SELECT method, date, instrument_id, round(value, 6) AS value FROM c_ledger WHERE (date, instrument_id) IN
 (SELECT (date, instrument_id) FROM c_ledger GROUP BY date, instrument_id HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM c_ledger))""")
def common_cases(spark, d):
    return I.common_cases(ledger(spark, d), ["date", "instrument_id"], "method").select(
        "method", "date", "instrument_id", rnd("value").alias("value")
    )


@query("method_completeness", """SELECT date, instrument_id, count(DISTINCT method) AS methods FROM c_ledger GROUP BY 1, 2 HAVING count(DISTINCT method) < 3""")
def method_completeness(spark, d):
    return ledger(spark, d).groupBy("date", "instrument_id").agg(F.count_distinct("method").alias("methods")).where("methods < 3")


@query("except_sets", """SELECT 'no_shipment' AS side, CAST(d AS VARCHAR) AS id FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem)
 UNION ALL SELECT 'no_order', CAST(d AS VARCHAR) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderdate AS DATE) = x.d)""")
def except_sets(spark, d):
    """Dates of one table that the other lacks, as EXCEPT and as anti join."""
    o = market.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    li = market.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    a = o.subtract(li).withColumn("side", F.lit("no_shipment"))
    b = li.distinct().join(o, "day", "left_anti").withColumn("side", F.lit("no_order"))
    return a.unionByName(b).select("side", F.col("day").cast("string").alias("id"))


@query("candidate_comparison", """WITH q AS (SELECT instrument_id, avg(CAST(token_valid_full_session AS DOUBLE)) AS token_completeness, avg(CAST(minute_exact_full_session AS DOUBLE)) AS minute_completeness,
   avg(CAST(tca_window_exact AS DOUBLE)) AS window_completeness, avg(observed_minute_count) AS obs, CAST(sum(provider_gap_count) AS BIGINT) AS gaps FROM c_quality4 WHERE NOT early_close GROUP BY 1),
 v AS (SELECT instrument_id, count(DISTINCT session_date) / 30.0 AS completeness, median(close) AS px, median(vwap * volume) AS dv FROM c_hour GROUP BY 1)
SELECT instrument_id, round(v.completeness, 6) AS minute_session_completeness, round(token_completeness, 6) AS token_completeness, round(minute_completeness, 6) AS minute_completeness,
  round(window_completeness, 6) AS window_completeness, round(obs + 1e-9, 6) AS average_observed_minute_count, gaps AS provider_gaps, v.completeness >= 0.95 AS minute_eligible,
  px >= 5 AND v.completeness >= 0.95 AND dv > 0 AS daily_eligible, CASE WHEN token_completeness >= 0.95 THEN 'high' WHEN token_completeness >= 0.8 THEN 'medium' ELSE 'low' END AS token_band
FROM v JOIN q USING (instrument_id)""")
def candidate_comparison(spark, d):
    h = hour_bars(spark, d)
    v = h.groupBy("instrument_id").agg((F.count_distinct("session_date") / F.lit(30.0)).alias("session_completeness"))
    v = v.join(quantiles(h, ["instrument_id"], "close", {"median_daily_price": 0.5}), "instrument_id")
    dollars = h.select("instrument_id", (F.col("vwap") * F.col("volume")).alias("x"))
    v = v.join(quantiles(dollars, ["instrument_id"], "x", {"median_daily_dollar_volume": 0.5}), "instrument_id")
    dly = v.withColumn("security_type", F.lit(U.COMMON)).withColumnRenamed("session_completeness", "daily_completeness")
    out = U.candidate_comparison(v, dly, quality(spark, d, DAY_4H))
    return out.select(
        "instrument_id", "provider_gaps", "minute_eligible", "daily_eligible", "token_band",
        *(rnd(c).alias(c) for c in ("minute_session_completeness", "token_completeness", "minute_completeness", "window_completeness")),
        rnd_ratio("average_observed_minute_count").alias("average_observed_minute_count"),
    )
