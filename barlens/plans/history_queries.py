"""Window queries over sessions and tokens, and the scalar families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions import scalar as S
from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import bars as B
from barlens.operators import history as H
from barlens.operators import ranking as R
from barlens.plans.inputs import DAY_4H, bars, daily, hour_bars
from barlens.plans.registry import cte, query
from barlens.sources import market

HISTORY = (
    "previous_session_total_volume", "rolling_adv", "rolling_median_volume", "rolling_volatility",
    "previous_session_return", "previous_session_range", "previous_session_trade_count",
)
HIST_SQL = """SELECT *, lag(volume) OVER o::DOUBLE AS previous_session_total_volume, avg(volume) OVER p AS rolling_adv,
  median(volume) OVER p AS rolling_median_volume, coalesce(stddev_pop(r) OVER i, 0) AS rolling_volatility,
  ln(lag(close) OVER o / lag(open) OVER o) AS previous_session_return, (lag(high) OVER o - lag(low) OVER o) / lag(open) OVER o AS previous_session_range,
  coalesce(lag(trade_count) OVER o, 0)::DOUBLE AS previous_session_trade_count, lag(session_date) OVER o AS previous_session_date
FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date)) AS r FROM {src})
WINDOW o AS (PARTITION BY symbol ORDER BY session_date), p AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
 i AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)""".replace("lag(volume) OVER o::DOUBLE", "CAST(lag(volume) OVER o AS DOUBLE)").replace("coalesce(lag(trade_count) OVER o, 0)::DOUBLE", "CAST(coalesce(lag(trade_count) OVER o, 0) AS DOUBLE)")
cte("c_sess", """SELECT instrument_id, symbol, session_date, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, max(minute) AS last_minute FROM c_min GROUP BY 1, 2, 3""")
cte("c_hist_daily", HIST_SQL.format(src="c_daily"))
cte("c_hist", HIST_SQL.format(src="c_sess"))


@query("history_features", "SELECT symbol, session_date, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in HISTORY) + " FROM c_hist_daily")
def history_features(spark, d):
    return H.history_features(daily(spark, d)).select("symbol", "session_date", *(rnd_ratio(c).alias(c) for c in HISTORY))


INTRADAY = ("elapsed_session_fraction", "observed_cumulative_volume", "recent_bucket_volume", "recent_realized_volatility")
cte("c_b4", """SELECT instrument_id, symbol, session_date, CAST(minute // 240 AS INTEGER) AS bucket, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, minute) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM c_min GROUP BY 1, 2, 3, 4""")
cte("c_b60", """SELECT instrument_id, symbol, session_date, CAST(minute // 60 AS INTEGER) AS bucket, open, high, low, close, volume, trade_count, vwap FROM c_hour""")
INTRADAY_SQL = """SELECT *, row_number() OVER o - 1 AS k, count(*) OVER g AS n, (row_number() OVER o - 1) / count(*) OVER g AS elapsed_session_fraction,
  CAST(coalesce(sum(volume) OVER b, 0) AS DOUBLE) AS observed_cumulative_volume, CAST(lag(volume) OVER o AS DOUBLE) AS recent_bucket_volume,
  coalesce(stddev_pop(r) OVER f, 0) AS recent_realized_volatility,
  CAST(sum(volume) OVER a AS BIGINT) AS remaining_volume, CAST(sum(volume) OVER g AS BIGINT) AS session_volume, lag(bucket) OVER o AS previous_bucket
FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, session_date ORDER BY bucket)) AS r FROM {src})
WINDOW o AS (PARTITION BY symbol, session_date ORDER BY bucket), g AS (PARTITION BY symbol, session_date),
 b AS (PARTITION BY symbol, session_date ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 a AS (PARTITION BY symbol, session_date ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 f AS (PARTITION BY symbol, session_date ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
cte("c_intra4", INTRADAY_SQL.format(src="c_b4"))


@query("intraday_features", "SELECT symbol, session_date, bucket, " + ", ".join(f"round({c}, 6) AS {c}" for c in INTRADAY)
       + " FROM (" + INTRADAY_SQL.format(src="c_b60") + ")")
def intraday_features(spark, d):
    b = B.bucket_minutes(bars(spark, d), 60, ("symbol", "session_date"))
    return H.intraday_features(b).select("symbol", "session_date", "bucket", *(rnd(c).alias(c) for c in INTRADAY))


cte("c_full", "SELECT * FROM c_tok QUALIFY count(*) OVER (PARTITION BY instrument_id, session_date) = 6")
cte("c_ord", "SELECT *, dense_rank() OVER (PARTITION BY instrument_id ORDER BY session_date) AS o FROM c_full")
cte("c_seasonal", """SELECT t.*, h.expected_volume, h.expected_dollar_volume, h.expected_trade_count, d.adv20, d.cutoff
FROM c_ord t JOIN (SELECT t.instrument_id, t.session_date, t.token, sum(h.volume * pow(19.0 / 21, t.o - h.o)) / sum(pow(19.0 / 21, t.o - h.o)) AS expected_volume,
    sum(h.dollar_volume * pow(19.0 / 21, t.o - h.o)) / sum(pow(19.0 / 21, t.o - h.o)) AS expected_dollar_volume,
    sum(h.trade_count * pow(19.0 / 21, t.o - h.o)) / sum(pow(19.0 / 21, t.o - h.o)) AS expected_trade_count
   FROM c_ord t JOIN c_ord h ON h.instrument_id = t.instrument_id AND h.token = t.token AND h.o BETWEEN t.o - 20 AND t.o - 1 GROUP BY 1, 2, 3) h
   USING (instrument_id, session_date, token)
 JOIN (SELECT instrument_id, session_date, avg(v) OVER (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS adv20,
    lag(session_date) OVER (PARTITION BY instrument_id ORDER BY session_date) AS cutoff
   FROM (SELECT instrument_id, session_date, sum(volume) AS v FROM c_full GROUP BY 1, 2)) d USING (instrument_id, session_date)""")


def seasonal(spark, d):
    return H.seasonal_ewma(B.token_bars(bars(spark, d), DAY_4H), token_count=DAY_4H.tokens)


@query("seasonal_ewma", """SELECT instrument_id, session_date, token, round(expected_volume + 1e-9, 6) AS expected_volume, round(expected_dollar_volume + 1e-6, 4) AS expected_dollar_volume,
  round(expected_trade_count + 1e-9, 6) AS expected_trade_count, round(adv20 + 1e-9, 6) AS adv20, cutoff FROM c_seasonal""")
def seasonal_ewma(spark, d):
    return seasonal(spark, d).select(
        "instrument_id", "session_date", "token", rnd_ratio("expected_volume").alias("expected_volume"),
        rnd(F.col("expected_dollar_volume") + 1e-6, 4).alias("expected_dollar_volume"),
        rnd_ratio("expected_trade_count").alias("expected_trade_count"), rnd_ratio("adv20").alias("adv20"), "cutoff",
    )


def features(spark, d):
    s = seasonal(spark, d)
    return H.token_features(
        s.where("instrument_id <> 'click'"), s.where("instrument_id = 'click'"), token_count=DAY_4H.tokens
    )


cte("c_feat", """SELECT *, volume_surprise - coalesce(lag(volume_surprise) OVER w, 0) AS surprise_change FROM (
SELECT t.instrument_id, t.session_date, t.token, t.volume, t.cutoff, t.adv20, t.expected_volume,
  ln(t.close / coalesce(lag(t.close) OVER w, t.pc)) AS return_to_prior_close, ln(t.close / t.open) AS return_to_open, ln(t.high / t.low) AS high_low_range,
  t.realized_volatility AS realized_vol, ln(1 + t.volume) - ln(1 + t.expected_volume) AS volume_surprise,
  ln(1 + t.dollar_volume) - ln(1 + t.expected_dollar_volume) AS dollar_surprise, ln(1 + t.trade_count) - ln(1 + t.expected_trade_count) AS trade_surprise,
  ln((sum(t.volume) OVER r + 1) / (sum(t.expected_volume) OVER r + 1)) AS cumulative_volume_ratio, ln(1 + t.volume / greatest(t.adv20 / 6, 1)) AS volume_to_adv,
  ln(t.vwap / coalesce(lag(t.close) OVER w, t.pc)) AS vwap_to_prior_close, ln(1 + t.adv20) AS log_adv, sin(2 * pi() * (t.token + 0.5) / 6) AS time_sin,
  cos(2 * pi() * (t.token + 0.5) / 6) AS time_cos, (t.token + 1) / 6 AS time_fraction, b.ret AS benchmark_return,
  ln(1 + b.volume) - ln(1 + b.expected_volume) AS benchmark_volume_surprise, b.realized_volatility AS benchmark_realized_vol
FROM (SELECT s.*, p.pc FROM c_seasonal s JOIN (SELECT instrument_id, session_date, lag(c) OVER (PARTITION BY instrument_id ORDER BY session_date) AS pc
        FROM (SELECT instrument_id, session_date, arg_max(close, token) AS c FROM c_full GROUP BY 1, 2)) p USING (instrument_id, session_date)) t
JOIN (SELECT *, ln(close / coalesce(lag(close) OVER (PARTITION BY session_date ORDER BY token), open)) AS ret FROM c_seasonal WHERE instrument_id = 'click') b
  ON b.session_date = t.session_date AND b.token = t.token WHERE t.instrument_id <> 'click'
WINDOW w AS (PARTITION BY t.instrument_id, t.session_date ORDER BY t.token), r AS (PARTITION BY t.instrument_id, t.session_date ORDER BY t.token ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY instrument_id, session_date ORDER BY token)""")


@query("token_features", "SELECT instrument_id, session_date, token, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in H.FEATURES) + " FROM c_feat")
def token_features(spark, d):
    return features(spark, d).select("instrument_id", "session_date", "token", *(rnd_ratio(c).alias(c) for c in H.FEATURES))


cte("c_prior", """SELECT *, avg(volume) OVER (PARTITION BY instrument_id, token ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_mean,
  avg(volume) OVER (PARTITION BY instrument_id, session_date ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS observed_mean FROM c_full""")


@query("difficulty_baseline", """SELECT instrument_id, session_date, token, round(prior_mean + 1e-9, 6) AS prior_mean, round(observed_mean + 1e-9, 6) AS observed_mean FROM c_prior""")
def difficulty_baseline(spark, d):
    t = full_tokens(spark, d)
    return H.prior_mean(t).select(
        "instrument_id", "session_date", "token", rnd_ratio("prior_mean").alias("prior_mean"), rnd_ratio("observed_mean").alias("observed_mean")
    )


def full_tokens(spark, d):
    """Tokens of the sessions that have all of them."""
    t = B.token_bars(bars(spark, d), DAY_4H)
    w = Window.partitionBy("instrument_id", "session_date")
    return t.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == DAY_4H.tokens).drop("_n")


@query("empirical_cdf", """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 0.5) / count(*) OVER (PARTITION BY l_returnflag), 6) AS cdf FROM lineitem""")
def empirical_cdf(spark, d):
    """Rank of each line's price within its flag; a flag may hold a third of the table or more."""
    from barlens.operators.evaluate import empirical_cdf as cdf

    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = market.table(spark, d, "lineitem").select("l_returnflag", *key, "l_quantity", "l_extendedprice")
    out = cdf(li, ["l_returnflag"], "l_extendedprice", ties=[*key, "l_quantity"], name="cdf")
    return out.select("l_returnflag", *key, "l_extendedprice", rnd("cdf").alias("cdf"))


@query("cumulative_curve", """SELECT instrument_id, session_date, token, round(sum(volume) OVER r / sum(volume) OVER g + 1e-9, 6) AS cumulative FROM c_tok60
WINDOW r AS (PARTITION BY instrument_id, session_date ORDER BY token ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY instrument_id, session_date)""")
def cumulative_curve(spark, d):
    from barlens.plans.inputs import DAY_1H

    case = ["instrument_id", "session_date"]
    t = B.token_bars(bars(spark, d), DAY_1H)
    t = t.withColumn("share", F.col("volume") / F.sum("volume").over(Window.partitionBy(*case)))
    return H.cumulative_curve(t, case, "token", "share").select(*case, "token", rnd_ratio("cumulative").alias("cumulative"))


cte("c_pvals", """SELECT l_returnflag AS family, p_brand AS hypothesis, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END) / 20, 4) AS p_value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")


@query("holm", """SELECT family, hypothesis, p_value, round(least(1.0, max(s) OVER (PARTITION BY family ORDER BY p_value, hypothesis ROWS UNBOUNDED PRECEDING)), 6) AS adjusted_p
FROM (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, hypothesis) + 1) * p_value AS s FROM c_pvals)""")
def holm(spark, d):
    li = market.table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_discount")
    p = market.table(spark, d, "part").select("p_partkey", "p_brand")
    h = li.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy(
        F.col("l_returnflag").alias("family"), F.col("p_brand").alias("hypothesis")
    ).agg(F.round(F.avg(F.when(F.col("l_discount") < 0.05, 1.0).otherwise(0.0)) / 20, 4).alias("p_value"))
    return H.holm(h).withColumn("adjusted_p", rnd("adjusted_p"))


cte("c_vol", """SELECT instrument_id, session_date, coalesce(stddev_pop(r), 0) AS session_volatility, CAST(sum(volume) AS BIGINT) AS session_volume FROM (
 SELECT *, ln(vwap / lag(vwap) OVER (PARTITION BY instrument_id, session_date ORDER BY minute)) AS r FROM c_min) GROUP BY 1, 2""")


@query("session_returns", "SELECT instrument_id, session_date, round(session_volatility, 6) AS session_volatility, session_volume FROM c_vol")
def session_returns(spark, d):
    return H.session_volatility(bars(spark, d)).withColumn("session_volatility", rnd("session_volatility"))


# --- scalar families -------------------------------------------------------------------------


@query("scalar_math", """SELECT o_orderkey, round(ln(x), 6) AS ln_x, round(ln(1 + x), 6) AS log1p_x, round(exp(-x / 1e5), 6) AS exp_x, round(sqrt(x), 6) AS sqrt_x,
  round(sin(x), 4) AS sin_x, round_even(x / 1000, 0) AS rint_x, least(greatest(x, 5000.0), 400000.0) AS clip_x, CAST(floor(-x / 1000) AS BIGINT) AS floor_x
FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""")
def scalar_math(spark, d):
    x = F.col("o_totalprice")
    return market.table(spark, d, "orders").select(
        "o_orderkey", rnd(S.safe_ln(x)).alias("ln_x"), rnd(F.log1p(x)).alias("log1p_x"), rnd(F.exp(-x / 1e5)).alias("exp_x"),
        rnd(F.sqrt(x)).alias("sqrt_x"), rnd(F.sin(x), 4).alias("sin_x"), F.bround(x / 1000, 0).alias("rint_x"),
        F.least(F.greatest(x, F.lit(5000.0)), F.lit(400000.0)).alias("clip_x"), F.floor(-x / 1000).alias("floor_x"),
    )


@query("slippage_bps", """SELECT order_id, sign, round(CASE WHEN c.c_acctbal > 0 THEN 10000.0 * sign * (p - c.c_acctbal) / c.c_acctbal END, 4) AS bps FROM
 (SELECT o_orderkey AS order_id, o_custkey, o_totalprice / 100 AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sign FROM orders) o JOIN customer c ON c_custkey = o_custkey""")
def slippage_bps(spark, d):
    o = market.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), "o_custkey", (F.col("o_totalprice") / 100).alias("p"),
        S.side_sign(F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell")).alias("sign"),
    )
    c = market.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        "order_id", "sign", rnd(S.slippage_bps(F.col("p"), F.col("c_acctbal"), F.col("sign")), 4).alias("bps")
    )


@query("reference_price", """SELECT instrument_id, session_date, minute, round(CASE WHEN volume > 20 THEN vwap ELSE (open + high + low + close) / 4 END + 1e-9, 6) AS reference_price FROM c_min""")
def reference_price(spark, d):
    b = bars(spark, d).withColumn("vwap", F.when(F.col("volume") > 20, F.col("vwap")).otherwise(F.lit(float("nan"))))
    return b.select("instrument_id", "session_date", "minute", rnd_ratio(S.reference_price()).alias("reference_price"))


@query("calendar_fields", """SELECT o_orderkey, CAST(isodow(d) - 1 AS INTEGER) AS weekday, CAST(month(d) AS INTEGER) AS month, last_day(d) = d AS is_month_end, last_day(d) = d AND month(d) % 3 = 0 AS is_quarter_end
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar_fields(spark, d):
    fields = S.calendar_fields(F.to_date("o_orderdate"))
    return market.table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in fields.items()))


@query("month_chunks", """SELECT o_custkey, greatest(CAST(m AS DATE), s) AS chunk_start, least(last_day(CAST(m AS DATE)), e) AS chunk_end FROM
 (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e FROM orders GROUP BY 1), LATERAL (SELECT unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 MONTH)) AS m)""")
def month_chunks(spark, d):
    span = market.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("s"), F.max(F.to_date("o_orderdate")).alias("e")
    )
    return span.select("o_custkey", F.inline(S.month_chunks("s", "e")))


@query("string_functions", """SELECT c_custkey, upper(trim('  ' || c_mktsegment || ' ')) AS segment, 'sec-cik-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '-' || replace(upper(c_mktsegment), '.', '-') AS security_id,
  concat_ws('|', c_name, CAST(c_nationkey AS VARCHAR)) AS joined FROM customer""")
def string_functions(spark, d):
    c = market.table(spark, d, "customer")
    return c.select(
        "c_custkey", F.upper(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("segment"),
        S.security_id("c_custkey", "c_mktsegment").alias("security_id"),
        F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string")).alias("joined"),
    )


@query("hash_ids", """SELECT o_orderkey, substr(sha256(o_orderkey || '|' || o_orderstatus || '|4'), 1, 20) AS sample_id, ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT % 97 AS draw FROM orders""")
def hash_ids(spark, d):
    return market.table(spark, d, "orders").select(
        "o_orderkey", S.hash_id("o_orderkey", "o_orderstatus", F.lit(4)).alias("sample_id"),
        S.hash_index(F.col("o_orderkey").cast("string"), F.lit(97)).alias("draw"),
    )


@query("array_functions", """SELECT vec_id, CAST(s.range AS INTEGER) AS slot, s.range >= 8 - least(label, 8) AS mask,
  CASE WHEN s.range >= 8 - least(label, 8) THEN round(CAST(embedding[label - 8 + s.range + 1] AS DOUBLE), 6) ELSE 0 END AS value FROM embeddings CROSS JOIN range(8) s""")
def array_functions(spark, d):
    """The first ``label`` values of each vector right-aligned in eight slots."""
    e = market.embeddings(spark, d).withColumn("head", F.slice("embedding", 1, F.col("label")))
    slots = F.arrays_zip(S.right_align(F.col("head"), 8).alias("v"), S.right_align_mask(F.col("head"), 8).alias("m"))
    return e.select("vec_id", F.posexplode(slots).alias("slot", "z")).select(
        "vec_id", "slot", F.col("z.m").alias("mask"), rnd(F.col("z.v")).alias("value")
    )


@query("json_reasons", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, to_json(list_filter([CASE WHEN value > 100 THEN 'large' END, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda r: r IS NOT NULL))::VARCHAR AS reasons FROM events""")
def json_reasons(spark, d):
    e = market.table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    why = S.reasons((F.col("value") > 100, "large"), (F.col("user_id") % 2 == 0, "even"))
    return e.select("event_id", k.alias("k"), F.to_json(why).alias("reasons"))


@query("softmax", """SELECT instrument_id, session_date, token, round(exp(x - max(x) OVER g) / sum(e) OVER g, 6) AS share FROM
 (SELECT *, exp(x - max(x) OVER (PARTITION BY instrument_id, session_date)) AS e FROM (SELECT instrument_id, session_date, token, ln(1 + volume) / 3 AS x FROM c_tok60))
WINDOW g AS (PARTITION BY instrument_id, session_date)""")
def softmax(spark, d):
    from barlens.operators.forecast import softmax as soft
    from barlens.plans.inputs import DAY_1H

    t = B.token_bars(bars(spark, d), DAY_1H).withColumn("logit", F.log1p("volume") / 3)
    return soft(t, ["instrument_id", "session_date"], "logit", name="share").select(
        "instrument_id", "session_date", "token", rnd("share").alias("share")
    )


@query("transition_map", """SELECT source, string_agg(target || ':' || n, ',' ORDER BY target) AS targets FROM (SELECT source, target, count(*) AS n FROM
 (SELECT o_orderstatus AS source, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders) WHERE target IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def transition_map(spark, d):
    """Long transition counts first; a map only at the edge."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = market.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("source"), F.lead("o_orderstatus").over(w).alias("target")
    ).where("target is not null")
    long = o.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", "n"))))
    m = long.groupBy("source").agg(entries.alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return m.select("source", F.array_join(pairs, ",").alias("targets"))
