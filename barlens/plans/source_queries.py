"""Scans, sinks, models and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd, rnd_ratio
from barlens.operators import datasets as D
from barlens.operators import identity as I
from barlens.operators import models as M
from barlens.operators import universe as U
from barlens.plans.dataset_queries import arrays, buckets4, origins, samples
from barlens.plans.evaluation_queries import pairs
from barlens.plans.inputs import bars, daily, hour_bars, raw_bars
from barlens.plans.registry import cte, query
from barlens.plans.universe_queries import candidates, universe
from barlens.session import scratch_path
from barlens.sources import market
from barlens.sources import readers as R
from barlens.sources import writers as W
from barlens.streaming import jobs as S
from barlens.streaming import stateful


@query("scan_bars", """SELECT symbol, count(*) AS rows, CAST(sum(volume) AS BIGINT) AS volume, round(sum(close), 2) AS close FROM c_raw GROUP BY 1""")
def scan_bars(spark, d):
    """Provider rows written as two folders with an extra column, scanned together."""
    path = scratch_path(spark, "bars")
    raw = raw_bars(spark, d).withColumn("extra", F.lit("x"))
    raw.where("seq < 1000000000000").write.parquet(f"{path}/a")
    raw.where("seq >= 1000000000000").write.parquet(f"{path}/b")
    scanned = R.scan_bars(spark, f"{path}/a", f"{path}/b")
    return scanned.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"), rnd(F.sum("close"), 2).alias("close"))


@query("scan_symbol", "SELECT upper(symbol) AS symbol, count(*) AS rows FROM c_raw WHERE symbol IN ('click', 'view') GROUP BY 1")
def scan_symbol(spark, d):
    path = scratch_path(spark, "symbols")
    W.write_bars(raw_bars(spark, d), path)
    hit = R.scan_bars(spark, path, symbols=["CLICK", "View"])
    return hit.groupBy(F.upper("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("rows")).join(R.symbols_of(hit), "symbol")


@query("read_any", """SELECT count(*) AS rows, count(*) FILTER (c_nationkey = 3) AS wrong_effective_date, CAST(0 AS BIGINT) AS empty_identity, count(*) - count(DISTINCT c_acctbal) AS duplicate_identity, count(*) FILTER (c_nationkey = 7) AS missing_source FROM customer""")
def read_any(spark, d):
    """Customers as a snapshot, written as CSV and read back by suffix."""
    path = scratch_path(spark, "snapshot") + ".csv"
    c = market.table(spark, d, "customer")
    c.select(
        F.col("c_acctbal").cast("string").alias("instrument_id"), F.col("c_name").alias("symbol"), F.lit(U.COMMON).alias("security_type"),
        F.when(F.col("c_nationkey") == 3, "2021-01-05").otherwise("2021-01-04").alias("effective_date"), F.when(F.col("c_nationkey") != 7, "filing").alias("source"),
    ).write.csv(path, header=True)
    return R.check_snapshot(R.read_any(spark, path, R.SNAPSHOT_COLUMNS), "2021-01-04")


@query("read_receipts", """SELECT verdict, count(*) AS receipts FROM (SELECT CASE WHEN instrument_id = 'signup' THEN 'not_complete' WHEN instrument_id = 'error' THEN 'unknown_instrument'
  WHEN instrument_id = 'view' THEN 'hash_mismatch' WHEN instrument_id = 'purchase' THEN 'wrong_feed_or_adjustment' ELSE 'verified' END AS verdict FROM (SELECT DISTINCT instrument_id FROM c_min)) GROUP BY 1""")
def read_receipts(spark, d):
    """One response file per instrument; each instrument but one has a different fault."""
    path = scratch_path(spark, "receipts")
    day = hour_bars(spark, d).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum("volume").alias("v"))
    day.select(F.concat_ws(",", "row_count", "v").alias("value"), "instrument_id").repartition("instrument_id").write.partitionBy("instrument_id").text(f"{path}/responses")
    iid = F.regexp_extract("path", "instrument_id=([^/]+)/part", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/responses").where(iid != "")
    receipts = files.select(
        iid.alias("chunk_identity"), F.when(iid == "error", "nobody").otherwise(iid).alias("instrument_id"), F.upper(iid).alias("symbol"),
        F.when(iid == "signup", "failed").otherwise("complete").alias("status"), F.lit("sip").alias("feed"),
        F.when(iid == "purchase", "split").otherwise("raw").alias("adjustment"),
        F.when(iid == "view", F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("response_sha256"), F.lit(1).alias("row_count"),
    )
    receipts.write.json(f"{path}/receipts")
    known = market.table(spark, d, "events").select(F.col("event_type").alias("instrument_id"))
    out = R.read_receipts(spark, f"{path}/receipts", f"{path}/responses", known, identity=iid)
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("receipts"))


@query("read_actions", """WITH a AS (SELECT 'c' || o_custkey AS instrument_id, CAST(o_orderdate AS DATE) AS effective_date, o_orderdate AS available_at, round(o_totalprice / 1000 - 100, 3) AS factor, o_orderstatus AS s FROM orders),
 c AS (SELECT *, count(*) OVER (PARTITION BY instrument_id, effective_date) AS copies FROM a) SELECT instrument_id, effective_date, available_at, factor FROM c WHERE factor > 0 AND s <> 'P' AND copies = 1""")
def read_actions(spark, d):
    """A file of actions made from the orders, read as text and kept where the checks find nothing."""
    path = scratch_path(spark, "actions")
    text = lambda c: c.cast("string")
    market.table(spark, d, "orders").select(
        F.concat(F.lit("c"), text(F.col("o_custkey"))).alias("instrument_id"), text(F.to_date("o_orderdate")).alias("effective_date"), text(F.col("o_orderdate")).alias("available_at"),
        text(F.round(F.col("o_totalprice") / 1000 - 100, 3)).alias("factor"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("filing").alias("source"),
    ).write.parquet(path)
    read = R.read_any(spark, path, ["instrument_id", "effective_date", "factor", "available_at", "source"])
    return I.check_actions(read).where(F.size("violations") == 0).select("instrument_id", "effective_date", "available_at", "factor")


@query("load_partition", "SELECT session_date, minute, open, close, volume FROM c_hour WHERE instrument_id = 'purchase'")
def load_partition(spark, d):
    path = scratch_path(spark, "corpus")
    W.write_partitioned(hour_bars(spark, d), path, ["instrument_id"], rows_per_task=500)
    return R.load_partition(spark, path, "purchase").select("session_date", "minute", "open", "close", "volume")


@query("write_partitioned", "SELECT 'static' AS mode, symbol, count(*) AS rows, round(sum(target_volume_share), 3) AS share FROM c_static_ds GROUP BY 2")
def write_partitioned(spark, d):
    path = scratch_path(spark, "dataset")
    W.write_partitioned(D.static_dataset(buckets4(spark, d), 240), path)
    back = spark.read.parquet(path)
    return back.groupBy("mode", "symbol").agg(F.count(F.lit(1)).alias("rows"), rnd(F.sum(F.round(F.col("target_volume_share") + 1e-9, 6)), 3).alias("share"))


@query("write_sequences", "SELECT CAST(year(session_date) AS INTEGER) AS year, instrument_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT instrument_id, session_date, count(*) AS n FROM c_hour GROUP BY 1, 2) GROUP BY 1, 2")
def write_sequences(spark, d):
    path = scratch_path(spark, "sequences")
    from barlens.plans.dataset_queries import sequence_tokens

    s = D.session_arrays(sequence_tokens(spark, d), ["volume", "baseline"], ["session_id", "instrument_id", "session_date"])
    W.write_sequences(s, path)
    return spark.read.parquet(path).groupBy("year", "instrument_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.size("tokens")).alias("tokens"))


@query("write_csv_manifest", "SELECT symbol, count(*) AS rows, count(DISTINCT session_date) AS days FROM c_min GROUP BY 1")
def write_csv_manifest(spark, d):
    from barlens.operators.quality import bar_manifest
    from barlens.plans.inputs import DAY_1H

    path = scratch_path(spark, "manifest")
    b = bars(spark, d)
    W.write_csv_manifest(bar_manifest(b, b.select("symbol").distinct(), DAY_1H), path)
    back = spark.read.csv(path, header=True)
    return back.select("symbol", F.col("rows").cast("bigint").alias("rows"), F.col("days").cast("bigint").alias("days"))


@query("write_results", """SELECT strategy, count(*) AS results, round(avg(round(difference, 6)), 4) AS mean FROM c_pairs GROUP BY 1""")
def write_results(spark, d):
    from barlens.operators.evaluate import paired_differences

    path = scratch_path(spark, "results")
    p = pairs(spark, d)
    summary = paired_differences(p)
    config = p.limit(1).select(F.lit(17).alias("seed"), F.lit("N").alias("baseline"))
    W.write_results(p, summary, summary, config, path)
    r = spark.read.parquet(f"{path}/results").groupBy("strategy").agg(F.count(F.lit(1)).alias("results"))
    a = spark.read.csv(f"{path}/aggregate", header=True).select("strategy", rnd("mean_difference", 4).alias("mean"))
    return r.join(a, "strategy")


@query("flatten_provider_json", """SELECT violations, count(*) AS bars, count(DISTINCT symbol) AS symbols, round(sum(close), 2) AS close FROM (SELECT concat_ws(';', CASE WHEN instrument_id = 'Brand#3' THEN 'unknown_symbol' END) AS violations, symbol, close FROM c_daily) GROUP BY 1""")
def flatten_provider_json(spark, d):
    """Daily bars packed into one provider page for each symbol and month, written, read and flattened again."""
    b = daily(spark, d)
    obs = F.struct(
        F.date_format("session_date", "yyyy-MM-dd'T'05:00:00'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.col("volume").alias("v"), F.col("trade_count").alias("n"), F.col("vwap").alias("vw"),
    )
    per = b.groupBy(F.trunc("session_date", "MM").alias("m"), F.lower("symbol").alias("symbol")).agg(F.collect_list(obs).alias("o"))
    text = per.select(F.to_json(F.struct(F.create_map("symbol", "o").alias("bars"))).alias("value"))
    ids = market.table(spark, d, "part").select(F.col("p_brand").alias("instrument_id")).distinct().where("instrument_id <> 'Brand#3'")
    ids = ids.withColumn("symbol", F.replace(F.col("instrument_id"), F.lit("#"), F.lit(".")))
    path = scratch_path(spark, "provider")
    text.write.option("maxRecordsPerFile", 1).text(path)
    flat = R.flatten_provider_json(R.provider_pages(spark, path), ids).withColumn("violations", F.array_join("violations", ";"))
    return flat.groupBy("violations").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols"), rnd(F.sum("close"), 2).alias("close"))


@query("write_universe", """SELECT sha256(to_json(list({'rank': rank, 'instrument_id': instrument_id, 'liquidity_group': CAST(least(5, (rank - 1) * 5 // 10 + 1) AS INTEGER)} ORDER BY rank))::VARCHAR) AS identity, count(*) AS members FROM c_universe""")
def write_universe(spark, d):
    path = scratch_path(spark, "universe")
    why = candidates(spark, d).select(F.explode(F.from_json("exclusion_reasons", "array<string>")).alias("reason"))
    W.write_universe(universe(spark, d), why, 10, path)
    back = spark.read.json(path)
    parsed = F.from_json("manifest", "members array<struct<rank:int>>")
    return back.select("identity", F.size(parsed["members"]).cast("bigint").alias("members"))


@query("write_report_tables", """SELECT 'forecasting' AS name, count(*) AS rows FROM (SELECT DISTINCT method, seed, as_of_token FROM c_fl) UNION ALL SELECT 'execution', 3 UNION ALL SELECT 'representation_accessibility', count(*) FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_linestatus, p_size <= 25 FROM lineitem JOIN part ON p_partkey = l_partkey)
UNION ALL SELECT 'dataset_folds_exclusions', count(*) FROM (SELECT DISTINCT fold_id, "partition" FROM c_member)""")
def write_report_tables(spark, d):
    from barlens.operators.evaluate import forecast_metrics
    from barlens.plans.evaluation_queries import accessibility_curve, execution_table, forecast_ledger_df
    from barlens.plans.identity_queries import partition_counts

    path = scratch_path(spark, "report")
    tables = {
        "dataset_folds_exclusions": partition_counts(spark, d),
        "representation_accessibility": accessibility_curve(spark, d),
        "forecasting": forecast_metrics(forecast_ledger_df(spark, d), ["method", "seed", "as_of_token"]),
        "execution": execution_table(spark, d),
    }
    W.write_report_tables(tables, path)
    out = None
    for name in tables:
        n = spark.read.parquet(f"{path}/{name}.parquet").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


SCEN = {
    "uniform": "1.0", "u": "0.55 + 2.2 * power(2 * p - 1, 2)", "front": "0.4 + 2 * power(1 - p, 2)", "back": "0.4 + 2 * power(p, 2)", "low": "0.15",
    "drought": "1 - 0.85 * exp(-power((p - 0.5) / 0.14, 2))", "opening": "0.65 + 4 * exp(-p / 0.06)", "closing": "0.65 + 4 * exp(-(1 - p) / 0.06)",
}


@query("scenario_bars", "WITH s AS (SELECT instrument_id, session_date, max(close) AS bp, CAST(sum(volume) AS DOUBLE) AS bv FROM c_hour GROUP BY 1, 2), g AS (SELECT *, CAST(range AS INTEGER) AS bucket, (range + 0.5) / 26 AS p FROM s, range(26)) "
       + " UNION ALL ".join(f"SELECT instrument_id, session_date, bucket, '{n}' AS scenario_volume, round(bp * exp(0.01 * p), 6) AS close, round(bp * exp(0.01 * p) * 1.0005, 6) AS high, CAST(round_even(bv * ({e}), 0) AS BIGINT) AS volume, CAST(greatest(1, ceil(round_even(bv * ({e}), 0) / 100)) AS BIGINT) AS trade_count FROM g" for n, e in SCEN.items()))
def scenario_bars(spark, d):
    """Eight volume shapes for every observed session, scaled to its own volume and price."""
    s = hour_bars(spark, d).groupBy("instrument_id", "session_date").agg(F.max("close").alias("base_price"), F.sum("volume").cast("double").alias("base_volume"))
    out = None
    for name in SCEN:
        b = R.scenario_bars(s, buckets=26, volume=name, price="adverse")
        b = b.select("instrument_id", "session_date", "bucket", "scenario_volume", rnd("close").alias("close"), rnd("high").alias("high"), "volume", "trade_count")
        out = b if out is None else out.unionByName(b)
    return out


# --- models ----------------------------------------------------------------------------------


@query("mean_baseline", "SELECT instrument_id, round(avg(volume) + 1e-9, 6) AS prediction, count(*) AS rows FROM c_daily WHERE session_date < DATE '1998-01-01' GROUP BY 1")
def mean_baseline(spark, d):
    m = M.mean_baseline(daily(spark, d).where("session_date < date '1998-01-01'"), "volume", ["instrument_id"])
    return m.withColumn("prediction", rnd_ratio("prediction"))


FEATS = ("bucket", "weekday", "rolling_adv", "previous_session_total_volume", "previous_session_return")


def model_rows(spark, d):
    s = D.static_dataset(buckets4(spark, d), 240)
    return s.select("sample_id", "session_date", F.col("target_bucket_index").cast("double").alias("bucket"), *FEATS[1:], "target_volume_share")


def _folds(spark, d):
    return D.walk_forward(hour_bars(spark, d), train=14, validation=5, test=5, step=5)


def fit_once(family: str, **params):
    def run(spark, d):
        split = "session_date <= date '2024-01-20'", "session_date > date '2024-01-20'"
        out = M.fit_predict(model_rows(spark, d), *split, family, FEATS, "target_volume_share", ["sample_id", "bucket"], **params)
        return out.withColumn("prediction", rnd("prediction", 4))

    return run


query("ridge")(fit_once("ridge", alpha=0.01))
query("elastic_net")(fit_once("elastic_net", alpha=0.001, l1_ratio=0.5))
query("gbt")(fit_once("gbt", iterations=5, max_depth=3))


# normal equations of two standardised, median-filled features: the penalty is the ridge's own weight
@query("ridge_two_features", """WITH r AS (SELECT instrument_id, session_date, ln(open) AS x, CASE WHEN trade_count % 3 > 0 THEN trade_count END AS z, ln(1 + volume) AS y, session_date < DATE '1998-01-01' AS train FROM c_daily),
 m AS (SELECT median(x) AS mx, median(z) AS mz FROM r WHERE train), f AS (SELECT instrument_id, session_date, x AS x, coalesce(z, mz) AS z, y, train FROM r, m),
 s AS (SELECT avg(x) AS ax, avg(z) AS az, stddev_samp(x) AS sx, stddev_samp(z) AS sz, avg(y) AS ay, count(*) AS n FROM f WHERE train),
 u AS (SELECT f.*, (x - ax) / sx AS a, (z - az) / sz AS b FROM f, s),
 g AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ya, covar_pop(b, y) AS yb, 50.0 / count(*) AS k FROM u WHERE train),
 w AS (SELECT (ya * (bb + k * bb) - yb * ab) / ((aa + k * aa) * (bb + k * bb) - ab * ab) AS wa, (yb * (aa + k * aa) - ya * ab) / ((aa + k * aa) * (bb + k * bb) - ab * ab) AS wb FROM g)
SELECT instrument_id, session_date, round(ay + wa * a + wb * b, 5) AS prediction FROM u, w, s WHERE NOT train""")
def ridge_two_features(spark, d):
    rows = daily(spark, d).select("instrument_id", "session_date", F.ln("open").alias("x"), F.when(F.col("trade_count") % 3 > 0, F.col("trade_count")).alias("z"), F.log1p("volume").alias("y"))
    split = "session_date < date '1998-01-01'", "session_date >= date '1998-01-01'"
    return M.fit_predict(rows, *split, "ridge", ("x", "z"), "y", ["instrument_id", "session_date"], alpha=50.0).withColumn("prediction", rnd("prediction", 5))


def _walked(spark, d):
    return M.walk_forward_train(
        model_rows(spark, d), _folds(spark, d), family="ridge", features=FEATS, target="target_volume_share", grid=({"alpha": 0.001}, {"alpha": 1.0}), keep=("sample_id", "bucket")
    )


@query("walk_forward_train")
def walk_forward_train(spark, d):
    return _walked(spark, d)[0].withColumns({"prediction": rnd("prediction", 4), "actual": rnd("actual", 4)})


@query("walk_forward_metrics")
def walk_forward_metrics(spark, d):
    return _walked(spark, d)[1].withColumns({c: rnd(c, 5) for c in ("validation_rmse", "test_mae", "test_rmse")})


@query("scale_shape_gbt")
def scale_shape_gbt(spark, d):
    """Totals and shares of held-out samples from two boosted models, each the best of eight on validation rows."""
    from barlens.operators.forecast import share_from_logits

    scale = D.scale_rows(samples(spark, d), arrays(spark, d)).withColumn("as_of", F.col("as_of_token").cast("double"))
    scale = scale.withColumn("log_baseline", F.log1p("baseline_remaining_volume"))
    shape = lambda s, o=None: D.shape_rows(s, o).withColumn("horizon", F.col("horizon_offset").cast("double"))
    train, valid, test = (scale.where(F.col("partition") == p) for p in ("train", "validation", "test"))
    residual, logit, _ = M.scale_shape_gbt(
        train, shape(train, origins(spark, d)), test, shape(test), ("as_of", "log_baseline"), ("as_of", "horizon", "baseline_share"), valid, shape(valid), step=0.1, tolerance=0.01
    )
    s = logit.select("sample_id", "target_bucket", "logit", F.lit(True).alias("valid"))
    r = residual.select("sample_id", F.col("baseline_remaining_volume").alias("baseline"), "residual")
    out = share_from_logits(s, r, ["sample_id"])
    return out.select("sample_id", "target_bucket", rnd("share", 4).alias("share"), rnd("expected_total", 2).alias("expected_total"))


@query("frozen_vocabulary", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS category FROM orders")
def frozen_vocabulary(spark, d):
    o = market.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    model = M.frozen_vocabulary(o.where("o_orderdate < timestamp_ntz '1999-01-01'"), "o_orderpriority", "category")
    return model.transform(o).select("o_orderkey", "category")


# --- streaming -------------------------------------------------------------------------------

CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM c_ticks WHERE price > 0)"


def stream(spark, d):
    """The event table as a file stream; a glob matches a file as well as a folder."""
    return S.stream_ticks(spark, f"{d}/events.parque[t]")


@query("stream_tokens", f"""SELECT instrument_id, CAST(session_date AS TIMESTAMP) + to_minutes(token * 240) AS token_start, open, high, low, close, volume, trade_count AS trades, round(vwap + 1e-9, 6) AS vwap,
  round(realized_volatility, 6) AS realized_volatility, observed FROM c_tok WHERE CAST(session_date AS TIMESTAMP) + to_minutes(token_end_minute) <= date_trunc('millisecond', {CLOSED})""")
def stream_tokens(spark, d):
    t = S.run_available(S.stream_tokens(stream(spark, d), "4 hours", "1 hour"), "tokens")
    return t.withColumns({"token_start": F.col("token_start").cast("timestamp_ntz"), "vwap": rnd_ratio("vwap"), "realized_volatility": rnd("realized_volatility")})


@query("stream_late_trades", f"""WITH k AS (SELECT *, seq % 20 = 0 AS held FROM c_ticks WHERE price > 0), m AS (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 HOUR) AS mark FROM k WHERE NOT held AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM c_ticks))
SELECT instrument_id, count(*) AS trades, count(*) FILTER (held AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= mark) AS late FROM k, m GROUP BY 1""")
def stream_late_trades(spark, d):
    """The event table in two files, and every twentieth event in a third that comes last."""
    path = scratch_path(spark, "arrivals")
    events = market.table(spark, d, "events")
    half = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).scalar()
    held = F.col("event_id") % 20 == 0
    for name, part in (("1", ~held & (F.col("ts") < half)), ("2", ~held & (F.col("ts") >= half)), ("3", held)):
        events.where(part).coalesce(1).write.parquet(f"{path}/arrival={name}")
    ticks = S.stream_ticks(spark, f"{path}/arrival=*", files_per_trigger=1)
    late, _ = S.run_late(ticks, "1 hour", "late")
    every = market.ticks(spark, d).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("trades"))
    counts = late.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("late"))
    return every.join(counts, "instrument_id", "left").select("instrument_id", "trades", F.coalesce("late", F.lit(0)).cast("bigint").alias("late"))


@query("stream_dedupe", "SELECT instrument_id, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume FROM c_ticks WHERE price > 0 GROUP BY 1")
def stream_dedupe(spark, d):
    """Every trade arrives twice; each is kept once."""
    s = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    t = S.run_available(S.stream_dedupe(s, "1 hour"), "dedupe")
    return t.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"))


@query("stream_quality", "SELECT instrument_id, CAST(ts AS DATE) AS session_date, count(*) AS observed, count(*) FILTER (size <= 0) AS empty_trades, max(ts) AS last_ts FROM c_ticks WHERE price > 0 GROUP BY 1, 2")
def stream_quality(spark, d):
    q = S.run_updates(S.stream_quality(stream(spark, d)), "quality", ["instrument_id", "session_date"])
    return q.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("stream_gap_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY instrument_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM c_ticks WHERE price > 0),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY instrument_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT instrument_id, min(ts) AS run_start, max(ts) + INTERVAL 30 MINUTE AS run_end, count(*) AS trades FROM r GROUP BY instrument_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= date_trunc('millisecond', {CLOSED})""")
def stream_gap_sessions(spark, d):
    g = S.run_available(S.stream_gap_sessions(stream(spark, d), "30 minutes", "1 hour"), "gaps")
    return g.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start", "run_end")})


@query("stream_rolling", f"""WITH b AS (SELECT *, CAST(session_date AS TIMESTAMP) + to_minutes(minute) AS ts FROM c_min), w AS (SELECT b.*, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h.range) AS s FROM b, range(4) h),
 r AS (SELECT *, power(ln(close) - lag(ln(close)) OVER (PARTITION BY instrument_id, s ORDER BY ts), 2) AS sq FROM w)
SELECT instrument_id, s AS window_start, CAST(sum(volume) AS BIGINT) AS volume, round(max(high) - min(low), 6) AS price_range, round(sqrt(coalesce(sum(sq), 0)), 6) AS realized_volatility, count(*) AS observed
FROM r GROUP BY 1, 2 HAVING s + INTERVAL 4 HOUR <= date_trunc('millisecond', {CLOSED})""")
def stream_rolling(spark, d):
    bars = S.minute_bars(stream(spark, d), "1 hour")
    with stateful.keyed_state(spark):
        r = S.run_available(stateful.stream_volatility(bars, width_minutes=240, slide_minutes=60), "rolling")
    return r.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "price_range": rnd("price_range"), "realized_volatility": rnd("realized_volatility")})


@query("stream_profile_join", "SELECT t.instrument_id, t.seq, p.bucket, round(p.expected_volume + 1e-6, 4) AS expected_volume FROM c_ticks t JOIN c_profile4 p ON p.instrument_id = t.instrument_id AND p.session_date = CAST(t.ts AS DATE) AND p.bucket = hour(t.ts) // 4 WHERE t.price > 0")
def stream_profile_join(spark, d):
    from barlens.plans.forecast_queries import profile4

    path = scratch_path(spark, "profile")
    profile4(spark, d).select("instrument_id", "session_date", "bucket", "expected_volume").write.parquet(path)
    j = S.run_available(S.stream_profile_join(stream(spark, d), spark.read.parquet(path), token_minutes=240), "profiled")
    return j.select("instrument_id", "seq", "bucket", rnd(F.col("expected_volume") + 1e-6, 4).alias("expected_volume"))


@query("stream_boundary_forecasts", """WITH f AS (SELECT instrument_id, session_date, g.range * 240 AS generated_minute, minute, volume * (1 + g.range) AS v FROM c_hour, range(6) g WHERE minute >= g.range * 240),
 q AS (SELECT DISTINCT instrument_id, session_date, minute AS now_minute FROM c_hour), e AS (SELECT date_trunc('millisecond', max(CAST(session_date AS TIMESTAMP) + to_minutes(minute)) - INTERVAL 1 HOUR) AS mark FROM c_hour),
 j AS (SELECT q.*, f.generated_minute, f.minute, f.v FROM q JOIN f ON f.instrument_id = q.instrument_id AND f.session_date = q.session_date AND f.generated_minute = q.now_minute - q.now_minute % 240 AND f.minute >= q.now_minute, e
   WHERE CAST(q.session_date AS TIMESTAMP) + to_minutes(q.now_minute) <= mark)
SELECT instrument_id, session_date, now_minute, CAST(generated_minute AS INTEGER) AS generated_minute, minute, CAST(v AS DOUBLE) AS expected_volume,
  round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 0 END + 1e-9, 6) AS share FROM j WINDOW w AS (PARTITION BY instrument_id, session_date, now_minute)""")
def stream_boundary_forecasts(spark, d):
    """The forecasts and requests of ``truncate_forecast`` as streams; requests after the last watermark wait."""
    from barlens.plans.inputs import hour_bars

    path = scratch_path(spark, "boundary")
    instant = lambda minute: F.expr(f"cast(cast(session_date as timestamp_ntz) + make_interval(0, 0, 0, 0, 0, {minute}) as timestamp)")
    h = hour_bars(spark, d).select("instrument_id", "session_date", "minute", "volume")
    made = h.withColumn("g", F.explode(F.sequence(F.lit(0), F.floor(F.col("minute") / 240).cast("int")))).select(
        "instrument_id", "session_date", (F.col("g") * 240).alias("generated_minute"), "minute", (F.col("volume") * (1 + F.col("g"))).cast("double").alias("v")
    )
    packed = made.groupBy("instrument_id", "session_date", "generated_minute").agg(F.array_sort(F.collect_list(F.struct("minute", "v"))).alias("p"))
    packed.select("instrument_id", "session_date", "generated_minute", instant("generated_minute").alias("ts"), F.transform("p", lambda x: x["minute"]).alias("minutes"), F.transform("p", lambda x: x["v"]).alias("volumes")).write.parquet(f"{path}/forecasts")
    h.select("instrument_id", "session_date", F.col("minute").alias("now_minute"), instant("minute").alias("ts")).distinct().write.parquet(f"{path}/requests")
    forecasts, requests = (spark.readStream.schema(spark.read.parquet(f"{path}/{n}").schema).parquet(f"{path}/{n}") for n in ("forecasts", "requests"))
    with stateful.keyed_state(spark):
        t = S.run_available(stateful.stream_boundary_forecasts(forecasts, requests, update=240, delay="1 hour"), "answers")
    return t.select("instrument_id", "session_date", "now_minute", "generated_minute", "minute", "expected_volume", rnd_ratio("share").alias("share"))
