"""Hand-computed cases, invariants and brute-force comparisons on literal tables."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.functions import scalar as S
from barlens.operators import bars as B
from barlens.operators import clean as C
from barlens.operators import datasets as D
from barlens.operators import evaluate as E
from barlens.operators import execution as X
from barlens.operators import forecast as P
from barlens.operators import history as H
from barlens.operators import identity as I
from barlens.operators import latent as L
from barlens.operators import models as M
from barlens.operators import quality as Q
from barlens.operators import ranking as R
from barlens.operators import universe as U
from barlens.schema import SessionSpec, require_columns

DAY = dt.date(2024, 1, 3)
MARKET = SessionSpec()


def minute_bars(spark, minutes=range(390), **change):
    """A regular session: close 100 + i/100, volume i + 1."""
    rows = [
        ("a", "A", DAY, i, 99.98 + i / 100, 100.05 + i / 100, 99.95 + i / 100, 100 + i / 100, abs(i) + 1, abs(i) + 2, 99.99 + i / 100)
        for i in minutes
    ]
    df = spark.createDataFrame(
        rows,
        "instrument_id string, symbol string, session_date date, minute int, open double, high double, low double, "
        "close double, volume bigint, trade_count bigint, vwap double",
    )
    return df.withColumns(change) if change else df


# --- cleaning and time ------------------------------------------------------------------------


def test_clean_keeps_last_duplicate_and_regular_hours(spark):
    rows = [
        ("spy", "2024-01-03T14:29:00Z", 1.0, 0),  # before the open
        ("spy", "2024-01-03T14:30:00Z", 2.0, 1),
        ("spy", "2024-01-03T14:30:00Z", 3.0, 2),  # replaces the row above
        ("spy", "2024-01-03T20:59:00Z", 4.0, 3),
        ("spy", "2024-01-03T21:00:00Z", 5.0, 4),  # at the close
        ("spy", "2024-07-03T13:30:00Z", 6.0, 5),  # daylight saving time
    ]
    px = ", ".join(f"x as {c}" for c in ("open", "high", "low", "close", "vwap"))
    raw = spark.createDataFrame(rows, "symbol string, ts string, x double, seq int").selectExpr(
        "symbol", "ts", "seq", *[s.strip() for s in px.split(",")], "cast(10 as bigint) volume", "cast(1 as bigint) trade_count", "'y' as extra"
    )
    got = C.clean_bars(raw, MARKET).orderBy("ts").collect()
    assert [(r.symbol, r.minute, r.close) for r in got] == [("SPY", 0, 3.0), ("SPY", 389, 4.0), ("SPY", 0, 6.0)]
    assert "extra" not in got[0].asDict()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="close"):
        require_columns(spark.range(1), ["id", "close"])


def test_validate_bars_counts(spark):
    rows = [("A", 1, 1.0, 5), ("A", 1, 1.0, 5), ("A", 2, None, 0), ("B", 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, t int, close double, volume int").selectExpr(
        "symbol", "timestamp_seconds(t) ts", "1.0 open", "1.0 high", "1.0 low", "close", "volume"
    )
    got = {r.symbol: r for r in C.validate_bars(df).collect()}
    assert (got["A"].n_rows, got["A"].duplicate_timestamps, got["A"].null_close, got["A"].non_positive_volume_rows) == (3, 1, 1, 1)
    assert not got["A"].is_valid and got["B"].is_valid


def test_month_chunks_clip_and_empty(spark):
    df = spark.sql("select date '2024-01-15' s, date '2024-03-02' e, date '2023-01-01' z")
    got = df.select(S.month_chunks("s", "e").alias("c"), S.month_chunks("s", "z").alias("n")).first()
    assert [tuple(x) for x in got.c] == [
        (dt.date(2024, 1, 15), dt.date(2024, 1, 31)), (dt.date(2024, 2, 1), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 2)),
    ]
    assert got.n == []


def test_unknown_side_is_an_error(spark):
    with pytest.raises(Exception, match="side must be"):
        spark.sql("select 'hold' side").select(S.side_sign("side")).collect()


# --- session quality --------------------------------------------------------------------------


def quality(df, **kw):
    return Q.session_quality(df, MARKET, **kw).first()


def test_complete_session_is_exact(spark):
    q = quality(minute_bars(spark))
    assert q.minute_exact_full_session and q.token_valid_full_session and q.tca_window_exact
    assert (q.provider_gap_count, q.valid_token_count, q.invalid_token_reason) == (0, 26, "")
    assert q.token_observed_bar_counts == [15] * 26


def test_missing_minute_is_a_gap_but_tokens_stay_valid(spark):
    q = quality(minute_bars(spark, [i for i in range(390) if i != 200]))
    assert not q.minute_exact_full_session and q.token_valid_full_session and not q.tca_window_exact
    assert q.provider_gap_count == 1 and q.token_provider_gap_counts[200 // 15] == 1


def test_thin_and_dry_tokens_are_named(spark):
    df = minute_bars(spark, [i for i in range(390) if not 15 < i < 30], volume=F.expr("if(minute between 45 and 59, 0, volume)"))
    q = quality(df)
    assert q.invalid_token_reason == "token_01_observed_bars_lt_2;token_03_nonpositive_volume"
    assert q.valid_token_count == 24 and not q.token_valid_full_session


def test_structural_faults_clear_every_flag(spark):
    twice = minute_bars(spark).unionByName(minute_bars(spark, [7]))
    off = minute_bars(spark).unionByName(minute_bars(spark, [391, -3]))
    bad = minute_bars(spark, close=F.expr("if(minute = 5, 0, close)"))
    named = minute_bars(spark, symbol=F.expr("if(minute = 5, 'B', 'A')"))
    for df, why in ((twice, "duplicate_timestamp"), (off, "off_grid_minutes:2"), (bad, "nonpositive_price;invalid_ohlc"), (named, "multiple_symbols")):
        q = quality(df)
        assert q.invalid_token_reason == why
        assert not (q.minute_exact_full_session or q.token_valid_full_session or q.tca_window_exact)


def test_early_close_has_its_own_reason(spark):
    cal = spark.createDataFrame([(DAY, 210, True)], "session_date date, minutes int, early_close boolean")
    q = quality(minute_bars(spark, range(210)), calendar=cal)
    assert q.minute_exact_full_session and q.early_close and not q.token_valid_full_session
    assert q.invalid_token_reason == "early_close_not_primary_26_token_session" and q.token_observed_bar_counts == []


def test_tokens_of_a_session(spark):
    t = B.token_bars(minute_bars(spark), MARKET).orderBy("token").collect()
    assert len(t) == 26 and t[0].volume == sum(range(1, 16)) and t[0].open == pytest.approx(99.98) and t[0].close == pytest.approx(100.14)
    c = np.log([100 + i / 100 for i in range(15)])
    assert t[0].realized_volatility == pytest.approx(math.sqrt((np.diff(c) ** 2).sum()))


def test_tick_order_is_total(spark):
    rows = [("a", 1, 5, 10.0, 1), ("a", 1, 2, 20.0, 1), ("a", 0, -9, 30.0, 2), ("a", 0, 9, 40.0, 2)]
    df = spark.createDataFrame(rows, "g string, t int, seq bigint, price double, size int").withColumn("ts", F.timestamp_seconds("t"))
    r = B.ticks_to_bars(df, ["g"], ["ts", "seq"]).first()
    assert (r.open, r.close, r.high, r.low, r.volume, r.trade_count) == (30.0, 10.0, 40.0, 10.0, 6, 4)


# --- identity ---------------------------------------------------------------------------------


def test_split_factor_needs_both_clocks(spark):
    a = spark.createDataFrame(
        [("a", "2024-01-02", 5.0, "2024-01-01"), ("a", "2024-01-02", 7.0, "2024-01-03"), ("a", "2024-01-02", 2.0, "2024-01-09"), ("a", "2024-01-08", 3.0, "2024-01-01")],
        "instrument_id string, d string, factor double, k string",
    ).selectExpr("instrument_id", "date(d) effective_date", "factor", "cast(k as timestamp_ntz) available_at")
    s = spark.sql("select 'a' instrument_id, d session_date, cast(d as timestamp_ntz) observed_at, cast(d as timestamp_ntz) as_of from values (date '2024-01-03'), (date '2024-01-10'), (date '2024-01-01') t(d)")
    got = {r.session_date: r.split_factor for r in I.split_factor(s, a).collect()}
    assert got == {dt.date(2024, 1, 3): 35.0, dt.date(2024, 1, 10): 210.0, dt.date(2024, 1, 1): 1.0}
    adjusted = I.split_adjust(minute_bars(spark), spark.createDataFrame([("a", DAY, 4.0)], "instrument_id string, session_date date, split_factor double"))
    assert adjusted.where("not notional_preserved").count() == 0
    assert adjusted.where("minute = 3").first().volume == 16.0


def test_overlaps_across_months(spark):
    rows = [("a", "2024-01-30", "2024-02-10", "X"), ("a", "2024-02-05", "2024-02-20", "Y"), ("a", "2024-02-21", "2024-05-01", "Z"), ("a", "2024-04-30", "2024-06-01", "W")]
    iv = spark.createDataFrame(rows, "instrument_id string, start string, end string, symbol string").withColumns({c: F.to_date(c) for c in ("start", "end")})
    assert sorted(r.symbol for r in I.overlap_check(iv).collect()) == ["W", "Y"]


def test_same_day_renames_keep_the_last(spark):
    rows = [("7", "old", "2020-01-01", "2020-01-01"), ("7", "bbb", "2022-03-01", "2022-03-01 10:00:00"), ("7", "aaa", "2022-03-01", "2022-03-01 11:00:00")]
    h = spark.createDataFrame(rows, "cik string, symbol string, a string, c string").selectExpr(
        "cik", "symbol", "cast(a as timestamp_ntz) date_added", "cast(c as timestamp_ntz) created_at", "cast(null as timestamp_ntz) date_removed"
    )
    got = [(r.symbol, str(r.start), str(r.end)) for r in I.symbol_intervals(h, "2021-01-04", "2022-12-31").orderBy("start").collect()]
    assert got == [("OLD", "2021-01-04", "2022-02-28"), ("AAA", "2022-03-01", "2022-12-31")]


def test_complete_case_counts(spark):
    rows = [("x", 1, 2.0), ("y", 1, 1.0), ("x", 2, 2.0), ("y", 3, 5.0), ("z", 1, 9.0)]
    df = spark.createDataFrame(rows, "method string, case int, v double")
    cases = I.complete_case(df, baseline="x", candidate="y", value="v", identity=["case"])
    assert tuple(I.complete_case_counts(cases).first()) == (2, 2, 1, 1, 1, 0)


# --- ranking ----------------------------------------------------------------------------------


def test_positions_and_quantiles_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.choice([0.0, 1.0, rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    pdf = pd.DataFrame(rows, columns=["g", "v", "id"])
    got = R.row_numbers(df, ["g"], ["v", "id"]).toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount() + 1
    assert (got.sort_index() == want.set_axis(pdf.loc[want.index, "id"]).sort_index()).all()
    q = R.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.995}).toPandas().set_index("g").sort_index()
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.995)):
        np.testing.assert_allclose(q[name], pdf.groupby("g")["v"].quantile(p).sort_index(), rtol=1e-12)
    ranks = R.average_ranks(df, ["g"], "v", "r").toPandas()
    merged = pdf.assign(r=pdf.groupby("g")["v"].rank()).drop_duplicates(["g", "v"]).merge(ranks, on=["g", "v"], suffixes=("", "_s"))
    assert len(merged) == len(ranks) and (merged.r == merged.r_s).all()


def test_universe_needs_enough_members(spark):
    rows = [(f"i{i}", "X", U.COMMON, 10.0, 1.0, float(i // 2)) for i in range(1, 8)]
    c = spark.createDataFrame(rows, "instrument_id string, symbol string, security_type string, median_price double, session_completeness double, median_daily_dollar_volume double")
    top = U.select_universe(c, 5).orderBy("rank").collect()
    assert [r.instrument_id for r in top] == ["i6", "i7", "i4", "i5", "i2"]
    assert [r.liquidity_group for r in top] == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="too few universe members"):
        U.select_universe(c, 50).collect()


# --- forecasts --------------------------------------------------------------------------------


def matrix(spark, sessions):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), b, v) for i, s in enumerate(sessions) for b, v in enumerate(s) if v is not None]
    return spark.createDataFrame(rows, "instrument_id string, session_date date, bucket int, volume bigint")


def test_profile_mean_shares(spark):
    m = matrix(spark, [(1, 5), (1, 3), (9, 9)])
    got = P.profile_forecast(m, range(2)).where("session_date = date '2024-01-03'").orderBy("bucket").collect()
    share = (1 / 6 + 1 / 4) / 2
    assert got[0].share == pytest.approx(share) and got[0].expected_volume == pytest.approx(5 * share)
    assert got[0].history_sessions == 2 and got[0].short_history and got[0].cutoff == dt.date(2024, 1, 2)


def test_lookback_is_taken_before_empty_sessions_are_dropped(spark):
    m = matrix(spark, [(8, 2), (0, 0), (None, 4), (1, 1)])
    two = P.profile_forecast(m, range(2), lookback=2).where("session_date = date '2024-01-04'").orderBy("bucket").collect()
    assert two[0].share == pytest.approx(0.8) and two[0].history_sessions == 1
    one = P.profile_forecast(m, range(2), lookback=1).where("session_date = date '2024-01-04'")
    assert one.count() == 0


def test_profiles_match_a_loop(spark):
    rng = random.Random(1)
    sessions = [tuple(None if rng.random() < 0.06 else rng.choice([0, 3, 5, 8]) for _ in range(3)) for _ in range(40)]
    m = matrix(spark, sessions)
    for est in ("mean", "median", "previous", "ewma"):
        got = {(r.session_date, r.bucket): r.share for r in P.profile_forecast(m, range(3), estimator=est, lookback=6).collect()}
        want = {}
        for t, s in enumerate(sessions):
            if all(v is None for v in s):
                continue
            past = [np.array(x, float) for x in sessions[:t] if None not in x][-6:]
            past = [x / x.sum() for x in past if x.sum() > 0]
            if not past:
                continue
            if est == "mean":
                shape = np.mean(past, axis=0)
            elif est == "median":
                shape = np.median(past, axis=0)
            elif est == "previous":
                shape = past[-1]
            else:
                w = 0.75 ** np.arange(len(past) - 1, -1, -1)
                shape = np.average(past, axis=0, weights=w)
            for b, v in enumerate(shape / shape.sum()):
                want[(dt.date(2024, 1, 1) + dt.timedelta(days=t), b)] = v
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


# --- execution --------------------------------------------------------------------------------


def loop_remainder(values, caps, target, tol=1e-7):
    c = [min(max(v, 0.0), k) for v, k in zip(values, caps)]
    out = [min(math.floor(x + tol), k) for x, k in zip(c, caps)]
    left = target - sum(out)
    for i in sorted(range(len(c)), key=lambda i: (-(c[i] - math.floor(c[i])), i)):
        if left and out[i] < caps[i]:
            out[i] += 1
            left -= 1
    for i in range(len(c)):
        add = min(caps[i] - out[i], left)
        out[i] += add
        left -= add
    return out


def test_largest_remainder_matches_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for o in range(300):
        n = rng.randint(1, 9)
        caps = [rng.randint(0, 12) for _ in range(n)]
        target = rng.randint(0, sum(caps))
        raw = [rng.random() * k for k in caps]
        scale = min(1.0, target / sum(raw)) if sum(raw) else 0.0
        values = [round(v * scale, rng.choice([0, 1, 6])) for v in raw]
        values = [min(v, k) for v, k in zip(values, caps)]
        if sum(math.floor(v + 1e-7) for v in values) > target:
            continue
        want[o] = loop_remainder(values, caps, target)
        rows += [(o, i, v, k, target) for i, (v, k) in enumerate(zip(values, caps))]
    df = spark.createDataFrame(rows, "order_id int, k int, v double, cap bigint, q bigint")
    got = X.largest_remainder(df, value="v", capacity="cap", target="q").toPandas().sort_values(["order_id", "k"])
    assert {o: g["planned"].tolist() for o, g in got.groupby("order_id")} == want


def order_table(spark, volumes, quantity=100, side="buy"):
    rows = [(1, side, quantity, i, i, len(volumes), v, 10.0 + i, 10.0, sum(volumes), 10.5) for i, v in enumerate(volumes)]
    return spark.createDataFrame(
        rows,
        "order_id int, side string, quantity bigint, k int, minute int, n int, volume bigint, reference_price double, arrival_price double, window_volume bigint, session_vwap double",
    )


def test_pov_fills_match_a_loop(spark):
    rng = random.Random(8)
    volumes = [rng.randint(0, 400) for _ in range(30)]
    got = [r.executed for r in X.pov_fills(order_table(spark, volumes, 250), 0.08, 0.1).orderBy("minute").collect()]
    left, want = 250, []
    for v in volumes:
        fill = min(math.floor(0.08 * v), left, math.floor(0.1 * v))
        left -= fill
        want.append(fill)
    assert got == want


def test_twap_remainder_goes_first(spark):
    got = [r.planned for r in X.twap_schedule(order_table(spark, [9] * 7)).orderBy("k").collect()]
    assert got == [15, 15, 14, 14, 14, 14, 14]


def test_risk_neutral_trajectory_is_even_and_risk_averse_front_loads(spark):
    t = order_table(spark, [9] * 4)
    plan = lambda risk: [r.planned for r in X.almgren_chriss_schedule(t, eta=F.lit(1e-6), volatility=F.lit(0.01), risk_aversion=F.lit(risk)).orderBy("k").collect()]
    assert plan(0.0) == [25, 25, 25, 25]
    averse = plan(0.05)
    assert sum(averse) == 100 and averse == sorted(averse, reverse=True) and averse[0] > averse[-1]


@pytest.mark.parametrize("side", ["buy", "sell"])
def test_costs_reconcile(spark, side):
    fills = X.static_fills(X.twap_schedule(order_table(spark, [100, 400, 0, 900], 100, side)), 0.1)
    log = X.execution_log(X.fill_cost(fills, half_spread=F.lit(0.02), impact=F.lit(0.5)))
    s = X.tca_summary(log).first()
    assert s.filled == 10 + 25 + 0 + 25 and s.unfilled == 40
    assert s.residual == pytest.approx(0.0, abs=1e-9)
    sign = 1 if side == "buy" else -1
    assert s.opportunity_cost == pytest.approx(sign * 40 * 3.0)
    row = log.where("minute = 0").first()
    assert row.impact_per_share == pytest.approx(0.5 * 10 / 100) and row.execution_price == pytest.approx(10 + sign * (0.02 + 0.05))


def test_nothing_filled_has_no_price(spark):
    fills = X.static_fills(X.twap_schedule(order_table(spark, [1, 1])), 0.1)
    s = X.tca_summary(X.execution_log(X.fill_cost(fills, half_spread=F.lit(0.02), impact=F.lit(0.5)))).first()
    assert s.filled == 0 and s.average_price is None and s.implementation_shortfall is None and s.shortfall_bps is None


def test_window_of_a_crowded_session(spark):
    orders = spark.range(500).selectExpr("id order_id", "'a' instrument_id", "date '2024-01-03' session_date", "'buy' side", "10L quantity", "5 start_minute", "8 end_minute")
    b = X.prepare_window(orders, minute_bars(spark))
    assert b.count() == 1500
    r = b.where("order_id = 7").orderBy("k").collect()
    assert [(x.k, x.minute, x.n, x.window_volume) for x in r] == [(0, 5, 3, 21), (1, 6, 3, 21), (2, 7, 3, 21)]
    copied = X.prepare_window(orders, minute_bars(spark), hot=60)
    assert sorted(map(tuple, copied.collect())) == sorted(map(tuple, b.collect()))
    twice = X.prepare_window(orders, minute_bars(spark).unionByName(minute_bars(spark, [5]))).select("status").distinct().collect()
    assert [r.status for r in twice] == ["duplicate_minutes"]


def test_every_order_keeps_a_status(spark):
    rows = [(1, "a", 5, 8), (2, "none", 5, 8), (3, "a", 900, 950), (4, "a", 20, 25)]
    orders = spark.createDataFrame(rows, "order_id long, instrument_id string, start_minute int, end_minute int").selectExpr(
        "*", "date '2024-01-03' session_date", "'buy' side", "100L quantity"
    )
    bars = minute_bars(spark)
    bars = bars.withColumn("close", F.when(F.col("minute") == 22, -1.0).otherwise(F.col("close")))
    b = X.prepare_window(orders, bars).withColumn("share", F.when(F.col("minute") > 900, 1.0))
    status = lambda df: {r.order_id: r.status for r in df.select("order_id", "status").distinct().collect()}
    bad = {2: "no_session", 3: "empty_window", 4: "bad_bars"}
    assert status(b) == {1: "ok", **bad}
    assert status(X.vwap_schedule(b)) == {1: "no_forecast", **bad}
    tight = X.largest_remainder(b.withColumn("cap", F.lit(1)).withColumn("want", F.lit(1.0)), value="want", capacity="cap", target="quantity")
    assert status(tight)[1] == "infeasible" and tight.where("planned is not null").count() == 0
    for schedule in (X.twap_schedule(b), X.vwap_schedule(b)):
        s = X.tca_summary(X.execution_log(X.fill_cost(X.static_fills(schedule), half_spread=F.lit(0.02), impact=F.lit(0.5)))).collect()
        assert len(s) == 4 and all(r.filled == 0 and r.buckets == 0 and r.unfilled == 100 for r in s if r.order_id > 1)


def test_null_groups_keep_their_quantiles(spark):
    from barlens.operators.ranking import exact_quantiles, row_numbers

    rows = [(None, float(i)) for i in range(90)] + [("b", 1.0), ("b", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert {r.g: r.m for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()} == {None: 44.5, "b": 2.0}
    assert row_numbers(df, ["g"], ["x"]).where("g is null").count() == 90


def test_a_missing_measure_leaves_other_pairs_alone(spark):
    from barlens.operators.universe import correlations

    rows = [(float(i), float(i * i), None if i == 3 else float(-i)) for i in range(10)]
    got = {r.measure: r for r in correlations(spark.createDataFrame(rows, "t double, a double, b double"), ["t"], ["a", "b"]).collect()}
    assert got["a"].spearman == pytest.approx(1.0) and got["b"].pearson == pytest.approx(-1.0) and 0.95 < got["a"].pearson < 0.97


def test_correlations_derive_their_rows_once(spark):
    from barlens.operators.universe import correlations

    seen, df = spark.sparkContext.accumulator(0), spark.range(500).selectExpr("double(id) t", "double(id % 7) a", "-double(id) b")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {r.measure: r for r in correlations(df.mapInArrow(counted, df.schema), ["t"], ["a", "b"]).collect()}
    assert got["b"].spearman == pytest.approx(-1.0) and abs(got["a"].spearman) < 0.1 and seen.value == 500


def test_symbols_match_in_any_spelling(spark, tmp_path):
    from barlens.sources.readers import scan_bars

    rows = [("Click", 1), ("CLICK", 2), ("click", 3), ("clack", 4), ("zeta", 5)]
    spark.createDataFrame(rows, "symbol string, volume long").write.parquet(str(tmp_path / "b"))
    assert sorted(r.volume for r in scan_bars(spark, str(tmp_path / "b"), symbols=["cLick"]).collect()) == [1, 2, 3]


def test_first_emitted_session_knows_the_close_before(spark):
    from barlens.operators.history import seasonal_ewma

    t = spark.range(12).selectExpr(
        "'a' instrument_id", "date_add(date '2024-01-01', cast(id div 4 as int)) session_date", "cast(id % 4 as int) token",
        "id + 1 volume", "1.0 * id close", "1.0D dollar_volume", "1L trade_count",
    )
    got = seasonal_ewma(t, token_count=4).where("token = 0").orderBy("session_date").collect()
    assert [float(r.previous_close) for r in got] == [3.0, 7.0]


# --- datasets ---------------------------------------------------------------------------------


def dates_table(spark, n):
    return spark.range(n).selectExpr("date_add(date '2024-01-01', cast(id as int)) session_date")


def test_walk_forward_is_disjoint_and_chronological(spark):
    w = D.walk_forward(dates_table(spark, 30), train=10, validation=5, test=5, step=5, embargo=1).toPandas()
    assert sorted(w.fold_id.unique()) == ["fold-001", "fold-002"]
    for _, f in w.groupby("fold_id"):
        d = {p: g.session_date for p, g in f.groupby("partition")}
        assert max(d["train"]) < min(d["validation"]) and max(d["validation"]) < min(d["test"])
        assert (min(d["validation"]) - max(d["train"])).days == 2
    with pytest.raises(Exception, match="too few session dates"):
        D.walk_forward(dates_table(spark, 5), train=10, validation=5, test=5, step=5).collect()


def test_samples_and_context(spark):
    s = spark.createDataFrame([("s", "fold-1", "train", "2024-01-02", 26)], "session_id string, fold_id string, partition string, cutoff string, valid_count int")
    x = D.sample_index(s)
    assert x.count() == 22
    first = x.where("as_of_token = 4").first()
    want = hashlib.sha256(b"s|fold-1|train|4|2024-01-02").hexdigest()[:20]
    assert first.sample_id == want and first.target_indices == [4, 5, 7, 11] and first.context_start == 0
    last = x.where("as_of_token = 25").first()
    assert last.target_mask == [True, False, False, False]
    t = spark.range(26).selectExpr("'s' session_id", "cast(id as int) token", "double(id + 1) f")
    w = D.context_window(x, D.session_arrays(t, ["f"]), ["f"]).where("as_of_token = 5").first()
    assert [v[0] for v in w.context] == [0, 0, 0, 1, 2, 3, 4, 5] and w.context_mask == [False] * 3 + [True] * 5
    o = D.shape_origins(x).toPandas()
    assert len(o) == 4 and (o.inclusion_probability.round(6).tolist() == [round(1 / 6, 6), round(1 / 6, 6), 0.2, 0.2] or len(set(o.band)) == 4)


def test_static_rows_use_only_the_past(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=d), b, 10.0, 11.0, 9.0, 10.0 + d, 100 + d, 5) for d in range(4) for b in range(3)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, bucket int, open double, high double, low double, close double, volume bigint, trade_count bigint")
    s = D.static_dataset(df, 60).toPandas()
    assert len(s) == 9 and (s.available_at < s.as_of).all() and (s.target_at >= s.as_of).all()
    third = s[s.session_date == dt.date(2024, 1, 3)].iloc[0]
    assert third.rolling_adv == pytest.approx((300 + 303) / 2) and third.rolling_volatility == 0.0
    d = D.dynamic_dataset(df, 60).toPandas()
    assert len(d) == 3 * 3 and d.target_conditional_share.groupby(d.sample_id).sum().round(9).eq(1.0).all()
    assert (d.available_at < d.as_of).all()


def test_normaliser_clips_to_train(spark):
    train = spark.range(1001).selectExpr("double(id) x")
    fitted = D.fit_normalizer(train, ["x"])
    got = [r.x for r in D.robust_normalize(spark.createDataFrame([(500.0,), (1e9,), (None,)], "x double"), fitted, ["x"]).collect()]
    assert got == pytest.approx([0.0, (995 - 500) / 500, 0.0])


def test_ewma_matches_adjusted_weights(spark):
    xs = [4.0, 1.0, 7.0]
    w = [(19 / 21) ** i for i in (2, 1, 0)]
    got = spark.createDataFrame([(xs,)], "x array<double>").select(H.ewma_of(F.col("x"), 19 / 21)).first()[0]
    assert got == pytest.approx(sum(a * b for a, b in zip(xs, w)) / sum(w))


# --- evaluation -------------------------------------------------------------------------------


def test_paired_differences(spark):
    rows = [("twap", i, v) for i, v in enumerate([10.0, 10.0, 10.0])] + [("vwap", i, v) for i, v in enumerate([8.0, 8.0, 11.0])]
    df = spark.createDataFrame(rows, "strategy string, case int, v double")
    p = E.paired_differences(I.pair_strategies(df, baseline="twap", pair=["case"], value="v")).first()
    assert p.mean_difference == -1.0 and p.win_rate == pytest.approx(2 / 3) and p.median_difference == -2.0


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.9)], "family string, hypothesis string, p_value double")
    got = {r.hypothesis: r.adjusted_p for r in H.holm(df).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})


def test_block_bootstrap_matches_a_loop(spark):
    rng = random.Random(2)
    folds = {"a": [rng.gauss(0, 1) for _ in range(7)], "b": [rng.gauss(1, 1) for _ in range(3)]}
    rows = [(f, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for f, vs in folds.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "fold_id string, date date, difference double")
    got = E.block_bootstrap(df, blocks=(5,), repetitions=50, seed=13).first()
    means = []
    for r in range(50):
        sample = []
        for f, vs in folds.items():
            w, mine, j = min(5, len(vs)), [], 0
            while len(mine) < len(vs):
                h = int(hashlib.sha256(f"{f}|5|13|{r}|{j}".encode()).hexdigest()[:15], 16) % (len(vs) - w + 1)
                mine += vs[h : h + w]
                j += 1
            sample += mine[: len(vs)]
        means.append(np.mean(sample))
    assert got.ci_lower == pytest.approx(np.quantile(means, 0.025)) and got.ci_upper == pytest.approx(np.quantile(means, 0.975))
    every = [v for vs in folds.values() for v in vs]
    assert got.standardized_effect == pytest.approx(np.mean(every) / np.std(every, ddof=1))


def test_strict_and_inclusive_thresholds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    fitted = E.thresholds(df, ["x"])
    assert fitted.first().x == 9.0
    assert E.label_regimes(df, fitted, {"x": "high"}).where("high").count() == 2
    assert E.unusual_sessions(df, fitted, ["x"]).where("unusual_session").count() == 1


def test_difficulty_weights_have_mean_one(spark):
    rng = random.Random(4)
    rows = [(str(i), i % 3, rng.random(), rng.choice([0.0, 1.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, s int, level_error double, shape_error double")
    t = E.difficulty_table(df, "s", "k")
    assert t.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


# --- latent and models ------------------------------------------------------------------------


def test_rank_and_ridge_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    y = x @ rng.normal(size=(5, 2)) + rng.normal(size=(200, 2)) * 0.1 + 4
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "embedding array<double>, t array<double>").repartition(4)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    p = s / s.sum()
    assert L.effective_rank(df).first().effective_rank == pytest.approx(np.exp(-(p * np.log(p + 1e-12)).sum()), rel=1e-6)
    slope, intercept = L.ridge_solve(L.gram(df, "embedding", "t"), 5, [2.0])[2.0]
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(5), xc.T @ yc)
    np.testing.assert_allclose(slope, want, rtol=1e-8)
    np.testing.assert_allclose(intercept, y.mean(0) - x.mean(0) @ want, rtol=1e-8)


def test_sparse_gate_reports_rules(spark):
    rows = [([1.0, 0.0, 0.0, 0.0],), ([0.0, 2.0, 0.0, 0.0],)]
    d = L.latent_diagnostics(spark.createDataFrame(rows, "embedding array<double>"))
    r = d.first()
    assert r.zero_fraction == 0.75 and r.dead_dimension_fraction == 0.5 and r.mean_hoyer_sparsity == pytest.approx(1.0)
    assert L.sparse_gate(d).first().failures == ["too_few_active_dimensions", "too_many_dead_dimensions"]


def test_boosting_beats_the_mean_on_a_planted_signal(spark):
    df = spark.range(400).selectExpr("double(id % 20) x", "double(id % 7) z").withColumn("y", F.when(F.col("x") > 9, 5.0).otherwise(0.0) + F.col("z") * 0.01)
    df = df.withColumn("x", F.when(F.col("z") == 3, None).otherwise(F.col("x")))
    p = M.regression_pipeline("gbt", ["x", "z"], "y", iterations=5).fit(df).transform(df)
    rmse = E.regression_metrics(p, [], "y", "prediction").first().rmse
    assert rmse < 0.7 * df.agg(F.stddev_pop("y")).first()[0]


def test_vocabulary_is_frozen(spark):
    train = spark.createDataFrame([("b",), ("a",)], "s string")
    m = M.frozen_vocabulary(train, "s", "i")
    assert {r.s: r.i for r in m.transform(train).collect()} == {"a": 0.0, "b": 1.0}
    with pytest.raises(Exception):
        m.transform(spark.createDataFrame([("c",)], "s string")).collect()
