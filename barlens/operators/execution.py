"""Order schedules, fills and cost attribution for many orders at once.

A table of order buckets (one row per order and bucket) flows through
``schedule -> fills -> cost -> log -> summary``. An order has at most one
session of buckets, so every window over an order is bounded.

Schedules, fills, costs and logs also take packed orders (:func:`packed_window`):
one row per order whose ``buckets`` array holds its buckets. Nothing is then
sorted or shuffled by order; :func:`unpack` gives a row per bucket at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.scalar import is_finite, reference_price, side_sign, slippage_bps

ORDER = ("order_id",)
#: The array column of packed orders.
BUCKETS = "buckets"
At = Callable[[str], Column]


def unpack(packed: DataFrame) -> DataFrame:
    """A row per bucket of packed orders, one without a bucket for an order that has none."""
    return packed.select(*(c for c in packed.columns if c != BUCKETS), F.inline_outer(BUCKETS))


def _pack(rows: DataFrame, keys: Sequence[str], index: str, carry: Sequence[str]) -> DataFrame:
    """Bucket rows as one row per order with the columns of ``carry`` beside its buckets."""
    inner = [c for c in rows.columns if c not in keys]
    order = lambda a, b: F.when(a[index] < b[index], -1).when(a[index] > b[index], 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*inner)), order).alias(BUCKETS), *(F.first(c).alias(f"_of_{c}") for c in carry))


def add_columns(orders: DataFrame, columns: dict[str, Callable[[At], Column]]) -> DataFrame:
    """Add bucket columns, each a function of ``at(name)``: of bucket rows, or of the buckets of packed orders."""
    if BUCKETS not in orders.columns:
        return orders.withColumns({n: f(F.col) for n, f in columns.items()})
    names = orders.schema[BUCKETS].dataType.elementType.names

    def widened(b: Column) -> Column:
        at = lambda n: b[n] if n in names else F.col(n)
        return reduce(lambda x, f: x.withField(f[0], f[1](at)), columns.items(), b)

    return orders.withColumn(BUCKETS, F.transform(BUCKETS, widened))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(items: Column, of: Callable[[Column], Column], zero: Column) -> Column:
    return F.aggregate(items, zero, lambda a, x: a + F.coalesce(of(x), zero))


def _running(items: Column, of: Callable[[Column], Column], zero: Column, kind: str) -> Column:
    """Running sums of an array, each including its own element."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("all"), zero.alias("last"))
    step = lambda a, x: _let(a["last"] + F.coalesce(of(x), zero), lambda t: F.struct(F.array_append(a["all"], t).alias("all"), t.alias("last")))
    return F.aggregate(items, start, step, lambda a: a["all"])


def prepare_window(orders: DataFrame, bars: DataFrame, *, hot: int = 50_000, extra: Sequence[str] = ()) -> DataFrame:
    """Order buckets as rows, see :func:`packed_window`."""
    w = packed_window(orders, bars, hot=hot, extra=extra)
    fields = [F.col(c) for c in ("k", "minute", "volume", "reference_price", "open", "close", *extra)]
    return unpack(w).select(*(c for c in w.columns if c != BUCKETS), *fields)


def packed_window(orders: DataFrame, bars: DataFrame, *, hot: int = 50_000, extra: Sequence[str] = ()) -> DataFrame:
    """Packed orders: the bars of the order's session inside its window, and a ``status`` for every order.

    An order that cannot be run keeps one row without a bucket (``k``,
    ``minute`` and the bar are NULL, ``n`` is 0) whose status says why:
    ``no_session``, ``duplicate_minutes`` (of the session), ``empty_window`` or
    ``bad_bars`` (a price that is not positive and finite, or a negative volume,
    inside the window). No bar is left out of a window.

    A session's bars are packed into one row, so an order meets one row instead
    of its bars, and everything that depends on the window alone is computed
    inside the row. Only a session with more than ``hot`` orders is copied, once
    per ``hot`` orders, so that it is spread over tasks. Where the packed
    sessions are small Spark broadcasts them after checking their size.

    ``extra`` names columns of the bars that go along, such as a forecast.
    """
    usable = F.coalesce(F.col("volume") >= 0, F.lit(False))
    for c in ("open", "high", "low", "close"):
        usable = usable & F.coalesce(is_finite(c) & (F.col(c) > 0), F.lit(False))
    key = ["instrument_id", "session_date"]
    bar = F.struct("minute", "volume", "reference_price", "open", "close", "_usable", *extra)
    good = lambda c: F.when(F.col("_usable"), c)
    sessions = (
        bars.withColumns({"reference_price": reference_price(), "_usable": usable})
        .groupBy(*key)
        .agg(
            F.sort_array(F.collect_list(bar)).alias("_bars"),
            F.try_divide(F.sum(good(F.col("reference_price") * F.col("volume"))), F.sum(good(F.col("volume")))).alias("session_vwap"),
            F.sum(good(F.col("volume"))).alias("session_volume"),
            F.count_distinct("minute").alias("_minutes"),
        )
    )
    busy = orders.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / hot).alias("_copies")).where("_copies > 1")
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    salted = sessions.join(busy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("_copies")
    # narrow rows are spread before the work on their buckets, however few pieces the input has
    keyed = orders.repartition("order_id").join(busy, key, "left").withColumn("_salt", F.pmod(F.xxhash64("order_id"), copies)).drop("_copies")
    mine = F.filter(
        "_bars", lambda x: (x["minute"] >= F.col("start_minute")) & (x["minute"] < F.col("end_minute"))
    )
    j = keyed.join(salted, [*key, "_salt"], "left").withColumn("_mine", mine)
    status = (
        F.when(F.col("_bars").isNull(), "no_session")
        .when(F.size("_bars") != F.col("_minutes"), "duplicate_minutes")
        .when(F.size("_mine") == 0, "empty_window")
        .when(F.exists("_mine", lambda x: ~x["_usable"]), "bad_bars")
        .otherwise("ok")
    )
    j = j.withColumn("status", status).withColumn("_bars", F.when(F.col("status") == "ok", F.col("_mine")))
    j = j.withColumns(
        {
            "n": F.when(F.col("status") == "ok", F.size("_bars")).otherwise(0),
            "arrival_price": F.get("_bars", F.lit(0))["reference_price"],
            "window_volume": F.aggregate("_bars", F.lit(0).cast("bigint"), lambda a, x: a + x["volume"].cast("bigint")),
        }
    )
    keep = [*orders.columns, "session_vwap", "session_volume", "n", "arrival_price", "window_volume", "status"]
    names = ("minute", "volume", "reference_price", "open", "close", *extra)
    buckets = F.transform("_bars", lambda b, i: F.struct(i.alias("k"), *(b[c].alias(c) for c in names)))
    # an order without buckets has one whose fields are NULL
    none = F.array(F.struct(*(F.get(BUCKETS, F.lit(0))[c].alias(c) for c in ("k", *names))))
    return j.select(*keep, buckets.alias(BUCKETS)).withColumn(BUCKETS, F.coalesce(BUCKETS, none))


def _status(df: DataFrame, problem: Column, name: str) -> DataFrame:
    """Note a problem of an order that had none so far."""
    old = F.col("status") if "status" in df.columns else F.lit("ok")
    return df.withColumn("status", F.when((old == "ok") & problem, name).otherwise(old))


def twap_schedule(buckets: DataFrame) -> DataFrame:
    """Even split, the remainder one share each to the first buckets."""
    plan = lambda at: F.when(at("n") > 0, F.floor(at("quantity") / at("n")) + (at("k") < at("quantity") % at("n")).cast("bigint"))
    return add_columns(buckets, {"planned": plan})


def _rounded(buckets: Column, value: Callable[[Column], Column], capacity: Callable[[Column], Column], target: Column, tolerance: float) -> Column:
    """``planned`` per bucket of one order, and whether the order is ``infeasible``; see :func:`largest_remainder`."""
    zero = F.lit(0).cast("bigint")

    def part(b: Column, i: Column) -> Column:
        cap = capacity(b).cast("bigint")
        clipped = F.greatest(F.lit(0.0), F.least(value(b), cap.cast("double")))

        def split(c: Column) -> Column:
            base = F.least(F.floor(c + tolerance), cap).cast("bigint")
            turn = F.struct(F.when(base < cap, 0).otherwise(1).alias("full"), (F.lit(0.0) - (c - F.floor(c))).alias("fraction"), i.alias("i"))
            return F.struct(base.alias("base"), cap.alias("cap"), turn.alias("turn"), value(b).isNotNull().alias("known"))

        return _let(clipped, split)

    def plan(parts: Column) -> Column:
        left = target - _total(parts, lambda p: p["base"], zero)
        known = (F.size(parts) > 0) & F.forall(parts, lambda p: p["known"])
        fits = _total(parts, lambda p: p["cap"], zero) >= target
        facts = _let(left, lambda n: F.struct(
            F.when(n > 0, F.get(F.array_sort(F.transform(parts, lambda p: p["turn"])), (F.least(n, F.size(parts)) - 1).cast("int"))).alias("last"),
            known.alias("known"), fits.alias("fits"),
        ))
        return _let(facts, lambda f: F.struct(
            _let(F.transform(parts, lambda p: one_more(p, f["last"])), lambda steps: F.transform(full(parts, steps), lambda x: F.when(f["known"] & f["fits"], x))).alias("planned"),
            (f["known"] & ~f["fits"]).alias("infeasible"),
        ))

    def one_more(p: Column, last: Column) -> Column:
        return p["base"] + F.when((p["base"] < p["cap"]) & (p["turn"] <= last), 1).otherwise(0)

    def full(parts: Column, steps: Column) -> Column:
        room = F.zip_with(parts, steps, lambda p, x: F.coalesce(p["cap"] - x, zero))

        def filled(rest: Column) -> Column:
            before = _running(room, lambda r: r, zero, "bigint")
            more = _let(room, lambda free: F.zip_with(before, free, lambda upto, r: F.greatest(zero, F.least(r, rest - upto + r))))
            return F.when(rest > 0, F.zip_with(steps, more, lambda x, m: x + m)).otherwise(steps)

        return _let(target - _total(steps, lambda x: x, zero), filled)

    return _let(F.transform(buckets, part), plan)


def largest_remainder(
    df: DataFrame,
    *,
    keys: Sequence[str] = ORDER,
    value: str | Callable[[At], Column],
    capacity: str | Callable[[At], Column],
    target: str,
    index: str = "k",
    tolerance: float = 1e-7,
    name: str = "planned",
) -> DataFrame:
    """Integers near ``value`` that sum to ``target`` under per-bucket capacities.

    Floors first; then one unit each to the largest fractions that still have
    room; then leftovers in index order through a running sum of free room.
    Where the capacities do not hold the target, or a value is missing, the
    plan is NULL, and the order's ``status`` is ``infeasible`` in the first case.

    ``value`` and ``capacity`` are columns or functions of ``at(name)``.
    An order is rounded inside its row of packed buckets. Bucket rows are
    packed and unpacked for it, which groups them by ``keys`` once.
    """
    if BUCKETS in df.columns:
        names = df.schema[BUCKETS].dataType.elementType.names
        done = df.withColumn("_plan", _rounded(F.col(BUCKETS), _of(value, names), _of(capacity, names), F.col(target), tolerance))
        done = _status(done, F.coalesce(F.col("_plan.infeasible"), F.lit(False)), "infeasible")
        return done.withColumn(BUCKETS, F.zip_with(BUCKETS, "_plan.planned", lambda b, p: b.withField(name, p))).drop("_plan")
    kept = [c for c in df.columns if c != name]
    packed = _pack(df.select(*kept), keys, index, [target])
    done = packed.withColumn("_plan", _rounded(F.col(BUCKETS), _of(value, kept, keys), _of(capacity, kept, keys), F.col(f"_of_{target}"), tolerance))
    rows = done.select(*keys, F.col("_plan.infeasible").alias("_infeasible"), F.inline(F.zip_with(BUCKETS, "_plan.planned", lambda b, p: b.withField(name, p))))
    out = _status(rows, F.col("_infeasible"), "infeasible")
    return out.select(*kept, name, *(["status"] if "status" not in kept else []))


def _of(column: str | Callable[[At], Column], names: Sequence[str], outside: Sequence[str] = ()) -> Callable[[Column], Column]:
    """A column of a bucket: its own field, or one of its order."""
    at = lambda b: lambda n: b[n] if n in names and n not in outside else F.col(n)
    return lambda b: at(b)(column) if isinstance(column, str) else column(at(b))


def _plan_by_shares(buckets: DataFrame, share: str) -> DataFrame:
    """Largest-remainder plan; ``planned`` is NULL where the shares have no mass."""
    positive = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    if BUCKETS in buckets.columns:
        mass = _total(F.col(BUCKETS), lambda b: positive(b[share]), F.lit(0.0))
    else:
        mass = F.sum(positive(F.col(share))).over(Window.partitionBy(*ORDER))
    want = lambda at: F.when(at("_mass") > 0, at("quantity") * positive(at(share)) / at("_mass"))
    planned = largest_remainder(buckets.withColumn("_mass", mass), value=want, capacity=lambda at: at("quantity"), target="quantity")
    return _status(planned, ~(F.coalesce("_mass", F.lit(0.0)) > 0), "no_forecast").drop("_mass")


def vwap_schedule(buckets: DataFrame, share: str = "share") -> DataFrame:
    """Order quantity in proportion to forecast shares, rounded by largest remainder.

    The shares are those of the order's own buckets; an order without positive
    shares keeps its rows without a plan, with status ``no_forecast``.
    """
    return _plan_by_shares(buckets, share)


def oracle_vwap_schedule(buckets: DataFrame, *, allow_evaluation_only: bool = False) -> DataFrame:
    """VWAP on realised volume: hindsight, so it must be asked for."""
    if not allow_evaluation_only:
        raise ValueError("the realised-volume schedule is evaluation-only; pass allow_evaluation_only=True")
    shares = add_columns(buckets, {"_share": lambda at: F.try_divide(at("volume"), at("window_volume"))})
    planned = vwap_schedule(shares, "_share")
    if BUCKETS in planned.columns:
        planned = planned.withColumn(BUCKETS, F.transform(BUCKETS, lambda b: b.dropFields("_share")))
    return planned.drop("_share").withColumn("evaluation_only", F.lit(True))


def almgren_chriss_schedule(buckets: DataFrame, *, eta: Column, volatility: Column, risk_aversion: Column) -> DataFrame:
    """Closed-form constant-parameter trajectory, rounded with tolerance 1e-5."""
    ratio = risk_aversion * volatility * volatility / (2.0 * eta)
    b = buckets.withColumns({"_ratio": ratio, "_kappa": F.acosh(F.lit(1.0) + ratio)})

    def want(at: At) -> Column:
        q, n, k, kap = at("quantity").cast("double"), at("n"), at("k"), at("_kappa")

        def inventory(j: Column) -> Column:
            held = q * F.exp(-kap * j) * (-F.expm1(-2.0 * kap * (n - j))) / (-F.expm1(-2.0 * kap * n))
            return F.when(j == n, F.lit(0.0)).otherwise(held)

        return F.when(n > 0, F.when(at("_ratio") <= 1e-14, q / n).otherwise(inventory(k) - inventory(k + 1)))

    planned = largest_remainder(b, value=want, capacity=lambda at: at("quantity"), target="quantity", tolerance=1e-5)
    return planned.drop("_ratio", "_kappa")


def static_fills(schedule: DataFrame, hard_rate: float | Column = 0.1) -> DataFrame:
    """Fills of a fixed plan: the plan or the participation cap, whichever is less; nothing without a plan."""
    cap = lambda at: F.greatest(F.lit(0), F.floor(_rate(hard_rate) * at("volume")))
    done = lambda at: F.when(at("planned").isNull(), F.lit(0).cast("bigint")).otherwise(F.least(at("planned"), cap(at)))
    return add_columns(schedule, {"capacity": cap, "executed": done})


def pov_fills(buckets: DataFrame, rate: float | Column = 0.05, hard_rate: float | Column = 0.1) -> DataFrame:
    """Participation fills: cumulative fills are the running ask cut at the quantity."""
    cap = F.greatest(F.lit(0), F.floor(_rate(hard_rate) * F.col("volume")))
    ask = F.floor(_rate(rate) * F.col("volume"))
    by = Window.partitionBy(*ORDER).orderBy("minute")
    b = buckets.withColumns({"capacity": cap, "_a": F.least(ask, cap)})
    b = b.withColumn("_cum", F.least(F.col("quantity"), F.sum("_a").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    before = F.coalesce(F.lag("_cum").over(by), F.lit(0))
    return b.withColumns(
        {"planned": F.when(ask.isNotNull(), F.least(ask, F.col("quantity") - before)), "executed": F.col("_cum") - before}
    ).drop("_a", "_cum")


def _rate(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fill_cost(fills: DataFrame, *, half_spread: Column, impact: Column, epsilon: float = 1.0) -> DataFrame:
    """Half spread plus temporary impact linear in participation."""
    per_share = lambda at: impact * at("executed") / F.greatest(at("volume").cast("double"), F.lit(epsilon))
    price = lambda at: at("reference_price") + side_sign("side") * (half_spread + per_share(at))
    return add_columns(
        fills,
        {
            "half_spread": lambda at: half_spread,
            "impact_per_share": per_share,
            "execution_price": price,
            "spread_cost": lambda at: half_spread * at("executed"),
            "impact_cost": lambda at: per_share(at) * at("executed"),
        },
    )


def execution_log(costed: DataFrame, forecast: str | None = None, keys: Sequence[str] = ORDER) -> DataFrame:
    """Running inventory, cost and forecast comparison of each order bucket, a row per bucket."""
    cost = lambda at: at("spread_cost") + at("impact_cost")
    if BUCKETS in costed.columns:
        field = lambda b: lambda n: b[n]
        done = _running(F.col(BUCKETS), lambda b: b["executed"], F.lit(0).cast("bigint"), "bigint")
        paid = _running(F.col(BUCKETS), lambda b: cost(field(b)), F.lit(0.0), "double")
        sums = F.arrays_zip(done.alias("_done"), paid.alias("_paid"))
        both = lambda b, x: b.withField("cumulative_executed", x["_done"]).withField("cumulative_cost", x["_paid"])
        log = unpack(costed.withColumn(BUCKETS, F.zip_with(BUCKETS, sums, both)))
    else:
        run = Window.partitionBy(*keys).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
        log = costed.withColumns({"cumulative_executed": F.sum("executed").over(run), "cumulative_cost": F.sum(cost(F.col)).over(run)})
    share = lambda c: lambda at: F.when(at("volume") > 0, at(c) / at("volume")).otherwise(0.0)
    against = {"volume_forecast_error": lambda at: F.lit(None).cast("double"), "volume_vs_forecast": lambda at: F.lit("not_available")}
    if forecast is not None:
        against = {
            "volume_forecast_error": lambda at: at("volume") - at(forecast),
            "volume_vs_forecast": lambda at: F.when(at(forecast).isNull(), "not_available")
            .when(at("volume") > at(forecast), "above")
            .when(at("volume") < at(forecast), "below")
            .otherwise("equal"),
        }
    return add_columns(
        log,
        {
            "inventory_before": lambda at: at("quantity") - at("cumulative_executed") + at("executed"),
            "inventory_after": lambda at: at("quantity") - at("cumulative_executed"),
            "planned_participation": share("planned"),
            "participation": share("executed"),
            "timing_cost": lambda at: side_sign("side") * at("executed") * (at("reference_price") - at("arrival_price")),
            **against,
        },
    )


def tca_summary(log: DataFrame, keys: Sequence[str] = ORDER, carry: Sequence[str] = ("side", "quantity", "session_vwap", "arrival_price")) -> DataFrame:
    """One row per order; prices and shortfalls are NULL when nothing filled.

    All columns come from one aggregation of the log. The order's constants
    are grouping columns, which keeps every buffer fixed-width. An order that
    could not be run has a row too: nothing filled, and its ``status``.
    """
    sign = side_sign("side")
    filled = F.sum("executed")
    carry = [*carry, *(["status"] if "status" in log.columns and "status" not in carry else [])]
    g = log.groupBy(*keys, *(c for c in carry if c not in keys)).agg(
        filled.alias("filled"),
        F.sum(F.col("executed") * F.col("execution_price")).alias("filled_notional"),
        F.sum(sign * F.col("executed") * (F.col("execution_price") - F.col("arrival_price"))).alias("_shortfall"),
        F.sum("timing_cost").alias("_timing"),
        F.sum("spread_cost").alias("spread_cost"),
        F.sum("impact_cost").alias("impact_cost"),
        F.max_by("reference_price", "minute").alias("_last"),
        F.sum("volume").alias("window_volume"),
        F.avg("participation").alias("average_participation"),
        F.max("participation").alias("maximum_participation"),
        F.min("minute").alias("first_minute"),
        F.max("minute").alias("last_minute"),
        F.count("minute").alias("buckets"),
    )
    some = F.col("filled") > 0
    average = F.when(some, F.col("filled_notional") / F.col("filled"))
    g = g.withColumns(
        {
            "unfilled": F.col("quantity") - F.col("filled"),
            "average_price": average,
            "implementation_shortfall": F.when(some, F.col("_shortfall")),
            "timing_cost": F.when(some, F.col("_timing")),
            "total_cost": F.col("spread_cost") + F.col("impact_cost"),
            "completion_rate": F.col("filled") / F.col("quantity"),
            "realized_participation": F.coalesce(F.try_divide("filled", "window_volume"), F.lit(0.0)),
        }
    )
    return g.withColumns(
        {
            "shortfall_bps": slippage_bps(F.col("average_price"), F.col("arrival_price"), sign),
            "vwap_slippage_bps": slippage_bps(F.col("average_price"), F.col("session_vwap"), sign),
            "opportunity_cost": sign * F.col("unfilled") * (F.col("_last") - F.col("arrival_price")),
            "residual": F.col("implementation_shortfall") - F.col("timing_cost") - F.col("total_cost"),
        }
    ).drop("_shortfall", "_timing", "_last")


def oracle_cost(buckets: DataFrame, *, impact: Column, rate: float = 0.1, keys: Sequence[str] = ORDER) -> DataFrame:
    """Evaluation-only lower bound: allocation in proportion to realised volume.

    With ``alloc = F v / sum(v)`` the cost is ``eta (F / sum(v))^2 sum(v^2 / max(v, 1))``,
    one aggregation per order.
    """
    v = F.col("volume").cast("double")
    g = buckets.groupBy(*keys).agg(
        F.sum("volume").alias("_v"),
        F.sum(v * v / F.greatest(v, F.lit(1.0))).alias("_s"),
        F.first("quantity").alias("_q"),
        F.max(impact).alias("_eta"),
    )
    feasible = F.least(F.col("_q").cast("double"), F.lit(rate) * F.col("_v"))
    unit = F.try_divide(feasible, F.col("_v"))
    return g.select(*keys, F.coalesce(F.col("_eta") * unit * unit * F.col("_s"), F.lit(0.0)).alias("oracle_cost"))


def allocation_regret(model: Column, oracle: Column) -> Column:
    return (model - oracle) / F.greatest(oracle, F.lit(1e-12))


SUMMARY_METHODS = ("twap", "vwap", "pov", "almgren-chriss", "oracle-vwap")


def run_methods(
    buckets: DataFrame,
    methods: Sequence[str],
    *,
    half_spread: Column,
    impact: Column,
    volatility: Column | None = None,
    risk_aversion: Column | None = None,
    pov_rate: float = 0.05,
    hard_rate: float = 0.1,
    allow_evaluation_only: bool = False,
    keys: Sequence[str] = ORDER,
    carry: Sequence[str] = ("side", "quantity", "session_vwap", "arrival_price"),
) -> DataFrame:
    """Summaries of every method on the same order buckets, tagged with ``method``; every order has a row for every method.

    ``oracle-vwap`` trades on realised volume and must be asked for;
    ``evaluation_only`` marks its rows. An order that a method cannot run keeps
    a row with nothing filled, whose ``status`` says why: that of
    :func:`prepare_window`, or the method's own ``no_forecast`` or
    ``infeasible``. Keep :func:`complete_cases` of it to compare methods.

    The plans are columns of one table: the buckets are shuffled by order once
    and every window below keeps that partitioning. ``buckets`` needs a
    ``share`` column for the forecast-driven method.
    """
    if "oracle-vwap" in methods and not allow_evaluation_only:
        raise ValueError("the realised-volume method is evaluation-only; pass allow_evaluation_only=True")
    if "almgren-chriss" in methods and (volatility is None or risk_aversion is None):
        raise ValueError("almgren-chriss needs a volatility and a risk aversion")
    b = buckets if "status" in buckets.columns else buckets.withColumn("status", F.lit("ok"))
    for m in methods:
        before = F.col("status")
        b = b.withColumn("_window_status", before)
        if m == "twap":
            b = static_fills(twap_schedule(b), hard_rate)
        elif m == "vwap":
            b = static_fills(_plan_by_shares(b, "share"), hard_rate)
        elif m == "oracle-vwap":
            realised = b.withColumn("_realised", F.try_divide("volume", "window_volume"))
            b = static_fills(_plan_by_shares(realised, "_realised").drop("_realised"), hard_rate)
        elif m == "almgren-chriss":
            eta = F.greatest(impact / 100000.0, F.lit(1e-12))
            b = static_fills(
                almgren_chriss_schedule(b, eta=eta, volatility=volatility, risk_aversion=risk_aversion), hard_rate
            )
        elif m == "pov":
            b = pov_fills(b, pov_rate, hard_rate)
        else:
            raise ValueError(f"unknown method {m!r}")
        done = F.struct(F.lit(m).alias("method"), "planned", F.coalesce("executed", F.lit(0).cast("bigint")).alias("executed"), F.col("status").alias("method_status"))
        b = b.withColumn(f"_m_{m}", done).withColumn("status", F.col("_window_status")).drop("planned", "executed", "capacity", "_window_status")
    kept = [c for c in b.columns if c != "status" and not c.startswith("_m_")]
    rows = b.select(*kept, F.inline(F.array(*(F.col(f"`_m_{m}`") for m in methods)))).withColumnRenamed("method_status", "status")
    log = execution_log(fill_cost(rows, half_spread=half_spread, impact=impact), keys=[*keys, "method"])
    return tca_summary(log, [*keys, "method"], carry).withColumn("evaluation_only", F.col("method") == "oracle-vwap")


def complete_cases(runs: DataFrame, keys: Sequence[str] = ORDER) -> DataFrame:
    """The rows of orders that every method of ``runs`` could run."""
    good = runs.groupBy(*keys).agg(F.bool_and(F.col("status") == "ok").alias("_good")).where("_good").select(*keys)
    return runs.join(good, list(keys), "left_semi")


def best_and_worst(runs: DataFrame, cost: str, *, digits: int = 6) -> DataFrame:
    """The methods of least and largest mean cost, in one row; of equal means the first name.

    Where the participation cap binds in every bucket two methods fill the same,
    and the last bits of their means are those of the order of summation. Means
    are therefore compared after rounding.
    """
    m = runs.groupBy("method").agg(F.round(F.avg(cost), digits).alias("_m")).where("_m IS NOT NULL")
    return m.agg(
        F.min_by("method", F.struct("_m", "method")).alias("best"), F.min_by("method", F.struct(-F.col("_m"), "method")).alias("worst")
    )


def tca_cases(
    bars: DataFrame,
    cases: DataFrame,
    methods: Sequence[str],
    shares: DataFrame | None = None,
    *,
    fractions: Sequence[float] = (0.01, 0.03, 0.05),
    start: int = 60,
    end: int = 360,
    rate: float = 0.1,
    half_spread: float = 5e-5,
    impact: float = 1e-3,
    volatility: float | None = None,
    risk_aversion: float | None = None,
    allow_evaluation_only: bool = False,
) -> DataFrame:
    """Matched cases: every method on the same order with costs scaled to the arrival open.

    ``shares`` (``instrument_id, session_date, minute, share``) is the causal
    volume forecast that ``vwap`` follows; no method but the guarded
    ``oracle-vwap`` sees realised volume before it trades.

    ``cases`` has ``instrument_id, session_date, side, adv20``; each becomes an
    order of every fraction of its average volume, one share at least. The
    arrival is the open of the first window minute. Cases that cannot be run
    stay, with their ``status``.
    """
    each = cases.withColumn("order_fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    orders = each.select(
        F.concat_ws("|", "instrument_id", F.col("session_date").cast("string"), F.col("order_fraction").cast("string")).alias("order_id"),
        "instrument_id", "session_date", "side", F.greatest(F.lit(1), F.bround(F.col("adv20") * F.col("order_fraction"), 0).cast("bigint")).alias("quantity"), "order_fraction",
        F.lit(start).alias("start_minute"), F.lit(end).alias("end_minute"),
    )
    b = prepare_window(orders, bars)
    opened = Window.partitionBy("order_id").orderBy("minute")
    b = b.withColumn("arrival_open", F.first("open").over(opened))
    if shares is not None:
        b = b.join(shares.select("instrument_id", "session_date", "minute", "share"), ["instrument_id", "session_date", "minute"], "left")
    elif "vwap" in methods:
        raise ValueError("vwap follows a forecast: pass shares")
    eta = F.col("arrival_open") * impact
    carry = ("side", "quantity", "session_vwap", "arrival_price", "instrument_id", "session_date", "order_fraction")
    runs = run_methods(
        b, methods, half_spread=F.col("arrival_open") * half_spread, impact=eta, hard_rate=rate,
        volatility=None if volatility is None else F.lit(volatility), risk_aversion=None if risk_aversion is None else F.lit(risk_aversion),
        allow_evaluation_only=allow_evaluation_only, carry=carry,
    )
    floor = oracle_cost(b, impact=eta, rate=rate)
    return runs.join(floor, "order_id").withColumn("regret", allocation_regret(F.col("impact_cost"), F.col("oracle_cost")))


def experiment_grid(
    sessions: DataFrame,
    *,
    sides: Sequence[str],
    quantities: Sequence[int],
    impacts: Sequence[float],
    risks: Sequence[float],
    start: int,
    end: int,
) -> DataFrame:
    """Orders of a full parameter grid on every session, numbered by their content.

    The parameter lists are literals: each session row is exploded, nothing is
    joined.
    """
    grid = sessions.select("instrument_id", "session_date")
    for name, values in (("side", sides), ("quantity", quantities), ("impact", impacts), ("risk_aversion", risks)):
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return grid.withColumns({"start_minute": F.lit(start), "end_minute": F.lit(end)}).withColumn(
        "order_id",
        F.concat_ws(
            "|", "instrument_id", F.col("session_date").cast("string"), "side", F.col("quantity").cast("string"),
            F.col("impact").cast("string"), F.col("risk_aversion").cast("string"),
        ),
    )


def grid_regimes(results: DataFrame) -> DataFrame:
    """High or low liquidity and volatility against the median over all result rows."""
    from barlens.operators.ranking import exact_quantiles, unpivot

    long = unpivot(results, [], ["session_volume", "session_volatility"], "what", "value")
    med = exact_quantiles(long, ["what"], "value", {"median": 0.5})
    pick = lambda c: F.max(F.when(F.col("what") == c, F.col("median")))
    both = med.agg(F.struct(pick("session_volume").alias("v"), pick("session_volatility").alias("s")).alias("m")).scalar()
    label = lambda c, m: F.when(F.col(c) >= m, "high").otherwise("low")
    return results.withColumn("_m", both).withColumns(
        {
            "liquidity_regime": label("session_volume", F.col("_m.v")),
            "volatility_regime": label("session_volatility", F.col("_m.s")),
        }
    ).drop("_m")
