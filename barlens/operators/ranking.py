"""Exact positions and quantiles that never gather a group in one task.

A plain window or ``percentile`` puts a whole group into one task. Here rows
are range-partitioned on (group, order), so a group that holds a third of the
table spreads over a third of the tasks; each partition is counted on its own
and only the per-partition counts are accumulated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.session import settle


def with_positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    descending: Sequence[str] = (),
    weight: str | None = None,
    before: str = "_before",
    total: str = "_n",
) -> DataFrame:
    """Add the weight ordered before each row of its group and the group's weight.

    ``by`` + ``order`` must identify a row. With unit weights ``before + 1`` is
    the row number.
    """
    keys = [F.col(c).desc() if c in descending else F.col(c) for c in order]
    spread = df.repartitionByRange(*(F.col(c) for c in by), *keys)
    if weight is None:
        return _numbered_runs(spread, by, keys, before, total)
    rows = settle(spread.withColumn("_chunk", F.spark_partition_id()))
    w = F.col(weight)
    local = Window.partitionBy("_chunk", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_chunk").agg(F.sum(w).cast("bigint").alias("_in_chunk"))
    # at most one row per shuffle partition and group
    chunks = Window.partitionBy(*(by or [F.lit(0)]))
    offsets = counts.select(
        *(F.col(c).alias(f"_of_{c}") for c in by),
        F.col("_chunk").alias("_of_chunk"),
        F.coalesce(
            F.sum("_in_chunk").over(chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_chunks_before"),
        F.sum("_in_chunk").over(chunks).alias(total),
    )
    placed = rows.withColumn("_local", F.coalesce(F.sum(w).over(local), F.lit(0)))
    same = F.col("_chunk") == F.col("_of_chunk")
    for c in by:  # a NULL group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (
        placed.join(offsets, same)
        .withColumn(before, (F.col("_chunks_before") + F.col("_local")).cast("bigint"))
        .drop("_chunk", "_local", "_chunks_before", "_of_chunk", *(f"_of_{c}" for c in by))
    )


def _numbered_runs(spread: DataFrame, by: Sequence[str], keys: Sequence[Column], before: str, total: str) -> DataFrame:
    """Positions of range-partitioned rows: taken inside each sorted partition before the checkpoint, so rows move once.

    A row's number within its partition is the low part of ``monotonically_increasing_id``; what lies before its partition
    comes from one row for each partition and group.
    """
    ordered = spread.sortWithinPartitions(*by, *keys).withColumn("_at", F.monotonically_increasing_id())
    rows = settle(ordered.withColumns({"_chunk": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    runs = rows.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_in_chunk"), F.min("_at").alias("_first"))
    chunks = Window.partitionBy(*(by or [F.lit(0)]))
    offsets = runs.select(
        *(F.col(c).alias(f"_of_{c}") for c in by),
        F.col("_chunk").alias("_of_chunk"),
        (F.coalesce(F.sum("_in_chunk").over(chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_in_chunk").over(chunks).alias(total),
    )
    same = F.col("_chunk") == F.col("_of_chunk")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    placed = rows.join(offsets, same).withColumn(before, F.col("_at") + F.col("_shift"))
    return placed.drop("_chunk", "_at", "_shift", "_of_chunk", *(f"_of_{c}" for c in by))


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], *, descending: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Exact ``row_number`` for groups of any size."""
    out = with_positions(df, by, order, descending=descending)
    return out.withColumn(name, F.col("_before") + 1).drop("_before", "_n")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """One row per distinct value of a group with its tie-averaged rank."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = with_positions(counts, by, [value], weight="_ties")
    return placed.select(
        *by, value, (F.col("_before") + (F.col("_ties") + 1) / F.lit(2.0)).alias(name)
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per probability.

    Equal values are counted before the shuffle; nulls are ignored.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_ties"))
    )
    placed = with_positions(counts, by, [value], weight="_ties")
    picks: list[Column] = []
    for name, p in probabilities.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_ties"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}_{name}"))
    picked = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in probabilities.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*by, *out)


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Long form of double columns, produced inside the same stage."""
    pairs = F.array(
        *(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns)
    )
    return df.select(*keep, F.inline(pairs))
