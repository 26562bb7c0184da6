"""Exact order statistics of groups of any size by radix refinement.

A value's bits, turned so that they sort like the value, are read sixteen at a time from the top. A pass counts each group's rows
by their next sixteen bits, a histogram of at most 65,536 numbers that sums map-side, and keeps only the bin that holds the wanted
rank; four passes leave the value itself. No pass sorts rows or brings a group together, and rows outside the bins drop out of
the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.session import settle

DIGIT, PASSES = 16, 4


def _turned(bits: pa.Array) -> pa.Array:
    """Bits of doubles as integers that sort like them, and back: the function is its own inverse."""
    negative = pc.less(bits, 0)
    return pc.if_else(negative, pc.bit_wise_xor(bits, (1 << 63) - 1), bits)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per probability; nulls are ignored, NaN sorts last."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # -0.0 and 0.0 are one value
            bits = pc.add(b["_v"], 0.0).view(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in by), _turned(bits)], names=[*by, "_key"])

    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("_key", T.LongType())])
    # digits of the key as an unsigned number: its sign bit turned
    rows = rows.mapInArrow(keyed, schema).withColumn("_key", F.col("_key").bitwiseXOR(F.lit(-(1 << 63))))
    digit = lambda p: F.shiftrightunsigned("_key", DIGIT * (PASSES - 1 - p)).bitwiseAND(F.lit((1 << DIGIT) - 1))

    wanted = [(name, float(p), end) for name, p in probabilities.items() for end in ("lo", "hi")]
    targets = None
    for p in range(PASSES):
        at = [*by, "_digit"] if targets is None else [*by, "_prefix", "_digit"]
        counts = rows.withColumn("_digit", digit(p)).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        group = Window.partitionBy(*at[:-1]) if at[:-1] else Window.partitionBy(F.lit(0))
        bins = counts.withColumn("_before", F.coalesce(F.sum("_n").over(group.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if targets is None:
            h = lambda q: (F.col("_all") - 1) * F.lit(q)
            ranks = F.array(*(F.struct(F.lit(n).alias("_name"), F.lit(e).alias("_end"), (F.floor(h(q)) if e == "lo" else F.ceil(h(q))).alias("_rank")) for n, q, e in wanted))
            bins = bins.withColumn("_all", F.sum("_n").over(group)).withColumn("_t", F.explode(ranks)).select(*by, "_digit", "_n", "_before", "_all", "_t.*")
        else:
            bins = bins.join(targets, _same([*by, "_prefix"])).select(*(F.col(c) for c in by), "_prefix", "_digit", "_n", "_before", "_all", "_name", "_end", "_rank")
        hit = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        prefix = F.col("_digit") if targets is None else F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit"))
        targets = settle(bins.where(hit).select(*by, prefix.alias("_prefix"), "_all", "_name", "_end", (F.col("_rank") - F.col("_before")).alias("_rank")))
        targets = targets.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, "_prefix"]), "_all", "_name", "_end", "_rank")
        if p < PASSES - 1:
            open_bins = targets.select(*(f"_of_{c}" for c in [*by, "_prefix"])).distinct()
            inside = rows.drop("_prefix").withColumn("_prefix", F.shiftrightunsigned("_key", DIGIT * (PASSES - 1 - p)))
            rows = settle(inside.join(open_bins, _same([*by, "_prefix"]), "left_semi"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _turned(b["_bits"])
            yield b.set_column(b.schema.get_field_index("_bits"), "_bits", bits.view(pa.float64()))

    found = targets.select(*(F.col(f"_of_{c}").alias(c) for c in by), "_name", "_end", "_all", F.col("_of__prefix").bitwiseXOR(F.lit(-(1 << 63))).alias("_bits"))
    schema = T.StructType([*found.schema.fields[:-1], T.StructField("_bits", T.DoubleType())])
    pick = lambda n, e: F.max(F.when((F.col("_name") == n) & (F.col("_end") == e), F.col("_bits")))
    ends = found.mapInArrow(read, schema).groupBy(*by).agg(F.max("_all").alias("_all"), *(pick(n, e).alias(f"_{e}_{n}") for n, _, e in wanted))
    out = []
    for name, q in probabilities.items():
        h, lo, hi = (F.col("_all") - 1) * F.lit(float(q)), F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(h == F.floor(h), lo).otherwise(lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return ends.select(*by, *out)


def _same(columns: Sequence[str]):
    """Rows and targets of one group and bin; a null group is a group."""
    out = None
    for c in columns:
        one = F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        out = one if out is None else out & one
    return out
