"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.session import scratch_path, settle  # noqa: F401

# What separates words (space, tab, line feed, vertical tab, form feed, carriage return), as a class and as text.
BLANK_CLASS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def blank(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased (``bytes`` methods touch ASCII only, as the word rule does)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def bound_batches(spark: SparkSession, megabytes: int = 16, rows: int = 2000) -> None:
    """Bound what one Arrow batch may hold, since a row can be a text of any length; a smaller setting stays."""
    at = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(at)) > rows:
        spark.conf.set(at, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this library on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Store:
    """Tables of one computation below the shared folder: written as Parquet, which cuts lineage, and dropped once nothing reads them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder, self.paths = spark, scratch_path(spark, label), {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                drop_path(self.spark, self.paths[id(t)][1])


#: Ids that no document has are counted from here.
BEYOND = 1 << 62


def told_apart(classes: DataFrame, key: list[str]) -> DataFrame:
    """Column ``id`` of classes, each known by ``key``: their ``least`` member, which the class of the smallest key has where several share it.

    The others get numbers BEYOND; the caller links them with the class that has the id. ``classes`` is written right after.
    """
    first = classes.groupBy("least").agg(F.min(F.struct(*key)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("least", "_first")
    own = F.col("_first").isNull() | (F.col("_first") == F.struct(*key))
    return classes.join(first, "least", "left").withColumn("id", F.when(own, F.col("least")).otherwise(F.lit(BEYOND) + F.monotonically_increasing_id())).drop("_first")


def literal_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A few collected rows as literals of the plan: their size is known to be small, so a join sends them to the tasks."""
    made = [F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in schema)) for r in rows]
    if not made:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    return spark.range(1).select(F.inline(F.array(*made)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend on ``seed`` alone."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from the columns: the same row draws the same number everywhere."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` of every node with an edge; the component is the smallest node that can be reached.

    Alternates large-star and small-star steps: each moves edges towards the smallest neighbour, with map-side minima, so
    a node with very many edges only ever sends one minimum per task. A step is written and the one before dropped, until every
    edge leads straight to a smallest node; nothing but that verdict reaches the driver. An empty input gives an empty result.
    """
    store, last = Store(edges.sparkSession, "components"), None
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    while True:
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = store.put(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        store.drop(last)
        last = pairs
        if _stars(pairs):
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether distinct pairs ``u > v`` are stars about their smallest node: no ``u`` has two of them or is itself a ``v``."""
    ends = pairs.selectExpr("stack(2, u, 1L, v, 0L) as (node, up)")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)").isEmpty()


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``(u, v, u_in, v_in)``: pairs whose ends lie in two components of ``roots``, and which; a node that ``roots`` lacks is its own."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    joined = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return joined.select("u", "v", F.coalesce("u_in", "u").alias("u_in"), F.coalesce("v_in", "v").alias("v_in")).where("u_in <> v_in")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (of :func:`components`) after further links ``(u, v)``: only the components that these join are followed anew."""
    among = components(between(links, roots), "u_in", "v_in")
    now = among.select(F.col("node").alias("component"), F.col("component").alias("now"))
    known = roots.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return known.unionAll(among.join(roots, "node", "left_anti").select("node", "component"))


class Forest:
    """Union-find over one task's rows, with the smallest member as the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while self.up.setdefault(top, top) != top:
            top = self.up[top]
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[tuple[int, int]]:
        return ((x, r) for x in list(self.up) if (r := self.root(x)) != x)


def tokenizer_file(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a public tokenizer's vocabulary lies; ``folder`` or BARLENS_TOKENIZERS names another place than the installed one."""
    folder = folder or os.environ.get("BARLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
