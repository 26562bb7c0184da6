"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The tree is domain, language, source. A node's budget is split among its children by their weights, and no child gets more
than it can give (``tokens * max_epochs`` of its leaves). What a child cannot take goes to its siblings by weight; only what
a whole family cannot take goes up, to the siblings of the parent. Each level is one water-filling over the (small) table of
nodes, in closed form: children in the order of capacity over weight, with running sums, give the level at which the budget
is used up.

A leaf then takes whole epochs and, of the next epoch, a prefix of its tokens in the order that seed and epoch number draw.
The prefix is found without sorting a leaf: draws are cut into ranges, the ranges' token sums name the range in which the
budget ends, and only that range's documents are put in order. A document is selected by comparing its draw with the leaf's
cut, so texts are never shuffled.

Defined results: null text has no tokens; null domain, language or source is a value of its own, the empty string with it; a
weight that is missing is 1, a weight of 0 or less excludes a node; a document without tokens follows its draw; repeated rows
are drawn alike and all counted; an empty table, or a budget of nothing, selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import BLANK_CLASS, literal_table, settle

LEVELS = ("domain", "lang", "source")
#: Documents in one range of draws, on average; leaves that are sent along with the tasks as literals.
RANGE, MOST_LOCAL = 5000, 500


def words(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS), "")).cast("bigint")


def draw(seed: int, epoch: Column | int, doc_id: Column | str) -> Column:
    """A 60-bit draw of a document in an epoch."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _filled(nodes: DataFrame, parent: list[str], out: str) -> DataFrame:
    """Split each parent's ``budget`` among its rows of ``nodes`` (``weight``, ``room``) as column ``out``."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), *LEVELS[: len(parent) + 1])
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = nodes.withColumns({"_w": F.sum("weight").over(by) - F.sum("weight").over(upto) + F.col("weight"), "_c": F.sum("room").over(upto) - F.col("room")})
    level = (F.col("budget") - F.col("_c")) / F.col("_w")
    w = w.withColumn("_level", F.when(F.col("room") > level * F.col("weight"), level))
    w = w.withColumn("_level", F.max("_level").over(by))
    return w.withColumn(out, F.least("room", F.greatest(F.lit(0.0), F.coalesce(F.col("_level") * F.col("weight"), "room")))).drop("_w", "_c", "_level")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, float]], max_epochs: float) -> DataFrame:
    """``(domain, lang, source, n, tokens, budget)`` of each leaf, from ``(domain, lang, source, n, tokens)``.

    ``weights`` has a mapping for each level; keys name a node by its path (``"web"``, ``"web/en"``, ``"web/en/src3"``) or by
    its own name, the path first.
    """

    def weight(depth: int) -> Column:
        given = weights.get(LEVELS[depth], {})
        if not given:
            return F.lit(1.0)
        table = F.create_map(*(F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))))
        path = F.concat_ws("/", *LEVELS[: depth + 1])
        return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, F.col(LEVELS[depth])), F.lit(1.0))

    leaves = leaves.withColumns({f"_w{i}": weight(i) for i in range(3)})
    alive = (F.col("_w0") > 0) & (F.col("_w1") > 0) & (F.col("_w2") > 0)
    tree = leaves.where(alive).withColumn("room", F.col("tokens") * float(max_epochs))
    node = None
    for depth in range(3):
        names = list(LEVELS[: depth + 1])
        rows = tree.groupBy(*names).agg(F.sum("room").alias("room"), F.first(f"_w{depth}").alias("weight"))
        rows = rows.withColumn("budget", total.cast("double")) if node is None else rows.join(node, names[:-1])
        node = _filled(rows, names[:-1], "share").select(*names, F.col("share").alias("budget"))
    return leaves.join(node, list(LEVELS), "left").select(*LEVELS, "n", "tokens", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6).alias("budget"))


def _named(docs: DataFrame, domain: Column) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))]


def plan(
    docs: DataFrame, *, domain: Column, weights: Mapping[str, Mapping[str, float]], share: float, max_epochs: float = 1, seed: int = 0, tokens: Column | None = None
) -> DataFrame:
    """One row a leaf: ``full`` epochs, and ``cut`` and ``cut_id``, up to which the next epoch is taken.

    The budget is ``share`` of all tokens. The documents are read once, to narrow rows that are checkpointed.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_named(docs, domain), (words() if tokens is None else tokens).alias("n_tokens"))
    slim = settle(slim)
    leaves = slim.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
    total = slim.agg((F.coalesce(F.sum("n_tokens"), F.lit(0)) * share).alias("total")).scalar()
    leaf = budgets(leaves, total, weights, max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))
    leaf = leaf.withColumns({"full": full.cast("bigint"), "ranges": F.ceil(F.col("n") / RANGE)})
    leaf = settle(leaf.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")))
    local = leaf.select(*LEVELS, "full", "rest", "ranges")
    d = draw(seed, F.col("full"), "doc_id")
    width = F.floor(F.lit(float(1 << 60)) / F.col("ranges")) + 1
    drawn = slim.join(_sent(local, LEVELS), list(LEVELS)).withColumn("draw", d).withColumn("range", F.floor(F.col("draw") / width).cast("bigint"))
    sums = drawn.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"), F.first("ranges").alias("ranges"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("after", F.sum("held").over(upto)).withColumn("before", F.col("after") - F.col("held"))
    last = settle(sums.where("rest > 0 and after > rest and before <= rest").select(*LEVELS, "range", "before", "rest"))
    within = drawn.drop("rest").join(last, [*LEVELS, "range"])
    run = Window.partitionBy(*LEVELS).orderBy("draw", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = within.withColumn("sum", F.sum("n_tokens").over(run) + F.col("before")).where("sum <= rest")
    ends = taken.groupBy(*LEVELS).agg(F.max(F.struct("draw", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("end"))
    ends = last.join(ends, list(LEVELS), "left").select(*LEVELS, "range", "end")
    out = leaf.join(ends, list(LEVELS), "left")
    none, every = F.lit(-1), F.lit(1 << 60)
    start = F.col("range") * width - 1
    cut = F.when(F.col("rest") <= 0, none).when(F.col("range").isNull(), every).otherwise(F.coalesce(F.col("end.draw"), start))
    return out.select(*LEVELS, "n", "tokens", "budget", "full", cut.cast("bigint").alias("cut"), F.coalesce("end.id", F.lit((1 << 63) - 1)).alias("cut_id"))


def _sent(rows: DataFrame, names) -> DataFrame:
    """A table of few rows as literals, so that Spark sends it to the tasks by its known size; a larger one stays a table."""
    got = rows.limit(MOST_LOCAL + 1).collect()
    return rows if len(got) > MOST_LOCAL else literal_table(rows.sparkSession, got, rows.schema)


def mixed(docs: DataFrame, leaves: DataFrame, *, domain: Column, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that a :func:`plan` selects, with all their columns in ``_row`` and how often in ``repeats``."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), *_named(docs, domain))
    rows = rows.join(_sent(leaves.select(*LEVELS, "full", "cut", "cut_id"), LEVELS), list(LEVELS))
    at = draw(seed, F.col("full"), "_id")
    rows = rows.withColumn("_draw", at)
    here = (F.col("_draw") < F.col("cut")) | ((F.col("_draw") == F.col("cut")) & (F.coalesce("_id", F.lit(-(1 << 63))) <= F.col("cut_id")))
    return rows.withColumn("repeats", F.col("full") + here.cast("bigint")).where("repeats > 0").select("_row", *LEVELS, "repeats")
