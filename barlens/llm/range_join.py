"""Near-duplicate vectors by an exact metric range join.

Cosine ``c`` between unit vectors is a Euclidean distance of ``sqrt(2 - 2c)``, so "cosine at least ``threshold``" is "distance
at most ``r``". Vectors of one label (and dimension) are compared:

1. *Pivots.* A label with many vectors gets pivots, drawn by hash, and every vector belongs to the cell of its nearest pivot.
2. *Boundary replication.* If ``x`` of cell ``i`` and ``y`` of cell ``j`` lie within ``r``, the triangle inequality gives
   ``d(x, p_j) <= d(x, p_i) + 2r``, and the bisector of ``p_i`` and ``p_j`` lies within ``r`` of ``x``. So ``x`` visits exactly
   the cells that pass both tests, and each cell then holds every partner of its own vectors.
3. *Cells join independently.* A cell counts the links of its own vectors only, so nothing is counted twice. A large cell is
   cut into a grid of blocks of bounded size, whatever its share of the rows.

Equal vectors of a label are one class with a number of copies, known by label and vector and not by an id. A block returns a number per vector and a spanning forest
of its links, never the pairs. Vectors that are null, zero, or hold null or non-finite components, and rows without a label
or id, link with nothing.

Defined results: every row keeps a row; a row that repeats an id is a vector of its own with the same component; vectors of
different dimension never link; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import Forest, bound_batches, components, settle, told_apart, unit_hash

#: Vectors of a label that share one cell on average, most vectors in a block, most pivots over all labels (the rest go without: their grid is larger, not cut).
CELL, BLOCK, PIVOTS = 4000, 4096, 4096


def _pivots(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivots of the labels that need them: at most 2 * PIVOTS vectors reach the driver."""
    large = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n"), "label", "dim").limit(PIVOTS // 2)
    want, left = [], PIVOTS
    for r in large.collect():
        k = min(left, -(-r["n"] // CELL))
        if k > 1:
            want.append((r["label"], r["dim"], k, min(1.0, (2 * k + 20) / r["n"])))
            left -= k
    if not want:
        return {}
    wanted = classes.sparkSession.createDataFrame(want, "label bigint, dim int, k int, share double")
    drawn = classes.join(wanted, ["label", "dim"]).withColumn("draw", unit_hash("id", seed=5)).where("draw < share").select("label", "dim", "k", "draw", "vector").collect()
    out: dict[tuple[int, int], list] = {}
    for r in sorted(drawn, key=lambda r: r["draw"]):
        at = out.setdefault((r["label"], r["dim"]), [])
        if len(at) < r["k"]:
            v = np.array(r["vector"])
            at.append(v / np.linalg.norm(v))
    return {k: np.stack(v) for k, v in out.items() if len(v) > 1}


def _placed(classes: DataFrame, radius: float) -> DataFrame:
    """Each class in its own cell, and a copy in each cell that it visits."""
    pivots = _pivots(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), g in b.groupby(["label", "dim"]):
                x = np.stack(g["vector"].to_numpy()).astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                p = pivots.get((label, dim))
                if p is None:
                    home, visit = np.zeros(len(x), int), np.zeros((len(x), 1), bool)
                else:
                    dot = x @ p.T
                    home = dot.argmax(1)
                    far, near = np.sqrt(np.maximum(0, 2 - 2 * dot)), np.sqrt(np.maximum(0, 2 - 2 * dot.max(1)))
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home]
                    visit = (far <= near[:, None] + 2 * radius) & (dot.max(1)[:, None] - dot <= radius * apart + 1e-9)
                    visit[np.arange(len(x)), home] = False
                row, cell = np.nonzero(visit)
                row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
                unit = [v.tobytes() for v in x]
                ids, copies = g["id"].to_numpy(), g["copies"].to_numpy()
                for s in range(0, len(row), 8192):  # a batch with many visits leaves in parts
                    at = row[s : s + 8192]
                    yield pd.DataFrame(
                        {"label": label, "dim": dim, "cell": cell[s : s + 8192], "own": (np.arange(s, s + len(at)) < len(x)), "id": ids[at], "copies": copies[at], "unit": [unit[i] for i in at]}
                    )

    return classes.mapInPandas(run, "label bigint, dim int, cell int, own boolean, id bigint, copies bigint, unit binary")


def _cell_links(placed: DataFrame, threshold: float) -> DataFrame:
    """``(id, links, root)``: of each block's vectors with a link, how many partners (own vectors only) and the block's smallest member reached."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["side"] == 0], g[g["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")
        x, y = (np.frombuffer(b"".join(s["unit"]), np.float64).reshape(len(s), -1) for s in (a, b))
        ia, ib, copies = a["id"].to_numpy(), b["id"].to_numpy(), b["copies"].to_numpy()
        forest, links = Forest(), np.zeros(len(x), np.int64)
        top = ib.copy()
        for s in range(0, len(x), 512):
            near = x[s : s + 512] @ y.T >= threshold
            near &= ia[s : s + 512, None] != ib[None, :]
            links[s : s + 512] = near @ copies
            for i in np.flatnonzero(near.any(1)):
                at = near[i]
                me = int(ia[s + i])
                for r in np.unique(top[at]):
                    forest.link(me, int(r))
                top[at] = forest.root(me)
        for j in np.flatnonzero(top != ib):
            forest.link(int(ib[j]), int(top[j]))
        ids = np.array(sorted(forest.up), np.int64)
        own = dict(zip(ia.tolist(), links.tolist()))
        return pd.DataFrame({"id": ids, "links": np.array([own.get(int(i), 0) for i in ids], np.int64), "root": np.array([forest.root(int(i)) for i in ids], np.int64)})

    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).alias("across"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("down")).where("across > 0")
    sized = placed.join(sizes, key)
    h = F.xxhash64("id")
    a = sized.where("own").select(*key, F.pmod(h, "across").alias("a"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("b"), F.lit(0).alias("side"), "id", "copies", "unit")
    b = sized.select(*key, F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("a"), F.pmod(h, "down").alias("b"), F.lit(1).alias("side"), "id", "copies", "unit")
    return a.unionAll(b).groupBy(*key, "a", "b").applyInPandas(run, "id bigint, links bigint, root bigint")


def linked(vectors: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    bound_batches(vectors.sparkSession, rows=8192)
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    most = F.array_max(F.transform("vector", F.abs))
    # squares of very large or small components leave the range of doubles: such vectors are brought near one first
    scaled = F.when((most > 1e100) | (most < 1e-100), F.transform("vector", lambda x: x / most)).otherwise(F.col("vector"))
    v = v.withColumn("key", F.when(usable & F.coalesce(finite & (most > 0), F.lit(False)), scaled))
    keyed = v.where("key is not null")
    classes = keyed.groupBy("label", F.col("key").alias("vector")).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    several = settle(keyed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    repeated = not several.isEmpty()
    classes = told_apart(classes, ["label", "vector"]) if repeated else classes.withColumn("id", F.col("least"))
    classes = settle(classes.select("label", F.size("vector").alias("dim"), "id", "copies", "vector"))
    placed = settle(_placed(classes, math.sqrt(2 - 2 * threshold) + 1e-9))
    found = settle(_cell_links(placed, threshold))
    edges = found.where("id <> root").select("id", "root")
    if repeated:  # the classes of one id are one component
        mine = keyed.join(several, "vec_id", "left_semi").join(classes.select("label", F.col("vector").alias("key"), "id"), ["label", "key"]).select("vec_id", "id")
        edges = edges.unionAll(mine.join(mine.groupBy("vec_id").agg(F.min("id").alias("root")), "vec_id").where("id <> root").select("id", "root"))
    roots = components(edges, "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.select("label", F.col("vector").alias("key"), "id", "copies").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    of = of.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = v.join(of, ["label", "key"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
