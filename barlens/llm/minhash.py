"""Near-duplicate documents by fast similarity sketching.

A document is the set of its distinct five-word shingles (64-bit hashes; words are those of ``[^\\x20\\x09-\\x0D]+`` after
lower-casing A-Z; fewer than five words make one shingle; a document without words has an empty set and links with nothing).

1. *Sketch.* In round ``i < t`` every shingle falls into a bin drawn for it in that round, with a drawn value; a bin keeps the
   smallest value of the first round that reaches it. In rounds ``t .. 2t-1`` every shingle falls into bin ``i - t``, so all
   ``t`` coordinates fill, whatever the size of the set; agreement of coordinates is as concentrated about the Jaccard
   similarity as with ``t`` independent hash functions, at ``O(n + t log t)`` work.
2. *Banding.* ``bands`` groups of ``rows`` coordinates are hashed; documents that share a group meet in a bucket. A pair at the
   threshold ``p`` shares none with probability ``(1 - p**rows) ** bands``. Both follow ``percent`` so that this is at most
   MISS: 32 bands of 6 at 0.85, 38 of 5 at 0.80.
3. *Exact verification* on full sets: ``100 * |A and B| >= percent * |A or B|`` links.

Equal sets are one class from the start. No bucket is expanded into its pairs: first every class is compared with the most
central member it meets (that with the most company over all its bands), then with the centres of its other buckets, and
last, only in buckets whose members still lie in different components, the members across components. Those buckets are
split into blocks, and sketches rule out pairs five deviations below the threshold before sets are moved.

Defined results: null text counts as empty; a null ``doc_id`` keeps its row, unlinked; repeated rows each keep a row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import Forest, Store, between, blank, bound_batches, components, merged, mix64, seeds, told_apart

WORDS = 5
BANDS, ROWS = 32, 6
#: How likely a pair at the threshold may share no band, and how many coordinates the bands may take for it.
MISS, COORDINATES = 3e-7, 192
#: Classes of one bucket in one block of the last step.
BLOCK = 256
_STEPS = seeds(WORDS, 11)


def layout(percent: int, miss: float = MISS) -> tuple[int, int]:
    """``(bands, rows)``: the most rows whose bands miss a pair at the threshold as rarely as asked; one row takes what it needs."""
    for rows in range(COORDINATES, 0, -1):
        meet = (percent / 100) ** rows
        bands = 1 if meet >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-meet))) if meet > miss else math.inf
        if bands * rows <= COORDINATES or rows == 1:
            break
    return int(bands), rows


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = blank(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - WORDS + 1, 1)
    total = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, len(h))):
            total = mix64(total + h[k : k + n] * _STEPS[k])
    return np.unique(total)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a non-empty set; see the module's text."""
    out, full = np.zeros(t, np.uint64), np.zeros(t, bool)
    salt = seeds(2 * t, 7)
    done, at_once = 0, max(1, 4096 // len(items))
    while done < t and not full.all():
        rounds = np.arange(done, min(t, done + at_once), dtype=np.uint64)
        h = mix64(items[None, :] ^ salt[done : done + len(rounds), None])
        place = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        key = np.sort(((place << np.uint64(48)) | (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        where = (key >> np.uint64(48)).astype(np.int64)
        first = np.ones(len(key), bool)
        first[1:] = where[1:] != where[:-1]
        first &= ~full[where]
        out[where[first]] = key[first] & np.uint64((1 << 48) - 1)
        full[where[first]] = True
        done += len(rounds)
    for b in np.flatnonzero(~full):
        out[b] = (np.uint64(t + b) << np.uint64(32)) | (mix64(items ^ salt[t + b]).min() & np.uint64(0xFFFFFFFF))
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    by, steps = coordinates.reshape(bands, rows), seeds(rows, 23)
    key = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix64(key + by[:, k] * steps[k])
    return key.view(np.int64)


def signatures(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, set_key, band_keys, brief)`` per row; ``set_key`` is null for an empty set.

    ``brief`` holds one byte of every coordinate: enough to rule out pairs, not to accept any.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                s = shingles(text)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                c = sketch(s, bands * rows)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(c, bands, rows), mix64(c).astype(np.uint8).tobytes()))
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].astype("Int64"), **dict(zip(("n_shingles", "set_key", "band_keys", "brief"), map(list, zip(*out)) if out else ([],) * 4))}
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(
        run, "doc_id bigint, n_shingles bigint, set_key binary, band_keys array<bigint>, brief binary"
    )


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets, made anew from the whole texts, are similar enough.

    Texts travel instead of sets: they are smaller. ``v`` is the centre of many pairs, so its set is kept while it repeats.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, y = None, None
        for b in batches:
            good = []
            for text, other in zip(b["x"], b["y"]):
                if other != last:
                    last, y = other, shingles(other)
                x = shingles(text)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(both) - same))
            yield b.loc[np.array(good, bool), ["u", "v"]]

    left, right = texts.select(F.col("id").alias("u"), F.col("text").alias("x")), texts.select(F.col("id").alias("v"), F.col("text").alias("y"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInPandas(run, "u bigint, v bigint")


def _candidates(g: pd.DataFrame, percent: int, agree: float) -> Iterator[tuple[int, np.ndarray]]:
    """Positions in ``g`` of a member and of those it must be compared with, likeliest first, in one task of a bucket.

    Left out are pairs of one component, pairs that size or sketch rules out, and pairs that share an earlier bucket.
    """
    left = np.flatnonzero(g["side"] == 0)
    one = bool(g["block"].iloc[0] == g["other"].iloc[0])
    right = left if one else np.flatnonzero(g["side"] == 1)
    if not len(left) or not len(right):
        return
    bucket, ids, n, component = g["band"].iloc[0], g["id"].to_numpy(), g["n"].to_numpy(), g["component"].to_numpy()
    brief, keys = np.frombuffer(b"".join(g["brief"]), np.uint8).reshape(len(g), -1), np.stack(g["band_keys"].to_numpy())
    for i in left:
        at = right[(component[right] != component[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i])) & ((ids[right] > ids[i]) if one else True)]
        at = at[(keys[at] == keys[i]).argmax(1) == np.flatnonzero(keys[i] == bucket)[0]]
        same = (brief[at] == brief[i]).sum(1)
        at, same = at[same >= agree], same[same >= agree]
        if len(at):
            yield i, at[np.argsort(-same, kind="stable")]


def _rivals(members: DataFrame, facts: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Links between components inside the buckets given, as a spanning forest ``(u, v)`` of components.

    A bucket is cut into blocks of BLOCK members, and a task holds two blocks at most. The first pass has sketches only and
    names the members of a task that have anything to compare; the second brings their texts and compares, no longer once two
    components are linked. No pair leaves a task.
    """
    least = percent / 100
    agree = coordinates * (least - 5 * math.sqrt(least * (1 - least) / coordinates))
    key = ["band", "block", "other"]

    def needed(g: pd.DataFrame) -> pd.DataFrame:
        at = {j for i, others in _candidates(g, percent, agree) for j in (i, *others)}
        return g.iloc[sorted(at)][[*key, "side", "id"]]

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        forest, sets, component, texts = Forest(), {}, g["component"].to_list(), g["text"].to_list()

        def items(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(texts[i])
            return sets[i]

        for i, others in _candidates(g, percent, agree):
            for j in others:
                if forest.root(component[i]) != forest.root(component[j]):
                    both = np.sort(np.concatenate((items(i), items(j))), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        forest.link(component[i], component[j])
        return pd.DataFrame(list(forest.edges()), columns=["u", "v"], dtype="int64")

    blocks, own = F.ceil(F.col("size") / BLOCK), F.col("own")
    grid = members.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks)}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least(own, "other").cast("int").alias("block"), F.greatest(own, "other").cast("int").alias("other"), (own > F.col("other")).cast("int").alias("side"),
        "id", "n", "component", "brief", "band_keys",
    )
    wanted = grid.groupBy(*key).applyInPandas(needed, "band bigint, block int, other int, side int, id bigint")
    return wanted.join(facts, "id").groupBy(*key).applyInPandas(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 85, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs`` (which needs ``doc_id`` and ``text``).

    ``component_id`` is the smallest ``doc_id`` reachable over links; ``kept`` marks the row that carries it. A ``doc_id``
    given to several texts stands for one document that links what any of them links. ``bands`` and ``rows`` come from
    ``percent`` unless both are given.
    """
    if bands is None or rows is None:
        bands, rows = layout(percent)
    store = Store(docs.sparkSession, "minhash")
    sig = store.put(signatures(docs, bands=bands, rows=rows))
    known = sig.where("set_key is not null and doc_id is not null")
    made = known.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("band_keys").alias("band_keys"), F.first("brief").alias("brief"))
    several = known.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = store.put(several)
    repeated = not several.isEmpty()
    classes = store.put(told_apart(made, ["set_key"]) if repeated else made.withColumn("id", F.col("least")))

    placed = classes.select("id", F.explode("band_keys").alias("band"))
    sizes = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = store.put(placed.join(sizes, "band").select("band", "id", "size"))
    company = store.put(shared.groupBy("id").agg(F.sum("size").alias("company")))
    ranked = shared.join(company, "id").withColumn("rank", F.struct("company", (-F.col("id")).alias("minus")))
    centres = ranked.groupBy("band").agg(F.max("rank").alias("centre"))
    met = store.put(shared.join(centres, "band"))
    store.drop(shared)
    texts = store.put(_class_texts(docs, classes.join(company, "id", "left_semi"), several if repeated else None))

    first = met.groupBy("id").agg(F.max("centre").alias("centre")).select(F.col("id").alias("u"), (-F.col("centre.minus")).alias("v")).where("u <> v")
    links = store.put(_verified(first, texts, percent))
    roots = store.put(components(links, "u", "v"))
    store.drop(links)

    more = met.select(F.col("id").alias("u"), (-F.col("centre.minus")).alias("v")).where("u <> v").distinct().join(first, ["u", "v"], "left_anti")
    more = store.put(between(more, roots).select("u", "v"))
    roots = _joined(store, roots, None if more.isEmpty() else _verified(more, texts, percent))

    placed = met.where("size > 2").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = store.put(placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band"))
    facts = classes.select("id", "n", "brief", "band_keys").join(company.select("id"), "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.withColumn("component", F.coalesce("component", "id"))
    rivals = placed.join(mixed, "band", "left_semi").select("band", "id", "size").join(facts, "id")
    roots = _joined(store, roots, None if mixed.isEmpty() else _rivals(rivals, facts.join(texts, "id"), percent, bands * rows))
    store.drop(met, texts, company, more, mixed)
    if repeated:
        roots = _joined(store, roots, _same_document(known.join(several, "doc_id", "left_semi"), classes))

    of = classes.select("set_key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("component", "id").alias("root"))
    return sig.select("doc_id", "n_shingles", "set_key").join(of, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _class_texts(docs: DataFrame, classes: DataFrame, several: DataFrame | None) -> DataFrame:
    """``(id, text)``: a text of each class, that of its least document; ``several`` holds the ids that stand for several sets."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("least"), "text")
    of = classes.select("least", "id", "set_key")
    if several is None:
        return texts.join(of, "least").select("id", "text")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(set_key=[xxhash.xxh3_128_digest(shingles(t).tobytes()) for t in b["text"]])

    several = several.withColumnRenamed("doc_id", "least")
    one = texts.join(several, "least", "left_anti").join(of, "least").select("id", "text")
    rest = texts.where("text is not null").join(several, "least", "left_semi").mapInPandas(keyed, "least bigint, text string, set_key binary")
    return one.unionAll(rest.join(of, ["least", "set_key"]).select("id", "text"))


def _same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between the classes of ids that stand for several sets."""
    of = rows.select("doc_id", "set_key").distinct().join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
    least = of.groupBy("doc_id").agg(F.min("id").alias("v"))
    return of.join(least, "doc_id").where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def _joined(store: Store, roots: DataFrame, links: DataFrame | None) -> DataFrame:
    """``roots`` after further links, if there are any."""
    if links is None:
        return roots
    links = store.put(links)
    out = roots if links.isEmpty() else store.put(merged(roots, links))
    store.drop(links, None if out is roots else roots)
    return out
