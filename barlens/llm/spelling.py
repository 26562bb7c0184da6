"""Words that are spelling variants of more frequent words.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Two words are near if exactly one code point is
inserted, deleted or replaced. A word's form is its most frequent near word if that is at least twice as frequent.

1. *Vocabulary.* Runs are counted map-side; only words long and frequent enough stay.
2. *Bloom-guided neighbourhoods.* The vocabulary is hashed into blocked Bloom filters, one for each word length (a length with
   very many words is sliced by hash). Filters are sent to the tasks in rounds of at most ROUND_BYTES, however large the
   vocabulary: each word probes its deletions in the filter of the next shorter length, and its replacements by later letters in
   that of its own, so each pair is met from one side only. An edit's hash is the word's polynomial hash with one term changed,
   so edits are spelled out only where a filter lets them pass.
3. *Exact join.* What passed is joined with the vocabulary by the whole word, which removes every false positive.
4. *Roots.* Forms are followed by pointer doubling; a form is twice as frequent as its word, so chains are short and end.

Defined results: null and empty texts have no words; a null ``doc_id`` counts as an empty one where it takes part in a hash;
repeated rows count each time; equally frequent forms are told apart by code-point order; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm import blocked_bloom
from barlens.llm.common import bound_batches, mix64, settle

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Filters of one round.
ROUND_BYTES = 32 << 20
#: Edits probed at once, and edits of one task (a task's words are chosen so that it has about as many).
AT_ONCE, TASK_EDITS = 1 << 18, 1 << 26
# An odd base has an inverse modulo 2**64, which deletions need.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def vocabulary(docs: DataFrame, *, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slip: int | None = None) -> DataFrame:
    """``(word, n)``: words of at least ``letters`` code points that occur ``least`` times or more.

    ``slip`` plants typing errors: a run loses one code point where ``slip`` divides the CRC-32 of ``<doc_id>:<run>``, the one
    at that number modulo the run's length.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= letters).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))))
        cut = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        runs = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= letters)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def codes(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.array(words, f"<U{length}").view("<u4").reshape(len(words), length).astype(np.uint64)


def spelled(c: np.ndarray) -> list[str]:
    """The words of rows of code points."""
    return np.ascontiguousarray(c.astype("<u4")).view(f"<U{c.shape[1]}").ravel().tolist() if c.shape[1] else [""] * len(c)


def hashed(total: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(total + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def totals(c: np.ndarray) -> np.ndarray:
    """The polynomial hash of each row."""
    with np.errstate(over="ignore"):
        return (c * _powers(c.shape[1], BASE)).sum(1, dtype=np.uint64)


def slice_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(12)) & np.uint64(0xFFFFF)) % np.uint64(parts)


def rounds(counts: dict[int, int], budget: int = ROUND_BYTES) -> list[dict[int, tuple[int, int, int, int]]]:
    """Filters of the words of each length, dealt into rounds of at most ``budget`` bytes.

    A round maps a length to ``(slice, slices, first block, blocks)``.
    """
    most = max(1, budget // blocked_bloom.BLOCK_BYTES)
    out: list[dict[int, tuple[int, int, int, int]]] = []
    used = most
    for length, n in sorted(counts.items()):
        parts = -(-blocked_bloom.blocks_for(n) // most)
        for part in range(parts):
            blocks = blocked_bloom.blocks_for(-(-n // parts))
            if used + blocks > most or length in out[-1]:
                out.append({})
                used = 0
            out[-1][length] = (part, parts, used, blocks)
            used += blocks
    return out


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def _keys(plan: dict[int, tuple[int, int, int, int]]):
    """Hashes of a batch's words that the round holds, and their blocks."""

    def run(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for length, at in _by_length(b["word"]):
            if length in plan:
                part, parts, first, blocks = plan[length]
                for some in np.array_split(at, max(1, len(at) * length // AT_ONCE)):
                    h = hashed(totals(codes(b["word"].iloc[some].tolist(), length)), length)
                    h = h[slice_of(h, parts) == part]
                    hashes.append(h)
                    places.append(first + blocked_bloom.place(h, blocks))
        return np.concatenate(hashes), np.concatenate(places)

    return run


def _edits(c: np.ndarray, letters: np.ndarray, plan: dict[int, tuple[int, int, int, int]], bits: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of ``c`` (words of one length) and edits of them that the filters let pass; ``AT_ONCE`` edits are made at a time."""
    n, length = c.shape
    power = _powers(length, BASE)

    def passing(h: np.ndarray, target: int) -> np.ndarray:
        part, parts, first, blocks = plan[target]
        own = np.arange(len(h)) if parts == 1 else np.flatnonzero(slice_of(h, parts) == part)
        return own[blocked_bloom.passing(bits, h[own], first + blocked_bloom.place(h[own], blocks))]

    with np.errstate(over="ignore"):
        terms = c * power
        total = terms.sum(1, dtype=np.uint64)
        if length in plan:
            step = max(1, AT_ONCE // (n * len(letters)))
            for i in range(0, length, step):
                some = c[:, i : i + step]
                row, at, new = np.nonzero(letters[None, None, :] > some[:, :, None])
                h = hashed(total[row] + (letters[new] - some[row, at]) * power[i + at], length)
                good = passing(h, length)
                if len(good):
                    made = c[row[good]]
                    made[np.arange(len(good)), i + at[good]] = letters[new[good]]
                    yield row[good], spelled(made)
        if length - 1 in plan:
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            h = before + (total[:, None] - before - terms) * np.uint64(INVERSE)
            # of a run of equal letters only the first is deleted: the others give the same word
            row, at = np.nonzero(np.concatenate([np.ones((n, 1), bool), c[:, 1:] != c[:, :-1]], 1))
            h = hashed(h[row, at], length - 1)
            good = passing(h, length - 1)
            for g in np.array_split(good, max(1, len(good) * length // AT_ONCE)):
                if len(g):
                    keep = np.arange(length - 1)[None, :]
                    made = np.take_along_axis(c[row[g]], keep + (keep >= at[g][:, None]), 1)
                    yield row[g], spelled(made)


def pairs(words: DataFrame, *, budget: int = ROUND_BYTES) -> DataFrame:
    """``(word, n, near, near_n)``: every near pair of the settled table ``(word, n)``, once."""
    spark = words.sparkSession
    bound_batches(spark)
    counts = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r["c"]), np.uint64)
    edits = sum(n * length * (len(letters) + 1) for length, n in counts.items())
    tasks = max(spark.sparkContext.defaultParallelism, -(-edits // TASK_EDITS))
    dealt = words.repartition(tasks, "word")
    found = None
    for plan in rounds(counts, budget):
        blocks = sum(p[3] for p in plan.values())
        sent = spark.sparkContext.broadcast(blocked_bloom.build(dealt, blocks, _keys(plan)))

        def probe(batches: Iterator[pd.DataFrame], plan=plan, sent=sent) -> Iterator[pd.DataFrame]:
            bits = sent.value
            for b in batches:
                for length, at in _by_length(b["word"]):
                    step = max(1, AT_ONCE // (length * len(letters)))
                    for i in range(0, len(at) if length in plan or length - 1 in plan else 0, step):
                        some = b.iloc[at[i : i + step]]
                        for row, edit in _edits(codes(some["word"].tolist(), length), letters, plan, bits):
                            got = some.iloc[row]
                            yield pd.DataFrame({"word": got["word"].to_numpy(), "n": got["n"].to_numpy(), "near": edit})

        part = settle(dealt.mapInPandas(probe, "word string, n bigint, near string"))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def _roots(formed: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form: the last one reached. Pointer doubling; one number a step reaches the driver."""
    up = settle(formed)
    while True:
        after = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(up.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = stepped.select("word", "root")
        if not stepped.agg(F.max("moved")).first()[0]:
            return up


def variants(words: DataFrame, *, times: int = 2, budget: int = ROUND_BYTES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of a table ``(word, n)`` whose words are distinct.

    A form is at least ``times`` (two or more) as frequent as its word.
    """
    words = settle(words)
    both = pairs(words, budget=budget).select(F.inline(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    good = -F.col("best.minus") >= times * F.col("n")
    formed = settle(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")))
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
