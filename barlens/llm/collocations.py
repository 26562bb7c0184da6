"""Phrases of two or three words that stay together, per language.

Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words ``[^\\x20\\x09]+``. A phrase never
leaves its piece. Of the phrases found ``least`` times or more, each is scored at its weakest cut, ``scale * a * a / (l * r)``
with the counts of the whole and of both parts, and dropped where a longer one holds most of its occurrences.

1. *Apriori-safe candidates.* A phrase is only as frequent as its parts: words are counted, then pairs of words that can be
   frequent, then triples of such pairs. They are counted as 64-bit hashes with map-side sums, and frequent ones lie in blocked
   Bloom filters of at most FILTER_BYTES; neither ever loses a frequent phrase, whatever its size or its collisions. One more
   reading spells out the longest candidate that starts at each word, with its occurrences, which tasks sum before they move.
2. *Double-array tries.* Candidates are gathered in rounds of at most ROUND_BYTES, each in order dealt into tries of at most
   SHARD_BYTES: a word is two arcs (the digits of its number), a node's arcs lie at ``base + arc``, ``check`` names its owner.
3. *Counting.* All candidates of a trie move level by level, and each leaves its occurrences at every node it visits: those of a
   candidate and of all it begins with. Counts of equal nodes are summed over the tries. They are exact: words are compared
   whole, every candidate begins with candidates only, and each occurrence is in the longest one at its place.

Texts are read four times, however many candidates there are, and no trie leaves its task.

The first ``top`` of each language come from a ranking whose tasks keep their own first ones before any row moves.

Defined results: null and empty texts have no words; a null language is UNKNOWN; repeated rows count each time; ``doc_id`` and
other columns are ignored; ties follow the order of the phrase's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm import blocked_bloom
from barlens.llm.common import bound_batches, mix64, settle

UNKNOWN = "und"
LEAST, TOP, SCALE = 10, 2000, 1_000_000
#: Bounds of a filter sent to tasks, of one trie's candidates, and of the candidates that a task gathers for its tries.
FILTER_BYTES, SHARD_BYTES, ROUND_BYTES = 32 << 20, 16 << 20, 64 << 20
#: Bytes that a candidate takes in a trie besides its words.
NODE_BYTES = 40
#: Arcs of a node that shares its slots with others.
NARROW = 8
#: Hashes that a task gathers before it sends their sums on, and words hashed at once.
HELD, AT_ONCE = 1 << 21, 1 << 13
BASE = 0x9E3779B97F4A7C15
WORDS = ("w1", "w2", "w3")
COUNTED = "lang string, w1 binary, w2 binary, w3 binary, n bigint"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def split(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts in order, their letters and offsets, and whether the next word lies in the same piece."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts).lower(), np.uint8)
    kind = _KIND[data]
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    letters, offsets = data[word], np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    breaks = np.cumsum(kind == 2, dtype=np.int64 if len(kind) >> 31 else np.int32)
    joined = np.zeros(len(start), bool)
    joined[:-1] = breaks[start[1:]] == breaks[end[:-1] - 1]
    return words, letters, offsets, joined


def word_hashes(lang: str, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, which only ever prune: those of a language have a seed of their own."""
    out, lengths = np.empty(len(offsets) - 1, np.uint64), np.diff(offsets)
    power = np.full(int(lengths.max(initial=0)) + 1, BASE, np.uint64)
    power[0] = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) | 1
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(power)
        for i in range(0, len(out), AT_ONCE):
            some = lengths[i : i + AT_ONCE]
            first, last = offsets[i], offsets[i + len(some)]
            at = offsets[i : i + len(some)] - first
            place = np.arange(last - first) - np.repeat(at, some)
            out[i : i + len(some)] = np.add.reduceat((letters[first:last] + np.uint64(1)) * power[place], at)
    return mix64(out)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """Each batch's words by language, their hashes, and whether the next word lies in the same piece."""
    for b in batches:
        lang, text = b["lang"], b["text"]
        for name in pc.unique(lang).to_pylist():
            words, letters, offsets, joined = split(text.filter(pc.equal(lang, name)).to_pylist())
            if len(words):
                yield name, words, word_hashes(name, letters, offsets), joined


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession, rows=4000)
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))


def _followed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with one more word."""
    with np.errstate(over="ignore"):
        return mix64(h * np.uint64(0xD6E8FEB86659FD93) + more)


def _filter(keys: DataFrame, rows: int):
    """A filter of the hashes ``h`` (one a row), sent to the tasks; beyond its bound it gets less selective, not wrong."""
    blocks = min(blocked_bloom.blocks_for(rows), FILTER_BYTES // blocked_bloom.BLOCK_BYTES)

    def hashes(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        h = b["h"].to_numpy().view(np.uint64)
        return h, blocked_bloom.place(h, blocks)

    return keys.sparkSession.sparkContext.broadcast(blocked_bloom.build(keys.select("h"), blocks, hashes))


def _inside(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    out[blocked_bloom.passing(bits, h, blocked_bloom.place(h, len(bits)))] = True
    return out


def _phrases(h: np.ndarray, joined: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """``(length, first positions, hashes, which its filter holds)`` of the words, of pairs whose words the first filter holds, and
    of triples whose pairs the second one holds; the longest of them have no filter unless there are three."""
    first = np.arange(len(h))
    good = _inside(filters[0], h) if filters else None
    yield 1, first, h, good
    if filters:
        first = np.flatnonzero(joined[:-1] & good[:-1] & good[1:])
        pair = _followed(h[first], h[first + 1])
        kept = _inside(filters[1], pair) if len(filters) > 1 else None
        yield 2, first, pair, kept
    if len(filters) > 1:
        first, pair = first[kept], pair[kept]
        # triples: this pair is kept, and so is the one that starts at the next position
        two = np.flatnonzero(first[1:] == first[:-1] + 1)
        first, pair = first[two], pair[two]
        triple = _followed(pair, h[first + 2])
        yield 3, first, triple, _inside(filters[2], triple) if len(filters) > 2 else None


def _summed(batches: Iterator[pa.RecordBatch], filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Hashes of phrases one word longer than there are filters, and how often each occurs."""

    def sums(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())})

    held, rows = [], 0
    for _, _, h, joined in _batches(batches):
        *_, (_, _, found, _) = _phrases(h, joined, filters)
        held.append(found)
        rows += len(found)
        if rows >= HELD:
            yield sums(held)
            held, rows = [], 0
    if rows:
        yield sums(held)


def _spelled(batches: Iterator[pa.RecordBatch], filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The longest phrase at each word that may be frequent, each once a batch with its occurrences; told apart by their words.

    The row without words counts all words of the batch.
    """
    for lang, words, h, joined in _batches(batches):
        longest = np.zeros(len(words) + 2, np.int8)
        for k, first, _, kept in _phrases(h, joined, filters):
            longest[first[kept]] = k
        # words of a kept phrase are kept themselves; 0 stands for no word
        place = np.flatnonzero(longest)
        coded = words.take(pa.array(place)).dictionary_encode()
        at, known = np.zeros(len(longest), np.int64), coded.dictionary.cast(pa.binary())
        at[place] = coded.indices.to_numpy() + 1
        some = np.stack([np.where(longest[place] > i, at[place + i], 0) for i in range(3)])
        if (base := len(known) + 1) ** 3 < 1 << 63:  # their numbers fit one integer
            packed, n = np.unique((some[0] * base + some[1]) * base + some[2], return_counts=True)
            some = np.stack([packed // base**2, packed // base % base, packed % base])
        else:
            some, n = np.unique(some, axis=1, return_counts=True)
        some, n = np.c_[np.zeros(3, np.int64), some], np.r_[len(words), n]
        parts = [known.take(pa.array(row - 1, mask=row == 0)) for row in some]
        yield pa.record_batch({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(n)), **dict(zip(WORDS, parts)), "n": pa.array(n, pa.int64())})


def candidates(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """``(lang, w1, w2, w3, n)``: the longest phrase at each word that may occur ``least`` times or more, and how often it is.

    All frequent words, pairs and triples are among these phrases and what they begin with, and few others. Words that a phrase
    does not have are null; the row of a language that has no word at all counts its words.
    """
    texts, sent = _texts(docs), []
    for _ in range(3):

        def run(batches: Iterator[pa.RecordBatch], sent=tuple(sent)) -> Iterator[pa.RecordBatch]:
            return _summed(batches, [s.value for s in sent])

        keys = settle(texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"))
        sent.append(_filter(keys, keys.count()))
    every = tuple(sent)
    return _sums(texts.mapInArrow(lambda batches: _spelled(batches, [s.value for s in every]), COUNTED))


def _sums(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))


def trie(arcs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(base, check, states)`` of a double-array trie; columns of ``arcs`` are its distinct sequences in sorted order.

    Node 0 is the root; the child of node ``s`` by arc ``x`` (below ``width``) lies at ``base[s] + x`` and is owned by ``s``:
    ``check[base[s] + x] == s``. An arc of -1 ends a sequence. ``states`` has the node of every sequence after each arc. A node
    with more than NARROW arcs has a stretch of its own; the others share slots, each at the first place drawn that is free.
    """
    levels, rows = arcs.shape
    new = np.zeros((levels, rows), bool)
    differs = np.zeros(rows, bool)
    differs[:1] = True
    for k in range(levels):
        differs[1:] |= arcs[k, 1:] != arcs[k, :-1]
        new[k] = differs & (arcs[k] >= 0)
    shared = width + 2 * int(new.sum()) + 2
    base, check = np.full(shared, -1, np.int64), np.full(shared, -1, np.int64)
    check[0] = 0
    rng = np.random.default_rng(5)
    node, states = np.zeros(rows, np.int64), np.full((levels, rows), -1, np.int64)
    for k in range(levels):
        live = np.flatnonzero(arcs[k] >= 0)
        if not len(live):
            break
        first = new[k][live]
        parent, arc = node[live][first], arcs[k][live][first]
        owner, at, fan = np.unique(parent, return_inverse=True, return_counts=True)
        wide = np.flatnonzero(fan > NARROW)
        more = np.full(len(wide) * width, -1, np.int64)
        start = np.full(len(owner), -1, np.int64)
        start[wide] = len(check) + np.arange(len(wide)) * width
        base, check = np.r_[base, more], np.r_[check, more]
        own = np.flatnonzero(fan[at] > NARROW)
        check[start[at[own]] + arc[own]] = parent[own]
        todo = np.flatnonzero(fan[at] <= NARROW)
        while len(todo):
            trying = np.unique(at[todo])
            start[trying] = rng.integers(1, shared - width + 1, len(trying))
            slot = start[at[todo]] + arc[todo]
            order = np.argsort(slot, kind="stable")
            clash = check[slot] >= 0
            clash[order[1:]] |= slot[order[1:]] == slot[order[:-1]]
            bad = np.zeros(len(owner), bool)
            bad[at[todo[clash]]] = True
            fits = ~bad[at[todo]]
            check[slot[fits]] = parent[todo[fits]]
            todo = todo[~fits]
        base[owner] = start
        states[k, live] = (start[at] + arc)[np.cumsum(first) - 1]
        node[live] = states[k, live]
    return base, check, states


def _numbers(known: pa.Array, values) -> np.ndarray:
    """The number of each word among the known ones; -1 for none."""
    return pc.fill_null(pc.index_in(values, value_set=known, skip_nulls=True), -1).to_numpy().astype(np.int64)


def _visits(g: pa.Table) -> Iterator[pa.RecordBatch]:
    """How many occurrences visit each node of the tries of a round, with the words that lead there."""
    g = g.combine_chunks()
    known = pc.unique(pa.chunked_array([c for name in WORDS for c in g[name].chunks])).drop_null()
    langs = pc.unique(g["lang"])
    width = max(int(np.ceil(np.sqrt(len(known)))), len(langs))
    lang, numbers, n = _numbers(langs, g["lang"]), [_numbers(known, g[name]) for name in WORDS], g["n"].to_numpy()
    order = np.lexsort((*numbers[::-1], lang))
    for rows in np.array_split(order, -(-_bytes(g) // SHARD_BYTES)):
        if not len(rows):
            continue
        words = [x[rows] for x in numbers]
        _, check, states = trie(np.stack([lang[rows], *(np.where(x < 0, -1, d) for x in words for d in (x // width, x % width))]), width)
        seen = np.zeros(len(check), np.int64)
        for k in (1, 2, 3):
            inside = states[2 * k] >= 0
            np.add.at(seen, states[2 * k][inside], n[rows[inside]])
        for k in (1, 2, 3):
            node, at = np.unique(states[2 * k], return_index=True)
            node, at = node[node >= 0], at[node >= 0]
            parts = [known.take(pa.array(x[at])) if i < k else pa.nulls(len(at), pa.binary()) for i, x in enumerate(words)]
            yield pa.record_batch({"lang": langs.take(pa.array(lang[rows[at]])), **dict(zip(WORDS, parts)), "n": pa.array(seen[node])})


def _bytes(g: pa.Table | pa.RecordBatch) -> int:
    return g.nbytes + NODE_BYTES * g.num_rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of candidates and all they begin with, a round at a time; rows without words pass as they are."""
    held, room = [], 0
    for b in batches:
        bare = pc.is_null(b["w1"])
        if pc.any(bare).as_py():
            yield b.filter(bare)
            b = b.filter(pc.invert(bare))
        if room and room + _bytes(b) > ROUND_BYTES:
            yield from _visits(pa.Table.from_batches(held))
            held, room = [], 0
        if b.num_rows:
            held.append(b)
            room += _bytes(b)
    if held:
        yield from _visits(pa.Table.from_batches(held))


def phrase_counts(found: DataFrame) -> DataFrame:
    """``(lang, w1, w2, w3, n)``: exact counts of the candidates ``found`` and of all they begin with.

    The row of a language that has no word at all counts its words.
    """
    return _sums(found.mapInArrow(_counted, COUNTED))


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    counts = settle(phrase_counts(candidates(docs, least=least)).where((F.col("n") >= least) | F.col("w1").isNull()))
    totals = counts.where("w1 is null").select("lang", F.col("n").alias("total"))
    one = counts.where("w1 is not null and w2 is null")
    twos = counts.where("w2 is not null and w3 is null")
    triples = counts.where("w3 is not null")
    firsts, lasts = one.select("lang", "w1", F.col("n").alias("n_first")), one.select("lang", F.col("w1").alias("last"), F.col("n").alias("n_last"))

    # of each pair: the largest count of a triple that holds it
    held = triples.select("lang", "n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    held = held.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("n").alias("longer"))
    pairs = twos.join(held, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("n")))
    pairs = pairs.join(firsts, ["lang", "w1"]).join(lasts.withColumnRenamed("last", "w2"), ["lang", "w2"])
    pairs = pairs.select("lang", "w1", "w2", "w3", F.col("n").alias("a"), F.array(F.struct(F.lit(1).alias("k"), F.col("n_first").alias("l"), F.col("n_last").alias("r"))).alias("cuts"))
    ends = twos.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("n_end"))
    starts = twos.select("lang", "w1", "w2", F.col("n").alias("n_start"))
    three = triples.join(starts, ["lang", "w1", "w2"]).join(ends, ["lang", "w2", "w3"]).join(firsts, ["lang", "w1"]).join(lasts.withColumnRenamed("last", "w3"), ["lang", "w3"])
    cuts = F.array(F.struct(F.lit(1).alias("k"), F.col("n_first").alias("l"), F.col("n_end").alias("r")), F.struct(F.lit(2).alias("k"), F.col("n_start").alias("l"), F.col("n_last").alias("r")))
    scored = pairs.unionByName(three.select("lang", "w1", "w2", "w3", F.col("n").alias("a"), cuts.alias("cuts")))

    # squares and products have 30 digits at most, the scaled ones 37
    whole = lambda c: c.cast("decimal(15,0)")
    score = lambda c: F.call_function("div", whole(F.col("a")) * whole(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)"), whole(c["l"]) * whole(c["r"]))
    best = F.array_min(F.transform("cuts", lambda c: F.struct(score(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    phrase = F.concat_ws(" ", F.col("w1").cast("string"), F.col("w2").cast("string"), F.col("w3").cast("string"))
    scored = scored.select("lang", phrase.alias("phrase"), "a", best.alias("best")).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").cast("bigint").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
