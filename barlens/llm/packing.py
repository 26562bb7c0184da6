"""Packing of tokenised documents into windows by non-negative least squares on the length histogram.

A document's ids (with a closing 0) are cut at multiples of the window, so whole windows fill themselves and each document
leaves one rest. What is left is a histogram of at most ``window - 1`` lengths, whatever the corpus:

1. *Enumerate* shallow combinations: every pair of lengths, and triples on a grid of lengths, that fill a window exactly.
2. *Solve* ``min |A x - h|, x >= 0`` for the repeat counts ``x`` against the histogram ``h``.
3. *Round* down and take the counts in turn, so that no length is used more often than it occurs.
4. *Greedily pack* what rounding leaves: again on the histogram, longest first, each window filled with the longest lengths
   that fit; one step packs as many equal windows as there are pieces for.

The driver sees the histogram and the resulting recipes (a recipe is a combination and how often it is used), both bounded
by the window. Pieces learn their place in Spark: a piece's rank among those of its length, found block by block, names the
recipe, the window in it and the offset. No order over all pieces, and no group grows with the corpus.

Defined results: null text counts as empty (a document of the closing id alone); repeated rows are packed one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches, settle, tokenizer_file

WINDOW = 1024
#: Pieces of one length that one task numbers.
RANK_BLOCK = 50_000
#: Spellings whose ids a task remembers at most.
REMEMBERED = 800_000


# The splitter of byte-level BPE, and the printable bytes that it spells as themselves.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, from a ``tokenizers`` file.

    The splitter of byte-level BPE never joins what a single space between two visible characters parts. So a text is cut
    there, parts and the splitter's pieces are remembered, and only unseen pieces go to the tokenizer's model. A text that
    holds the spelling of an added token, and every text of another kind of tokenizer, is encoded whole. :meth:`many` looks
    the distinct words of many texts up once.
    """

    def __init__(self, path: str) -> None:
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        made = json.loads(self.full.to_str())
        before = made["pre_tokenizer"] or {}
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made["normalizer"]
        self.known: dict[str, bytes] = {}
        self.runs, self.cut, self.split = re.compile(r"\s\s|^\s|\s$"), re.compile(r"(?<=[!-~]) (?=[!-~])"), regex.compile(SPLITTER).findall
        spare = iter(range(256, 512))
        self.spelling = {b: chr(b) if b in PRINTABLE else chr(next(spare)) for b in range(256)}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spelling))]
            ids = self._keep(piece, struct.pack(f"<{len(ids)}I", *ids))
        return ids

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(part) < 64:
            self.known[part] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            ids = self._piece(part) if part[1:].isalpha() and part[0] == " " else self._keep(part, b"".join(map(self._piece, self.split(part))))
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(a in text for a in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.cut.split(text) if self.runs.search(text) else text.split(" ")
        get, part = self.known.get, self._part
        return part(parts[0]) + b"".join([get(p) or part(p) for p in map(" ".__add__, parts[1:])])

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that begin with a single space and end visibly, so that the splitter cuts between them in one long text."""
        out = list(map(self.known.get, parts))
        unseen = [i for i, ids in enumerate(out) if ids is None]
        pieces = iter(self.split("".join([parts[i] for i in unseen])))
        for i in unseen:
            part, ids, done = parts[i], [], 0
            while done < len(part):
                piece = next(pieces)
                ids.append(self._piece(piece))
                done += len(piece)
            out[i] = ids[0] if len(ids) == 1 else self._keep(part, b"".join(ids))
        return out

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of an array of strings, as a call for each would give them."""
        texts = texts.fill_null("")
        if not self.plain or not len(texts):
            return [self(t) for t in texts.to_pylist()]
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        spelled = coded.dictionary.to_pylist()
        # a word that is empty or has white space at an end comes of a space that does not stand alone
        alone = np.array([bool(w) and not w[0].isspace() and not w[-1].isspace() for w in spelled])
        ids: list[bytes] = [b""] * len(spelled)
        for i, part in zip(at := np.flatnonzero(alone).tolist(), self._parts([" " + spelled[i] for i in at])):
            ids[i] = part
        codes = coded.indices.to_numpy()
        bounds = pc.list_value_length(words).to_numpy().cumsum().tolist()
        starts = [0, *bounds[:-1]]
        whole = ~np.logical_and.reduceat(alone[codes], starts)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        out = []
        for i, (a, b) in enumerate(zip(starts, bounds)):
            if whole[i]:
                out.append(self(texts[i].as_py()))
            else:
                out.append(self._part(spelled[codes[a]]) + b"".join([ids[c] for c in codes[a + 1 : b].tolist()]))
        return out


def pieces(docs: DataFrame, *, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: every document cut at multiples of the window."""
    bound_batches(docs.sparkSession)
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for b in batches:
            out = []
            for i, ids in zip(b["doc_id"].to_pylist(), encode.many(b["text"])):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                out += [(i, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def combinations(lengths: np.ndarray, window: int, grid: int) -> np.ndarray:
    """Rows of three lengths (0 for none) that sum to the window: all pairs, and triples whose lengths occur and lie on a grid."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    a = lengths[lengths <= window // 2]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)[has[window - a]]
    coarse = lengths[lengths % grid == 0]
    x, y = (m.ravel() for m in np.meshgrid(coarse, coarse))
    z = window - x - y
    ok = (x <= y) & (z >= y)
    ok[ok] &= has[z[ok]]
    return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], 1)])


def repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """``argmin |A x - h|`` over ``x >= 0`` by accelerated projected gradients; ``A`` counts each length in each combination.

    ``A`` is never formed: its products are gathers and a scatter over three columns.
    """
    if not len(combos):
        return np.zeros(0)
    top, used = len(histogram), combos > 0
    mul = lambda x: np.bincount(combos[used], (used * x[:, None])[used], top)
    back = lambda r: (r[combos] * used).sum(1)
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = back(mul(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(mul(y) - histogram) / (1.05 * size))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


def recipes(histogram: np.ndarray, window: int = WINDOW, grid: int = 16) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; together they hold every piece counted in ``histogram[1..window]`` once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], often: int) -> None:
        need = np.bincount(combo, minlength=window + 1)
        often = min([often, *(int(left[i] // need[i]) for i in set(combo))])
        if often > 0:
            left[:] -= often * need
            out.append((combo, often))

    take((window,), int(left[window]))
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window, grid)
    counts = repeats(combos, left.astype(float))
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 1:
            break
        take(tuple(int(c) for c in combos[i] if c), int(counts[i]))
    while left.any():
        here = left.copy()
        combo: list[int] = []
        room = window
        while room and (fits := np.flatnonzero(here[1 : room + 1])).size:
            n = int(fits[-1]) + 1
            combo.append(n)
            here[n] -= 1
            room -= n
        take(tuple(combo), int(left[combo[0]]))
    return out


def pack(cut: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`pieces`."""
    cut = settle(cut)
    spark = cut.sparkSession
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each length up to the window
    histogram = np.zeros(window + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    places, first, used = [], 0, np.zeros(window + 1, np.int64)
    for combo, often in recipes(histogram, window):
        offset = 0
        for n in combo:
            places.append((n << 44 | int(used[n]), first, int(used[n]), offset))
            used[n] += often
            offset += n
        first += often
    # A place is a run of ranks of one length: (length and lowest rank, first sequence, lowest rank, offset).
    runs = np.array(sorted(places), np.int64).reshape(-1, 4)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b.pop("rank").to_numpy()
            at = np.searchsorted(runs[:, 0], (b["length"].to_numpy() << 44) | rank, "right") - 1
            yield b.assign(sequence_id=runs[at, 1] + rank - runs[at, 2], offset=runs[at, 3])

    blocks = F.array(*(F.lit(-(-int(n) // RANK_BLOCK)) for n in histogram))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(blocks, F.col("length").cast("int"))))
    before = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "block"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
