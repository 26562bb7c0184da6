"""Quality classifier: ordinal regression with cumulative links.

Ratings are graded: 0 for a poor document, 1 for a sound one that is toxic, 2 for a sound and clean one. One weight vector
over hashed text is shared by all grades; ordered thresholds turn the score ``s`` into tail probabilities

    P(grade >= k) = sigmoid(s - theta_k),   theta_1 <= theta_2,

so that the expected grade is their sum. Thresholds stay ordered because the model learns the first and the logs of the gaps.

Features are counts of hashed words and of hashed word shapes (capitals, small letters, digits, each other sign by itself)
and of "the same word as before", as square roots of shares: every document has length 1. The model is fitted on a bounded
sample of labelled documents (``sample``, drawn by hash); scoring covers every document, in its own row.

A document is kept if it is more likely sound than poor and its ``p_clean`` reaches the model's cutoff. The cutoff is chosen
on labelled documents that the fit has not seen (a quarter as many): at most LOSS of the clean ones fall below it.

Defined results: null text has no features and gets the prior; a document rated twice counts with its lowest grade; ratings
of unknown documents and null ratings are ignored; without two grades to learn from nothing can be told apart and all rows
score as the grade there is (the best grade without any); repeated rows each keep a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches, unit_hash

GRADES = 3
SIZE = 1 << 16
#: Labelled documents that the fit uses at most, on average.
SAMPLE = 8000
#: Share of the labelled documents drawn that the fit leaves for the choice of the cutoff, and of the clean ones that may go.
HELD, LOSS = 0.2, 0.01
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


class _Words(dict):
    """Word to its hash (31 bits) and, below, the feature number of its shape; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.lower()) & 0x7FFFFFFF
        out = h << 16 | xxhash.xxh3_64_intdigest(word.translate(_SHAPE)[-4:], 1) % SIZE
        if len(word) < 64:
            self[word] = out
        return out


def features(text: str | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and values of a text; ``known`` remembers words from text to text."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    h = both >> 16
    same = int((h[1:] == h[:-1]).sum())
    every = np.concatenate([h % SIZE, both % SIZE, np.zeros(same, np.int64)])
    at, n = np.unique(every, return_counts=True)
    return at.astype(np.int32), np.sqrt(n / len(every)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Shared weights, ordered thresholds, and the least ``P(grade = 2)`` of a document that is kept."""

    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = 0.5

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for ``k = 1 ..`` as columns."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, texts: Sequence[str | None], known: dict[bytes, int] | None = None) -> np.ndarray:
        out, known = np.zeros(len(texts)), _Words() if known is None else known
        for i, t in enumerate(texts):
            at, x = features(t, known)
            out[i] = self.weights[at] @ x
        return out


def fit_arrays(at: np.ndarray, x: np.ndarray, row: np.ndarray, grade: np.ndarray, *, steps: int = 200, rate: float = 0.5, ridge: float = 2e-6) -> Model:
    """Maximum likelihood with a small ridge penalty by Adam over the whole sample; deterministic."""
    n, k = len(grade), GRADES - 1
    seen = np.unique(grade) if n else np.array([GRADES - 1])
    if len(seen) < 2:
        return Model(np.zeros(SIZE), np.where(np.arange(1, k + 1) <= seen[0], -40.0, 40.0))
    size = SIZE + k
    p, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    p[SIZE + 1 :] = 0.5
    for step in range(1, steps + 1):
        theta = np.concatenate([[p[SIZE]], p[SIZE] + np.cumsum(np.exp(p[SIZE + 1 :]))])
        s = np.bincount(row, p[at] * x, n)
        cum = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - theta), np.zeros((n, 1))], 1)
        slope = cum * (1 - cum)
        here = np.arange(n)
        mass = np.maximum(cum[here, grade] - cum[here, grade + 1], 1e-12)
        ds = -(slope[here, grade] - slope[here, grade + 1]) / mass / n
        dt = np.array([((grade == j) * slope[:, j] / mass - (grade == j - 1) * slope[:, j] / mass).sum() / n for j in range(1, k + 1)])
        g = np.concatenate([np.bincount(at, ds[row] * x, SIZE) + ridge * p[:SIZE], [dt.sum()], np.exp(p[SIZE + 1 :]) * dt[1:][::-1].cumsum()[::-1]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(p[:SIZE].copy(), np.concatenate([[p[SIZE]], p[SIZE] + np.cumsum(np.exp(p[SIZE + 1 :]))]))


def clean_cutoff(clean: np.ndarray, other: np.ndarray, loss: float = LOSS) -> float:
    """The ``p_clean`` to ask for, from those of held-out clean documents and of the others.

    At most ``loss`` of the clean ones lie below it, and none for whose loss no other document goes. One half without clean
    documents, nothing without others.
    """
    if not len(clean):
        return 0.5
    clean = np.sort(clean)
    most = clean[int(loss * len(clean))]
    below = other[other < most]
    return float(clean[np.searchsorted(clean, below.max(), "right")]) if len(below) else 0.0


def ratings(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` from ``quality`` and ``toxic``."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).cast("int").alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, *, sample: int = SAMPLE, seed: int = 1) -> Model:
    """Fit on at most about ``sample`` documents of ``graded`` that ``docs`` has, and choose the cutoff on others.

    Their features reach the driver, not their texts.
    """
    n, most = graded.count(), sample / (1 - HELD)
    share = most / n if n > most else 1.0
    draw = unit_hash("doc_id", seed=seed)
    drawn = graded.withColumn("held", draw >= share * (1 - HELD)).where(draw < share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in batches:
            f = [features(t, known) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "held": b["held"], "at": [a.tobytes() for a, _ in f], "x": [x.tobytes() for _, x in f]})

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(drawn, "doc_id").mapInPandas(run, "doc_id bigint, grade int, held boolean, at binary, x binary")
    got = sorted(rows.collect())
    at, x = ([np.frombuffer(r[c], kind) for r in got] for c, kind in (("at", np.int32), ("x", np.float32)))
    grade, held = np.array([r["grade"] for r in got], int), np.array([r["held"] for r in got], bool)
    some = np.flatnonzero(~held)
    join = lambda parts, kind: np.concatenate([np.empty(0, kind), *(parts[i] for i in some)])
    row = np.repeat(np.arange(len(some)), [len(at[i]) for i in some])
    model = fit_arrays(join(at, np.int32), join(x, np.float32), row, grade[some])
    p = model.tails(np.array([model.weights[at[i]] @ x[i] for i in np.flatnonzero(held)], float))[:, -1]
    model.cutoff = clean_cutoff(p[grade[held] == GRADES - 1], p[grade[held] < GRADES - 1])
    return model


def scored(docs: DataFrame, model: Model, *, carry: Sequence[str] = (), least: float | None = None, tail: int = GRADES - 1) -> DataFrame:
    """``doc_id``, ``score``, ``p_sound`` (grade 1 or more), ``p_clean`` (grade 2), ``expected_grade``, ``kept`` per row.

    ``kept`` asks for ``p_sound >= 0.5`` and ``p_clean >= model.cutoff``, or else, where ``least`` is given, for
    ``P(grade >= tail) >= least``. ``carry`` puts input columns into a struct ``_row``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in batches:
            s = model.scores(b.pop("_t").tolist(), known)
            p = model.tails(s)
            yield b.assign(score=s, p_sound=p[:, 0], p_clean=p[:, 1], expected_grade=p.sum(1), kept=(p[:, 0] >= 0.5) & (p[:, -1] >= model.cutoff) if least is None else p[:, tail - 1] >= least)

    bound_batches(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(carry))]
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_t"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("doc_id", *names)) + ", score double, p_sound double, p_clean double, expected_grade double, kept boolean"
    out = d.mapInPandas(run, schema)
    rows = [F.struct(*(F.col(n).alias(c) for c, n in zip(carry, names))).alias("_row")] if carry else []
    return out.select(*rows, "doc_id", "score", "p_sound", "p_clean", "expected_grade", "kept")
