"""Quality rules whose cutoffs carry a risk guarantee. DataFrame functions only.

Counts are taken from each whole text in its own row, without a shuffle. The rules compare five shares with cutoffs that form
a ladder from lenient to strict; a stratum (language) uses one level of the ladder. A level is certified when the labelled
holdout shows, by an exact binomial test, that it wrongly rejects more than ``risk`` of the stratum's good documents with
probability ``delta`` at most:

* the p-value of level ``l`` is ``P(Bin(n, risk) <= k)`` with ``n`` good documents of which ``l`` rejects ``k``;
* levels are tested in a fixed order, lenient first, and testing stops at the first that fails (no price for the levels);
* strata are many, so each is tested at ``delta / strata`` (Bonferroni).

Levels are nested, so the strictest level certified is used; a stratum without one has no rules beyond the base rules.

Defined results: null text has no words; a null stratum is a stratum of its own, the empty string with it; labels of unknown
documents and null labels are ignored; a document labelled twice counts as good only if all its labels say so; repeated rows
each keep a row; columns that ``docs`` has besides those named are ignored, or carried where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import BLANK_CHARS, BLANK_CLASS, literal_table

WINDOW = 5
#: Cutoffs per level: symbols a character of words, repeated lines a line, capitals a character of words, exclamation marks a word, words that repeat the word before.
LADDER = (
    (0.40, 0.95, 0.70, 1.80, 0.95), (0.30, 0.80, 0.60, 1.00, 0.80), (0.20, 0.60, 0.50, 0.60, 0.60),
    (0.12, 0.50, 0.40, 0.40, 0.45), (0.06, 0.45, 0.32, 0.25, 0.35), (0.04, 0.40, 0.25, 0.15, 0.30),
)
SHARES = ("symbol_share", "dup_line_share", "caps_share", "bang_share", "echo_share")
#: So many strata are sent along as literals; beyond, they stay a table.
MOST_LOCAL = 500
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``stratum``, the base counts and the shares of every row; ``carry`` keeps input columns in a struct ``_row``.

    Shingles are compared by 64-bit hashes. Only texts that repeat a shingle sort their shingles.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*carry).alias("_row")] if carry else []
    d = docs.select(*kept, "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", BLANK_CLASS), ""))
    d = d.withColumn("n_words", F.size("_w").cast("bigint"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    h = lambda i: F.get(F.col("_h"), i)
    d = d.withColumn(
        "_s",
        F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.expr(f"slice(_h, 1, size(_h) - {WINDOW - 1})"), lambda x, i: F.xxhash64(x, *(h(i + k) for k in range(1, WINDOW))))
        ),
    )
    d = d.withColumn("_echo", F.size(F.filter("_h", lambda x, i: x == h(i - 1))))
    d = d.withColumn(
        "_p",
        F.when(F.size(F.array_distinct("_s")) < F.size("_s"), F.sort_array(F.transform("_s", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    at = lambda k: F.get(F.col("_p"), k)["x"]
    d = d.withColumn("_r", F.sort_array(F.transform(F.filter("_p", lambda p, k: F.coalesce(p["x"] == at(k - 1), F.lit(False)) | F.coalesce(p["x"] == at(k + 1), F.lit(False))), lambda p: p["i"])))
    step = F.transform("_r", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_r"), k + 1) - p, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != ""))
    d = d.withColumns(
        {
            "word_chars": (F.length("_t") - _removed(F.col("_t"), BLANK_CHARS)).cast("bigint"),
            "n_symbols": _removed(F.col("_t"), "#*$%&|<>").cast("bigint"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
            "_lines": F.size("_l"),
            "_caps": _removed(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_bangs": _removed(F.col("_t"), "!"),
        }
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    pairs = (("n_symbols", "word_chars"), ("n_dup_lines", "_lines"), ("_caps", "word_chars"), ("_bangs", "n_words"), ("_echo", "n_words"))
    return d.select(*(["_row"] if carry else []), "doc_id", "stratum", *BASE, *(share(a, b).alias(n) for n, (a, b) in zip(SHARES, pairs)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def strictness(ladder: Sequence[Sequence[float]] = LADDER) -> Column:
    """The most lenient level (1 first) that rejects the row; one past the ladder where none does."""
    out = F.lit(len(ladder) + 1)
    for level in range(len(ladder), 0, -1):
        hit = F.lit(False)
        for name, cut in zip(SHARES, ladder[level - 1]):
            hit = hit | (F.col(name) > cut)
        out = F.when(hit, F.lit(level)).otherwise(out)
    return out


def _log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1 by Stirling's series after eight steps up; good to about 1e-12."""
    y = x + 8.0
    steps = sum((F.ln(x + float(k)) for k in range(1, 8)), F.ln(x))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)`` for ``k < n * p``; 1 from there on.

    The mass at ``k`` times the sum of the falling ratios below it: terms further than 40 deviations away are below 1e-300.
    """
    k, n = k.cast("double"), n.cast("double")
    log_mass = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, 50 + 40 * F.sqrt(n * p)).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(0), reach), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, j: F.struct(
            (a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (a["total"] + a["term"]).alias("total")
        ),
        lambda a: a["total"],
    )
    return F.when((n > 0) & (k < n * p), F.least(F.lit(1.0), F.exp(log_mass) * terms)).otherwise(1.0)


def calibrate(counted: DataFrame, labels: DataFrame, *, risk: float = 0.05, delta: float = 0.05, ladder: Sequence[Sequence[float]] = LADDER) -> DataFrame:
    """``(stratum, level, n_good, n_rejected, p_value)``: the strictest certified level of each stratum that has one.

    ``counted`` comes from :func:`counts`; all labelled documents take part. Counting per stratum and level is a map-side
    aggregate to a few rows; the rest is arithmetic on those.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    seen = counted.join(good, "doc_id").select("stratum", strictness(ladder).alias("hit")).groupBy("stratum", "hit").agg(F.count(F.lit(1)).alias("n"))
    per = seen.groupBy("stratum").agg(F.sum("n").alias("n_good"), *(F.sum(F.when(F.col("hit") <= i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(1, len(ladder) + 1)))
    strata = per.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    tests = per.select(
        "stratum", "n_good", strata.scalar().alias("strata"),
        F.posexplode(F.array(*(F.col(f"k{i}") for i in range(1, len(ladder) + 1)))).alias("at", "n_rejected"),
    )
    tests = tests.select("stratum", "n_good", "n_rejected", (F.col("at") + 1).alias("level"), "strata", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk).alias("p_value"))
    failed = F.min(F.when(F.col("p_value") > delta / F.col("strata"), F.col("level")))
    stop = tests.groupBy("stratum").agg(F.coalesce(failed, F.lit(len(ladder) + 1)).alias("stop"))
    return tests.join(stop, "stratum").where(F.col("level") == F.col("stop") - 1).select("stratum", "level", "n_good", "n_rejected", "p_value")


def judged(docs: DataFrame, labels: DataFrame, *, risk: float = 0.05, delta: float = 0.05, ladder: Sequence[Sequence[float]] = LADDER, carry: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` with its counts, shares, ``level`` (of its stratum; 0 without), ``base_failed`` and ``kept``.

    The levels are one row a stratum: Spark sends them to the tasks while they are small, and joins them otherwise.
    """
    levels = calibrate(counts(docs), labels, risk=risk, delta=delta, ladder=ladder).select("stratum", "level")
    known = levels.limit(MOST_LOCAL + 1).collect()
    if len(known) <= MOST_LOCAL:
        levels = literal_table(docs.sparkSession, known, levels.schema)
    out = counts(docs, carry).join(levels, "stratum", "left")
    level = F.coalesce(F.col("level"), F.lit(0))
    failed = base_failed()
    out = out.withColumns({"level": level, "base_failed": failed, "_verdict": ~failed & (strictness(ladder) > level)})
    # A filter on a generated column stays above; pushed down, it would repeat every step of the counts inside itself.
    return out.withColumn("kept", F.explode(F.array("_verdict"))).drop("_verdict")
