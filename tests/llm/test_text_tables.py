"""Packing, mixing, rollups, rules, licenses and the classifier on small tables."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("barlens.llm")
from pyspark.sql import functions as F  # noqa: E402

from barlens.llm import licenses, mixing, ordinal, packing, risk_rules, token_rollup  # noqa: E402
from barlens.llm.common import scratch_path, tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "Hello  world\n\n done ", "naïve café — 東京 123", "a<|endoftext|>b", "tab\tand space  x", "x" * 300, "it's we'll  I'm", "word " * 3000]


def test_ids_are_those_of_the_tokenizer():
    encode, full = packing.Encoder(tokenizer_file()), packing.Encoder(tokenizer_file()).full
    for t in TEXTS:
        assert np.frombuffer(encode(t), "<u4").tolist() == full.encode(t or "", add_special_tokens=False).ids, t


def test_ids_of_many_texts_are_those_of_the_tokenizer_and_a_word_is_looked_up_once():
    draw = random.Random(1)
    ends = ["a", "ab", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "'s", "'", "1", "#", "é", "漢", "\u0301", "<|endoftext|>", "<|endof"]
    texts = [*TEXTS, "a b" * 30000, *("".join(draw.choices(ends, k=draw.randint(0, 14))) for _ in range(3000))]
    encode = packing.Encoder(tokenizer_file())
    for t, ids in zip(texts, encode.many(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.full.encode(t or "", add_special_tokens=False).ids, t
    assert encode.many(pa.array([], pa.string())) == []
    asked = []

    class Known(dict):
        def get(self, part):
            asked.append(part)
            return dict.get(self, part)

    encode.known = Known(encode.known)
    common = pa.array(["same few words " * 50 + "end"] * 40)
    first = encode.many(common)
    asked.clear()
    assert encode.many(common) == first == first[:1] * 40 and asked.count(" few") == 1


def test_recipes_use_every_piece_once_with_little_padding():
    rng = np.random.default_rng(2)
    h = np.bincount(np.minimum(rng.geometric(1 / 300, 60000), 1024), minlength=1025)
    h[0] = 0
    got, used = packing.recipes(h), np.zeros(1025, int)
    for combo, often in got:
        assert sum(combo) <= 1024
        used += often * np.bincount(combo, minlength=1025)
    assert (used == h).all()
    windows, tokens = sum(n for _, n in got), (h * np.arange(1025)).sum()
    assert windows * 1024 / tokens < 1.01
    assert packing.recipes(np.zeros(1025, int)) == []


def test_least_squares_counts_are_optimal():
    h = np.bincount([100] * 40 + [924] * 40 + [512] * 20 + [300] * 10 + [724] * 5, minlength=1025).astype(float)
    lengths = np.flatnonzero(h)
    c = packing.combinations(lengths, 1024, 16)
    x = packing.repeats(c, h)
    a = np.stack([np.bincount(r[r > 0], minlength=1025) for r in c], 1)
    slope = a.T @ (a @ x - h)
    assert (x >= 0).all() and slope.min() > -1e-3 and abs(slope[x > 1e-6]).max() < 1e-2


def test_packing_keeps_every_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 3)
    docs = spark.createDataFrame([(i if i != 1 else None, t, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0)] + [(100 + i, "same few words", 0) for i in range(40)], "doc_id bigint, text string, offset int")
    got = packing.pack(packing.pieces(docs)).toPandas()
    encode = packing.Encoder(tokenizer_file())
    for i, t in enumerate(TEXTS):
        if i in (1, 3):
            continue
        ids = encode(t) + b"\0" * 4
        p = got[got.doc_id == i].sort_values("start")
        assert (p.doc_tokens == len(ids) // 4).all() and p.length.sum() * 4 == len(ids)
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(p.start, p.length)] == p.ids_crc32.tolist()
    assert len(got[got.doc_id == 3]) == 2
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def fill(budget, rooms, weights):
    """Water-filling by repetition."""
    got, open_ = [0.0] * len(rooms), set(range(len(rooms)))
    while budget > 1e-9 and open_:
        w, left = sum(weights[i] for i in open_), budget
        for i in list(open_):
            more = min(left * weights[i] / w, rooms[i] - got[i])
            got[i] += more
            budget -= more
            if rooms[i] - got[i] < 1e-9:
                open_.discard(i)
    return got


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 30), ("b", "x", "1", 500), ("c", "x", "1", 400), ("c", "x", "2", 0)]
    df = spark.createDataFrame([(*r[:3], 1, r[3]) for r in leaves], "domain string, lang string, source string, n bigint, tokens bigint")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, F.lit(900), {"domain": {"a": 4.0, "c": 0.0}, "lang": {"a/x": 3.0}}, 1).collect()}
    top = dict(zip("ab", fill(900, [1040, 500], [4, 1])))
    x, y = fill(top["a"], [1010, 30], [3, 1])
    one, two = fill(x, [10, 1000], [1, 1])
    want = {("a", "x", "1"): one, ("a", "x", "2"): two, ("a", "y", "1"): y, ("b", "x", "1"): top["b"], ("c", "x", "1"): 0, ("c", "x", "2"): 0}
    assert got == {k: math.floor(v + 1e-6) for k, v in want.items()}


def test_a_leaf_gives_whole_epochs_and_a_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)
    rows = [(i, "w " * (1 + i % 9), "en", "s", i) for i in range(300)] + [(7, "w w", "en", "s", 0), (None, "w", None, None, 0), (400, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, repeats int")
    p = mixing.plan(docs, domain=F.lit("d"), weights={}, share=1.4, max_epochs=2, seed=3)
    leaf = {r.source: r for r in p.collect()}
    got = mixing.mixed(docs, p, domain=F.lit("d"), seed=3).select("_row.*", F.col("repeats").alias("times")).collect()
    total = sum(len(r.text.split()) * r.times for r in got if r.source == "s" and r.text)
    big = leaf["s"]
    assert big.full == 1 and big.budget - 9 < total <= big.budget
    again = sorted((r.doc_id, r.times) for r in got if r.doc_id is not None)
    assert again == sorted((r.doc_id, r.times) for r in mixing.mixed(docs, p, domain=F.lit("d"), seed=3).select("_row.doc_id", F.col("repeats").alias("times")).collect() if r.doc_id is not None)
    assert mixing.mixed(docs.limit(0), mixing.plan(docs.limit(0), domain=F.lit("d"), weights={}, share=0.5), domain=F.lit("d")).count() == 0


def test_rollup_is_additive_and_idempotent(spark):
    r = token_rollup.Rollup(spark, scratch_path(spark, "t"), {"words": None, "bpe": tokenizer_file()})
    make = lambda rows: spark.createDataFrame([(*x, 0) for x in rows], "doc_id bigint, change string, text string, source string, lang string, seq int, tokens int")
    one = make([(1, "insert", "a b c", "s", "en", 1), (2, "insert", "d e", "s", "en", 1), (3, "insert", None, None, None, 1), (4, "insert", "x", "t", "de", 1), (4, "insert", "x y", "t", "de", 2), (None, "insert", "z", "t", "de", 1)])
    two = make([(1, "revise", "a", "t", "en", 1), (2, "delete", None, None, None, 1), (9, "delete", None, None, None, 1), (4, "insert", "x y z", "t", "de", 1)])
    assert r.commit("b1", one) and r.commit("b2", two)
    assert not r.commit("b1", one) and not r.commit("b2", two)
    got = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert {k: v for k, v in got.items() if k[2] == "words"} == {("t", "en", "words"): (1, 1), (None, None, "words"): (1, 0), ("t", "de", "words"): (1, 3)}
    n = lambda t: len(packing.Encoder(tokenizer_file())(t)) // 4
    assert got[("t", "de", "bpe")] == (1, n("x y z")) and got[("t", "en", "bpe")] == (1, n("a"))
    assert r.commit("b3", one.limit(0)) and r.totals().count() == len(got)


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 5, 60, 400, 5000) for k in range(0, n, max(1, n // 7))]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for r in df.select("k", "n", risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        want = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.05) + (r.n - i) * math.log(0.95)) for i in range(r.k + 1)) if r.k < r.n * 0.05 else 1
        assert r.p == pytest.approx(want, rel=1e-8)


def test_rules_count_whole_texts(spark):
    texts = [None, "", "\n\n", "a b c d e a b c d e f", "a " * 40, "x\nx\n x\n\ny", "É # $$ <b> |", "one two three four five " * 3 + "six"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, True) for i, t in enumerate(texts)] + [(3, texts[3], "en", True)], "doc_id bigint, text string, lang string, kept boolean")
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None), (77, 1)], "doc_id bigint, quality int")
    got = risk_rules.judged(docs, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, s in enumerate(g) if g.count(s) > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in risk_rules.BASE) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (r.level == 0) and r.kept == (not r.base_failed)
    assert risk_rules.judged(docs.limit(0), labels).count() == 0


def test_cutoffs_hold_the_risk(spark):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + (" !" * 20 if i < 4 else ""), "en") for i in range(300)]
    few = [(1000 + i, "some words " + " ".join(f"v{i}y{k}" for k in range(20)), "xx") for i in range(20)]
    docs = spark.createDataFrame(clean + few, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in clean + few], "doc_id bigint, quality int")
    got = {r.stratum: r for r in risk_rules.calibrate(risk_rules.counts(docs), labels).collect()}
    assert set(got) == {"en"} and got["en"].n_rejected <= 4 and got["en"].p_value <= 0.025


def test_licenses_are_found_where_they_stand(spark):
    gpl, mit = licenses.TEMPLATES["gpl-3.0"], licenses.TEMPLATES["mit-text"]
    texts = ["so it is. " * 9 + gpl, gpl.upper().replace(" ", "\n"), "none here", None, "", mit.replace("hereby", "now") + " more", " ".join(mit.split()[:8]), "Released under\tthe MIT license", "under the mit license released"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (None, gpl, "x")], "doc_id bigint, text string, license string")
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs).collect()}
    assert set(got) == {(0, "gpl-3.0"), (1, "gpl-3.0"), (None, "gpl-3.0"), (5, "mit-text"), (7, "mit")}
    assert 26 <= got[(0, "gpl-3.0")].first_word <= 27 and got[(0, "gpl-3.0")].containment == 1 and got[(5, "mit-text")].containment < 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_classifier_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    graded = ordinal.ratings(labels)
    hold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.fit(docs, graded.where(~hold))
    assert model.thresholds[0] < model.thresholds[1]
    got = ordinal.scored(docs, model).join(graded.where(hold), "doc_id").toPandas()
    assert got.kept[got.grade == 2].mean() > 0.97 and got.kept[got.grade == 0].mean() < 0.4
    assert got.expected_grade[got.grade == 2].mean() > got.expected_grade[got.grade == 1].mean() > got.expected_grade[got.grade == 0].mean()
    odd = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "text " * 50000, 1)], "doc_id bigint, text string, score int")
    assert ordinal.scored(odd, model).count() == 3
    none = ordinal.fit(odd, graded.limit(0))
    assert [r.kept for r in ordinal.scored(odd, none).collect()] == [True] * 3
    assert ordinal.scored(odd.limit(0), model).count() == 0


def test_cutoff_spares_clean_documents():
    clean, other = np.linspace(0.5, 1, 1000), np.linspace(0, 0.9, 400)
    cut = ordinal.clean_cutoff(clean, other)
    assert (clean < cut).mean() <= ordinal.LOSS and 0.5 < cut < 0.51 and (other < cut).mean() > 0.5
    assert ordinal.clean_cutoff(clean, np.array([0.1, 0.2])) == 0.5 and ordinal.clean_cutoff(clean, np.array([])) == 0.0
    assert ordinal.clean_cutoff(np.array([]), other) == 0.5


def test_toxic_documents_go(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        words = [f"w{x}" for x in rng.integers(0, 300, 80)]
        grade = (2, 2, 2, 1, 0)[i % 5]
        if grade < 2:
            words[:: 8 if grade else 2] = [("nasty" if grade else "spam") + str(x) for x in rng.integers(0, 5, len(words[:: 8 if grade else 2]))]
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    graded = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 2000], "doc_id bigint, grade int")
    grade = {r[0]: r[2] for r in rows}
    kept = {r.doc_id: r.kept for r in ordinal.scored(docs.where("doc_id >= 2000"), ordinal.fit(docs, graded)).collect()}
    share = [np.mean([k for i, k in kept.items() if grade[i] == g]) for g in range(3)]
    assert share[2] > 0.96 and share[1] < 0.3 and share[0] < 0.05
