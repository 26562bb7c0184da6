"""Near copies of documents and of vectors against brute force."""

import re

import numpy as np
import pytest

pytest.importorskip("barlens.llm")
from barlens.llm import minhash, range_join  # noqa: E402
from barlens.llm.common import components  # noqa: E402


def closure(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_documents_link_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  Two"), (905, "É é"), (906, "é É")]
    for g in range(3):
        base = word(120)
        rows.append((g * 100, " ".join(base)))
        for k in range(1, 40):  # from hardly changed to changed beyond the threshold
            w = list(base)
            for i in rng.integers(0, len(w), k // 10):
                w[i] = f"x{k}"
            rows.append((g * 100 + k, " ".join(w).upper() if k % 3 else "\n".join(w)))
    rows += [(500 + k, " ".join(word(60))) for k in range(30)] + [(0, rows[7][1])]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows] + [(None, rows[7][1], 1, True)], "doc_id bigint, text string, component_id int, kept boolean")
    got = minhash.near_duplicates(docs).collect()
    sets = {i: word_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(ids, links)
    assert len(got) == len(rows) + 1 and len(links) > 200
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert len(np.unique(minhash.sketch(a, 192))) == 192 or n < 60
        assert (minhash.sketch(a, 192) == minhash.sketch(a[::-1].copy(), 192)).all()
    both = rng.integers(0, 1 << 62, 1700).astype(np.uint64)
    seen = [np.mean(minhash.sketch(both[k : 1500 + k // 3], 192) == minhash.sketch(both[200 : 1500 + k // 3], 192)) for k in range(0, 200, 20)]
    real = [(1300 + k // 3) / (1500 + k // 3 - k) for k in range(0, 200, 20)]
    assert np.abs(np.array(seen) - real).max() < 0.1


def test_empty_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


@pytest.mark.parametrize("cell, block", [(4000, 4096), (40, 16)])
def test_vectors_link_as_by_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(range_join, "CELL", cell)
    monkeypatch.setattr(range_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 8))
    for k in range(0, 200, 4):
        x[k + 1] = x[k] * 3
        x[k + 2] = x[k] + rng.normal(size=8) * 0.12 * np.linalg.norm(x[k]) / 8**0.5
    rows = [(i, [float(v) for v in e], 1 if i % 3 else 2) for i, e in enumerate(x)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, rows[1][1], None), (404, [1.0, None] + [1.0] * 6, 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (None, rows[1][1], 1)]
    vectors = spark.createDataFrame([(*r, True) for r in rows + odd], "vec_id bigint, embedding array<double>, label int, kept boolean")
    got = {r.vec_id: r for r in range_join.linked(vectors).collect()}
    good = {i: (np.array(e), g) for i, e, g in rows + odd[5:7]}
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cos(good[a][0], good[b][0]) >= 0.98]
    want = closure([i for i, *_ in rows + odd[:-1]], links)
    assert len(got) == len(rows) + len(odd) and len(links) > 60
    for i, c in want.items():
        n = sum(i in pair for pair in links)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, i == c), i
    assert (got[None].n_links, got[None].component_id) == (0, None)
    assert range_join.linked(vectors.limit(0)).count() == 0


def test_bands_follow_the_threshold():
    assert minhash.layout(85) == (32, 6) and minhash.layout(80) == (38, 5)
    for percent in range(10, 101):
        bands, rows = minhash.layout(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS and bands * rows <= minhash.COORDINATES


def test_stage_removes_pairs_from_four_fifths_up(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, gone = [], set()
    for i in range(60):
        more = (19, 22, 24, 25, 26)[i % 5]  # of 100 shingles: similarities of 0.840, 0.820, 0.806, 0.800 and 0.794
        words = [f"w{i}x{j}" for j in range(104 + more)]
        rows += [(2 * i, " ".join(words[:104]), "en", "src0", 1), (2 * i + 1, " ".join(words), "en", "src0", 1)]
        gone |= {2 * i + 1} if more <= 25 else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r.doc_id for r in pipeline.minhash_near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted({r[0] for r in rows} - gone)


def test_ids_that_stand_for_several_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for g in range(2):
        base = word(100)
        for k in range(40):  # neighbours are near, ends are not: buckets stay mixed until the last step
            w = list(base)
            for i in range(k // 2):
                w[i] = f"x{g}y{i}"
            rows.append((1000 * g + k, " ".join(w)))
    other = word(100)
    rows += [(1000 * (k % 2) + k, " ".join(other[: 100 - k // 8] + [f"z{k // 8}"] * (k // 8))) for k in range(39)] + [(5000 + k, " ".join(word(50))) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = minhash.near_duplicates(docs).collect()
    sets = [word_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    least, root = {}, closure(range(len(rows)), links)
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    want = sorted((d, len(sets[i]), least[root[i]]) for i, (d, _) in enumerate(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_vectors_of_one_id_and_of_any_size(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1e200, 0.0], 2), (3, [1e200, 1e199], 2), (4, [1e-200, 0.0], 2), (5, [5e-324, 5e-324], 3), (6, [1e308, 1e308], 3),
        (7, [0.0, 1.0], 4), (7, [1.0, 0.0], 5), (8, [0.0, 2.0], 4), (9, [3.0, 0.0], 5), (10, [0.0, -1.0], 4),
    ]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in range_join.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False), (5, 1, 5, True), (6, 1, 5, False),
        (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False), (10, 0, 10, True),
    ]


def test_stage_keeps_one_row_of_an_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 1), (1, "a " + text, "en", "s", 2), (2, text, "de", "s", 1), (3, "b", None, None, None), (None, text, "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(map(tuple, pipeline.minhash_near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
