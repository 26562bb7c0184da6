"""Spelling variants, phrases and secrets against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

pytest.importorskip("barlens.llm")
from pyspark.sql import functions as F  # noqa: E402

from barlens.llm import blocked_bloom, collocations, secret_scan, spelling  # noqa: E402

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, slip, letters=5, least=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in by.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(by[w]), n[form[w]] if form[w] else -1) for w in n)


def misspelled(rng, words):
    out = []
    for w in words:
        i, kind = int(rng.integers(0, len(w) + 1)), rng.integers(0, 5)
        letter = "abcdé÷ÿxyz"[rng.integers(0, 10)]
        out.append({0: w[:i] + letter + w[i:], 1: w[:i] + w[i + 1 :], 2: w[:i] + letter + w[i + 1 :]}.get(int(kind), w))
    return out


@pytest.mark.parametrize("budget", [spelling.ROUND_BYTES, 64])
def test_variants_as_by_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(blocked_bloom, "KEYS", 4)
    rng = np.random.default_rng(6)
    base = ["".join("abcdefgé"[k] for k in rng.integers(0, 8, rng.integers(4, 9))) for _ in range(60)] + ["aaaaaa", "ÀÉÿ×÷", "a" * 3000]
    rows = [(i, " ".join(misspelled(rng, [base[k] for k in rng.zipf(1.3, 30) % len(base)]))) for i in range(200)]
    rows += [(7, rows[0][1].upper()), (7, rows[0][1]), (None, rows[1][1]), (901, None), (902, ""), (903, "12 ,"), (904, f"{'a' * 3000} {'a' * 2999} {'a' * 2999}; {'a' * 2999}")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, word string, n int")
    words = spelling.vocabulary(docs, slip=5)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(words, budget=budget).collect())
    want = variants(rows, 5)
    assert got == want and sum(bool(w[1]) for w in want) > 50 and any(w[1] and w[2] != w[1] for w in want)


def test_no_words_no_variants(spark):
    docs = spark.createDataFrame([(1, None), (2, "a bb ccc")], "doc_id bigint, text string")
    for d in (docs, docs.limit(0)):
        assert spelling.variants(spelling.vocabulary(d, slip=97)).count() == 0


def test_filters_hold_all_their_keys():
    rng = np.random.default_rng(2)
    keys, other = (rng.integers(0, 1 << 64, n, np.uint64) for n in (50_000, 200_000))
    bits = np.zeros((blocked_bloom.blocks_for(len(keys)), blocked_bloom.LANES), np.uint64)
    at = blocked_bloom.place(keys, len(bits))
    for k, m in enumerate(blocked_bloom._masks(keys)):
        np.bitwise_or.at(bits[:, k], at, m)
    assert len(blocked_bloom.passing(bits, keys, at)) == len(keys)
    assert len(blocked_bloom.passing(bits, other, blocked_bloom.place(other, len(bits)))) < 600


def phrases(rows, least, top):
    one, two, three, total = Counter(), Counter(), Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            one.update((lang, x) for x in w)
            two.update((lang, *x) for x in pairwise(w))
            three.update((lang, *x) for x in zip(w, w[1:], w[2:]))
    out = defaultdict(list)
    longer = defaultdict(int)
    for (g, x, y, z), n in three.items():
        if n >= least:
            longer[g, x, y] = max(longer[g, x, y], n)
            longer[g, y, z] = max(longer[g, y, z], n)
            cuts = [(1, one[g, x], two[g, y, z]), (2, two[g, x, y], one[g, z])]
            s, _, lo, r = min((1000000 * n * n // (a * b), k, a, b) for k, a, b in cuts)
            out[g].append((-s, -n, f"{x} {y} {z}".encode(), lo, r))
    for (g, x, y), n in two.items():
        if n >= least and 100 * longer[g, x, y] < 50 * n:
            out[g].append((-(1000000 * n * n // (one[g, x] * one[g, y])), -n, f"{x} {y}".encode(), one[g, x], one[g, y]))
    return sorted((g, i + 1, p.decode(), -a, lo, r, total[g], -s) for g, found in out.items() for i, (s, a, p, lo, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("small", [False, True])
def test_phrases_as_by_brute_force(spark, monkeypatch, small):
    if small:  # several shards and rounds, split first words, weak filters
        for name, value in (("SHARD_BYTES", 800), ("ROUND_BYTES", 6000), ("FILTER_BYTES", 64), ("HELD", 50), ("AT_ONCE", 3)):
            monkeypatch.setattr(collocations, name, value)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "日本", "#", "a'b", "very" * 400]
    rows = []
    for i in range(300):
        w = [vocabulary[k] for k in rng.zipf(1.4, 60) % len(vocabulary)]
        seps = [" ", "\t", "  ", ", ", ".", "\n", " - "]
        rows.append((("en", "de", None, "")[i % 4], "".join(x + seps[k] for x, k in zip(w, rng.choice(7, 60, p=[0.5, 0.1, 0.1, 0.1, 0.05, 0.05, 0.1])))))
    rows += [("en", "W1 W2 W3 " * 50), ("en", None), ("xx", ""), ("xx", " ,;\r\x0b"), ("en", "w1 w2 " * 4000), ("hot", "the of " * 30)] + [rows[0]] * 5
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=6, top=37).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == phrases(rows, 6, 37) and len(got) > 100


def test_texts_are_read_four_times_however_many_candidates_there_are(spark, monkeypatch):
    for name, value in (("SHARD_BYTES", 800), ("ROUND_BYTES", 3000)):
        monkeypatch.setattr(collocations, name, value)
    rows = [("en", " ".join(f"a{(i + j) % 90} b{j % 30} c{j % 7}" for j in range(40))) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInArrow(seen, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=3, top=5000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == phrases(rows, 3, 5000) and len(got) > 100
    assert read.value == 4 * len(rows)


def test_no_phrases(spark):
    docs = spark.createDataFrame([("en", None), (None, "a b c")], "lang string, text string")
    for d in (docs, docs.limit(0)):
        assert collocations.collocations(d).count() == 0


def test_tries_hold_their_sequences_only():
    rng = np.random.default_rng(4)
    rows = np.unique(np.concatenate([rng.integers(0, 30, (400, 3)), np.c_[rng.integers(0, 30, (50, 2)), -np.ones(50, int)], np.c_[np.zeros(30, int), np.arange(30), -np.ones(30, int)]]), axis=0)
    arcs = rows[np.lexsort(rows.T[::-1])].T
    base, check, states = collocations.trie(arcs, 30)
    known = {tuple(x for x in r if x >= 0)[:k] for r in rows.tolist() for k in (1, 2, 3)}
    found = {(): 0}
    for path in sorted({p[:k] for p in known for k in range(1, len(p) + 1)}, key=len):
        slot = base[found[path[:-1]]] + path[-1]
        assert check[slot] == found[path[:-1]]
        found[path] = slot
    assert len(set(found.values())) == len(found) == 1 + len({p[:k] for p in known for k in range(1, len(p) + 1)})
    for x in range(30):
        if (0, x, 5) not in found and base[found[(0, x)]] >= 0:
            assert check[base[found[(0, x)]] + 5] != found[(0, x)]
    for r, s in zip(arcs.T.tolist(), states.T.tolist()):
        assert [found[tuple(r[: k + 1])] for k in range(3) if r[k] >= 0] == [x for x in s if x >= 0]


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(rows, examples=3):
    base, found = [], []
    for _, owner, repo, text in rows:
        text = text or ""
        spans = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [("hex", m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base.append(spans)
        every = [(e - len(v), e, v) for _, s, e, v in spans] + [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text)]
        found.append({x for x in every if re.search("[0-9]", x[2]) and re.search("[A-Za-z]", x[2]) and len(set(x[2])) >= 10})
    owners = defaultdict(set)
    for (_, owner, *_), f in zip(rows, found):
        for *_, v in f:
            owners[v].add(owner or "")
    order, out = {"assign": 0, "access": 1, "hex": 2, "live": 3}, []
    listed = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in sorted(spans, key=lambda x: (x[1], order[x[0]])))
    for (i, *_), b, f in zip(rows, base, found):
        live = [("live", s, e) for s, e, v in f if len(owners[v]) == 1]
        n = Counter(k for k, *_ in b)
        out.append((-1 if i is None else i, n["assign"], n["access"], n["hex"], hashlib.sha256(listed(b).encode()).hexdigest(), listed(b + live), len(live), sum(len(owners[v]) >= examples for *_, v in f)))
    return sorted(out)


def test_secrets_as_by_brute_force(spark):
    rng = np.random.default_rng(9)
    key = lambda n, letters="0123456789abcdef": "".join(letters[k] for k in rng.integers(0, len(letters), n))
    example, own, shared = key(40), key(40), "AKIA" + key(16, "ABCDEFGH0123456789")
    texts = [
        f'token = "{example}" é日本 😀 password: {own}', "token=token : abcdefghijklmnop", f"API_KEY='{own}' apikey={example}!", f"{shared}X secret=short AKIA123", "0123456789abcdef" * 3 + " 😀 passwd=" + "x" * 12,
        f"deadbeef{own} {own}", None, "", "no secrets at all", f"{key(30, 'ABCdef0123456789+/')} TOKEN: {key(24)}", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", f"{example} " * 300, "password==" + "a.b=" * 40, "password: \n abcdefghijklmnop",
    ]
    rows = [(i, f"o{i % 4}" if i % 5 else None, f"r{i % 2}", t) for i, t in enumerate(texts)] + [(100 + i, f"o{i % 9}", "r", f"see {example} or {shared}") for i in range(12)]
    rows += [rows[0], rows[0], (None, "o1", None, texts[0]), (3, "o9", "r", f"other text {key(40)}")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, owner string, repo string, text string, spans string, base int")
    got = secret_scan.report(secret_scan.scan(docs, owner=F.col("owner"), repository=F.col("repo")))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got.collect())
    want = secrets(rows)
    assert got == want and sum(w[6] for w in want) > 3 and sum(w[7] for w in want) > 300
    assert secret_scan.scan(docs.limit(0), owner=F.col("owner"), repository=F.col("repo")).count() == 0


def test_running_sums_of_any_length(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        steps = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7) if n else F.array().cast("array<int>")
        got = spark.range(1).select(secret_scan.running(steps)).first()[0]
        assert got == np.cumsum([x % 7 for x in range(1, n + 1)]).tolist()


def test_license_copies_with_words_put_in(spark):
    """Recall against brute force over copies whose edits leave 0.8 of the shingles or a little less, at every offset."""
    from barlens.llm import licenses

    full = licenses.words(licenses.TEMPLATES["mit-full"])
    want = {tuple(full[i : i + 5]) for i in range(len(full) - 4)}
    rng = np.random.default_rng(12)
    rows, held = [], {}
    for i in range(60):
        w = list(full)
        for at in sorted(rng.choice(np.arange(5, len(full) - 5), 3 + i % 6, replace=False), reverse=True):
            w[at:at] = [f"put{i}"] * int(rng.integers(1, 6))
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        held[i] = len(want & have) / len(want)
        rows.append((i, " ".join(["before"] * int(rng.integers(0, 90)) + w + ["after"] * int(rng.integers(0, 90)))))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (0, rows[0][1]), (99, " ".join(full[:100])), (98, ("word " * 60_000) + licenses.TEMPLATES["mit-full"])]
    got = [r for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")).collect() if r.license == "mit-full"]
    found = {r.doc_id: r.containment for r in got if r.doc_id is not None}
    due = {i for i, c in held.items() if c >= 0.8}
    assert 20 < len(due) < 60
    assert set(found) == due | {98} and all(found[i] == pytest.approx(held[i]) for i in due)
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 0 for r in got) == 2
