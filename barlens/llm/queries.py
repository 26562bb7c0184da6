"""Registered queries of this subpackage; ``ORACLES`` holds the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm import collocations, html_text, licenses, minhash, mixing, ordinal, packing, range_join, risk_rules, secret_scan, spelling, token_rollup, zip_warc
from barlens.llm.common import drop_path, scratch_path, settle, table, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark, d):
    return range_join.linked(table(spark, d, "embeddings"))


@query
def op2_packing(spark, d):
    return packing.pack(packing.pieces(table(spark, d, "documents")))


@query
def op3_minhash_near_dedup(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"))


@query
def op4_token_counts(spark, d):
    """All documents arrive, every twentieth first as a draft with a wrong source, next to drafts that never become documents;
    then the drafts are revised, the others deleted, and the revision is sent again."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    draft = F.pmod(F.col("doc_id"), F.lit(20)) == 0
    change = lambda df, kind, n: df.select("doc_id", F.lit(kind).alias("change"), "text", "source", "lang", F.lit(n).alias("seq"))
    early = docs.withColumns({"text": F.when(draft, F.substring("text", 1, 100)).otherwise(F.col("text")), "source": F.when(draft, F.lit("draft")).otherwise(F.col("source"))})
    stray = docs.where(draft).select((-F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 1, 50).alias("text"), "source", "lang")
    folder = scratch_path(spark, "rollup")
    rollup = token_rollup.Rollup(spark, folder, {"byte_bpe_50k": tokenizer_file(), "words": None})
    rollup.commit("1-arrive", change(early.unionByName(stray), "insert", 1))
    rollup.commit("2-revise", change(docs.where(draft), "revise", 2))
    rollup.commit("3-delete", change(stray, "delete", 3))
    rollup.commit("2-revise", change(docs.where(draft), "revise", 2))
    out = settle(rollup.totals())
    drop_path(spark, folder)
    return out


@query
def op5_license_scans(spark, d):
    return licenses.scan(table(spark, d, "documents"))


# The mixture of the registered query: invented domains, four of five documents wanted, two languages favoured, one source halved.
MIX = {"domain": {"d0": 3.0, "d1": 2.0}, "lang": {"en": 4.0, "de": 2.0}, "source": {"src0": 0.5}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2.0, 17


def domain():
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(4)).cast("string"))


@query
def op6_mixing(spark, d):
    docs = table(spark, d, "documents")
    leaves = settle(mixing.plan(docs, domain=domain(), weights=MIX, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED))
    out = mixing.mixed(docs.select("doc_id", "lang", "source"), leaves, domain=domain(), seed=MIX_SEED)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "domain", "lang", "source", "repeats")


@query
def op7_html_extraction(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@query
def op8_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    model = ordinal.fit(docs, ordinal.ratings(table(spark, d, "labels")))
    return ordinal.scored(docs, model)


@query
def op9_quality_rules(spark, d):
    out = risk_rules.judged(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", *risk_rules.BASE, "base_failed", "kept", "stratum", "level")


_LADDER = ", ".join("[" + ", ".join(f"{c!r}" for c in cuts) + "]" for cuts in risk_rules.LADDER)
ORACLES["op9_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l FROM t),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY 1),
c AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echo FROM w LEFT JOIN cover USING (doc_id)),
s AS (SELECT *, [CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, CASE WHEN word_chars > 0 THEN caps / word_chars ELSE 0 END,
  CASE WHEN n_words > 0 THEN bangs / n_words ELSE 0 END, CASE WHEN n_words > 0 THEN echo / n_words ELSE 0 END] AS v FROM c),
ladder AS (SELECT unnest(range(1, {len(risk_rules.LADDER) + 1})) AS level, unnest([{_LADDER}]) AS cut),
h AS (SELECT doc_id, stratum, level, v[1] > cut[1] OR v[2] > cut[2] OR v[3] > cut[3] OR v[4] > cut[4] OR v[5] > cut[5] AS hit FROM s, ladder),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
k AS (SELECT stratum, level, count(*) AS n, count(*) FILTER (hit) AS k FROM h JOIN good USING (doc_id) GROUP BY 1, 2),
p AS (SELECT stratum, level, CASE WHEN k < n * 0.05 THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(0.95))) FROM (SELECT unnest(range(0, k + 1)) AS j)) ELSE 1 END AS p, (SELECT count(DISTINCT stratum) FROM k) AS m FROM k),
stop AS (SELECT stratum, coalesce(min(level) FILTER (p > 0.05 / m), {len(risk_rules.LADDER) + 1}) - 1 AS level FROM p GROUP BY 1)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(h.hit, false) AS kept, s.stratum, CAST(coalesce(stop.level, 0) AS INTEGER) AS level
FROM s LEFT JOIN stop USING (stratum) LEFT JOIN h ON h.doc_id = s.doc_id AND h.level = stop.level
"""


@query
def op10_warc(spark, d):
    folder = scratch_path(spark, "warc")
    out = settle(zip_warc.archived(table(spark, d, "pages"), folder))
    drop_path(spark, folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, url, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to, url FROM r
"""
# A cosine over a label's pairs; components by the smallest label reached, as often as it still falls.
ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.y, reach.c FROM reach JOIN l ON l.x = reach.x),
c AS (SELECT x, min(c) AS c FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


def _fill(depth: int) -> str:
    """SQL of one level of water-filling: a child is full if what the fuller ones leave gives it more than its room."""
    names = list(mixing.LEVELS[: depth + 1])
    at, up = ", ".join(names), ", ".join(names[:-1])
    by = f"PARTITION BY {up}" if up else ""
    budget = "(SELECT sum(tokens) FROM leaf) * %r" % MIX_SHARE if not depth else "p.budget"
    source = f"FROM (SELECT {at}, sum(tokens) * {MIX_EPOCHS!r} AS room, any_value(w{depth}) AS weight FROM weighted GROUP BY {at}) x" + (f" JOIN f{depth - 1} p USING ({up})" if depth else "")
    return f"""r{depth} AS (SELECT x.*, CAST({budget} AS DOUBLE) AS given {source}),
s{depth} AS (SELECT *, sum(weight) OVER ({by}) - sum(weight) OVER o + weight AS w, sum(room) OVER o - room AS c FROM r{depth} WINDOW o AS ({by} ORDER BY room / weight, {at} ROWS UNBOUNDED PRECEDING)),
l{depth} AS (SELECT *, max(CASE WHEN room > (given - c) / w * weight THEN (given - c) / w END) OVER ({by}) AS level FROM s{depth}),
f{depth} AS (SELECT {at}, least(room, greatest(0, coalesce(level * weight, room))) AS budget FROM l{depth})"""


def _weight(level: str) -> str:
    return "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in MIX[level].items()) + " ELSE 1.0 END"


ORACLES["op6_mixing"] = rf"""
WITH doc AS (SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4 AS VARCHAR), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS t FROM documents),
leaf AS (SELECT domain, lang, source, count(*) AS n, sum(t) AS tokens FROM doc GROUP BY 1, 2, 3),
weighted AS (SELECT *, {_weight("domain")} AS w0, {_weight("lang")} AS w1, {_weight("source")} AS w2 FROM leaf),
{_fill(0)},
{_fill(1)},
{_fill(2)},
b AS (SELECT domain, lang, source, tokens, floor(budget + 1e-6) AS budget FROM leaf JOIN f2 USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS BIGINT) ELSE 0 END AS full_epochs FROM b),
x AS (SELECT doc_id, domain, lang, source, t, full_epochs, budget - full_epochs * tokens AS rest, CAST('0x' || substr(md5('{MIX_SEED}:' || full_epochs || ':' || doc_id), 1, 15) AS BIGINT) AS draw FROM doc JOIN e USING (domain, lang, source)),
y AS (SELECT *, sum(t) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT doc_id, domain, lang, source, full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS repeats FROM y WHERE full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""


def _license_sql() -> str:
    """Every window of every template group, counted without bands."""
    parts, rows = [], []
    for name, text in licenses.TEMPLATES.items():
        w = licenses.words(text)
        k = min(licenses.SHINGLE, len(w))
        rows += [f"('{name}', {len(w)}, '{s}')" for s in dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))]
    for length, g in licenses.groups(licenses.TEMPLATES, 0.8, 1e-4).items():
        k, width, stride = g["k"], g["window"] - g["k"] + 1, g["stride"]
        parts.append(f"""SELECT doc_id, license, spot, count(DISTINCT s) / any_value(t) AS containment, min(i) AS first_word, max(i) + {k} AS last_word FROM (
  SELECT h.*, unnest(range(CAST(greatest(0, ceil((i - {width - 1}) / {stride}.0)) * {stride} AS BIGINT), i + 1, {stride})) AS spot FROM hit{length} h) GROUP BY doc_id, license, spot""")
    hits = ",\n".join(
        f"""hit{n} AS (SELECT doc_id, n, i, license, s, t FROM (SELECT doc_id, len(w) AS n, i, array_to_string(w[i + 1:i + {g['k']}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - {g['k'] - 1})) AS i FROM w WHERE len(w) >= {g['k']})) JOIN (SELECT * FROM tpl WHERE length = {n}) USING (s))"""
        for n, g in licenses.groups(licenses.TEMPLATES, 0.8, 1e-4).items()
    )
    union = "\nUNION ALL ".join(parts)
    return rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
tpl AS (SELECT *, count(*) OVER (PARTITION BY license) AS t FROM (VALUES {", ".join(rows)}) v(license, length, s)),
{hits},
x AS ({union})
SELECT doc_id, license, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, containment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, spot) AS r FROM x WHERE containment >= 0.8) WHERE r = 1"""


ORACLES["op5_license_scans"] = _license_sql()


SLIP = 97


@query
def op11_spelling_variants(spark, d):
    return spelling.variants(spelling.vocabulary(table(spark, d, "documents"), slip=SLIP))


# The CRC of a text is linear in its bytes: ``far`` has what a byte adds at each distance from the end. Pairs meet in words with
# one letter left out, or masked where it stood.
ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
w AS (SELECT concat(doc_id, ':', w) AS m, w, sum(n) AS n FROM (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS w, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2) GROUP BY 1, 2),
bytes AS (SELECT m, hex(encode(m)) AS x, CAST(octet_length(encode(m)) AS BIGINT) AS size FROM w),
bits AS (SELECT b, b AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT b, v FROM bits WHERE k = 8),
far AS (SELECT 0 AS d, b, v FROM tab UNION ALL SELECT d + 1, far.b, xor(far.v >> 8, tab.v) FROM far JOIN tab ON tab.b = far.v % 256 WHERE d < (SELECT max(size) FROM bytes)),
place AS (SELECT m, size - 1 - i AS d, xor(CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), CASE WHEN i < 4 THEN 255 ELSE 0 END) AS b FROM (SELECT *, unnest(range(size)) AS i FROM bytes)),
crc AS (SELECT m, xor(4294967295, bit_xor(v)) AS h FROM place JOIN far USING (d, b) GROUP BY 1),
v AS (SELECT CASE WHEN h % {SLIP} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n) AS n FROM w JOIN crc USING (m) GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
spot AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
cut AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS s FROM spot),
hole AS (SELECT word, n, left(word, i) || '_' || substr(word, i + 2) AS s FROM spot),
short AS (SELECT c.word, c.n, v.word AS near, v.n AS near_n FROM cut c JOIN v ON v.word = c.s),
near AS (SELECT * FROM short UNION ALL SELECT near, near_n, word, n FROM short UNION ALL SELECT a.word, a.n, b.word, b.n FROM hole a JOIN hole b ON a.s = b.s AND a.word <> b.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND r = 1),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM f JOIN (SELECT walk.word, root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL) USING (word)
"""


@query
def op12_phrase_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


ORACLES["op12_phrase_collocations"] = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, unnest(regexp_split_to_array(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, len(w) - i AS more FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
one AS (SELECT lang, a AS x, count(*) AS n FROM g GROUP BY 1, 2),
two AS (SELECT lang, a AS x, b AS y, count(*) AS n FROM g WHERE more >= 1 GROUP BY 1, 2, 3),
three AS (SELECT lang, a AS x, b AS y, c AS z, count(*) AS n FROM g WHERE more >= 2 GROUP BY 1, 2, 3, 4 HAVING count(*) >= {collocations.LEAST}),
held AS (SELECT lang, x, y, max(n) AS n FROM (SELECT lang, x, y, n FROM three UNION ALL SELECT lang, y, z, n FROM three) GROUP BY 1, 2, 3),
cuts AS (SELECT two.lang, two.x || ' ' || two.y AS phrase, two.n AS a, 1 AS k, l.n AS l, r.n AS r FROM two LEFT JOIN held USING (lang, x, y) JOIN one l ON l.lang = two.lang AND l.x = two.x JOIN one r ON r.lang = two.lang AND r.x = two.y
  WHERE two.n >= {collocations.LEAST} AND (held.n IS NULL OR 100 * held.n < 50 * two.n)
UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.n, 1, l.n, r.n FROM three t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.n, 2, l.n, r.n FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z),
s AS (SELECT *, CAST(CAST({collocations.SCALE} AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM one GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= {collocations.TOP}
"""


@query
def op13_secret_scans(spark, d):
    """A source stands for an owner, and its documents of one language for a repository."""
    return secret_scan.report(secret_scan.scan(table(spark, d, "documents"), owner=F.col("source"), repository=F.col("lang")))


def _spans_sql(name: str, pattern: str, group: int, least: int, kind: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, owner, repo, {kind} AS kind, e - length(h) AS s, e, v FROM (
  SELECT *, sum(length(h) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, owner, repo, i, hits[i] AS h, rest[i] AS x, vals[i] AS v FROM (
    SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, owner, repo, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS vals, regexp_split_to_array(t, '{quoted}') AS rest FROM t)))) WHERE length(v) >= {least})"""


ORACLES["op13_secret_scans"] = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents),
{", ".join(_spans_sql(n, rx, g, least, k) for k, (n, rx, g, least) in enumerate(secret_scan.KINDS))},
{_spans_sql("runs", secret_scan.RUN, 0, 0, 3)},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
found AS (SELECT DISTINCT doc_id, owner, repo, e - length(v) AS s, e, v FROM (SELECT * FROM base UNION ALL SELECT * FROM runs)
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {secret_scan.DISTINCT}),
verdict AS (SELECT v, count(DISTINCT owner) AS owners FROM found GROUP BY 1),
judged AS (SELECT * FROM found JOIN verdict USING (v)),
every AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, 3, s, e FROM judged WHERE owners = 1),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2 FROM base GROUP BY 1),
x AS (SELECT doc_id, concat_ws(':', ['assign', 'access', 'hex', 'live'][kind + 1], s, e) AS o, kind, s FROM every),
j AS (SELECT doc_id, string_agg(o, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(o, ',' ORDER BY s, kind) AS spans FROM x GROUP BY 1),
c AS (SELECT doc_id, count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {secret_scan.EXAMPLES}) AS n_copied FROM judged GROUP BY 1)
SELECT t.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN c USING (doc_id)
"""
