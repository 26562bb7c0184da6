"""Embedding-table diagnostics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.scalar import rnd
from barlens.operators import clean as C
from barlens.operators import latent as L
from barlens.plans.registry import CTES, cte, query
from barlens.sources import market

cte("c_emb", "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings")
cte("c_sparse", "SELECT vec_id, label, list_transform(v, lambda x: greatest(x, 0.0)) AS v FROM c_emb")
cte("c_dims", "SELECT vec_id, label, unnest(range(64)) AS dim, unnest(v) AS x FROM c_sparse")


def emb(spark, d):
    return market.embeddings(spark, d)


def sparse(spark, d):
    """Embeddings thresholded at zero: about half of each vector is active."""
    return emb(spark, d).withColumn("embedding", F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0))))


@query("compose_embedding", """SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(84)) AS dim, unnest(list_concat(v[1:16], list_concat(list_transform(v[17:32], lambda x: x), list_concat(list_transform(v[33:48], lambda x: CASE WHEN label >= 5 THEN x ELSE 0 END),
  list_concat(list_transform(v[49:64], lambda x: CASE WHEN label % 2 = 0 THEN x ELSE 0 END), list_concat(list_transform(range(16), lambda i: 0.0::DOUBLE), [1.0, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END, 0.0]::DOUBLE[])))))) AS x FROM c_emb)""")
def compose_embedding(spark, d):
    """Sixteen current values and four predicted blocks of sixteen, some unavailable."""
    part = lambda i: F.slice("embedding", 16 * i + 1, 16)
    flags = F.array(F.lit(True), F.col("label") >= 5, F.col("label") % 2 == 0, F.lit(False))
    e = L.compose_embedding(part(0), F.array(part(1), part(2), part(3), part(0)), flags)
    return emb(spark, d).select("vec_id", F.posexplode(e).alias("dim", "x")).withColumn("x", rnd("x"))


DIAG = (
    "finite", "zero_fraction", "mean_hoyer_sparsity", "mean_active_dimensions", "median_active_dimensions", "p95_active_dimensions", "mean_variance", "active_dimension_fraction",
    "dead_dimension_fraction", "always_on_dimension_fraction", "mean_support_entropy", "activation_frequency_q05", "activation_frequency_q50", "activation_frequency_q95",
)
cte("c_diag", """SELECT 1.0::DOUBLE AS finite, r.*, c.* FROM (SELECT avg(1 - a / 64) AS zero_fraction, avg((8 - l1 / greatest(l2, 1e-12)) / 7) AS mean_hoyer_sparsity, avg(a) AS mean_active_dimensions, quantile_cont(a, 0.5)::DOUBLE AS median_active_dimensions, quantile_cont(a, 0.95)::DOUBLE AS p95_active_dimensions
  FROM (SELECT vec_id, count(*) FILTER (x > 0) AS a, sum(abs(x)) AS l1, sqrt(sum(x * x)) AS l2 FROM c_dims GROUP BY 1)) r,
 (SELECT avg(var) AS mean_variance, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END) AS active_dimension_fraction, avg(CASE WHEN p = 0 THEN 1.0 ELSE 0 END) AS dead_dimension_fraction, avg(CASE WHEN p = 1 THEN 1.0 ELSE 0 END) AS always_on_dimension_fraction,
   avg(-p * ln(p + 1e-12) - (1 - p) * ln(1 - p + 1e-12)) AS mean_support_entropy, quantile_cont(p, 0.05) AS activation_frequency_q05, quantile_cont(p, 0.5) AS activation_frequency_q50, quantile_cont(p, 0.95) AS activation_frequency_q95
  FROM (SELECT dim, var_pop(x) AS var, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) AS p FROM c_dims GROUP BY 1)) c""")


@query("latent_diagnostics", "SELECT " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in DIAG) + " FROM c_diag")
def latent_diagnostics(spark, d):
    return L.latent_diagnostics(sparse(spark, d)).select(*(rnd(F.col(c) + 1e-9).alias(c) for c in DIAG))


@query("effective_rank")
def effective_rank(spark, d):
    return L.effective_rank(sparse(spark, d)).withColumn("effective_rank", rnd("effective_rank", 4))


@query("sparse_gate", """SELECT concat_ws(';', CASE WHEN abs(zero_fraction - 0.75) > 0.05 THEN 'zero_fraction_off_target' END, CASE WHEN active_dimension_fraction < 0.8 THEN 'too_few_active_dimensions' END,
  CASE WHEN dead_dimension_fraction >= 0.2 THEN 'too_many_dead_dimensions' END) AS failures FROM c_diag""")
def sparse_gate(spark, d):
    return L.sparse_gate(L.latent_diagnostics(sparse(spark, d))).select(F.array_join("failures", ";").alias("failures"))


# a group is fifty consecutive vectors, the label is the regime
cte("c_steps", """SELECT a.vec_id // 50 AS g, a.vec_id, p.label AS source, a.label AS target, count(*) FILTER (p.x <= 0 AND a.x <= 0) AS n00, count(*) FILTER (p.x <= 0 AND a.x > 0) AS n01, count(*) FILTER (p.x > 0 AND a.x <= 0) AS n10, count(*) FILTER (p.x > 0 AND a.x > 0) AS n11
FROM c_dims a JOIN c_dims p ON p.vec_id = a.vec_id - 1 AND p.dim = a.dim AND p.vec_id // 50 = a.vec_id // 50 GROUP BY 1, 2, 3, 4""")
cte("c_jac", "SELECT *, CASE WHEN n01 + n10 + n11 > 0 THEN n11 / (n01 + n10 + n11) ELSE 1 END AS j FROM c_steps")


def steps(spark, d):
    return sparse(spark, d).withColumn("g", F.floor(F.col("vec_id") / 50))


@query("support_transitions", """SELECT round(avg(j), 6) AS mean_consecutive_support_jaccard, round(avg(1 - j), 6) AS support_transition_rate, CAST(sum(n00) AS BIGINT) AS inactive_to_inactive, CAST(sum(n01) AS BIGINT) AS inactive_to_active, CAST(sum(n10) AS BIGINT) AS active_to_inactive,
  CAST(sum(n11) AS BIGINT) AS active_to_active FROM (SELECT g, avg(j) AS j, sum(n00) AS n00, sum(n01) AS n01, sum(n10) AS n10, sum(n11) AS n11 FROM c_jac GROUP BY 1)""")
def support_transitions(spark, d):
    s = L.support_summary(L.support_pairs(steps(spark, d), "g", "vec_id", "embedding", "label"), "g")
    return s.withColumns({c: rnd(c) for c in ("mean_consecutive_support_jaccard", "support_transition_rate")})


@query("regime_transitions", """SELECT CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, count(*) AS transitions, round(max(s.j), 6) AS support_jaccard FROM c_jac LEFT JOIN (SELECT source AS r, avg(j) AS j FROM (SELECT g, source, avg(j) AS j FROM c_jac WHERE source = target GROUP BY 1, 2) GROUP BY 1) s ON s.r = source AND source = target GROUP BY 1, 2""")
def regime_transitions(spark, d):
    r = L.regime_transitions(L.support_pairs(steps(spark, d), "g", "vec_id", "embedding", "label"), "g")
    return r.withColumn("support_jaccard", rnd("support_jaccard"))


@query("chance_overlap", "SELECT round(avg(c), 6) AS chance_support_jaccard FROM (SELECT g, sum(m * m) / greatest(sum(2 * m - m * m), 1e-12) AS c FROM (SELECT vec_id // 50 AS g, dim, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) AS m FROM c_dims GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)")
def chance_overlap(spark, d):
    return L.chance_overlap(steps(spark, d), "g", "embedding").withColumn("chance_support_jaccard", rnd("chance_support_jaccard"))


# consecutive vectors as (context, target) pairs; even groups are TRAIN
cte("c_lp", "SELECT a.vec_id, a.label, p.v AS context, a.v AS target FROM c_emb a JOIN c_emb p ON p.vec_id = a.vec_id - 1")
cte("c_trace", "SELECT sum(v) AS tr, count(*) AS k, list(m ORDER BY dim) AS mean FROM (SELECT dim, var_samp(x) AS v, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS dim, unnest(v) AS x FROM c_emb) WHERE label < 5 GROUP BY 1)")


def pairs(spark, d):
    e = emb(spark, d)
    prev = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("context"))
    return e.withColumnRenamed("embedding", "target").join(prev, "vec_id")


def train_scale(spark, d):
    return L.latent_scale(emb(spark, d).where("label < 5"))


@query("latent_scale", "SELECT round(tr, 6) AS covariance_trace, round(tr / k, 8) AS per_dimension_variance, k AS dimensions FROM c_trace")
def latent_scale(spark, d):
    return train_scale(spark, d).select(rnd("covariance_trace").alias("covariance_trace"), rnd("per_dimension_variance", 8).alias("per_dimension_variance"), "dimensions")


NM = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("latent_nmse", f"SELECT label, round(avg({NM.format(a='target', b='context')} / tr), 6) AS nmse FROM c_lp, c_trace GROUP BY 1")
def latent_nmse(spark, d):
    return L.latent_nmse(pairs(spark, d), train_scale(spark, d), "target", "context", ["label"]).withColumn("nmse", rnd("nmse"))


@query("latent_baselines", f"""SELECT label, round(avg(list_sum(list_transform(target, lambda x: x * x)) / tr), 6) AS zero_nmse, round(avg({NM.format(a='target', b='mean')} / tr), 6) AS train_mean_nmse, round(avg({NM.format(a='target', b='context')} / tr), 6) AS persistence_nmse FROM c_lp, c_trace GROUP BY 1""")
def latent_baselines(spark, d):
    b = L.latent_baselines(pairs(spark, d), train_scale(spark, d), ["label"])
    return b.withColumns({c: rnd(c) for c in ("zero_nmse", "train_mean_nmse", "persistence_nmse")})


@query("identity_ratio", f"""SELECT label, round(avg({NM.format(a='target', b='mean')}) / greatest(avg({NM.format(a='target', b='context')}), 1e-12), 6) AS identity_ratio FROM c_lp, c_trace GROUP BY 1""")
def identity_ratio(spark, d):
    """TRAIN-mean prediction against repeating the last latent."""
    p = pairs(spark, d).withColumn("_m", train_scale(spark, d).select("mean").scalar())
    e = p.select(
        "label", L.squared_gap(F.col("target"), F.col("_m")).alias("prediction_error"), L.squared_gap(F.col("target"), F.col("context")).alias("identity_error")
    )
    return L.identity_ratio(e, ["label"]).withColumn("identity_ratio", rnd("identity_ratio"))


@query("probe_views", "SELECT vec_id, CAST(dim AS INTEGER) AS dim, CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS support, round(CASE WHEN x <> 0 THEN abs(x) ELSE 0 END, 6) AS magnitude, round(x, 6) AS full_value FROM c_dims")
def probe_views(spark, d):
    v = L.probe_views(F.col("embedding"))
    z = F.arrays_zip(v["support"].alias("s"), v["magnitude"].alias("m"), v["full"].alias("f"))
    return sparse(spark, d).select("vec_id", F.posexplode(z).alias("dim", "z")).select(
        "vec_id", "dim", F.col("z.s").alias("support"), rnd("z.m").alias("magnitude"), rnd("z.f").alias("full_value")
    )


def parts(spark, d, view="embedding"):
    """Hash thirds: train, validation, test."""
    e = emb(spark, d).withColumn("third", F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(3)))
    return [e.where(F.col("third") == i) for i in range(3)]


@query("logistic_probe")
def logistic_probe(spark, d):
    train, _, test = parts(spark, d)
    p = L.logistic_probe(train, test, "embedding")
    return L.class_scores(p).withColumns({c: rnd(c, 3) for c in ("balanced_accuracy", "macro_f1")})


@query("class_scores", """WITH p AS (SELECT label AS l, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS g FROM embeddings), k AS (SELECT c, count(*) FILTER (l = c) AS a, count(*) FILTER (g = c) AS g, count(*) FILTER (l = c AND g = c) AS h FROM p, (SELECT range AS c FROM range(10)) GROUP BY 1)
SELECT round(avg(h / a), 6) AS balanced_accuracy, round(avg(2 * h / (a + g)), 6) AS macro_f1 FROM k""")
def class_scores(spark, d):
    e = emb(spark, d).select("label", F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("prediction"))
    return L.class_scores(e).withColumns({c: rnd(c) for c in ("balanced_accuracy", "macro_f1")})


@query("ridge_gram", """SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 6) AS value FROM (SELECT vec_id, unnest(range(13)) AS i, unnest(list_concat([1.0]::DOUBLE[], list_concat(v[1:8], v[61:64]))) AS x FROM c_emb) a
JOIN (SELECT vec_id, unnest(range(13)) AS i, unnest(list_concat([1.0]::DOUBLE[], list_concat(v[1:8], v[61:64]))) AS x FROM c_emb) b USING (vec_id) GROUP BY 1, 2""")
def ridge_gram(spark, d):
    """Sufficient sums of a ridge of the last four values on the first eight."""
    e = emb(spark, d).select(F.slice("embedding", 1, 8).alias("f"), F.slice("embedding", 61, 4).alias("t"))
    return L.gram(e, "f", "t").withColumn("value", rnd("value"))


@query("ridge_probe")
def ridge_probe(spark, d):
    train, valid, test = (p.select(F.slice("embedding", 1, 60).alias("f"), F.slice("embedding", 61, 4).alias("t")) for p in parts(spark, d))
    r = L.ridge_probe(train, valid, test, "f", "t", size=60)
    return r.withColumns({c: rnd(c, 4) for c in ("nmse", "mae", "rmse")})


NORMAL = """sqrt(-2 * ln((('0x' || substr(sha256({k} || '|a'), 1, 15))::BIGINT + 1) / 1152921504606846977.0::DOUBLE)) * cos(2 * pi() * (('0x' || substr(sha256({k} || '|b'), 1, 15))::BIGINT + 1) / 1152921504606846977.0::DOUBLE)"""
cte("c_mat", f"SELECT i, j, w / sqrt(sum(w * w) OVER (PARTITION BY j)) AS w FROM (SELECT i.range AS i, j.range AS j, {NORMAL.format(k=chr(39) + '13|' + chr(39) + ' || i.range || ' + chr(39) + '|' + chr(39) + ' || j.range')} AS w FROM range(64) i, range(4) j)")
cte("c_vals", "SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM c_emb")


@query("random_projection", "SELECT vec_id, CAST(j AS INTEGER) AS j, round(sum(x * w), 6) AS value FROM c_vals JOIN c_mat USING (i) GROUP BY 1, 2")
def random_projection(spark, d):
    p = L.project(emb(spark, d).select("vec_id", "embedding"), "embedding", L.projection_matrix(64, 4, 13))
    return p.select("vec_id", F.posexplode("projected").alias("j", "value")).withColumn("value", rnd("value"))


cte("c_mat512", CTES["c_mat"].replace("range(4) j", "range(512) j"))


@query("sliced_wasserstein", f"""WITH t AS (SELECT vec_id, i, {NORMAL.format(k=chr(39) + '14|' + chr(39) + ' || vec_id || ' + chr(39) + '|' + chr(39) + ' || i')} AS x FROM c_vals),
 p AS (SELECT vec_id, j, sum(x * w) AS v FROM c_vals JOIN c_mat512 USING (i) GROUP BY 1, 2), q AS (SELECT vec_id, j, sum(x * w) AS v FROM t JOIN c_mat512 USING (i) GROUP BY 1, 2),
 a AS (SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY v, vec_id) AS r FROM p), b AS (SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY v, vec_id) AS r FROM q)
SELECT CAST(a.j AS INTEGER) AS direction, round(avg(power(a.v - b.v, 2)), 6) AS squared_distance, count(*) AS rows FROM a JOIN b ON b.j = a.j AND b.r = a.r GROUP BY 1""")
def sliced_wasserstein(spark, d):
    s = L.sliced_wasserstein(emb(spark, d), "vec_id", "embedding", size=64, directions=512, seed=13)
    return s.withColumn("squared_distance", rnd("squared_distance"))


@query("select_lambda", """WITH c AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 ELSE 10.0 END::DOUBLE AS coefficient, l_linestatus AS geometry, avg(l_discount) AS error, CASE WHEN max(l_linenumber) < 7 THEN 'PASS' ELSE 'FAIL' END AS gate FROM lineitem GROUP BY 1, 2),
 k AS (SELECT coefficient, round(avg(error), 12) AS e FROM c GROUP BY 1 HAVING bool_and(gate = 'PASS') AND count(DISTINCT geometry) = 2)
SELECT (SELECT coefficient FROM k ORDER BY e, coefficient LIMIT 1) AS coefficient, (SELECT count(*) FROM k) AS eligible""")
def select_lambda(spark, d):
    li = market.table(spark, d, "lineitem").select("l_linenumber", "l_linestatus", "l_discount")
    m = F.col("l_linenumber") % 3
    c = li.groupBy(F.when(m == 0, 0.1).when(m == 1, 1.0).otherwise(10.0).alias("coefficient"), F.col("l_linestatus").alias("geometry")).agg(
        F.avg("l_discount").alias("error"), F.when(F.max("l_linenumber") < 7, "PASS").otherwise("FAIL").alias("gate")
    )
    return L.select_lambda(c)


@query("check_embedding", "SELECT violations, count(*) AS rows FROM (SELECT concat_ws(';', CASE WHEN label = 3 THEN 'size' END, CASE WHEN label = 7 THEN 'missing_seed' END, CASE WHEN label = 9 THEN 'cutoff_not_before_session' END) AS violations FROM embeddings) GROUP BY 1")
def check_embedding(spark, d):
    """Embeddings with planted faults by label."""
    e = emb(spark, d).select(
        F.when(F.col("label") == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"),
        F.when(F.col("label") != 7, 13).alias("seed"),
        F.lit("2024-01-02").cast("date").alias("session_date"),
        F.when(F.col("label") == 9, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("date").alias("cutoff"),
    )
    v = C.check_embedding(e, 64, ["seed"]).withColumn("violations", F.array_join("violations", ";"))
    return v.groupBy("violations").agg(F.count(F.lit(1)).alias("rows"))
