"""Queries over banks of vectors and their codes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from loomset.functions import vectors as V
from loomset.operators import codes, selection, training, transfer
from loomset.plans import tables as Q
from loomset.plans.registry import query
from loomset.runtime import materialize, shared_dir, table
from loomset.streaming import attempts as stream

DIM, TOPK = 48, 8

_VALID = "(SELECT *, list_transform(hidden, lambda x: x::DOUBLE) AS h FROM activation_bank WHERE length(hidden) = 48 AND length(list_filter(hidden, lambda x: x IS NULL OR isnan(x))) = 0)"


def _valid(spark, d):
    return codes.usable(table(spark, d, "activation_bank"), DIM)


@query("banks", """
SELECT bank_id, split_part(bank_id, '_', 1) AS family, split_part(bank_id, '_', 2) AS layer_name, coalesce(TRY_CAST(nullif(regexp_extract(bank_id, 'layer0*([0-9]+)', 1), '') AS INT), -1) AS layer, split_part(bank_id, '_', 3) AS run,
  count(*) AS n_vectors, count(DISTINCT set_idx) AS n_sets, max(view_idx) + 1 AS views, max(length(hidden)) AS hidden_dim FROM activation_bank GROUP BY ALL""")
def banks(spark, d):
    rows = table(spark, d, "activation_bank").withColumns(codes.bank_parts(F.col("bank_id")))
    return rows.groupBy("bank_id", "family", "layer_name", "layer", "run").agg(F.count("*").alias("n_vectors"), F.count_distinct("set_idx").alias("n_sets"), (F.max("view_idx") + 1).alias("views"), F.max(F.size("hidden")).cast("bigint").alias("hidden_dim"))


@query("banks_filtered", """
SELECT DISTINCT bank_id FROM activation_bank WHERE split_part(bank_id, '_', 1) IN ('lumen', 'ostra', 'marl') AND split_part(bank_id, '_', 1) <> 'ostra' AND ends_with(split_part(bank_id, '_', 2), '17')""")
def banks_filtered(spark, d):
    rows = table(spark, d, "activation_bank").select("bank_id").distinct().withColumns(codes.bank_parts(F.col("bank_id")))
    return codes.filter_banks(rows, families=["lumen", "ostra", "marl"], without=["ostra"], layer_suffix="17").select("bank_id")


@query("vector_norms", f"SELECT vec_id, round(sqrt(list_dot_product(h, h)), 5) AS norm, round(list_sum(h) / 48, 6) AS mean FROM {_VALID}")
def vector_norms(spark, d):
    h = F.col("hidden")
    return _valid(spark, d).select("vec_id", F.round(V.norm(h), 5).alias("norm"), F.round(V.mean_of(h), 6).alias("mean"))


@query("view_cosines", f"""
SELECT a.bank_id, a.set_idx, a.view_idx, round(list_dot_product(a.h, b.h) / (greatest(sqrt(list_dot_product(a.h, a.h)), 1e-12) * greatest(sqrt(list_dot_product(b.h, b.h)), 1e-12)), 6) AS cosine
FROM {_VALID} a JOIN {_VALID} b ON a.bank_id = b.bank_id AND a.set_idx = b.set_idx AND b.view_idx = a.view_idx + 1""")
def view_cosines(spark, d):
    rows = _valid(spark, d)
    nxt = rows.select("bank_id", "set_idx", (F.col("view_idx") - 1).alias("view_idx"), F.col("hidden").alias("other"))
    got = rows.join(nxt, ["bank_id", "set_idx", "view_idx"])
    return got.select("bank_id", "set_idx", "view_idx", F.round(V.cosine(F.col("hidden"), F.col("other")), 6).alias("cosine"))


_MEANS = "(SELECT bank_id, set_idx, list(m ORDER BY i) AS m FROM (SELECT bank_id, set_idx, i, avg(v) AS m FROM (SELECT bank_id, set_idx, unnest(h) AS v, generate_subscripts(h, 1) AS i FROM " + _VALID + ") GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_DENSE = f"(SELECT bank_id, set_idx, list_transform(m, lambda x: (x - mu) / sqrt(var + 1e-5)) AS z_dense FROM (SELECT *, list_sum(list_transform(m, lambda x: (x - mu) * (x - mu))) / 48 AS var FROM (SELECT *, list_sum(m) / 48 AS mu FROM {_MEANS})))"
_TOP = "list_transform(list_slice(list_sort(list_transform({z}, lambda x, i: {{'v': -round(abs(x), 9), 'i': i - 1}})), 1, 8), lambda s: s.i)"
_CODES = f"(SELECT bank_id AS key, set_idx, z_dense, top, list_transform(z_dense, lambda x, i: CASE WHEN list_contains(top, i - 1) THEN x ELSE 0.0 END) AS z FROM (SELECT *, {_TOP.format(z='z_dense')} AS top FROM {_DENSE}))"


def _codes(spark, d):
    """A code for each set of a bank."""
    got = codes.encode_sets(_valid(spark, d), ["bank_id", "set_idx"], DIM, TOPK)
    return got.withColumnRenamed("bank_id", "key")


@query("set_codes", f"SELECT key, set_idx, array_to_string(top, ',') AS top, round(list_sum(list_transform(z, lambda x: x * x)), 5) AS energy FROM {_CODES}")
def set_codes(spark, d):
    rows = _codes(spark, d)
    z = F.col("z")
    return rows.select("key", "set_idx", F.array_join(V.top_places(F.col("z_dense"), TOPK), ",").alias("top"), F.round(V.dot(z, z), 5).alias("energy"))


def _literal(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in m.tolist()) + "]"


_WEIGHTS = np.random.default_rng(0).normal(size=(24, DIM)) / DIM**0.5
_DECODER = np.random.default_rng(1).normal(size=(DIM, DIM)) / DIM


@query("pointwise_codes", f"""
WITH u AS (SELECT bank_id, set_idx, vec_id, list_transform(w, lambda r: list_dot_product(r, h)) AS u FROM {_VALID}, (SELECT {_literal(_WEIGHTS)} AS w)),
n AS (SELECT *, list_sum(list_transform(u, lambda x: (x - mu) * (x - mu))) / 24 AS var FROM (SELECT *, list_sum(u) / 24 AS mu FROM u)),
m AS (SELECT bank_id, set_idx, i, avg(v) AS v FROM (SELECT bank_id, set_idx, unnest(list_transform(u, lambda x: (x - mu) / sqrt(var + 1e-5))) AS v, generate_subscripts(u, 1) AS i FROM n) GROUP BY 1, 2, 3),
z AS (SELECT bank_id, set_idx, list(v ORDER BY i) AS z FROM m GROUP BY 1, 2), t AS (SELECT *, {_TOP.format(z='z')} AS top FROM z)
SELECT bank_id, set_idx, array_to_string(top, ',') AS top, round(sqrt(list_sum(list_transform(z, lambda x, i: CASE WHEN list_contains(top, i - 1) THEN x * x ELSE 0.0 END))), 5) AS norm FROM t""")
def pointwise_codes(spark, d):
    weights = _WEIGHTS
    got = codes.encode_sets(_valid(spark, d), ["bank_id", "set_idx"], DIM, TOPK, weights=weights, bias=np.zeros(24), pointwise=True)
    return got.select("bank_id", "set_idx", F.array_join(V.top_places(F.col("z_dense"), TOPK), ",").alias("top"), F.round(V.norm(F.col("z")), 5).alias("norm"))


@query("decoded_codes", f"""
WITH r AS (SELECT m, list_transform(w, lambda c: list_dot_product(c, z)) AS recon FROM (SELECT key, set_idx, z FROM {_CODES}) c JOIN {_MEANS} v ON v.bank_id = c.key AND v.set_idx = c.set_idx, (SELECT {_literal(_DECODER.T)} AS w)),
e AS (SELECT avg(list_sum(list_transform(list_zip(m, recon), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 48) AS mse, avg(list_sum(list_transform(m, lambda x: x * x)) / 48) AS energy FROM r)
SELECT round(mse, 5) AS mse, round(energy, 5) AS input_energy, round(mse / energy, 5) AS normalized_mse FROM e""")
def decoded_codes(spark, d):
    """Codes decoded by a shared matrix in numpy batches, and the error against the mean vectors."""
    vectors = _valid(spark, d)
    decoded = codes.multiply(_codes(spark, d), "z", _DECODER, "recon")
    means = codes.mean_vectors(vectors, ["bank_id", "set_idx"], DIM).withColumnRenamed("bank_id", "key")
    rows = decoded.join(means, ["key", "set_idx"])
    out = codes.reconstruction(rows, "mean", "recon")
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@query("code_diagnostics", f"""
WITH c AS {_CODES}, s AS (SELECT key, count(*) AS n_codes, max(length(z)) AS concept_dim, avg(length(list_filter(z, lambda x: x <> 0))) AS mac, avg(sqrt(list_sum(list_transform(z, lambda x: x * x)))) AS norm, avg(sqrt(list_sum(list_transform(z_dense, lambda x: x * x)))) AS dnorm FROM c GROUP BY 1),
f AS (SELECT key, i, avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END) AS freq FROM (SELECT key, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM c) GROUP BY 1, 2), t AS (SELECT key, sum(freq) AS s FROM f GROUP BY 1),
e AS (SELECT f.key, sum(CASE WHEN freq > 0 THEN -(freq / s) * ln(freq / s) ELSE 0 END) / ln(count(*)) AS entropy, CAST(sum(CASE WHEN freq > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ever, avg(freq) AS mf, max(freq) AS xf FROM f JOIN t ON f.key = t.key GROUP BY 1)
SELECT s.key, n_codes, concept_dim, round(mac, 5) AS mean_active_count, ever AS concepts_ever_active, round(ever / concept_dim, 5) AS frac_concepts_ever_active, round(mf, 5) AS mean_active_frequency, round(xf, 5) AS max_active_frequency, round(entropy, 5) AS support_entropy, round(norm, 4) AS mean_code_norm, round(dnorm, 4) AS mean_dense_code_norm FROM s JOIN e ON s.key = e.key""")
def code_diagnostics(spark, d):
    got = codes.diagnostics(_codes(spark, d))
    exact = {"n_codes", "concept_dim", "concepts_ever_active", "key"}
    return got.select(*[F.col(c) if c in exact else F.round(c, 4 if "norm" in c else 5).alias(c) for c in got.columns])


@query("concept_signs", f"""
SELECT key, i AS dim, CASE WHEN coalesce(avg(CASE WHEN v <> 0 THEN v END), 0) >= 0 THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT key, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS i FROM {_CODES}) GROUP BY 1, 2""")
def concept_signs(spark, d):
    return codes.concept_signs(_codes(spark, d)).select("key", F.col("dim").cast("bigint").alias("dim"), "sign")


@query("top_examples", f"""
SELECT key, dim, rank, set_idx, round(v, 5) AS value FROM (SELECT key, dim, set_idx, v, row_number() OVER (PARTITION BY key, dim ORDER BY abs(v) DESC, set_idx) AS rank FROM (SELECT key, set_idx, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS dim FROM {_CODES})) WHERE rank <= 3""")
def top_examples(spark, d):
    got = codes.top_examples(_codes(spark, d), "key", "set_idx", 3)
    return got.select("key", F.col("dim").cast("bigint").alias("dim"), "rank", "set_idx", F.round("value", 5).alias("value"))


def _split_codes(spark, d):
    rows = materialize(_codes(spark, d), "codes")
    return rows.withColumn("is_train", F.col("set_idx") % 5 != 0)


_SPLIT = f"(SELECT *, set_idx % 5 <> 0 AS is_train FROM {_CODES})"
_PAIRS = f"""(SELECT a.key AS source_key, b.key AS target_key, a.set_idx, a.is_train, a.z AS x, b.z AS y, list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 48 AS mse,
  length(list_intersect({_TOP.format(z='a.z')}, {_TOP.format(z='b.z')})) / 8 AS overlap, list_dot_product(a.z, b.z) / (greatest(sqrt(list_dot_product(a.z, a.z)), 1e-12) * greatest(sqrt(list_dot_product(b.z, b.z)), 1e-12)) AS cos
  FROM {_SPLIT} a JOIN {_SPLIT} b ON a.set_idx = b.set_idx AND a.key <> b.key)"""


@query("transfer_identity", f"""
WITH s AS {_SPLIT}, p AS {_PAIRS},
sh AS (SELECT source_key, target_key, set_idx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS sy FROM (SELECT *, substr(sha256('0' || CAST(set_idx AS VARCHAR)), 1, 16) AS k FROM p WHERE NOT is_train) WINDOW w AS (PARTITION BY source_key, target_key ORDER BY k)),
m AS (SELECT p.*, length(list_intersect({_TOP.format(z='p.x')}, {_TOP.format(z='sh.sy')})) / 8 AS shuffled FROM p LEFT JOIN sh ON p.source_key = sh.source_key AND p.target_key = sh.target_key AND p.set_idx = sh.set_idx)
SELECT source_key, target_key, 'identity' AS bridge, count(CASE WHEN NOT is_train THEN 1 END) AS n_test, round(avg(CASE WHEN NOT is_train THEN mse END), 4) AS transfer_mse, round(avg(CASE WHEN is_train THEN overlap END), 4) AS train_topk_overlap, round(avg(CASE WHEN NOT is_train THEN overlap END), 4) AS topk_overlap,
  round(avg(CASE WHEN NOT is_train THEN shuffled END), 4) AS shuffled_topk_overlap, round(avg(CASE WHEN NOT is_train THEN cos END), 4) AS cosine FROM m GROUP BY 1, 2 HAVING count(CASE WHEN NOT is_train THEN 1 END) > 0 AND count(CASE WHEN is_train THEN 1 END) >= 2""")
def transfer_identity(spark, d):
    got = transfer.evaluate(_split_codes(spark, d), ("identity",), TOPK)
    return got.select("source_key", "target_key", "bridge", "n_test", *[F.round(c, 4).alias(c) for c in ("transfer_mse", "train_topk_overlap", "topk_overlap", "shuffled_topk_overlap", "cosine")])


_RING = """(SELECT source_key, target_key, set_idx, {v} AS v, coalesce(lead({v}) OVER w, first_value({v}) OVER w) AS other FROM (SELECT *, substr(sha256('{seed}' || CAST(set_idx AS VARCHAR)), 1, 16) AS k FROM {p} WHERE NOT is_train) WINDOW w AS (PARTITION BY source_key, target_key ORDER BY k))"""
_UNIT = "list_transform({v}, lambda q: q / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"
_COSINE = "(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12)))"
_MOVED = "list_transform(list_zip(t, {d}), lambda p: p[1] + alpha * p[2])"


@query("steered_identity", f"""
WITH p AS (SELECT source_key, target_key, set_idx, is_train, {_UNIT.format(v='x')} AS dir, {_UNIT.format(v='y')} AS t FROM {_PAIRS}), ok AS (SELECT source_key, target_key FROM p GROUP BY 1, 2 HAVING count(CASE WHEN is_train THEN 1 END) >= 2),
r AS {_RING.format(v='dir', seed=1, p='p')}, e AS (SELECT r.*, p.t, alpha FROM r JOIN p USING (source_key, target_key, set_idx) JOIN ok USING (source_key, target_key), (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (5.0::DOUBLE)) AS a(alpha)),
m AS (SELECT source_key, target_key, alpha, v, other, {_MOVED.format(d='v')} AS a, {_MOVED.format(d='other')} AS b FROM e)
SELECT source_key, target_key, alpha AS steering_alpha, round(avg({_COSINE.format(a='a', b='v')}), 5) AS structured_similarity, round(avg({_COSINE.format(a='b', b='v')}), 5) AS random_similarity FROM m GROUP BY 1, 2, 3""")
def steered_identity(spark, d):
    """Targets moved along the source's code as it is, and along that of another set."""
    got = transfer.evaluate(_split_codes(spark, d), ("identity",), TOPK, alphas=(0.0, 1.0, 5.0))
    return got.select("source_key", "target_key", "steering_alpha", F.round("structured_similarity", 5).alias("structured_similarity"), F.round("random_similarity", 5).alias("random_similarity"))


@query("bridge_checks", f"SELECT source_key, target_key, bridge, count(*) AS n_train, 0.0::DOUBLE AS off FROM {_PAIRS}, (VALUES ('identity'), ('procrustes'), ('ridge')) AS b(bridge) WHERE is_train GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def bridge_checks(spark, d):
    """What must hold of fitted bridges, as the share by which it fails: a rotation and the identity leave lengths as they
    are; of a ridge solution W, the sum over rows of xW (xW - y) and the ridge times WW come to nothing."""
    pairs = materialize(transfer.code_pairs(_split_codes(spark, d)).filter("is_train"), "pairs")
    bridges = materialize(transfer.fit_bridges(transfer.grams(pairs), transfer.BRIDGES), "bridges")
    mapped = transfer.map_codes(pairs.select("source_key", "target_key", "set_idx", "is_train", "x", "y"), bridges)
    m, x, y = F.col("mapped"), F.col("x"), F.col("y")
    sums = mapped.groupBy("source_key", "target_key", "bridge").agg(F.count("*").alias("n_train"), F.sum(V.dot(m, m)).alias("mm"), F.sum(V.dot(m, y)).alias("my"), F.sum(V.dot(x, x)).alias("xx"))
    weights = bridges.select("source_key", "target_key", "bridge", V.dot(F.col("matrix"), F.col("matrix")).alias("ww"))
    off = F.when(F.col("bridge") == "ridge", F.col("mm") - F.col("my") + F.col("ww")).otherwise(F.col("mm") - F.col("xx")) / F.col("xx")
    return sums.join(weights, ["source_key", "target_key", "bridge"]).select("source_key", "target_key", "bridge", "n_train", F.abs(F.round(off, 6)).alias("off"))


@query("curved_bridges", f"SELECT source_key, target_key, count(CASE WHEN is_train THEN 1 END) AS n_train, count(CASE WHEN NOT is_train THEN 1 END) AS n_test, true AS better FROM {_PAIRS} GROUP BY 1, 2 HAVING count(CASE WHEN is_train THEN 1 END) >= 2")
def curved_bridges(spark, d):
    """A curved bridge for each pair of banks: the sets it was fitted on and those it was not, and whether it comes nearer
    to the targets it was fitted on than nothing does, which it must."""
    pairs = materialize(transfer.code_pairs(_split_codes(spark, d)).select("source_key", "target_key", "set_idx", "is_train", "x", "y"), "pairs")
    models = materialize(transfer.fit_curved(pairs, epochs=60).filter("n_train >= 2"), "models")
    mapped = transfer.map_curved(pairs, models)
    error = V.mean_of(F.zip_with("mapped", "y", lambda a, b: (a - b) * (a - b)))
    train = F.col("is_train")
    got = mapped.groupBy("source_key", "target_key").agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(~train, 1)).alias("n_test"), F.avg(F.when(train, error)).alias("e"), F.avg(F.when(train, V.mean_of(F.transform("y", lambda a: a * a)))).alias("none"))
    return got.select("source_key", "target_key", "n_train", "n_test", (F.col("e") < F.col("none")).alias("better"))


_SCORES = """(abs(sum({a} * {b})) / sqrt(sum({a} * {a}) * sum({b} * {b})))"""


@query("inspected_identity", f"""
WITH p AS {_PAIRS}, r AS {_RING.format(v='y', seed=0, p='p')}, c AS (SELECT source_key, target_key, set_idx, unnest(p.x) AS m, unnest(p.y) AS y, unnest(r.other) AS s, generate_subscripts(p.x, 1) - 1 AS dim FROM r JOIN p USING (source_key, target_key, set_idx)),
k AS (SELECT *, row_number() OVER (w ORDER BY abs(m) DESC, set_idx) <= 10 AS tm, row_number() OVER (w ORDER BY abs(y) DESC, set_idx) <= 10 AS ty, row_number() OVER (w ORDER BY abs(s) DESC, set_idx) <= 10 AS ts FROM c WINDOW w AS (PARTITION BY source_key, target_key, dim)),
g AS (SELECT source_key, target_key, dim, CASE WHEN sum(abs(m)) = 0 OR sum(abs(y)) = 0 THEN 0.0 ELSE {_SCORES.format(a='m', b='y')} END AS a, CASE WHEN sum(abs(m)) = 0 OR sum(abs(s)) = 0 THEN 0.0 ELSE {_SCORES.format(a='m', b='s')} END AS b,
  count(CASE WHEN tm AND ty THEN 1 END) / least(10, count(*)) AS o, count(CASE WHEN tm AND ts THEN 1 END) / least(10, count(*)) AS q, avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0.0 END) AS fy, avg(CASE WHEN m <> 0 THEN 1.0 ELSE 0.0 END) AS fx FROM k GROUP BY 1, 2, 3)
SELECT source_key, target_key, dim AS target_concept_dim, dim AS source_concept_dim, round(a, 4) AS alignment, round(b, 4) AS shuffled_alignment, round(o, 4) AS top_example_overlap, round(q, 4) AS shuffled_top_example_overlap, round(fy, 4) AS target_active_freq, round(fx, 4) AS source_active_freq, round(a - b + o - q, 3) AS inspection_score
FROM g WHERE (source_key, target_key) IN (SELECT (source_key, target_key) FROM p WHERE is_train GROUP BY source_key, target_key HAVING count(*) >= 2)""")
def inspected_identity(spark, d):
    """All concepts of all pairs of banks under the identity."""
    rows = _split_codes(spark, d)
    chosen = materialize(transfer.code_pairs(rows).select("source_key", "target_key").distinct(), "chosen")
    got = transfer.inspect_pairs(rows, chosen, method="identity")
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return got.select("source_key", "target_key", big("target_concept_dim"), big("source_concept_dim"), *[F.round(c, 4).alias(c) for c in ("alignment", "shuffled_alignment", "top_example_overlap", "shuffled_top_example_overlap", "target_active_freq", "source_active_freq")], F.round("inspection_score", 3).alias("inspection_score"))


@query("pair_relations", "SELECT DISTINCT a.f AS source_family, b.f AS target_family, CASE WHEN a.f = b.f THEN 'within_family' ELSE 'cross_family' END AS relation FROM (SELECT DISTINCT split_part(bank_id, '_', 1) AS f FROM activation_bank) a, (SELECT DISTINCT split_part(bank_id, '_', 1) AS f FROM activation_bank) b")
def pair_relations(spark, d):
    """How families stand to each other; a few names, one by one."""
    rows = table(spark, d, "activation_bank").select("bank_id").distinct().withColumns(codes.bank_parts(F.col("bank_id"))).select("family").distinct()
    names = rows.agg(F.collect_set("family").alias("f"))
    both = names.select(F.explode("f").alias("source_family"), "f").select("source_family", F.explode("f").alias("target_family"))
    return both.withColumn("relation", transfer.relation(F.col("source_family"), F.col("target_family")))


def _results(spark, d):
    got = transfer.evaluate(_split_codes(spark, d), transfer.BRIDGES, TOPK, alphas=(0.0, 1.0, 5.0))
    parts = {f"{side}_{c}": e for side in ("source", "target") for c, e in codes.bank_parts(F.col(f"{side}_key")).items() if c in ("family", "layer")}
    return got.withColumns(parts).withColumns({"method": F.lit("set"), "relation": transfer.relation(F.col("source_family"), F.col("target_family")), "set_size": F.lit(1)})


@query("transfer_grid")
def transfer_grid(spark, d):
    got = _results(spark, d)
    doubles = [c for c, t in got.dtypes if t == "double"]
    return got.select(*[F.round(c, 5).alias(c) if c in doubles and c != "steering_alpha" else F.col(c) for c in got.columns])


@query("transfer_summaries")
def transfer_summaries(spark, d):
    """Six groupings of the results without steering, in one scan."""
    rows = _results(spark, d).filter("steering_alpha = 0")
    m = ["method"]
    return transfer.summaries(rows, {
        "bridge_method": [*m, "bridge"], "method_relation": [*m, "relation", "bridge"], "family_pair": [*m, "source_family", "target_family", "bridge"], "depth_pair": [*m, "source_layer", "target_layer", "bridge"],
        "set_size": [*m, "set_size", "bridge"], "family_depth_pair": [*m, "source_family", "target_family", "source_layer", "target_layer", "bridge"],
    })


@query("inspected_concepts")
def inspected_concepts(spark, d):
    rows = _split_codes(spark, d)
    chosen = materialize(transfer.candidate_pairs(transfer.evaluate(rows, ("ridge",), TOPK), "ridge", 8), "chosen")
    return transfer.rank_concepts(transfer.inspect_pairs(rows, chosen), 8)


@query("trained_banks")
def trained_banks(spark, d):
    """The parts of the loss of a model trained for each bank, epoch by epoch, on its training and its test sets."""
    return training.train_banks(_valid(spark, d), DIM, concepts=32, epochs=3)


@query("pooled_tokens", """
SELECT vec_id, round(list_sum(t[greatest(n, 1)]), 5) AS last_sum, CASE WHEN n = 0 THEN 0.0 ELSE round(list_sum(list_transform(range(1, 9), lambda i: list_sum(list_transform(list_slice(t, 1, n), lambda x: x[i])) / n)), 5) END AS mean_sum
FROM (SELECT vec_id, vec_id % 9 AS n, list_transform(range(0, 8), lambda k: list_transform(list_slice(embedding, k * 8 + 1, k * 8 + 8), lambda x: x::DOUBLE)) AS t FROM embeddings)""")
def pooled_tokens(spark, d):
    """The two ways to one vector from the states of a text's tokens: the last, or their mean, under a mask. An empty
    mask gives the first state and a zero mean."""
    rows = table(spark, d, "embeddings")
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(V.doubles(F.col("embedding")), k * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i <= F.col("vec_id") % 9).cast("int"))
    return rows.select("vec_id", F.round(V.total(V.last_position(states, mask)), 5).alias("last_sum"), F.round(V.total(V.masked_mean(states, mask)), 5).alias("mean_sum"))


@query("stand_in_vectors")
def stand_in_vectors(spark, d):
    """Normal numbers in place of a model's states, the same wherever they are made."""
    rows = Q.sets(spark, d).select("original_id")
    return rows.select("original_id", V.gaussian_vector(F.col("original_id"), 16).alias("v")).select("original_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("bank_positions", f"SELECT bank_id, set_idx, ord FROM (SELECT bank_id, set_idx, row_number() OVER (PARTITION BY bank_id ORDER BY set_idx) - 1 AS ord FROM (SELECT DISTINCT bank_id, set_idx FROM activation_bank)) WHERE ord < 20")
def bank_positions(spark, d):
    """The first sets of each bank in their order."""
    rows = table(spark, d, "activation_bank").select("bank_id", "set_idx").distinct()
    return selection.numbered(rows, "set_idx", by=("bank_id",)).filter("ord < 20")


@query("streamed_reasons", f"SELECT reason, count(*) AS n FROM (SELECT split_part(unnest(reasons), '=', 1) AS reason, logged_at FROM rejected WHERE logged_at IS NOT NULL) WHERE reason IS NOT NULL GROUP BY 1")
def streamed_reasons(spark, d):
    """Reasons counted by a stream in windows of time, added up when it has read everything."""
    rows = spark.readStream.schema(table(spark, d, "rejected").schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(_folder(d, "rejected"))
    counted = stream.reason_counts(rows, "logged_at", "1 day", "3650 days")
    name = f"reasons_{uuid.uuid4().hex}"
    q = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).groupBy("reason").agg(F.sum("n").alias("n"))


def _folder(d: str, name: str) -> str:
    """A folder that holds the files of one table, which a stream wants to read: a pattern where the table is a file."""
    import os

    path = f"{d}/{name}.parquet"
    return path if os.path.isdir(path) else f"{d}/{name}.parque[t]"


@query("streamed_first", f"SELECT original_id, length_band FROM (SELECT original_id, unnest(rewrite_meta).length_band AS length_band FROM semantic_set_view) WHERE length_band IS NOT NULL GROUP BY ALL")
def streamed_first(spark, d):
    """The first rewrite of each original and band to arrive in a stream, appended once by key."""
    rows = spark.readStream.schema(table(spark, d, "semantic_set_view").schema).parquet(_folder(d, "semantic_set_view"))
    each = rows.select("original_id", "built_at", F.explode("rewrite_meta").alias("r")).select("original_id", "built_at", "r.length_band", "r.text").filter("length_band is not null")
    first = stream.first_accepted(each, ["original_id", "length_band"], F.lit(True), "built_at", "3650 days").select("original_id", "length_band")
    path = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    q = first.writeStream.foreachBatch(stream.append_new(["original_id", "length_band"], path)).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


@query("bank_losses")
def bank_losses(spark, d):
    return training.bank_losses(_valid(spark, d), DIM)


@query("decoder_directions", f"""
SELECT key, i AS dim, CASE WHEN coalesce(avg(CASE WHEN v <> 0 THEN v END), 0) >= 0 THEN 2.0 ELSE -2.0 END AS at_own_place FROM (SELECT key, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS i FROM {_CODES}) GROUP BY 1, 2""")
def decoder_directions(spark, d):
    signs = codes.concept_signs(_codes(spark, d))
    got = codes.decoder_directions(3.0 * np.eye(DIM), signs, length=2.0)
    return got.select("key", F.col("dim").cast("bigint").alias("dim"), F.get("direction", F.col("dim")).alias("at_own_place"))
