"""Queries over latent sets, claims, rejections, the registry and steering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import evidence, jobs, selection, sets, steering, transfer, validation
from loomset.plans import tables as Q
from loomset.plans.registry import query
from loomset.runtime import table

S = Q.strip_sql


def _e(x: str) -> str:
    return f"(coalesce({S(x)}, '') = '')"


_ISSUES = f"""
SELECT set_id, array_to_string(list_concat(list_concat(list_concat(list_concat(list_concat(
  list_filter([CASE WHEN {_e('set_id')} THEN 'missing_set_id' END, CASE WHEN {_e('latent_type')} THEN 'missing_latent_type' END, CASE WHEN {_e('latent_key')} THEN 'missing_latent_key' END, CASE WHEN {_e('source_dataset')} THEN 'missing_source_dataset' END,
    CASE WHEN coalesce(length(source_ids), 0) = 0 THEN 'missing_source_ids' END, CASE WHEN length(texts) < 2 THEN 'too_few_views<2' END, CASE WHEN length(ids) <> length(list_distinct(ids)) THEN 'duplicate_view_ids' END], lambda x: x IS NOT NULL),
  flatten(list_transform(list_zip(texts, ids), lambda z: list_filter([CASE WHEN {_e('z[1].text')} THEN 'empty_view_text:' || z[2] END, CASE WHEN {_e('z[1].view_type')} THEN 'missing_view_type:' || z[2] END], lambda x: x IS NOT NULL)))),
  list_filter([CASE WHEN length(list_distinct(list_filter(list_transform(texts, lambda v: coalesce({S('v.view_type')}, '')), lambda x: x <> ''))) < 2 THEN 'too_few_view_types<2' END], lambda x: x IS NOT NULL)),
  flatten(list_transform(edges, lambda e: list_filter([CASE WHEN NOT list_contains(refs, coalesce(e.source, '')) THEN 'edge_unknown_source:' || coalesce(e.source, '') END, CASE WHEN NOT list_contains(refs, coalesce(e.target, '')) THEN 'edge_unknown_target:' || coalesce(e.target, '') END, CASE WHEN coalesce(e.relation, 'positive') = '' THEN 'edge_missing_relation' END], lambda x: x IS NOT NULL)))),
  flatten(list_transform(list_zip(negs, nids), lambda z: list_filter([CASE WHEN {_e('z[1].text')} THEN 'empty_negative_text:' || z[2] END, CASE WHEN coalesce({S('z[1].negative_type')}, 'hard_negative') = '' THEN 'missing_negative_type:' || z[2] END], lambda x: x IS NOT NULL)))),
  list_filter([CASE WHEN NOT {_e('risk_tag')} AND coalesce(nullif({S('usage')}, ''), 'train') = 'train' THEN 'risk_tagged_row_marked_train' END], lambda x: x IS NOT NULL)), '; ') AS issues
FROM (SELECT *, list_concat(ids, list_transform(range(length(texts)), lambda i: CAST(i AS VARCHAR))) AS refs FROM (
  SELECT set_id, latent_type, latent_key, source_dataset, source_ids, risk_tag, usage, coalesce(texts, []) AS texts, coalesce(positive_edges, []) AS edges, coalesce(hard_negatives, []) AS negs,
    list_transform(coalesce(texts, []), lambda v, i: coalesce(nullif(v.id, ''), printf('view_%02d', i - 1))) AS ids, list_transform(coalesce(hard_negatives, []), lambda v, i: coalesce(nullif(v.id, ''), printf('negative_%02d', i - 1))) AS nids FROM {Q.LATENT_SQL}))"""


@query("latent_issues", _ISSUES)
def latent_issues(spark, d):
    return Q.latent(spark, d).select("set_id", F.array_join(validation.latent_issues(), "; ").alias("issues"))


@query("latent_counts", f"""
WITH l AS {Q.LATENT_SQL}, v AS (SELECT unnest(texts) AS v FROM l), n AS (SELECT unnest(hard_negatives) AS n FROM l)
SELECT 'latent_type' AS counter, coalesce({S('latent_type')}, '') AS key, count(*) AS n FROM l GROUP BY 2
UNION ALL SELECT 'source_dataset', coalesce({S('source_dataset')}, ''), count(*) FROM l GROUP BY 2
UNION ALL SELECT 'usage', coalesce(nullif({S('usage')}, ''), 'train'), count(*) FROM l GROUP BY 2
UNION ALL SELECT 'label', json_extract_string(metadata, '$.label'), count(*) FROM l WHERE json_extract_string(metadata, '$.label') IS NOT NULL GROUP BY 2
UNION ALL SELECT 'view_type', coalesce({S('v.view_type')}, ''), count(*) FROM v GROUP BY 2
UNION ALL SELECT 'evidence', CASE WHEN v.view_type = 'evidence_reference' OR coalesce(json_extract_string(v.metadata, '$.evidence_text_missing'), 'false') = 'true' THEN 'missing' ELSE 'present' END, count(*) FROM v WHERE v.view_type IN ('evidence', 'evidence_reference') GROUP BY 2
UNION ALL SELECT 'negative', 'placeholder', count(*) FROM n WHERE n.negative_type = 'placeholder_requires_mining' OR coalesce(json_extract_string(n.metadata, '$.needs_replacement'), 'false') = 'true' HAVING count(*) > 0""")
def latent_counts(spark, d):
    return sets.latent_counts(Q.latent(spark, d))


@query("claim_evidence", f"""
WITH l AS (SELECT length(coalesce(texts, [])) AS views, list_filter(texts, lambda v: v.view_type = 'claim')[1] AS c, list_filter(texts, lambda v: v.view_type = 'evidence')[1] AS e FROM {Q.LATENT_SQL}),
t AS (SELECT views, CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN list_transform(regexp_extract_all(coalesce(c.text, 'None'), '[A-Za-z0-9]+'), lambda x: lower(x)) END AS ct, CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN list_transform(regexp_extract_all(coalesce(e.text, 'None'), '[A-Za-z0-9]+'), lambda x: lower(x)) END AS et FROM l)
SELECT count(*) AS n_sets, round(avg(views), 6) AS mean_views, round(avg(CASE WHEN ct IS NULL THEN NULL WHEN length(list_distinct(list_concat(ct, et))) = 0 THEN 1.0 ELSE length(list_intersect(ct, et)) / length(list_distinct(list_concat(ct, et))) END), 6) AS mean_jaccard, round(avg(length(ct)), 6) AS mean_claim_tokens, round(avg(length(et)), 6) AS mean_evidence_tokens FROM t""")
def claim_evidence(spark, d):
    return sets.claim_evidence(Q.latent(spark, d))


@query("latent_normal", f"""
SELECT coalesce({S('set_id')}, '') AS set_id, coalesce({S('source_dataset')}, '') AS source_dataset, {S('domain')} AS domain, coalesce(nullif({S('usage')}, ''), 'train') AS usage,
  array_to_string(list_transform(coalesce(texts, []), lambda v, i: coalesce(nullif(v.id, ''), printf('view_%02d', i - 1)) || '=' || coalesce({S('v.text')}, '')), ' / ') AS views,
  array_to_string(list_transform(coalesce(positive_edges, []), lambda e: coalesce(e.source, '') || '>' || coalesce(e.target, '') || ':' || coalesce(e.relation, 'positive')), ' / ') AS edges,
  array_to_string(list_transform(coalesce(hard_negatives, []), lambda e: coalesce({S('e.negative_type')}, 'hard_negative')), ' / ') AS negatives
FROM {Q.LATENT_SQL}""")
def latent_normal(spark, d):
    rows = sets.normal_latent(Q.latent(spark, d))
    join = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), " / "), F.lit(""))
    return rows.select(
        "set_id", "source_dataset", "domain", "usage", join("texts", lambda v: F.concat(v["id"], F.lit("="), v["text"])).alias("views"),
        join("positive_edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(":"), e["relation"])).alias("edges"), join("hard_negatives", lambda n: n["negative_type"]).alias("negatives"),
    )


@query("rejected_reasons", f"SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM {Q.REJECTED_SQL}) WHERE reason IS NOT NULL GROUP BY 1")
def rejected_reasons(spark, d):
    return sets.reason_counts(Q.rejected(spark, d))


@query("rejected_kinds", f"SELECT reason, count(*) AS n FROM (SELECT split_part(unnest(reasons), '=', 1) AS reason FROM {Q.REJECTED_SQL}) WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 4")
def rejected_kinds(spark, d):
    return sets.reason_counts(Q.rejected(spark, d), kind_only=True, top=4)


@query("registry_issues", f"""
SELECT source_id, issue FROM (SELECT source_id, unnest([CASE WHEN {_e('source_id')} THEN 'missing_source_id' END, CASE WHEN {_e('hf_dataset')} THEN 'missing_hf_dataset' END, CASE WHEN {_e('builder')} THEN 'missing_builder' END,
  CASE WHEN NOT coalesce(status IN ('build_now', 'optional_eval', 'future_work'), false) THEN 'invalid_status:' || coalesce(status, '') END, CASE WHEN coalesce(length(splits), 0) = 0 THEN 'missing_splits' END, CASE WHEN coalesce(length(latent_types), 0) = 0 THEN 'missing_latent_types' END]) AS issue FROM registry) WHERE issue IS NOT NULL
UNION ALL SELECT source_id, 'duplicate_source_id' FROM registry GROUP BY 1 HAVING count(*) > 1""")
def registry_issues(spark, d):
    return validation.source_issues(table(spark, d, "registry"))


@query("registry_sources", "SELECT source_id, hf_dataset, status FROM registry WHERE status = 'build_now'")
def registry_sources(spark, d):
    return table(spark, d, "registry").filter("status = 'build_now'").select("source_id", "hf_dataset", "status")


@query("news_by_source", f"""
SELECT n.source_id, r.status, count(*) AS n FROM (SELECT split_part(source, ':', 2) AS source_id FROM {Q.NEWS_SQL}) n JOIN (SELECT source_id, min(status) AS status FROM registry WHERE source_id IS NOT NULL GROUP BY 1) r ON n.source_id = r.source_id GROUP BY 1, 2""")
def news_by_source(spark, d):
    known = table(spark, d, "registry").filter("source_id is not null").groupBy("source_id").agg(F.min("status").alias("status"))
    counts = Q.news(spark, d).select(F.split_part("source", F.lit(":"), F.lit(2)).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    listed = counts.join(known.select("source_id"), "source_id", "left_semi")
    return jobs.lookup(listed, known, "source_id").select("source_id", "status", "n")


# ---- claims and evidence: claims of latent sets and rejections against the sentences that evidence views hold

_SENTENCES = f"""(SELECT page, sentence_id, arg_max(sentence, o) AS sentence FROM (
  SELECT split_part(v.source_id, ':', 2) AS page, TRY_CAST(split_part(v.source_id, ':', 3) AS INT) AS sentence_id, {Q.collapse_sql("coalesce(v.text, '')")} AS sentence, set_id AS o FROM (SELECT set_id, unnest(texts) AS v FROM {Q.LATENT_SQL}) WHERE v.view_type = 'evidence' AND v.source_id LIKE 'wiki:%')
  WHERE sentence <> '' AND page <> '' AND sentence_id IS NOT NULL GROUP BY 1, 2)"""

_CLAIMS = f"""(SELECT id, label, claim, evidence_wiki_url, evidence_sentence_id FROM (
  SELECT split_part(latent_key, ':', 2) AS id, split_part(latent_key, ':', 3) AS label, texts[1].text AS claim, split_part(latent_key, ':', 4) AS evidence_wiki_url, split_part(latent_key, ':', 5) AS evidence_sentence_id FROM {Q.LATENT_SQL}
  UNION ALL SELECT CAST(source_id AS VARCHAR), label, claim, NULL, NULL FROM {Q.REJECTED_SQL}))"""


def _sentences(spark, d):
    views = Q.latent(spark, d).select("set_id", F.explode("texts").alias("v")).filter("v.view_type = 'evidence' and v.source_id like 'wiki:%'")
    part = lambda i: F.split_part("v.source_id", F.lit(":"), F.lit(i))
    rows = views.select("set_id", part(2).alias("page"), part(3).alias("s"), T.collapse(F.coalesce("v.text", F.lit(""))).alias("sentence"))
    rows = rows.select("set_id", "page", F.expr("try_cast(s as int)").alias("sentence_id"), "sentence").filter("sentence <> '' and page <> '' and sentence_id is not null")
    return selection.last_wins(rows, ["page", "sentence_id"], "set_id", "sentence")


def _claims(spark, d):
    part = lambda i: F.split_part("latent_key", F.lit(":"), F.lit(i))
    a = Q.latent(spark, d).select(part(2).alias("id"), part(3).alias("label"), F.get("texts", F.lit(0))["text"].alias("claim"), part(4).alias("evidence_wiki_url"), part(5).alias("evidence_sentence_id"), F.lit("7").alias("evidence_annotation_id"))
    none = F.lit(None).cast("string")
    b = Q.rejected(spark, d).select(F.col("source_id").cast("string").alias("id"), "label", "claim", none.alias("evidence_wiki_url"), none.alias("evidence_sentence_id"), none.alias("evidence_annotation_id"))
    return a.unionByName(b)


_JUDGED = f"""(SELECT *, CASE WHEN length(first) > 0 THEN first WHEN sentence IS NULL THEN ['missing_evidence_text'] ELSE [] END AS reasons FROM (
  SELECT c.*, s.sentence, list_filter([CASE WHEN upper(label2) NOT IN ('SUPPORTS', 'REFUTES') THEN 'unsupported_label:' || coalesce(nullif(upper(label2), ''), 'missing') END, CASE WHEN claim2 = '' THEN 'missing_claim' END, CASE WHEN c.page = '' THEN 'missing_evidence_wiki_url' END,
    CASE WHEN n IS NULL THEN 'missing_or_invalid_id' END, CASE WHEN coalesce(c.sid, -1) < 0 THEN 'missing_evidence_sentence_id' END], lambda x: x IS NOT NULL) AS first
  FROM (SELECT *, {S("coalesce(label, '')")} AS label2, {Q.collapse_sql("coalesce(claim, '')")} AS claim2, {S("coalesce(evidence_wiki_url, '')")} AS page, TRY_CAST(id AS BIGINT) AS n, TRY_CAST(evidence_sentence_id AS INT) AS sid FROM {_CLAIMS}) c
  LEFT JOIN {_SENTENCES} s ON c.page = s.page AND c.sid = s.sentence_id))"""


@query("claims_judged", f"SELECT id, claim2 AS claim, array_to_string(reasons, ',') AS reasons, count(*) AS n FROM {_JUDGED} GROUP BY 1, 2, 3")
def claims_judged(spark, d):
    judged = evidence.judge_claims(_claims(spark, d), _sentences(spark, d))
    return judged.groupBy("id", F.col("_claim").alias("claim"), F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("claim_sets", f"""
SELECT printf('fever_pool_%06d_7', n) AS set_id, printf('fever:%d:%s:%s:%d', n, upper(label2), page, sid) AS latent_key, claim2 AS claim, sentence AS evidence, CASE WHEN upper(label2) = 'SUPPORTS' THEN 'supported_by' ELSE 'refuted_by' END AS relation, count(*) AS n FROM {_JUDGED} WHERE length(reasons) = 0 GROUP BY ALL""")
def claim_sets(spark, d):
    got = evidence.claim_sets(evidence.judge_claims(_claims(spark, d), _sentences(spark, d)), "pool")
    return got.groupBy("set_id", "latent_key", F.col("texts")[0]["text"].alias("claim"), F.col("texts")[1]["text"].alias("evidence"), F.col("positive_edges")[0]["relation"].alias("relation")).agg(F.count("*").alias("n"))


@query("claim_references", f"""
SELECT count(*) AS n_sets, CAST(sum(CASE WHEN sentence IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_references, min(CASE WHEN sentence IS NULL THEN printf('Evidence sentence %d on Wikipedia page %s %s this claim.', sid, page, CASE WHEN upper(label2) = 'SUPPORTS' THEN 'supports' ELSE 'refutes' END) END) AS least FROM {_JUDGED} WHERE length(first) = 0""")
def claim_references(spark, d):
    got = evidence.claim_sets(evidence.judge_claims(_claims(spark, d), _sentences(spark, d), reference_view=True), "pool")
    missing = ~F.col("evidence_text_present")
    return got.agg(F.count("*").alias("n_sets"), F.coalesce(F.sum(missing.cast("bigint")), F.lit(0)).alias("n_references"), F.min(F.when(missing, F.col("texts")[1]["text"])).alias("least"))


@query("required_pages", f"SELECT DISTINCT {S('evidence_wiki_url')} AS page FROM {_CLAIMS} WHERE {S('evidence_wiki_url')} <> ''")
def required_pages(spark, d):
    return evidence.required_pages(_claims(spark, d))


# ---- steering


@query("steering_summary", f"""
SELECT rank, candidate, target_model_id, alpha, count(*) AS n, round(avg(baseline_keyword_score), 6) AS mean_baseline_keyword_score, round(avg(steered_keyword_score), 6) AS mean_steered_keyword_score, round(avg(keyword_gain), 6) AS mean_keyword_gain FROM {Q.PROBES_SQL} GROUP BY 1, 2, 3, 4""")
def steering_summary(spark, d):
    return steering.summarize(Q.probes(spark, d))


@query("steering_groups", f"""
WITH p AS {Q.PROBES_SQL}, m AS (SELECT *, steered_keyword_score AS topk_overlap, baseline_keyword_score AS shuffled_topk_overlap FROM p)
SELECT 'model' AS summary, target_model_id, NULL AS alpha, NULL AS candidate, count(*) AS n, coalesce(avg(keyword_gain), 'nan'::DOUBLE) AS keyword_gain, coalesce(avg(steered_keyword_score), 'nan'::DOUBLE) AS steered_keyword_score FROM m GROUP BY 2
UNION ALL SELECT 'model_alpha', target_model_id, alpha, NULL, count(*), coalesce(avg(keyword_gain), 'nan'::DOUBLE), coalesce(avg(steered_keyword_score), 'nan'::DOUBLE) FROM m GROUP BY 2, 3
UNION ALL SELECT 'candidate', NULL, NULL, candidate, count(*), coalesce(avg(keyword_gain), 'nan'::DOUBLE), coalesce(avg(steered_keyword_score), 'nan'::DOUBLE) FROM m GROUP BY 4""")
def steering_groups(spark, d):
    """Three groupings of one scan."""
    groups = {"model": ["target_model_id"], "model_alpha": ["target_model_id", "alpha"], "candidate": ["candidate"]}
    return transfer.summaries(Q.probes(spark, d), groups, ("keyword_gain", "steered_keyword_score"))


_ALPHAS = ["-2.0", "0.0", "2.0", "4.0"]


@query("steering_pivot", f"SELECT target_model_id, " + ", ".join(f"coalesce(avg(CASE WHEN CAST(alpha AS VARCHAR) = '{a}' THEN keyword_gain END), 'nan'::DOUBLE) AS \"{a}\"" for a in _ALPHAS) + f" FROM {Q.PROBES_SQL} GROUP BY 1")
def steering_pivot(spark, d):
    rows = Q.probes(spark, d).withColumn("a", F.col("alpha").cast("string"))
    return transfer.pivoted(rows, "target_model_id", "a", _ALPHAS, "keyword_gain")


@query("steering_last", f"SELECT candidate, CAST(max(prompt_idx) AS BIGINT) AS epoch, coalesce(max_by(keyword_gain, prompt_idx * 1000000 + probe_id)::DOUBLE, 'nan'::DOUBLE) AS keyword_gain FROM {Q.PROBES_SQL} GROUP BY 1")
def steering_last(spark, d):
    rows = Q.probes(spark, d).select("candidate", (F.col("prompt_idx") * 1000000 + F.col("probe_id")).alias("epoch"), F.col("keyword_gain").cast("double").alias("keyword_gain"))
    got = transfer.last_epoch(rows, "candidate", ["keyword_gain"])
    return got.select("candidate", F.floor(F.col("epoch") / 1000000).alias("epoch"), "keyword_gain")


@query("steering_candidates", f"""
WITH c AS (SELECT target_concept_dim, row_number() OVER (ORDER BY target_concept_dim) AS rank FROM (SELECT DISTINCT target_concept_dim FROM {Q.PROBES_SQL} WHERE target_concept_dim IS NOT NULL)),
l AS (SELECT rank, arg_max(candidate, probe_id) AS candidate, arg_max(label, probe_id) AS label, arg_max(coalesce(keywords, ''), probe_id) AS keywords, CASE WHEN rank % 3 = 0 THEN 'no' ELSE 'yes' END AS use FROM {Q.PROBES_SQL} GROUP BY rank)
SELECT c.rank, c.target_concept_dim, l.candidate, l.label, l.keywords FROM c JOIN l ON c.rank = l.rank WHERE use = 'yes' AND l.keywords <> ''""")
def steering_candidates(spark, d):
    probes = Q.probes(spark, d)
    concepts = probes.filter("target_concept_dim is not null").select("target_concept_dim").distinct()
    labels = probes.select("rank", "candidate", "label", F.coalesce("keywords", F.lit("")).alias("keywords"), F.when(F.col("rank") % 3 == 0, "no").otherwise("yes").alias("use_for_steering"), F.col("probe_id").alias("ord"))
    got = steering.candidates(concepts, labels, "target_concept_dim").filter("keywords <> ''")
    given = labels.groupBy("rank").agg(F.max_by("keywords", "ord").alias("k")).filter("k <> ''").select("rank")
    return got.join(given, "rank", "left_semi").select(F.col("rank").cast("bigint").alias("rank"), "target_concept_dim", "candidate", "label", "keywords")


@query("concept_examples", f"""
WITH p AS {Q.PROBES_SQL}, r AS (SELECT candidate, probe_id, row_number() OVER (PARTITION BY candidate ORDER BY probe_id) AS r FROM p WHERE keyword_gain > 0)
SELECT c.candidate, coalesce(string_agg(CAST(r.probe_id AS VARCHAR), ',' ORDER BY r.r), '') AS examples FROM (SELECT DISTINCT candidate FROM p WHERE candidate IS NOT NULL) c LEFT JOIN r ON c.candidate = r.candidate AND r.r <= 3 GROUP BY 1""")
def concept_examples(spark, d):
    probes = Q.probes(spark, d)
    concepts = probes.filter("candidate is not null").select("candidate").distinct()
    got = steering.with_examples(concepts, probes.filter("keyword_gain > 0").select("candidate", "probe_id"), ["candidate"], ["probe_id"], "probe_id", 3)
    return got.select("candidate", F.array_join(F.transform("examples", lambda x: x["probe_id"].cast("string")), ",").alias("examples"))
