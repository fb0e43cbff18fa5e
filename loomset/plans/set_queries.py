"""Queries over rewrite sets: judging, first successes, grouping, statistics, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import generation, jobs, sampling, selection, sets, validation
from loomset.plans import tables as Q
from loomset.plans.registry import query
from loomset.runtime import materialize, table
from loomset.sources import files


def _big(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


@query("sets_stats_by_source", f"""
SELECT coalesce(source, 'None') AS source, count(*) AS n_sets, CAST(sum(length(rewrites)) AS BIGINT) AS n_rewrites, min(length(rewrites)) AS min_rewrites, max(length(rewrites)) AS max_rewrites, round(avg(length(rewrites)), 6) AS mean_rewrites
FROM {Q.SETS_SQL} GROUP BY 1""")
def sets_stats_by_source(spark, d):
    n = F.size("rewrites")
    rows = Q.sets(spark, d).groupBy(F.coalesce("source", F.lit("None")).alias("source"))
    return rows.agg(F.count("*").alias("n_sets"), F.sum(n).alias("n_rewrites"), F.min(n).cast("bigint").alias("min_rewrites"), F.max(n).cast("bigint").alias("max_rewrites"), F.round(F.avg(n), 6).alias("mean_rewrites"))


@query("sets_totals", f"SELECT count(*) AS n_sets, CAST(sum(length(rewrites)) AS BIGINT) AS n_rewrites, min(length(rewrites)) AS min_rewrites, max(length(rewrites)) AS max_rewrites, round(avg(length(rewrites)), 6) AS mean_rewrites FROM {Q.SETS_SQL}")
def sets_totals(spark, d):
    return sets.set_totals(Q.sets(spark, d))


@query("sets_stats", f"""
WITH s AS {Q.SETS_SQL}, r AS (SELECT unnest(rewrites) AS r FROM s)
SELECT 'n_sets' AS metric, '' AS key, count(*) AS value FROM s
UNION ALL SELECT 'n_rewrites', '', CAST(sum(length(rewrites)) AS BIGINT) FROM s
UNION ALL SELECT 'rewrite_count', CAST(length(rewrites) AS VARCHAR), count(*) FROM s GROUP BY 2
UNION ALL SELECT 'label', coalesce(label, 'None'), count(*) FROM s GROUP BY 2
UNION ALL SELECT 'sets_at_least', CAST(k AS VARCHAR), CAST(sum(CASE WHEN length(rewrites) >= k THEN 1 ELSE 0 END) AS BIGINT) FROM s, (VALUES (2), (4), (8), (16), (24), (32), (40)) AS t(k) GROUP BY 2
UNION ALL SELECT 'model', coalesce(r.model_name, 'None'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'length_band', coalesce(r.length_band, 'None'), count(*) FROM r GROUP BY 2""")
def sets_stats(spark, d):
    return sets.set_stats(Q.sets(spark, d))


@query("sets_with_rewrites", f"SELECT original_id, length(rewrites) AS n_rewrites FROM {Q.SETS_SQL} WHERE length(rewrites) >= 6")
def sets_with_rewrites(spark, d):
    return sets.with_rewrites(Q.sets(spark, d), 6).select("original_id", F.size("rewrites").cast("bigint").alias("n_rewrites"))


_JUDGED = f"""(SELECT *, list_filter([
    CASE WHEN n < low OR n > high THEN printf('word_count=%d, expected=%d-%d', n, low, high) END,
    CASE WHEN length(hits) > 0 THEN 'banned_words=' || array_to_string(hits, ',') END,
    CASE WHEN length(rewrite) < 5 THEN 'empty_or_too_short' END], lambda r: r IS NOT NULL) AS reasons
  FROM (SELECT *, length({Q.band_words_sql('rewrite')}) AS n, list_sort(list_distinct(list_intersect({Q.banned_sql("coalesce(original_text, '')", T.STOPWORDS)}, {Q.band_words_sql('rewrite')}))) AS hits FROM {Q.ATTEMPTS_SQL}))"""


def _judged(spark, d):
    rows = Q.attempts(spark, d)
    banned = T.banned_words(F.coalesce("original_text", F.lit("")))
    return rows.withColumn("reasons", validation.rewrite_reasons(F.col("rewrite"), banned, F.col("low"), F.col("high")))


@query("attempts_judged", f"SELECT original_id, attempt_idx, model_name, length_band, length(reasons) = 0 AS ok, array_to_string(reasons, ' / ') AS reasons FROM {_JUDGED}")
def attempts_judged(spark, d):
    return _judged(spark, d).select("original_id", *_big("attempt_idx"), "model_name", "length_band", (F.size("reasons") == 0).alias("ok"), F.array_join("reasons", " / ").alias("reasons"))


_SLOT = ["original_id", "length_band"]


@query("attempts_first", f"SELECT original_id, length_band, min(attempt_idx) AS attempt_idx, arg_min(rewrite, attempt_idx) AS rewrite FROM {_JUDGED} WHERE length(reasons) = 0 GROUP BY 1, 2")
def attempts_first(spark, d):
    return selection.first_success(_judged(spark, d), _SLOT, F.size("reasons") == 0, "attempt_idx").select("original_id", "length_band", *_big("attempt_idx"), "rewrite")


@query("attempts_made", f"""
SELECT original_id, length_band, attempt_idx FROM (SELECT *, min(CASE WHEN length(reasons) = 0 THEN attempt_idx END) OVER (PARTITION BY original_id, length_band) AS first FROM {_JUDGED}) WHERE first IS NULL OR attempt_idx <= first""")
def attempts_made(spark, d):
    return selection.until_success(_judged(spark, d), _SLOT, F.size("reasons") == 0, "attempt_idx").select("original_id", "length_band", *_big("attempt_idx"))


@query("attempt_reasons", f"SELECT reason, count(*) AS n FROM (SELECT split_part(unnest(reasons), '=', 1) AS reason FROM {_JUDGED}) GROUP BY 1")
def attempt_reasons(spark, d):
    return sets.reason_counts(_judged(spark, d), kind_only=True)


@query("accepted_sets", f"""
SELECT original_id, arg_min(coalesce(original_text, ''), attempt_idx) AS original_text, count(*) AS n_rewrites, string_agg(coalesce(model_name, '?'), ',' ORDER BY attempt_idx) AS models, string_agg(rewrite, ' | ' ORDER BY attempt_idx) AS texts
FROM {_JUDGED} WHERE length(reasons) = 0 GROUP BY 1""")
def accepted_sets(spark, d):
    rows = _judged(spark, d).filter(F.size("reasons") == 0)
    got = sets.group_accepted(rows, "attempt_idx")
    models = F.transform("rewrites", lambda r: F.coalesce(r["model_name"], F.lit("?")))
    return got.select("original_id", F.coalesce("original_text", F.lit("")).alias("original_text"), F.size("rewrites").cast("bigint").alias("n_rewrites"), F.array_join(models, ",").alias("models"), F.array_join(F.transform("rewrites", lambda r: r["text"]), " | ").alias("texts"))


@query("semantic_rules", f"""
SELECT probe_id, array_to_string(list_filter([CASE WHEN c < 0.62 THEN printf('low_embedding_cosine=%.3f', c) END, CASE WHEN e < 0.5 THEN printf('low_entailment=%.3f', e) END, CASE WHEN x > 0.25 THEN printf('high_contradiction=%.3f', x) END], lambda r: r IS NOT NULL), '; ') AS reasons
FROM (SELECT probe_id, CASE WHEN rank % 5 = 0 THEN NULL ELSE rank / 20.0 END::DOUBLE AS c, (prompt_idx % 10 / 8.0)::DOUBLE AS e, (target_layer / 64.0)::DOUBLE AS x FROM {Q.PROBES_SQL})""")
def semantic_rules(spark, d):
    c = F.when(F.col("rank") % 5 != 0, F.col("rank") / 20.0)
    found = validation.semantic_reasons(c, F.col("prompt_idx") % 10 / 8.0, F.col("target_layer") / 64.0)
    return Q.probes(spark, d).select("probe_id", F.array_join(found, "; ").alias("reasons"))


@query("news_labels", f"SELECT coalesce(label, 'None') AS label, count(*) AS n, CAST(sum(CASE WHEN id < 'news_train_000000300' THEN 1 ELSE 0 END) AS BIGINT) AS n_first FROM {Q.NEWS_SQL} GROUP BY 1")
def news_labels(spark, d):
    return Q.news(spark, d).groupBy(F.coalesce("label", F.lit("None")).alias("label")).agg(F.count("*").alias("n"), F.sum((F.col("id") < "news_train_000000300").cast("bigint")).alias("n_first"))


_LABELS = ["world", "sports", "business", "science_technology"]


@query("news_balanced", f"""
WITH r AS (SELECT id, label, l, row_number() OVER (PARTITION BY l ORDER BY k) AS r, k FROM (SELECT id, label, list_position(['world', 'sports', 'business', 'science_technology'], label) - 1 AS l, substr(sha256('0' || id), 1, 16) AS k FROM {Q.NEWS_SQL}) WHERE l >= 0)
SELECT id, label FROM (SELECT *, CASE WHEN r > 75 + CASE WHEN l < 2 THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS o FROM r) ORDER BY o, k LIMIT 302""")
def news_balanced(spark, d):
    return sampling.balanced(Q.news(spark, d), 302, _LABELS, F.col("label"), F.col("id")).select("id", "label")


@query("news_split", f"""
SELECT id, ord, ord < floor(n * 0.8) AS is_train, ord % 4 = 1 AS in_shard, CAST(CASE WHEN ord < (n % 7) * (n // 7 + 1) THEN ord // (n // 7 + 1) ELSE n % 7 + (ord - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS shard
FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ord, count(*) OVER () AS n FROM {Q.NEWS_SQL})""")
def news_split(spark, d):
    rows = selection.numbered(Q.news(spark, d).select("id"), "id")
    return selection.even_ranges(selection.prefix_split(rows, "ord"), "ord", 7).select("id", "ord", "is_train", (F.pmod("ord", F.lit(4)) == 1).alias("in_shard"), "shard")


@query("news_first", f"SELECT id, text FROM (SELECT id, ord, {Q.collapse_sql('text')} AS text FROM (SELECT id, text, row_number() OVER (ORDER BY id) - 1 AS ord FROM {Q.NEWS_SQL})) WHERE text <> '' ORDER BY ord LIMIT 200")
def news_first(spark, d):
    """Prefix limit over rows with a text: rows without one do not count."""
    rows = selection.numbered(Q.news(spark, d).select("id", T.collapse(F.coalesce("text", F.lit(""))).alias("text")), "id")
    ok = F.col("text") != ""
    return selection.accepted_prefix(rows, "ord", ok, 200).filter(ok).select("id", "text")


@query("reject_prefix", f"""
WITH r AS (SELECT id, text, row_number() OVER (ORDER BY id) - 1 AS ord, text IS NOT NULL AND length(text) >= 250 AS ok FROM {Q.NEWS_SQL}),
p AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT id, ord, ok FROM p WHERE before < 100""")
def reject_prefix(spark, d):
    """Accepted and rejected rows until the hundredth is accepted."""
    rows = selection.numbered(Q.news(spark, d).select("id", "text"), "id").withColumn("ok", F.coalesce(F.length("text") >= 250, F.lit(False)))
    return selection.accepted_prefix(rows, "ord", F.col("ok"), 100).select("id", "ord", "ok")


_RESPONSES = f"""(SELECT original_id AS image_id, i - 1 AS idx, printf('%s-%03d', original_id, i - 1) AS response_id, {Q.collapse_sql("coalesce(r.text, '')")} AS output_text, coalesce(r.model_name, '?') AS model_source_id,
  CASE WHEN i % 3 = 0 THEN 'fr' ELSE 'en' END AS language_code, coalesce(r.length_band, '?') AS prompt_view, source AS source_dataset
  FROM (SELECT original_id, source, unnest(rewrites) AS r, generate_subscripts(rewrites, 1) AS i FROM {Q.SETS_SQL}))"""


def _responses(spark, d):
    rows = Q.sets(spark, d).select(F.col("original_id").alias("image_id"), F.col("source").alias("source_dataset"), F.posexplode("rewrites").alias("idx", "r"))
    return rows.select(
        "image_id", "source_dataset", "idx", F.format_string("%s-%03d", "image_id", "idx").alias("response_id"), T.collapse(F.coalesce("r.text", F.lit(""))).alias("output_text"), F.coalesce("r.model_name", F.lit("?")).alias("model_source_id"),
        F.when((F.col("idx") + 1) % 3 == 0, "fr").otherwise("en").alias("language_code"), F.coalesce("r.length_band", F.lit("?")).alias("prompt_view"),
    )


def _frag(fragments) -> str:
    return "(" + " OR ".join("contains(lower(output_text), '" + f.replace("'", "''") + "')" for f in fragments) + ")"


_FILTERED = f"""(WITH a AS (SELECT *, list_filter([CASE WHEN length(output_text) < 20 THEN 'too_short' END, CASE WHEN length(output_text) > 900 THEN 'too_long' END, CASE WHEN {_frag(T.REFUSAL_FRAGMENTS)} THEN 'refusal_like' END, CASE WHEN {_frag(T.LEAK_FRAGMENTS)} THEN 'metadata_leak' END,
    CASE WHEN NOT (length(regexp_extract_all(output_text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) = 0 OR length(regexp_extract_all(output_text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) / length(regexp_extract_all(output_text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) >= 0.75) THEN 'script_mismatch' END], lambda r: r IS NOT NULL) AS reasons FROM {_RESPONSES}),
  b AS (SELECT *, coalesce(min(CASE WHEN length(reasons) = 0 THEN idx END) OVER (PARTITION BY image_id, lower(output_text)) < idx, false) AS repeated FROM a)
  SELECT * REPLACE (CASE WHEN repeated THEN list_append(reasons, 'duplicate_within_image') ELSE reasons END AS reasons) FROM b)"""


def _filtered(spark, d):
    text = F.col("output_text")
    rows = _responses(spark, d).withColumn("own", validation.response_reasons(text, F.lit("ok"), F.lit("latin")))
    rows = selection.flag_repeats(rows, ["image_id"], F.lower(text), F.size("own") == 0, "idx")
    return rows.withColumn("reasons", F.when(F.col("repeated"), F.array_append("own", "duplicate_within_image")).otherwise(F.col("own"))).drop("own")


@query("responses_filtered", f"SELECT image_id, idx, array_to_string(reasons, ',') AS reasons FROM {_FILTERED}")
def responses_filtered(spark, d):
    return _filtered(spark, d).select("image_id", *_big("idx"), F.array_join("reasons", ",").alias("reasons"))


@query("filter_report", f"SELECT n, accepted, round(accepted / n, 6) AS rate FROM (SELECT count(*) AS n, count(CASE WHEN length(reasons) = 0 THEN 1 END) AS accepted FROM {_FILTERED})")
def filter_report(spark, d):
    rows = _filtered(spark, d).agg(F.count("*").alias("n"), F.count(F.when(F.size("reasons") == 0, 1)).alias("accepted"))
    return rows.select("n", "accepted", F.round(F.col("accepted") / F.col("n"), 6).alias("rate"))


_SCENES = f"""(SELECT 'visual_scene_' || substr(sha256('{{"image_id": ' || CAST(to_json(image_id) AS VARCHAR) || '}}'), 1, 16) AS set_id, image_id, count(*) AS n_views, count(DISTINCT model_source_id) AS n_models, count(DISTINCT language_code) AS n_languages, count(DISTINCT prompt_view) AS n_prompt_views,
   list({{'view_type': model_source_id || '__' || language_code || '__' || prompt_view, 'source_id': model_source_id, 'language': language_code, 'text': output_text, 'id': response_id}} ORDER BY response_id) AS texts FROM {_FILTERED} WHERE length(reasons) = 0 GROUP BY 2 HAVING count(*) >= 4)"""


def _scenes(spark, d):
    return sets.scene_sets(_filtered(spark, d).filter(F.size("reasons") == 0), 4)


@query("scene_sets", f"SELECT set_id, n_views, n_models, n_languages, n_prompt_views, array_to_string(list_transform(texts, lambda t: t.view_type), ';') AS view_types FROM {_SCENES}")
def scene_sets(spark, d):
    return _scenes(spark, d).select("set_id", "n_views", "n_models", "n_languages", "n_prompt_views", F.array_join(F.transform("texts", lambda t: t["view_type"]), ";").alias("view_types"))


@query("scene_audit", f"""
WITH v AS (SELECT unnest(texts) AS t FROM {_SCENES})
SELECT 'all' AS dimension, '' AS value, count(*) AS n_views, round(avg(length(t.text)), 6) AS mean_chars FROM v
UNION ALL SELECT 'model', t.source_id, count(*), round(avg(length(t.text)), 6) FROM v GROUP BY 2
UNION ALL SELECT 'language', t.language, count(*), round(avg(length(t.text)), 6) FROM v GROUP BY 2""")
def scene_audit(spark, d):
    return sets.audit(_scenes(spark, d), {"model": F.col("v.source_id"), "language": F.col("v.metadata.language_code")})


def _content(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(T.CONTENT_STOPWORDS)))
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[A-Za-zÀ-ÖØ-öø-ÿ'']+'), lambda w: trim(w, '''')), lambda w: length(w) >= 3 AND NOT list_contains([{stop}], w)))"


@query("scene_diversity", f"""
WITH v AS (SELECT set_id, generate_subscripts(texts, 1) AS i, unnest(texts) AS t FROM {_SCENES}), k AS (SELECT set_id, i, t.language AS lang, {_content('t.text')} AS w FROM v),
kk AS (SELECT * FROM k WHERE length(w) > 0),
p AS (SELECT a.set_id, length(list_intersect(a.w, b.w)) / length(list_distinct(list_concat(a.w, b.w))) AS j FROM kk a JOIN kk b ON a.set_id = b.set_id AND a.lang = b.lang AND a.i < b.i),
ps AS (SELECT set_id, avg(j) AS mean_jaccard, max(j) AS max_jaccard FROM p GROUP BY 1),
n AS (SELECT set_id, count(*) AS n FROM kk GROUP BY 1),
f AS (SELECT set_id, x, count(*) AS c FROM (SELECT set_id, unnest(w) AS x FROM kk) GROUP BY 1, 2),
r AS (SELECT f.set_id, sum(CASE WHEN c / n.n >= 0.5 THEN 1 ELSE 0 END) / count(*) AS repeated_fraction FROM f JOIN n ON f.set_id = n.set_id GROUP BY 1)
SELECT s.set_id, coalesce(n.n, 0) AS latin_view_count, round(coalesce(mean_jaccard, 0), 6) AS mean_jaccard, round(coalesce(max_jaccard, 0), 6) AS max_jaccard, round(coalesce(repeated_fraction, 0), 6) AS repeated_fraction,
  array_to_string(list_filter([CASE WHEN mean_jaccard > 0.4 THEN 'mean_content_jaccard_too_high' END, CASE WHEN max_jaccard > 0.85 THEN 'max_pair_content_jaccard_too_high' END, CASE WHEN repeated_fraction > 0.12 THEN 'repeated_content_word_fraction_too_high' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM {_SCENES} s LEFT JOIN n USING (set_id) LEFT JOIN ps USING (set_id) LEFT JOIN r USING (set_id)""")
def scene_diversity(spark, d):
    got = sets.diversity(_scenes(spark, d), F.col("v.metadata.language_code"))
    reasons = validation.diversity_reasons(F.col("mean_jaccard"), F.col("max_jaccard"), F.col("repeated_fraction"))
    return got.select("set_id", "latin_view_count", *[F.round(c, 6).alias(c) for c in ("mean_jaccard", "max_jaccard", "repeated_fraction")], F.array_join(reasons, ",").alias("reasons"))


@query("scene_rewrites", f"SELECT set_id AS original_id, texts[1].text AS original_text, length(texts) AS n_all, length(texts) - 1 AS n_others, {Q.band_words_sql('texts[1].text')}.length() AS first_words FROM {_SCENES}")
def scene_rewrites(spark, d):
    scenes = _scenes(spark, d)
    some = sets.as_original_and_rewrites(scenes, all_views=False).select("original_id", F.size("rewrites").cast("bigint").alias("n_others"))
    return sets.as_original_and_rewrites(scenes).select("original_id", "original_text", F.size("rewrites").cast("bigint").alias("n_all"), F.get("rewrites", F.lit(0))["word_count"].cast("bigint").alias("first_words")).join(some, "original_id")


_CONTROLS = f"""(SELECT set_id, t.id AS view_id, unnest([{{'c': 'shuffled_image', 'm': ''}}, {{'c': 'same_language_different_image', 'm': coalesce(t.language, '')}}, {{'c': 'same_prompt_different_image', 'm': coalesce(replace(t.view_type, t.source_id || '__' || t.language || '__', ''), '')}}, {{'c': 'same_model_different_image', 'm': coalesce(t.source_id, '')}}], recursive := true)
  FROM (SELECT set_id, unnest(texts) AS t FROM {_SCENES}))"""


@query("scene_controls", f"""
WITH r AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(set_id) OVER w = set_id THEN 0 ELSE 1 END AS starts FROM {_CONTROLS} WINDOW w AS (PARTITION BY c, m ORDER BY substr(sha256('0' || view_id || set_id), 1, 16), set_id, view_id)),
q AS (SELECT *, sum(starts) OVER (PARTITION BY c, m ORDER BY n) AS run, sum(starts) OVER (PARTITION BY c, m) AS runs FROM r), h AS (SELECT c, m, run, set_id AS hs, view_id AS hv FROM q WHERE starts = 1),
p AS (SELECT q.*, CASE WHEN one.hs <> q.set_id THEN one.hv WHEN two.hs <> q.set_id THEN two.hv END AS pick FROM q LEFT JOIN h one ON one.c = q.c AND one.m = q.m AND one.run = CASE WHEN q.run < q.runs THEN q.run + 1 ELSE 1 END LEFT JOIN h two ON two.c = q.c AND two.m = q.m AND two.run = 2),
s AS (SELECT set_id, c, list(pick ORDER BY view_id) AS picks FROM p GROUP BY 1, 2 HAVING count(*) = count(pick))
SELECT set_id, c AS control, c || '_' || substr(sha256(CAST(to_json(set_id || '|' || array_to_string(picks, '|')) AS VARCHAR)), 1, 16) AS control_id, array_to_string(picks, ',') AS picks, 'control_not_train' AS risk_tag, 'eval' AS usage FROM s""")
def scene_controls(spark, d):
    views = _scenes(spark, d).select("set_id", F.explode("texts").alias("v")).select("set_id", F.col("v.id").alias("view_id"), F.col("v.metadata.language_code").alias("language"), F.col("v.metadata.prompt_view").alias("prompt_view"), F.col("v.source_id").alias("model"), F.lit("").alias("any"))
    views = materialize(views, "views")
    kinds = {"shuffled_image": "any", "same_language_different_image": "language", "same_prompt_different_image": "prompt_view", "same_model_different_image": "model"}
    out = None
    for control, match in kinds.items():
        got = sampling.matched_controls(views, match, control).select("set_id", "control", "control_id", F.array_join("picks", ",").alias("picks"), "risk_tag", "usage")
        out = got if out is None else out.unionByName(got)
    return out


@query("sampled_views", f"""
SELECT original_id, array_to_string(list_prepend(original_text, list_transform(list_slice(list_sort(list_transform(list_zip(rewrites, range(length(rewrites))), lambda z: {{'k': substr(sha256('3' || original_id || CAST(z[2] AS VARCHAR)), 1, 16), 'text': z[1].text}})), 1, 3), lambda s: s.text)), ' | ') AS texts
FROM {Q.SETS_SQL} WHERE length(rewrites) >= 3""")
def sampled_views(spark, d):
    return sampling.sample_views(Q.sets(spark, d), 4, seed=3).select("original_id", F.array_join("texts", " | ").alias("texts"))


@query("stratified_probes", f"""
WITH e AS (SELECT probe_id, substr(sha256('0' || tag || CAST(probe_id AS VARCHAR)), 1, 16) AS k, tag FROM (SELECT probe_id, unnest(list_filter(string_split(coalesce(keywords, ''), ';'), lambda x: x <> '')) AS tag FROM {Q.PROBES_SQL}))
SELECT DISTINCT probe_id FROM (SELECT probe_id, row_number() OVER (PARTITION BY tag ORDER BY k) AS r FROM e) WHERE r <= 2""")
def stratified_probes(spark, d):
    rows = Q.probes(spark, d).select("probe_id", F.filter(F.split("keywords", ";"), lambda x: x != "").alias("tags"))
    return sampling.stratified(rows, "tags", "probe_id", 2).select("probe_id")


@query("shifted_news", f"""
SELECT label, id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS shuffled_id FROM (SELECT label, id, substr(sha256('0' || id), 1, 16) AS k FROM {Q.NEWS_SQL} WHERE label IS NOT NULL) WINDOW w AS (PARTITION BY label ORDER BY k)""")
def shifted_news(spark, d):
    rows = Q.news(spark, d).filter("label is not null").select("label", "id", F.col("id").alias("i"))
    return sampling.shifted(rows, ["label"], F.col("i"), ["id"]).select("label", "id", "shuffled_id")


@query("resumed", f"SELECT original_id, attempt_idx FROM {Q.ATTEMPTS_SQL} a WHERE NOT EXISTS (SELECT 1 FROM {_JUDGED} j WHERE length(j.reasons) = 0 AND j.original_id = a.original_id AND j.model_name = a.model_name AND j.length_band = a.length_band)")
def resumed(spark, d):
    """What a resumed run has to do: attempts whose original, model and band are not done."""
    done = _judged(spark, d).filter(F.size("reasons") == 0)
    return selection.not_done(Q.attempts(spark, d), done, ["original_id", "model_name", "length_band"]).select("original_id", *_big("attempt_idx"))


@query("shard_union", f"SELECT original_id, attempt_idx, shard FROM (SELECT original_id, attempt_idx, 'a' AS shard FROM {Q.ATTEMPTS_SQL} WHERE attempt_idx % 2 = 0 UNION ALL SELECT original_id, attempt_idx, NULL FROM {Q.ATTEMPTS_SQL} WHERE attempt_idx % 2 = 1)")
def shard_union(spark, d):
    rows = Q.attempts(spark, d).select("original_id", *_big("attempt_idx"))
    return rows.filter("attempt_idx % 2 = 0").withColumn("shard", F.lit("a")).unionByName(rows.filter("attempt_idx % 2 = 1"), allowMissingColumns=True)


@query("review_lines", f"""
SELECT row_number() OVER (ORDER BY original_id, i) + 1 AS ord, '| ' || concat_ws(' | ', replace(original_id, '|', chr(92) || '|'), replace(regexp_replace(coalesce(original_text, ''), '[\\r\\n]+', ' ', 'g'), '|', chr(92) || '|'), '', coalesce(r.model_name, ''), coalesce(r.length_band, ''), coalesce(CAST(CAST(r.word_count AS BIGINT) AS VARCHAR), ''), replace(regexp_replace(coalesce(r.text, ''), '[\\r\\n]+', ' ', 'g'), '|', chr(92) || '|')) || ' |' AS line
FROM (SELECT original_id, original_text, unnest(rewrites) AS r, generate_subscripts(rewrites, 1) AS i FROM {Q.SETS_SQL})
UNION ALL SELECT 0, '| Original ID | Original sentence | Banned words | Model | Length | Word count | Rewrite |' UNION ALL SELECT 1, '|---|---|---|---|---|---|---|'""")
def review_lines(spark, d):
    return files.review_table(Q.sets(spark, d).withColumn("banned_words", F.array().cast("array<string>")))


@query("json_rows", f"SELECT '{{\"id\":' || CAST(to_json(id) AS VARCHAR) || CASE WHEN label IS NULL THEN '' ELSE ',\"label\":' || CAST(to_json(label) AS VARCHAR) END || CASE WHEN source IS NULL THEN '' ELSE ',\"source\":' || CAST(to_json(source) AS VARCHAR) END || '}}' AS value FROM {Q.NEWS_SQL}")
def json_rows(spark, d):
    return sets.to_json_rows(Q.news(spark, d).select("source", "label", "id"))


@query("content_digest")
def content_digest(spark, d):
    return sets.content_digest(table(spark, d, "news_row"))


@query("job_grid", """
SELECT b.bank_id, m.method || '__' || b.bank_id || '__s' || printf('%02d', s.s) AS key, s.s AS set_size, m.method FROM (SELECT DISTINCT bank_id FROM activation_bank) b, (VALUES (2), (4), (8)) AS s(s), (VALUES ('set'), ('pointwise')) AS m(method)""")
def job_grid(spark, d):
    banks = table(spark, d, "activation_bank").select("bank_id").distinct()
    return jobs.grid_jobs(banks, T.set_sizes("2-4:2,8"), ["set", "pointwise"]).select("bank_id", "key", F.col("set_size"), "method")


@query("rendered_jobs", f"""
SELECT image_id, 'job_' || substr(sha256(CAST(to_json(image_id || '|' || model || '|' || code || '|' || view_id) AS VARCHAR)), 1, 16) AS job_id, prompt FROM (
  SELECT original_id AS image_id, m.model, l.code, v.view_id, 'Describe in ' || l.name || ': ' || v.instruction AS prompt FROM {Q.SETS_SQL}, (VALUES ('m1'), ('m3')) AS m(model), (VALUES ('en', 'English'), ('fr', 'French')) AS l(code, name), (VALUES ('a', 'objects'), ('b', 'scene')) AS v(view_id, instruction))""")
def rendered_jobs(spark, d):
    images = Q.sets(spark, d).select(F.col("original_id").alias("image_id"))
    models = spark.createDataFrame([("m1", None), ("m2", False), ("m3", True)], "source_id string, enabled boolean")
    languages = spark.createDataFrame([("en", "English", "latin"), ("fr", "French", "latin")], "code string, name string, script_hint string")
    views = spark.createDataFrame([("a", "objects"), ("b", "scene")], "view_id string, instruction string")
    made = jobs.render_jobs(images, models, languages, views, "Describe in {language_name}: {view_instruction}")
    return jobs.mock_answers(made).select("image_id", "job_id", "prompt")


@query("generated_texts", f"""SELECT original_id, CASE length(original_text) % 3 WHEN 0 THEN 'The company reported stronger results as demand grew abroad.' WHEN 1 THEN 'Officials confirmed the agreement after long talks on Monday.' WHEN 2 THEN 'Researchers found new evidence that supports the earlier claim.' END AS output_text, 'ok' AS generation_status FROM {Q.SETS_SQL} WHERE original_text IS NOT NULL""")
def generated_texts(spark, d):
    """The stand-in generator over one prompt for each original."""
    prompts = Q.sets(spark, d).filter("original_text is not null").select("original_id", F.col("original_text").alias("prompt"), F.lit("dry-run").alias("model_id"))
    return generation.generate(prompts, lambda _: generation.dry_run).select("original_id", "output_text", "generation_status")


@query("job_counts", f"SELECT model_name, length_band, count(*) AS n FROM {Q.ATTEMPTS_SQL} GROUP BY 1, 2")
def job_counts(spark, d):
    return Q.attempts(spark, d).groupBy("model_name", "length_band").agg(F.count("*").alias("n"))


@query("merged_shards", f"""SELECT original_id, attempt_idx, row_number() OVER (ORDER BY original_id, coalesce(model_name, ''), coalesce(length_band, ''), attempt_idx) - 1 AS ord FROM {Q.ATTEMPTS_SQL}""")
def merged_shards(spark, d):
    """Shards of attempts put together and numbered in one order."""
    rows = Q.attempts(spark, d).select("original_id", F.coalesce("model_name", F.lit("")).alias("m"), F.coalesce("length_band", F.lit("")).alias("b"), *_big("attempt_idx"))
    both = rows.filter("attempt_idx % 2 = 0").unionByName(rows.filter("attempt_idx % 2 = 1"))
    return selection.numbered(both, "original_id", "m", "b", "attempt_idx").select("original_id", "attempt_idx", "ord")


@query("retried_slots", f"""
WITH a AS (SELECT original_id, n AS attempt_idx, ['The company reported stronger results as demand grew abroad.', 'Officials confirmed the agreement after long talks on Monday.', 'Researchers found new evidence that supports the earlier claim.'][(length(coalesce(original_text, '')) + n) % 3 + 1] AS output_text FROM {Q.SETS_SQL}, (VALUES (0), (1)) AS t(n) WHERE original_id IS NOT NULL),
ok AS (SELECT *, starts_with(output_text, 'Officials') AS accepted FROM a)
SELECT original_id, attempt_idx, output_text, accepted FROM ok WHERE attempt_idx = 0 OR original_id NOT IN (SELECT original_id FROM ok WHERE attempt_idx = 0 AND accepted)""")
def retried_slots(spark, d):
    """Originals that are asked for again until an answer is accepted, twice at most, with the stand-in for a model."""
    slots = Q.sets(spark, d).filter("original_id is not null").select("original_id", F.coalesce("original_text", F.lit("")).alias("original_text"), F.lit("stand-in").alias("model_id"))
    ask = lambda n: F.concat("original_text", F.repeat(F.lit("?"), n))
    got = generation.until_accepted(slots, ["original_id"], lambda _: generation.dry_run, ask, F.startswith("output_text", F.lit("Officials")), 2)
    return got.select("original_id", "attempt_idx", "output_text", "accepted")


@query("sampled_ids", f"SELECT id FROM (SELECT DISTINCT id FROM news_row WHERE id IS NOT NULL) ORDER BY substr(sha256('5' || id), 1, 16), id LIMIT 25")
def sampled_ids(spark, d):
    """A seeded sample of ids."""
    return sampling.sampled_ids(table(spark, d, "news_row"), "id", 25, seed=5)
