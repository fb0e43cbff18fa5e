"""Queries over the text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import jobs
from loomset.plans import tables as Q
from loomset.plans.registry import query
from loomset.runtime import table

JOIN = "array_to_string({}, ' ')"


@query("news_text", f"""
SELECT id, CASE WHEN length(t) > 200 THEN {Q.strip_sql("regexp_replace(substr(t, 1, 200), ' [^ ]*$', '')")} ELSE t END AS text
FROM (SELECT id, {Q.collapse_sql("replace(coalesce(text, ''), chr(92) || 'n', ' ')")} AS t FROM {Q.NEWS_SQL}) WHERE t <> ''""")
def news_text(spark, d):
    rows = Q.news(spark, d).select("id", T.news_text(F.col("text"), 200).alias("text"))
    return rows.filter("text <> ''")


@query("word_counts", f"SELECT id, length({Q.band_words_sql('text')}) AS n_words, array_to_string({Q.band_words_sql('text')}, ' ') AS words FROM {Q.NEWS_SQL} WHERE text IS NOT NULL")
def word_counts(spark, d):
    return Q.news(spark, d).filter("text is not null").select("id", T.word_count(F.col("text")).cast("bigint").alias("n_words"), F.array_join(T.band_words(F.col("text")), " ").alias("words"))


@query("banned_words", f"SELECT original_id, array_to_string({Q.banned_sql('original_text', T.STOPWORDS)}, ' ') AS banned FROM {Q.SETS_SQL} WHERE original_text IS NOT NULL")
def banned_words(spark, d):
    return Q.sets(spark, d).filter("original_text is not null").select("original_id", F.array_join(T.banned_words(F.col("original_text")), " ").alias("banned"))


@query("banned_hits", f"""
SELECT original_id, attempt_idx, array_to_string(list_sort(list_distinct(list_intersect({Q.banned_sql('original_text', T.STOPWORDS)}, {Q.band_words_sql('rewrite')}))), ',') AS hits
FROM {Q.ATTEMPTS_SQL} WHERE original_text IS NOT NULL""")
def banned_hits(spark, d):
    rows = Q.attempts(spark, d).filter("original_text is not null")
    return rows.select("original_id", F.col("attempt_idx").cast("bigint").alias("attempt_idx"), F.array_join(T.banned_hits(F.col("rewrite"), T.banned_words(F.col("original_text"))), ",").alias("hits"))


def _clean_sql() -> str:
    q = "[\"''“”‘’ ]"
    t = Q.strip_sql("rewrite")
    t = Q.strip_sql(f"regexp_replace({t}, '(?i)^```(?:json|text)?', '')")
    t = Q.strip_sql(f"regexp_replace({t}, '```$', '')")
    t = f"regexp_replace({t}, '^{q}+|{q}+$', '', 'g')"
    steps = [f"SELECT original_id, attempt_idx, {t} AS t FROM {Q.ATTEMPTS_SQL}"]
    for m in T.ANSWER_MARKERS:
        after = Q.strip_sql(f"regexp_replace(t, '(?is)^.*{m}', '')")
        steps.append(f"SELECT original_id, attempt_idx, CASE WHEN regexp_matches(t, '(?i){m}') THEN {after} ELSE t END AS t FROM ({steps[-1]})")
    line = f"list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {Q.strip_sql('x')} <> '')[1]"
    return f"SELECT original_id, attempt_idx, regexp_replace(regexp_replace(coalesce({line}, t), '^[ \\-\\t]+|[ \\-\\t]+$', '', 'g'), '^{q}+|{q}+$', '', 'g') AS answer FROM ({steps[-1]})"


@query("clean_answers", _clean_sql())
def clean_answers(spark, d):
    return Q.attempts(spark, d).select("original_id", F.col("attempt_idx").cast("bigint").alias("attempt_idx"), T.clean_answer(F.col("rewrite")).alias("answer"))


@query("short_texts", f"""
SELECT id, CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 57) || '...' END AS short, replace(t, '|', chr(92) || '|') AS cell
FROM (SELECT id, {Q.collapse_sql('text')} AS t FROM {Q.NEWS_SQL} WHERE text IS NOT NULL)""")
def short_texts(spark, d):
    t = F.col("text")
    return Q.news(spark, d).filter("text is not null").select("id", T.short_text(t, 60).alias("short"), T.escape_cell(T.collapse(t)).alias("cell"))


@query("names", """
SELECT DISTINCT bank_id, replace(replace(replace(lower('A\\B: ' || bank_id), chr(92), '/'), '/', '__'), ' ', '_') AS with_colon,
  replace(replace(replace(replace(lower('A\\B: ' || bank_id), chr(92), '/'), '/', '__'), ' ', '_'), ':', '') AS stable,
  trim(regexp_replace(replace(lower('A/B: ' || bank_id || '!'), '/', '__'), '[^a-z0-9_.-]+', '_', 'g'), '_') AS slug,
  lower(trim(regexp_replace('A/B: ' || bank_id || '!', '[^A-Za-z0-9_.-]+', '_', 'g'), '_')) AS safe,
  coalesce(nullif(regexp_extract(bank_id || '_60pct', '_(20|60|90)pct', 1), ''), 'unknown') AS depth,
  coalesce(nullif(regexp_extract(bank_id, '_(20|60|90)pct', 1), ''), 'unknown') AS no_depth
FROM activation_bank""")
def names(spark, d):
    b = F.col("bank_id")
    rows = table(spark, d, "activation_bank").select("bank_id").distinct()
    odd = F.concat(F.lit("A\\B: "), b)
    return rows.select(
        "bank_id", F.replace(F.replace(F.replace(F.lower(odd), F.lit("\\"), F.lit("/")), F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_")).alias("with_colon"), T.stable_id(odd).alias("stable"),
        T.slug(F.concat(F.lit("A/B: "), b, F.lit("!"))).alias("slug"), T.safe_name(F.concat(F.lit("A/B: "), b, F.lit("!"))).alias("safe"), T.depth_pct(F.concat(b, F.lit("_60pct"))).alias("depth"), T.depth_pct(b).alias("no_depth"),
    )


@query("model_keys", """
SELECT key, p[2] AS family, array_to_string(list_slice(p, 4, length(p) - 2), '__') AS model_slug, p[length(p) - 1] AS layer_name, p[length(p)] AS set_token,
  p[2] || ' ' || p[3] || ' ' || p[length(p) - 1] AS short, 'models/' || p[1] || '/' || p[2] || '/' || p[3] || '/' || array_to_string(list_slice(p, 4, length(p) - 2), '__') || '/' || p[length(p) - 1] || '/' || p[length(p)] AS path
FROM (SELECT key, string_split(key, '__') AS p FROM (SELECT DISTINCT 'setcode__' || split_part(target_model_id, '/', 1) || '__mid_3b__' || replace(target_model_id, '/', '__') || '__layer_' || target_layer || '_60pct__s16' AS key FROM steering_probe WHERE target_model_id IS NOT NULL AND target_layer IS NOT NULL))""")
def model_keys(spark, d):
    m = F.col("target_model_id")
    rows = table(spark, d, "steering_probe").filter("target_model_id is not null and target_layer is not null")
    key = F.concat(F.lit("setcode__"), F.split_part(m, F.lit("/"), F.lit(1)), F.lit("__mid_3b__"), F.replace(m, F.lit("/"), F.lit("__")), F.lit("__layer_"), F.col("target_layer").cast("string"), F.lit("_60pct__s16"))
    keys = rows.select(key.alias("key")).distinct()
    p = T.key_parts(F.col("key"))
    return keys.select("key", p["family"].alias("family"), p["model_slug"].alias("model_slug"), p["layer_name"].alias("layer_name"), p["set_token"].alias("set_token"), T.short_key(F.col("key")).alias("short"), T.model_path(F.col("key")).alias("path"))


@query("stable_hashes", f"""
SELECT id, substr(sha256(CASE WHEN text IS NULL THEN 'null' ELSE CAST(to_json(text) AS VARCHAR) END), 1, 16) AS h,
  substr(sha256('{{"image_id": ' || CAST(to_json(id) AS VARCHAR) || '}}'), 1, 16) AS keyed, substr(sha256('7' || id), 1, 16) AS ord
FROM {Q.NEWS_SQL}""")
def stable_hashes(spark, d):
    return Q.news(spark, d).select("id", T.stable_hash(F.col("text")).alias("h"), T.keyed_hash("image_id", F.col("id")).alias("keyed"), T.order_key(F.col("id"), seed=7).alias("ord"))


@query("keyword_scores", f"""
SELECT probe_id, array_to_string(h, ';') AS hits, length(h) AS score FROM (
  SELECT probe_id, list_filter(list_filter(list_transform(string_split(coalesce(keywords, ''), ';'), lambda k: lower({Q.strip_sql('k')})), lambda k: k <> ''), lambda k: contains(lower(coalesce(steered, '')), k)) AS h FROM {Q.PROBES_SQL})""")
def keyword_scores(spark, d):
    hits = T.keyword_hits(F.col("steered"), T.keywords(F.col("keywords")))
    return Q.probes(spark, d).select("probe_id", F.array_join(hits, ";").alias("hits"), F.size(hits).cast("bigint").alias("score"))


def _guess_sql() -> str:
    both = "lower(concat_ws(' ', coalesce(candidate, ''), coalesce(label, '')))"
    whens = " ".join(f"WHEN contains({both}, '{m}') THEN '{';'.join(k)}'" for m, k in T.MARKED_KEYWORDS.items())
    words = f"list_transform(regexp_split_to_array(coalesce(label, ''), '{Q.SPACE_SQL}+'), lambda w: lower(trim(w, ' /_-')))"
    return f"SELECT DISTINCT label, CASE {whens.replace('candidate', 'label')} ELSE array_to_string(list_slice(list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 3))), 1, 8), ';') END AS keywords FROM {Q.PROBES_SQL}".replace("coalesce(candidate, '')", "coalesce(label, '')")


@query("guessed_keywords", _guess_sql())
def guessed_keywords(spark, d):
    x = F.col("label")
    return Q.probes(spark, d).select("label").distinct().select("label", F.array_join(T.guessed_keywords(x, x), ";").alias("keywords"))


@query("content_words", f"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[A-Za-zÀ-ÖØ-öø-ÿ'']+'), lambda w: trim(w, '''')), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(f"'{w}'" for w in sorted(set(T.CONTENT_STOPWORDS)))}], w)))), ' ') AS words
FROM {Q.NEWS_SQL} WHERE text IS NOT NULL""")
def content_words(spark, d):
    return Q.news(spark, d).filter("text is not null").select("id", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), " ").alias("words"))


def _fragments_sql(x: str, fragments) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '" + f.replace("'", "''") + "')" for f in fragments) + ")"


@query("text_flags", f"""
SELECT doc_id, {_fragments_sql('text', T.REFUSAL_FRAGMENTS)} AS refusal, {_fragments_sql('text', T.LEAK_FRAGMENTS)} AS leak,
  regexp_matches(text, '[\\x{{0600}}-\\x{{06ff}}]') AS arabic, regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') AS cjk,
  (length(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) = 0 OR length(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) / greatest(length(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')), 1) >= 0.75) AS latin
FROM documents WHERE text IS NOT NULL""")
def text_flags(spark, d):
    t = F.col("text")
    match = lambda h: T.script_matches(t, F.lit(h))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.refusal_like(t).alias("refusal"), T.leaks_metadata(t).alias("leak"), match("arabic").alias("arabic"), match("cjk").alias("cjk"), match("latin").alias("latin"))


@query("elapsed", f"""
SELECT probe_id, CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s // 60 % 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS elapsed
FROM (SELECT probe_id, CAST(probe_id * 37 AS BIGINT) AS s FROM {Q.PROBES_SQL})""")
def elapsed(spark, d):
    return Q.probes(spark, d).select("probe_id", T.elapsed(F.col("probe_id") * 37).alias("elapsed"))


@query("prompts", f"""
SELECT original_id, length_band, sha256(replace(replace(replace(replace(replace('{T.REWRITE_TEMPLATE.replace("'", "''")}', '{{min_words}}', low), '{{max_words}}', high), '{{length_band}}', length_band), '{{banned_words}}', CASE WHEN length(b) > 0 THEN array_to_string(b, ', ') ELSE '(none)' END), '{{original}}', original_text)) AS prompt_sha
FROM (SELECT original_id, original_text, {Q.banned_sql('original_text', T.STOPWORDS)} AS b FROM {Q.SETS_SQL} WHERE original_text IS NOT NULL),
  (VALUES ('5-7', '5', '7'), ('10-12', '10', '12'), ('15-17', '15', '17'), ('20-22', '20', '22')) AS bands(length_band, low, high)""")
def prompts(spark, d):
    rows = Q.sets(spark, d).filter("original_text is not null").select("original_id", F.col("original_text").alias("text"))
    models = spark.createDataFrame([("m1", "a/m1", True), ("m2", "a/m2", False)], "name string, model_id string, enabled boolean")
    slots = jobs.rewrite_slots(rows, models, T.bands(None))
    return slots.select("original_id", F.col("band.length_band").alias("length_band"), F.sha2("prompt", 256).alias("prompt_sha"))


@query("sampled_rewrites", f"""
SELECT original_id, array_to_string(list_transform(list_slice(rewrites, 1, 3), lambda r: CASE WHEN length({Q.collapse_sql("coalesce(r.text, '')")}) <= 40 THEN {Q.collapse_sql("coalesce(r.text, '')")} ELSE substr({Q.collapse_sql("coalesce(r.text, '')")}, 1, 37) || '...' END), ' | ') AS sample
FROM {Q.SETS_SQL}""")
def sampled_rewrites(spark, d):
    return Q.sets(spark, d).select("original_id", T.sample_texts(F.col("rewrites"), 3, 40).alias("sample"))


@query("event_props", "SELECT event_id, coalesce(json_extract_string(j, '$.generated_text'), json_extract_string(j, '$.text'), json_extract_string(j, '$.answer')) AS answer FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"generated_text\": \"' || event_type || '\"}' ELSE '{\"answer\": \"' || event_type || '\"}' END AS j FROM events)")
def event_props(spark, d):
    even = F.concat(F.lit('{"generated_text": "'), F.col("event_type"), F.lit('"}'))
    odd = F.concat(F.lit('[{"answer": "'), F.col("event_type"), F.lit('"}]'))
    return table(spark, d, "events").select("event_id", T.generated_text(F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)).alias("answer"))


@query("topic_tags", """SELECT probe_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(replace(keywords, 'a', '|'), ''), '[|,;]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS tags FROM """ + Q.PROBES_SQL)
def topic_tags(spark, d):
    return Q.probes(spark, d).select("probe_id", F.array_join(T.tags(F.replace("keywords", F.lit("a"), F.lit("|"))), "/").alias("tags"))


@query("depth_layers", f"""
SELECT target_model_id, fraction, CAST(greatest(1, least(n, round_even(n * fraction, 0))) AS BIGINT) AS layer, printf('%02d', CAST(round_even(fraction * 100, 0) AS INT)) || 'pct' AS layer_label
FROM (SELECT target_model_id, max(target_layer) AS n FROM {Q.PROBES_SQL} WHERE target_model_id IS NOT NULL GROUP BY 1), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS f(fraction)""")
def depth_layers(spark, d):
    models = Q.probes(spark, d).filter("target_model_id is not null").groupBy("target_model_id").agg(F.max("target_layer").alias("n_layers"))
    return jobs.layer_jobs(models, [0.25, 0.5, 0.75]).select("target_model_id", "fraction", F.col("layer").cast("bigint").alias("layer"), "layer_label")


@query("display_names", "SELECT DISTINCT label, CASE WHEN label = 'world' THEN 'World news' WHEN label = 'science_technology' THEN 'Science Technology' WHEN label = 'sports' THEN 'Sports' WHEN label = 'business' THEN 'Business' END AS shown FROM news_row WHERE label IN ('world', 'science_technology', 'sports', 'business')")
def display_names(spark, d):
    return table(spark, d, "news_row").filter(F.col("label").isin("world", "science_technology", "sports", "business")).select("label").distinct().select("label", T.display(F.col("label"), {"world": "World news"}).alias("shown"))
