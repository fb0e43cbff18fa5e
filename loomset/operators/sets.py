"""Building, summarising and reshaping sets of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T

REWRITE_FIELDS = ("text", "model_name", "model_id", "length_band", "word_count")


def group_accepted(rows: DataFrame, order: str) -> DataFrame:
    """Accepted rewrites as one set for each original: its fields from the first row, its rewrites in order."""
    first = [F.min_by(c, order).alias(c) for c in ("original_text", "label", "source", "banned_words") if c in rows.columns]
    fields = [c for c in ("rewrite", *REWRITE_FIELDS[1:]) if c in rows.columns]
    element = F.struct(F.col(order).alias("_o"), *[F.col(c).alias("text" if c == "rewrite" else c) for c in fields])
    got = rows.groupBy("original_id").agg(F.min(order).alias("first_seen"), *first, F.array_sort(F.collect_list(element)).alias("_r"))
    return got.withColumn("rewrites", F.transform("_r", lambda r: F.struct(*[r["text" if c == "rewrite" else c].alias("text" if c == "rewrite" else c) for c in fields]))).drop("_r")


def with_rewrites(sets: DataFrame, least: int) -> DataFrame:
    return sets.filter(F.coalesce(F.size("rewrites"), F.lit(0)) >= least)


def set_stats(sets: DataFrame, thresholds: Sequence[int] = (2, 4, 8, 16, 24, 32, 40)) -> DataFrame:
    """``metric, key, value`` of sets with ``label`` and ``rewrites``. One scan: every set gives its few facts,
    added up map-side. A null label counts as ``None``."""
    n = F.coalesce(F.size("rewrites"), F.lit(0))
    fact = lambda m, k, v=1: F.struct(F.lit(m).alias("metric"), k.cast("string").alias("key"), F.lit(v).cast("bigint").alias("v") if not isinstance(v, Column) else v.cast("bigint").alias("v"))
    none = F.lit("None")
    each = F.concat(
        F.array(fact("n_sets", F.lit("")), fact("n_rewrites", F.lit(""), n), fact("rewrite_count", n), fact("label", F.coalesce("label", none)), *[fact("sets_at_least", F.lit(k), (n >= k).cast("bigint")) for k in thresholds]),
        F.transform(F.coalesce("rewrites", F.array()), lambda r: F.struct(F.lit("model").alias("metric"), F.coalesce(r["model_name"], none).alias("key"), F.lit(1).cast("bigint").alias("v"))),
        F.transform(F.coalesce("rewrites", F.array()), lambda r: F.struct(F.lit("length_band").alias("metric"), F.coalesce(r["length_band"], none).alias("key"), F.lit(1).cast("bigint").alias("v"))),
    )
    return sets.select(F.inline(each)).groupBy("metric", "key").agg(F.sum("v").alias("value"))


def set_totals(sets: DataFrame) -> DataFrame:
    """``n_sets, n_rewrites, min_rewrites, max_rewrites, mean_rewrites``; 0 for an empty table."""
    n = F.coalesce(F.size("rewrites"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return sets.agg(F.count("*").alias("n_sets"), zero(F.sum(n)).alias("n_rewrites"), zero(F.min(n)).alias("min_rewrites"), zero(F.max(n)).alias("max_rewrites"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("mean_rewrites"))


def content_digest(df: DataFrame) -> DataFrame:
    """``n_rows, digest`` that any order of the rows leaves the same."""
    # 32 bits of each row's hash, so that no sum overflows
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.concat_ws("-", F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(h, 32).bitwiseAND(F.lit(0xFFFFFFFF)))).alias("digest"))


def latent_counts(sets: DataFrame) -> DataFrame:
    """``counter, key, n`` of latent sets: types, datasets, usages, labels, view types, evidence, placeholders."""
    strip = lambda c: F.coalesce(T.strip(c), F.lit(""))
    usage = F.coalesce(F.nullif(T.strip(F.col("usage")), F.lit("")), F.lit("train"))
    one = lambda m, k: F.struct(F.lit(m).alias("counter"), k.alias("key"))
    views = F.coalesce("texts", F.array())
    truth = lambda meta, key: F.coalesce(F.get_json_object(meta, f"$.{key}"), F.lit("false")) == "true"
    evidence = F.filter(views, lambda v: v["view_type"].isin("evidence", "evidence_reference"))
    label = F.get_json_object("metadata", "$.label")
    facts = F.concat(
        F.array(one("latent_type", strip(F.col("latent_type"))), one("source_dataset", strip(F.col("source_dataset"))), one("usage", usage)),
        F.when(label.isNull(), F.array().cast("array<struct<counter:string,key:string>>")).otherwise(F.array(one("label", label))),
        F.transform(views, lambda v: one("view_type", strip(v["view_type"]))),
        F.transform(evidence, lambda v: one("evidence", F.when((v["view_type"] == "evidence_reference") | truth(v["metadata"], "evidence_text_missing"), "missing").otherwise("present"))),
        F.transform(F.filter(F.coalesce("hard_negatives", F.array()), lambda n: F.coalesce(n["negative_type"] == "placeholder_requires_mining", F.lit(False)) | truth(n["metadata"], "needs_replacement")), lambda n: one("negative", F.lit("placeholder"))),
    )
    return sets.select(F.inline(facts)).groupBy("counter", "key").agg(F.count("*").alias("n"))


def claim_evidence(sets: DataFrame) -> DataFrame:
    """One row: sets, mean views, and over the sets with a claim and an evidence view the mean word overlap and
    the mean numbers of words; null where no set has both."""
    first = lambda kind: F.get(F.filter(F.coalesce("texts", F.array()), lambda v: v["view_type"] == kind), F.lit(0))
    pair = sets.select(F.size(F.coalesce("texts", F.array())).alias("views"), first("claim").alias("c"), first("evidence").alias("e"))
    token = pair.withColumn("ct", F.when(F.col("c").isNotNull() & F.col("e").isNotNull(), T.plain_tokens(F.coalesce("c.text", F.lit("None"))))).withColumn("et", F.when(F.col("ct").isNotNull(), T.plain_tokens(F.coalesce("e.text", F.lit("None")))))
    r = lambda c: F.round(F.avg(c), 6)
    return token.agg(F.count("*").alias("n_sets"), F.coalesce(r(F.col("views")), F.lit(0.0)).alias("mean_views"), r(F.when(F.col("ct").isNotNull(), T.token_jaccard(F.array_distinct("ct"), F.array_distinct("et"), 1.0))).alias("mean_jaccard"), r(F.size("ct")).alias("mean_claim_tokens"), r(F.size("et")).alias("mean_evidence_tokens"))


def reason_counts(rejected: DataFrame, kind_only: bool = False, top: int | None = None) -> DataFrame:
    """``reason, n``, of whole reasons or of what stands before ``=``."""
    r = F.explode("reasons").alias("reason")
    rows = rejected.select(r).filter("reason is not null")
    if kind_only:
        rows = rows.select(F.substring_index("reason", "=", 1).alias("reason"))
    out = rows.groupBy("reason").agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "reason").limit(top)


def normal_latent(sets: DataFrame) -> DataFrame:
    """Latent sets with everything that may be missing in its place: ids of views and negatives, types, relation,
    usage; texts and types trimmed."""
    place = lambda prefix: lambda v, i: F.coalesce(F.nullif(v["id"], F.lit("")), F.format_string(f"{prefix}_%02d", i))
    s = lambda c: F.coalesce(T.strip(c), F.lit(""))
    views = F.transform("texts", lambda v, i: F.struct(place("view")(v, i).alias("id"), s(v["text"]).alias("text"), s(v["view_type"]).alias("view_type"), v["source_id"].alias("source_id"), F.coalesce(v["generated"], F.lit(False)).alias("generated"), v["metadata"].alias("metadata")))
    edges = F.transform("positive_edges", lambda e: F.struct(F.coalesce(e["source"], F.lit("")).alias("source"), F.coalesce(e["target"], F.lit("")).alias("target"), F.coalesce(e["relation"], F.lit("positive")).alias("relation"), e["evidence"].alias("evidence"), e["metadata"].alias("metadata")))
    negatives = F.transform("hard_negatives", lambda n, i: F.struct(place("negative")(n, i).alias("id"), s(n["text"]).alias("text"), F.coalesce(T.strip(n["negative_type"]), F.lit("hard_negative")).alias("negative_type"), n["source_id"].alias("source_id"), n["metadata"].alias("metadata")))
    fields = {c: s(F.col(c)) for c in ("set_id", "latent_type", "latent_key", "source_dataset")}
    return sets.withColumns(fields | {"domain": T.strip(F.col("domain")), "texts": F.coalesce(views, F.array().cast(sets.schema["texts"].dataType)), "positive_edges": edges, "hard_negatives": negatives, "risk_tag": T.strip(F.col("risk_tag")), "usage": F.coalesce(F.nullif(T.strip(F.col("usage")), F.lit("")), F.lit("train"))})


def to_json_rows(df: DataFrame) -> DataFrame:
    """``value``: a JSON object for each row, its names in order, without null fields."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "true"}).alias("value"))


def scene_sets(responses: DataFrame, min_views: int = 12, order: str = "response_id") -> DataFrame:
    """Accepted descriptions as one set for each image with enough of them."""
    view = F.struct(
        F.col(order).alias("_o"), F.col("response_id").alias("id"), F.col("output_text").alias("text"), F.concat_ws("__", "model_source_id", "language_code", "prompt_view").alias("view_type"),
        F.col("model_source_id").alias("source_id"), F.lit(True).alias("generated"), F.struct("language_code", "prompt_view").alias("metadata"),
    )
    got = responses.groupBy("image_id").agg(
        F.min_by("source_dataset", order).alias("source_dataset"), F.count("*").alias("n_views"), F.count_distinct("model_source_id").alias("n_models"),
        F.count_distinct("language_code").alias("n_languages"), F.count_distinct("prompt_view").alias("n_prompt_views"), F.array_sort(F.collect_list(view)).alias("_v"),
    ).filter(F.col("n_views") >= min_views)
    texts = F.transform("_v", lambda v: v.dropFields("_o"))
    return got.select(
        F.concat(F.lit("visual_scene_"), T.keyed_hash("image_id", F.col("image_id"))).alias("set_id"), F.lit("visual_scene").alias("latent_type"), F.concat_ws(":", F.coalesce("source_dataset", F.lit("unknown")), "image_id").alias("latent_key"),
        F.coalesce("source_dataset", F.lit("unknown")).alias("source_dataset"), F.array("image_id").alias("source_ids"), texts.alias("texts"), F.lit("train").alias("usage"), F.lit(0.8).alias("confidence"), "n_views", "n_models", "n_languages", "n_prompt_views",
    )


def as_original_and_rewrites(sets: DataFrame, all_views: bool = True) -> DataFrame:
    """Sets of views as sets of an original and rewrites: the first view is the original, and the rewrites are all
    views or the others."""
    rest = F.col("texts") if all_views else F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0)))
    made = F.transform(rest, lambda v: F.struct(v["text"].alias("text"), v["source_id"].alias("model_name"), v["view_type"].alias("length_band"), T.word_count(F.coalesce(v["text"], F.lit(""))).alias("word_count")))
    return sets.filter(F.size("texts") > 0).select(F.col("set_id").alias("original_id"), F.get("texts", F.lit(0))["text"].alias("original_text"), F.col("latent_type").alias("label"), F.col("source_dataset").alias("source"), made.alias("rewrites"))


def audit(sets: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """``dimension, value, n_views, mean_chars`` of sets with ``texts``: totals and each dimension in one scan,
    by grouping sets. ``dims`` are expressions over a view ``v``."""
    rows = sets.select(F.explode("texts").alias("v")).select(*[c.alias(n) for n, c in dims.items()], F.length(F.coalesce("v.text", F.lit(""))).alias("_chars"))
    # which of the dimensions a row of the result is grouped by shows in the grouping id
    names = list(dims)
    got = rows.groupingSets([[F.col(n)] for n in names] + [[]], *[F.col(n) for n in names]).agg(F.grouping_id(*names).alias("_g"), F.count("*").alias("n_views"), F.round(F.avg("_chars"), 6).alias("mean_chars"))
    full = (1 << len(names)) - 1
    dimension, value = F.lit("all"), F.lit("")
    for i, n in enumerate(names):
        here = F.col("_g") == full - (1 << (len(names) - 1 - i))
        dimension, value = F.when(here, n).otherwise(dimension), F.when(here, F.coalesce(F.col(n).cast("string"), F.lit("None"))).otherwise(value)
    return got.select(dimension.alias("dimension"), value.alias("value"), "n_views", "mean_chars")


#: Languages whose words the diversity of a set is judged by.
LATIN_LANGUAGES = ("en", "fr", "de", "es", "pt", "id", "sw")


def diversity(sets: DataFrame, language: Column) -> DataFrame:
    """``set_id, latin_view_count, mean_jaccard, max_jaccard, repeated_fraction`` of sets with ``texts``; ``language``
    is an expression over a view ``v``. Pairs are made inside the row, between views of a set and language."""
    views = sets.select("set_id", F.posexplode("texts").alias("i", "v")).select("set_id", "i", language.alias("lang"), T.content_tokens(F.coalesce("v.text", F.lit(""))).alias("tokens")).filter(F.col("lang").isin(*LATIN_LANGUAGES) & (F.size("tokens") > 0))
    per = views.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("i", "lang", "tokens"))).alias("vs"))  # a set's views are few
    pairs = F.flatten(F.transform("vs", lambda a, i: F.transform(F.filter("vs", lambda b: (b["i"] > a["i"]) & (b["lang"] == a["lang"])), lambda b: T.token_jaccard(a["tokens"], b["tokens"], 0.0))))
    scored = per.withColumn("pairs", pairs).withColumn("words", F.flatten(F.transform("vs", lambda a: a["tokens"]))).withColumn("n", F.size("vs"))
    distinct = F.array_distinct("words")
    repeated = F.size(F.filter(distinct, lambda w: F.size(F.filter("words", lambda x: x == w)) / F.col("n") >= 0.5)) / F.greatest(F.size(distinct), F.lit(1))
    mean = F.when(F.size("pairs") > 0, F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x) / F.size("pairs")).otherwise(0.0)
    got = scored.select("set_id", F.col("n").cast("bigint").alias("latin_view_count"), mean.alias("mean_jaccard"), F.coalesce(F.array_max("pairs"), F.lit(0.0)).alias("max_jaccard"), repeated.alias("repeated_fraction"))
    zero = {"latin_view_count": 0, "mean_jaccard": 0.0, "max_jaccard": 0.0, "repeated_fraction": 0.0}
    return sets.select("set_id").distinct().join(got, "set_id", "left").fillna(zero)
