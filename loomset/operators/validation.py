"""Rules that give every row its reasons, in a fixed order; a row without a reason passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.functions.binding import let


def reasons(*rules: Column) -> Column:
    """The rules that gave a reason, in order."""
    return F.array_compact(F.array(*rules))


def rewrite_reasons(text: Column, banned: Column, low: Column, high: Column) -> Column:
    """Of a rewrite: its words, banned words in it, its length."""
    def judge(x: Column) -> Column:
        n, hits = x["n"], x["hits"]
        return reasons(
            F.when((n < low) | (n > high), F.format_string("word_count=%d, expected=%d-%d", n, low, high)),
            F.when(F.size(hits) > 0, F.concat(F.lit("banned_words="), F.array_join(hits, ","))),
            F.when(F.length(text) < 5, "empty_or_too_short"),
        )

    return let(F.struct(T.word_count(text).alias("n"), T.banned_hits(text, banned).alias("hits")), judge)


def semantic_reasons(cosine: Column, entailment: Column, contradiction: Column, least_cosine: float = 0.62, least_entailment: float = 0.50, most_contradiction: float = 0.25) -> Column:
    """Of the scores of a rewrite against its original; a score that is null is not judged."""
    return reasons(
        F.when(cosine < least_cosine, F.format_string("low_embedding_cosine=%.3f", cosine)),
        F.when(entailment < least_entailment, F.format_string("low_entailment=%.3f", entailment)),
        F.when(contradiction > most_contradiction, F.format_string("high_contradiction=%.3f", contradiction)),
    )


def response_reasons(text: Column, status: Column, hint: Column, least: int = 20, most: int = 900) -> Column:
    """Of a generated description; ``text`` is collapsed."""
    return reasons(
        F.when(status == "error", "generation_error"),
        F.when(F.length(text) < least, "too_short"),
        F.when(F.length(text) > most, "too_long"),
        F.when(T.refusal_like(text), "refusal_like"),
        F.when(T.leaks_metadata(text), "metadata_leak"),
        F.when(~T.script_matches(text, hint), "script_mismatch"),
    )


def diversity_reasons(mean: Column, most: Column, repeated: Column, max_mean: float = 0.40, max_pair: float = 0.85, max_repeated: float = 0.12) -> Column:
    return reasons(
        F.when(mean > max_mean, "mean_content_jaccard_too_high"),
        F.when(most > max_pair, "max_pair_content_jaccard_too_high"),
        F.when(repeated > max_repeated, "repeated_content_word_fraction_too_high"),
    )


#: The states a source may be in.
SOURCE_STATES = ("build_now", "optional_eval", "future_work")


def source_issues(registry: DataFrame) -> DataFrame:
    """``source_id, issue``: what is wrong with the entries of a registry."""
    blank = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")) == ""
    found = reasons(
        F.when(blank("source_id"), "missing_source_id"),
        F.when(blank("hf_dataset"), "missing_hf_dataset"),
        F.when(blank("builder"), "missing_builder"),
        F.when(~F.coalesce(F.col("status").isin(*SOURCE_STATES), F.lit(False)), F.concat(F.lit("invalid_status:"), F.coalesce("status", F.lit("")))),
        F.when(F.coalesce(F.size("splits"), F.lit(0)) <= 0, "missing_splits"),
        F.when(F.coalesce(F.size("latent_types"), F.lit(0)) <= 0, "missing_latent_types"),
    )
    single = registry.select("source_id", F.explode(found).alias("issue"))
    twice = registry.groupBy("source_id").count().filter("count > 1").select("source_id", F.lit("duplicate_source_id").alias("issue"))
    return single.unionByName(twice)


def latent_issues(min_views: int = 2, min_types: int = 2) -> Column:
    """Of a latent set with views, edges and hard negatives in arrays, all inside the row. Texts, types, keys and
    ids of the set are trimmed before they are judged; missing view and negative ids get their place."""
    field = lambda c: F.coalesce(T.strip(F.col(c)), F.lit(""))
    texts, edges, negatives = (F.coalesce(F.col(c), F.array()) for c in ("texts", "positive_edges", "hard_negatives"))
    numbered = lambda prefix: lambda v, i: F.coalesce(F.nullif(v["id"], F.lit("")), F.format_string(f"{prefix}_%02d", i))
    ids = F.transform(texts, numbered("view"))
    types = F.array_distinct(F.filter(F.transform(texts, lambda v: F.coalesce(T.strip(v["view_type"]), F.lit(""))), lambda t: t != ""))
    none = F.array().cast("array<string>")
    refs = F.when(F.size(texts) > 0, F.concat(ids, F.transform(F.sequence(F.lit(0), F.greatest(F.size(texts) - 1, F.lit(0))), lambda i: i.cast("string")))).otherwise(none)
    empty = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    view = F.flatten(F.zip_with(texts, ids, lambda v, i: reasons(F.when(empty(v["text"]), F.concat(F.lit("empty_view_text:"), i)), F.when(empty(v["view_type"]), F.concat(F.lit("missing_view_type:"), i)))))
    known = lambda ids, c: F.array_contains(ids, F.coalesce(c, F.lit("")))
    edge = F.flatten(let(refs, lambda ids: F.transform(edges, lambda e: reasons(
        F.when(~known(ids, e["source"]), F.concat(F.lit("edge_unknown_source:"), F.coalesce(e["source"], F.lit("")))),
        F.when(~known(ids, e["target"]), F.concat(F.lit("edge_unknown_target:"), F.coalesce(e["target"], F.lit("")))),
        F.when(F.coalesce(e["relation"], F.lit("positive")) == "", "edge_missing_relation"),
    ))))
    negative = F.flatten(F.zip_with(negatives, F.transform(negatives, numbered("negative")), lambda n, i: reasons(
        F.when(empty(n["text"]), F.concat(F.lit("empty_negative_text:"), i)),
        F.when(F.coalesce(T.strip(n["negative_type"]), F.lit("hard_negative")) == "", F.concat(F.lit("missing_negative_type:"), i)),
    )))
    usage = F.coalesce(F.nullif(T.strip(F.col("usage")), F.lit("")), F.lit("train"))
    return F.concat(
        reasons(*[F.when(field(c) == "", f"missing_{c}") for c in ("set_id", "latent_type", "latent_key", "source_dataset")], F.when(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, "missing_source_ids"), F.when(F.size(texts) < min_views, f"too_few_views<{min_views}"), F.when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_view_ids")),
        F.coalesce(view, none),
        reasons(F.when(F.size(types) < min_types, f"too_few_view_types<{min_types}")),
        F.coalesce(edge, none),
        F.coalesce(negative, none),
        reasons(F.when((F.coalesce(T.strip(F.col("risk_tag")), F.lit("")) != "") & (usage == "train"), "risk_tagged_row_marked_train")),
    )
