"""The queries over the training-data operators, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import bpe, formatting, leaks, neardup, neighbours, oracles, overlap, pairs, spans, splits, truncation
from loomset.runtime import latest, materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by text, and semantic sets by all their texts together, every delivery."""
    news = table(spark, sf_dir, "news_row").select(F.lit("news").alias("kind"), F.col("id").alias("key"), F.col("fetched_at").alias("at"), "text")
    sets = table(spark, sf_dir, "semantic_set_view").select(F.lit("set").alias("kind"), F.col("original_id").alias("key"), F.col("built_at").alias("at"), F.array_join("texts", "\n").alias("text"))
    return news.unionByName(sets)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_texts(spark, sf_dir), 0.7)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(_texts(spark, sf_dir), 0.8)


def _set_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every semantic set."""
    return latest(table(spark, sf_dir, "semantic_set_view"), "original_id", "built_at", "texts", "source", "rewrite_meta").filter("original_id is not null")


def _answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, rec_key, view_idx, prompt, answer``: originals with their rewrites, claims with the responses given."""
    sets = _set_texts(spark, sf_dir).select("original_id", F.col("texts")[0].alias("prompt"), F.posexplode("texts").alias("view_idx", "answer")).filter("view_idx > 0")
    rejected = latest(table(spark, sf_dir, "rejected").select("source_index", "logged_at", "claim", "reasons"), "source_index", "logged_at", "claim", "reasons").filter("source_index is not null")
    given = F.filter("reasons", lambda r: F.startswith(r, F.lit("response=")))
    answered = rejected.withColumn("given", given).filter(F.size("given") > 0)
    return sets.select(F.lit("set").alias("kind"), F.col("original_id").alias("rec_key"), "view_idx", "prompt", "answer").unionByName(
        answered.select(F.lit("rejected").alias("kind"), F.col("source_index").cast("string").alias("rec_key"), F.lit(0).alias("view_idx"), F.col("claim").alias("prompt"), F.substring(F.col("given")[0], 10, 2147483647).alias("answer"))
    )


def _judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_answer_pairs(spark, sf_dir), "pairs")
    return pairs.judged(found, truncation.fit(found.select(F.col("answer").alias("text"))))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_pairs(spark, sf_dir).drop("in_order")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by kind and, of the copies, how much is copied in order on average."""
    return _judged_pairs(spark, sf_dir).groupBy("kind", "defect").agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.when(F.col("defect") == "copy", F.col("in_order"))), 6).alias("in_order"))


def _limited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, rec_key, view_idx, source, text``: texts of semantic sets, by their model or the set's source, and
    steered outputs, by their model."""
    views = _set_texts(spark, sf_dir).select("original_id", "source", "rewrite_meta", F.posexplode("texts").alias("view_idx", "text"))
    model = F.get(F.col("rewrite_meta"), F.col("view_idx") - 1)["model_name"]
    probes = latest(table(spark, sf_dir, "steering_probe").select("probe_id", "generated_at", "target_model_id", "steered"), "probe_id", "generated_at", "target_model_id", "steered").filter("probe_id is not null")
    return views.select(F.lit("set").alias("kind"), F.col("original_id").alias("rec_key"), "view_idx", F.when(F.col("view_idx") == 0, F.col("source")).otherwise(model).alias("source"), "text").unionByName(
        probes.select(F.lit("probe").alias("kind"), F.col("probe_id").cast("string").alias("rec_key"), F.lit(0).alias("view_idx"), F.col("target_model_id").alias("source"), F.col("steered").alias("text"))
    )


def _cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = materialize(_limited_texts(spark, sf_dir), "texts")
    return truncation.flag(texts, truncation.fit(texts), unless=pairs.unanswered)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_texts(spark, sf_dir).filter("cut").select("kind", "rec_key", "view_idx")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.share(_cut_texts(spark, sf_dir), F.col("source"))


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    latent = latest(table(spark, sf_dir, "latent_set").select("set_id", "built_at", "source_ids"), "set_id", "built_at", "source_ids")
    sets = table(spark, sf_dir, "semantic_set_view").select("original_id").distinct()
    return latent.select(F.lit("latent").alias("kind"), F.col("set_id").alias("rec_key"), F.col("source_ids").alias("sources")).unionByName(
        sets.select(F.lit("set").alias("kind"), F.col("original_id").alias("rec_key"), F.array("original_id").alias("sources"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.source_groups(_sourced(spark, sf_dir)).filter("n > 1").select("rec_key", "group_key")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(_sourced(spark, sf_dir))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records there are, how many a test split of a tenth should have, and by how many it misses that."""
    given = splits.assign_splits(_sourced(spark, sf_dir)).agg(F.count("*").alias("n_records"), F.count(F.when(F.col("split") == "test", 1)).alias("n_test"))
    goal = F.bround(F.col("n_records") * 0.1).cast("bigint")
    return given.select("n_records", goal.alias("goal"), F.abs(F.col("n_test") - goal).alias("off"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "news_row").select(F.lit("news").alias("kind"), F.col("id").alias("key"), F.lit(0).cast("bigint").alias("num"), F.col("fetched_at").alias("at"), "text")
    rejected = table(spark, sf_dir, "rejected").select(F.lit("rejected").alias("kind"), F.col("source_index").cast("string").alias("key"), F.col("source_index").cast("bigint").alias("num"), F.col("logged_at").alias("at"), F.col("claim").alias("text"))
    return news.unionByName(rejected)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.copies(_written(spark, sf_dir))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapsed(_written(spark, sf_dir))


def _split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, side, source, split, text``: claims and evidence by the split their records are in."""
    latent = latest(table(spark, sf_dir, "latent_set").select("set_id", "built_at", "usage", "texts", "source_dataset"), "set_id", "built_at", "usage", "texts", "source_dataset")
    views = latent.select("set_id", "usage", "source_dataset", F.explode("texts").alias("v")).filter(F.coalesce("v.view_type", F.lit("")) != "evidence_reference")
    rejected = latest(table(spark, sf_dir, "rejected").select("source_index", "logged_at", "split", "claim"), "source_index", "logged_at", "split", "claim")
    name = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return views.select(F.col("set_id").alias("key"), overlap.side(F.col("usage")).alias("side"), F.coalesce("source_dataset", F.lit("")).alias("source"), name(F.col("usage")).alias("split"), F.col("v.text").alias("text")).unionByName(
        rejected.select(F.concat(F.lit("rejected:"), F.col("source_index").cast("string")).alias("key"), overlap.side(F.col("split")).alias("side"), F.lit("rejected").alias("source"), name(F.col("split")).alias("split"), F.col("claim").alias("text"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.cross_split(_split_texts(spark, sf_dir).select("key", "side", "text"), 0.7)
    return found.select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records by split and source, and how many of them are in training too."""
    texts = _split_texts(spark, sf_dir)
    found = overlap.overlapping(texts.select("key", "side", "text"), 0.7).select("key", F.lit(1).alias("hit"))
    records = texts.filter("side = 'e'").select("key", "split", "source").distinct()
    return records.join(found, "key", "left").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, n_spans, n_words`` of every evaluation record that is in training too."""
    return overlap.overlapping(_split_texts(spark, sf_dir).select("key", "side", "text"), 0.7)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, sf_dir, "activation_bank"))


def p7_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_lists(table(spark, sf_dir, "activation_bank"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coverage(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_report, p3_found, p3_splits, p3_totals, p4_found, p4_report, p5_found, p5_collapsed, p6_found, p6_report, p6_spans, p7_found, p7_lists, p8_ids, p9_found, p9_spans, p10_found, p10_coverage)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
