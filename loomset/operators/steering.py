"""Candidates for steering, and how generations steered by them score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import selection

#: Judgements under which a candidate is taken.
TAKEN = ("yes", "yes_maybe", "maybe_control")


def candidates(concepts: DataFrame, labels: DataFrame, order: str, use: tuple[str, ...] = TAKEN) -> DataFrame:
    """Concepts, ranked from 1 in their order, with the label given to their rank (the last one given); keywords
    that a label lacks are guessed. Labels are few: people wrote them."""
    ranked = selection.numbered(concepts, order, name="_r").withColumn("rank", (F.col("_r") + 1).cast("int")).drop("_r")
    columns = [c for c in labels.columns if c not in ("rank", "ord")]
    given = labels.withColumn("rank", F.col("rank").cast("int"))
    if "ord" in labels.columns:
        given = selection.last_wins(given, ["rank"], "ord", *columns)
    kept = given.filter(F.col("use_for_steering").isin(*use))
    words = T.keywords(F.col("keywords")) if "keywords" in columns else F.array().cast("array<string>")
    found = F.when(F.size(words) > 0, words).otherwise(T.guessed_keywords(F.col("candidate"), F.col("label")))
    return ranked.join(kept, "rank").withColumn("keywords", F.array_join(found, ";"))


def typed_candidates(rows: DataFrame) -> DataFrame:
    """A manifest of candidates read as strings, in its types."""
    types = {"rank": "int", "target_concept_dim": "int", "source_concept_dim": "int", "pair_controlled_topk": "double", "inspection_score": "double"}
    casts = {c: F.col(c).cast(t) for c, t in types.items() if c in rows.columns}
    return rows.withColumns(casts | {"keywords": T.keywords(F.col("keywords"))})


def with_examples(concepts: DataFrame, examples: DataFrame, by: list[str], fields: list[str], order: str, most: int) -> DataFrame:
    """Concepts with their first examples in an array, empty where there is none. Examples are cut to ``most``
    before they are gathered."""
    few = examples.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("_r") <= most)
    got = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", *fields))).alias("examples"))
    return concepts.join(got, by, "left").withColumn("examples", F.coalesce("examples", F.array()))


def score(outputs: DataFrame, text: Column, words: Column) -> DataFrame:
    hits = T.keyword_hits(text, words)
    return outputs.withColumns({"keyword_hits": hits, "keyword_score": F.size(hits)})


def summarize(scored: DataFrame, by: tuple[str, ...] = ("rank", "candidate", "target_model_id", "alpha")) -> DataFrame:
    """Means of baseline, steered score and gain by candidate, model and strength."""
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return scored.groupBy(*by).agg(F.count("*").alias("n"), mean("baseline_keyword_score"), mean("steered_keyword_score"), mean("keyword_gain"))
