"""Claims joined with the sentences they rest on, and turned into sets or into reasons why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import selection, validation

SUPPORTED = ("SUPPORTS", "REFUTES")


def wiki_sentences(pages: DataFrame) -> DataFrame:
    """``page, sentence_id, sentence`` of ``id, lines``: a line holds a number, the sentence and what it links to;
    the last line of a number counts; lines without a number or text are left out."""
    line = pages.select(T.title(F.col("id")).alias("page"), F.posexplode(F.split(F.coalesce("lines", F.lit("")), r"\r\n|\n|\r")).alias("o", "line"))
    parts = line.select("page", "o", F.expr("try_cast(split(line, '\t')[0] as int)").alias("sentence_id"), F.get(F.split("line", "\t"), F.lit(1)).alias("raw"))
    clean = parts.select("page", "sentence_id", "o", T.collapse(F.coalesce("raw", F.lit(""))).alias("sentence")).filter((F.col("page") != "") & F.col("sentence_id").isNotNull() & (F.col("sentence") != ""))
    return selection.last_wins(clean, ["page", "sentence_id"], "o", "sentence")


def first_evidence(evidence: Column) -> Column:
    """Of nested evidence as JSON, lists of lists of annotation, evidence, page and sentence: the first item that
    names a page and a sentence."""
    items = F.flatten(F.from_json(evidence, "array<array<array<string>>>"))
    item = F.get(F.filter(items, lambda x: F.get(x, F.lit(2)).isNotNull() & F.get(x, F.lit(3)).isNotNull()), F.lit(0))
    return F.when(item.isNotNull(), F.struct(F.get(item, F.lit(0)).alias("annotation"), F.get(item, F.lit(1)).alias("evidence"), F.get(item, F.lit(2)).alias("page"), F.get(item, F.lit(3)).alias("sentence")))


def normal_claims(claims: DataFrame) -> DataFrame:
    """Flat claims: where page or sentence is missing, both come from the nested evidence."""
    if "evidence" not in claims.columns:
        return claims
    found = claims.withColumn("_e", first_evidence(F.col("evidence")))
    lacks = F.col("evidence_wiki_url").isNull() | F.col("evidence_sentence_id").isNull() if "evidence_wiki_url" in claims.columns else F.lit(True)
    old = lambda c: F.col(c).cast("string") if c in claims.columns else F.lit(None).cast("string")
    take = lambda c, f: F.when(lacks & F.col("_e").isNotNull(), F.col(f"_e.{f}")).otherwise(old(c))
    return found.withColumns({"evidence_wiki_url": take("evidence_wiki_url", "page"), "evidence_sentence_id": take("evidence_sentence_id", "sentence"), "evidence_annotation_id": take("evidence_annotation_id", "annotation")}).drop("_e", "evidence")


def required_pages(claims: DataFrame) -> DataFrame:
    """``page`` that some claim names."""
    return normal_claims(claims).select(T.title(F.col("evidence_wiki_url").cast("string")).alias("page")).filter("page <> ''").distinct()


def judge_claims(claims: DataFrame, sentences: DataFrame, reference_view: bool = False) -> DataFrame:
    """Claims with the sentence they name, and the reasons why they give no set. Only sentences of pages that
    claims name go into the join."""
    flat = normal_claims(claims)
    page = T.title(F.col("evidence_wiki_url").cast("string"))
    number = F.expr("try_cast(id as bigint)")
    sentence_id = F.expr("try_cast(evidence_sentence_id as int)")
    rows = flat.withColumns({"_label": F.upper(T.strip(F.coalesce("label", F.lit("")))), "_claim": T.collapse(F.coalesce("claim", F.lit(""))), "page": page, "claim_id": number, "sentence_id": sentence_id})
    needed = sentences.join(rows.select("page").distinct(), "page", "left_semi")
    joined = rows.join(needed, ["page", "sentence_id"], "left")
    first = validation.reasons(
        F.when(~F.col("_label").isin(*SUPPORTED), F.concat(F.lit("unsupported_label:"), F.coalesce(F.nullif(F.col("_label"), F.lit("")), F.lit("missing")))),
        F.when(F.col("_claim") == "", "missing_claim"),
        F.when(F.col("page") == "", "missing_evidence_wiki_url"),
        F.when(F.col("claim_id").isNull(), "missing_or_invalid_id"),
        F.when(F.coalesce("sentence_id", F.lit(-1)) < 0, "missing_evidence_sentence_id"),
    )
    late = F.lit(None).cast("string") if reference_view else F.when(F.col("sentence").isNull(), "missing_evidence_text")
    return joined.withColumn("reasons", F.when(F.size(first) > 0, first).otherwise(validation.reasons(late)))


def claim_sets(judged: DataFrame, split: str, prefix: str = "fever") -> DataFrame:
    """Latent sets of the judged claims without a reason: the claim, its evidence or a reference to it, the edge
    between them, and the place of a hard negative that is still to be found."""
    ok = judged.filter(F.size("reasons") == 0)
    source = T.record_id(prefix, split, F.col("claim_id"))
    evidence_id = F.format_string("wiki:%s:%d", F.col("page"), F.col("sentence_id"))
    missing = F.col("sentence").isNull()
    word = F.when(F.col("_label") == "SUPPORTS", "supports").otherwise("refutes")
    reference = F.format_string("Evidence sentence %d on Wikipedia page %s %s this claim.", F.col("sentence_id"), F.col("page"), word)
    view = lambda i, t, k, s: F.struct(F.lit(i).alias("id"), t.alias("text"), k.alias("view_type"), s.alias("source_id"), F.lit(False).alias("generated"))
    none = F.lit(None).cast("string")
    return ok.select(
        F.format_string(f"{prefix}_{split}_%06d_%s", F.col("claim_id"), F.coalesce(F.col("evidence_annotation_id").cast("string"), F.lit("unknown"))).alias("set_id"),
        F.lit("fact").alias("latent_type"),
        F.format_string(f"{prefix}:%d:%s:%s:%d", F.col("claim_id"), F.col("_label"), F.col("page"), F.col("sentence_id")).alias("latent_key"),
        F.lit(f"{prefix}/{prefix}").alias("source_dataset"),
        F.array(source, evidence_id).alias("source_ids"),
        F.array(view("claim", F.col("_claim"), F.lit("claim"), source), view("evidence", F.coalesce("sentence", reference), F.when(missing, "evidence_reference").otherwise("evidence"), evidence_id)).alias("texts"),
        F.array(F.struct(F.lit("claim").alias("source"), F.lit("evidence").alias("target"), T.relation_of(F.col("_label")).alias("relation"), evidence_id.alias("evidence"))).alias("positive_edges"),
        F.array(F.struct(F.lit("label_flip_control").alias("id"), F.format_string("A nearby hard negative should use the same topic but a different evidence relation for claim %d.", F.col("claim_id")).alias("text"), F.lit("placeholder_requires_mining").alias("negative_type"), none.alias("source_id"))).alias("hard_negatives"),
        F.lit("train").alias("usage"),
        F.col("_label").alias("label"),
        (~missing).alias("evidence_text_present"),
    )
