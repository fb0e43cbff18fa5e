"""Work lists: every combination of inputs with small tables of models, languages, views and settings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.functions import text as X

#: Rows that a settings table may have to be put beside every input.
MOST_SETTINGS = 10_000


def enabled(rows: DataFrame) -> DataFrame:
    """Settings that aren't switched off."""
    return rows.filter(F.coalesce("enabled", F.lit(True))) if "enabled" in rows.columns else rows


def combine(inputs: DataFrame, **settings: DataFrame) -> DataFrame:
    """``inputs`` with a struct column for each table of settings: every combination. The combinations are made and
    counted first, so what is put beside each row has a known bound; the inputs are not shuffled."""
    spark = inputs.sparkSession
    rows = {name: df.limit(MOST_SETTINGS + 1).collect() for name, df in settings.items()}
    n = math.prod(len(r) for r in rows.values())
    if n > MOST_SETTINGS:
        raise ValueError(f"{n} or more combinations of settings; {MOST_SETTINGS} are the most")
    flat = [T.StructField(f"_{name}_{f.name}", f.dataType) for name, df in settings.items() for f in df.schema.fields]
    made = spark.createDataFrame([tuple(v for row in combination for v in row) for combination in itertools.product(*rows.values())], T.StructType(flat))
    names = [f.name for f in flat]
    listed = made.agg(F.collect_list(F.struct(*names)).alias("_s"))
    each = inputs.join(F.broadcast(listed)).select(*inputs.columns, F.inline("_s"))
    structs = {name: F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in df.columns]) for name, df in settings.items()}
    return each.withColumns(structs).drop(*names)


def rewrite_slots(originals: DataFrame, models: DataFrame, bands: list[tuple[str, int, int]]) -> DataFrame:
    """``original x band x model`` with the words each rewrite must avoid and its instruction."""
    spark = originals.sparkSession
    table = spark.createDataFrame(bands, "length_band string, min_words int, max_words int")
    slots = combine(originals.withColumn("banned_words", X.banned_words(F.col("text"))), model=enabled(models), band=table)
    return slots.withColumn("prompt", X.rewrite_prompt(F.col("text"), F.col("banned_words"), F.col("band.min_words"), F.col("band.max_words")))


def render_jobs(images: DataFrame, models: DataFrame, languages: DataFrame, views: DataFrame, template: str) -> DataFrame:
    """``image x model x language x view`` with the prompt, its hash and an id made of the four."""
    jobs = combine(images, model=enabled(models), language=languages, view=views)
    prompt = X.fill(template, language_name=F.col("language.name"), language_code=F.col("language.code"), view_id=F.col("view.view_id"), view_instruction=F.col("view.instruction"))
    ids = F.concat_ws("|", "image_id", "model.source_id", "language.code", "view.view_id")
    return jobs.withColumn("prompt", prompt).withColumns({"prompt_hash": X.stable_hash(F.col("prompt")), "job_id": F.concat(F.lit("job_"), X.stable_hash(ids))})


def lookup(ids: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """``ids`` with what is known of them; an id that isn't known is an error when the row is read."""
    joined = ids.join(known.withColumn("_known", F.lit(True)), by, "left")
    bad = F.concat(F.lit(f"unknown {by}: "), F.coalesce(F.col(by).cast("string"), F.lit("null")))
    return joined.withColumn(by, F.when(F.col("_known"), F.col(by)).otherwise(F.raise_error(bad).cast(ids.schema[by].dataType))).drop("_known")


def grid_jobs(banks: DataFrame, sizes: list[int], methods: list[str]) -> DataFrame:
    """``bank x set size x method`` with the key of each model."""
    jobs = banks.withColumn("set_size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return jobs.withColumn("key", F.concat_ws("__", "method", "bank_id", F.format_string("s%02d", "set_size")))


def layer_jobs(models: DataFrame, fractions: Mapping[str, float] | list[float]) -> DataFrame:
    """``model x depth`` with the layer each depth means."""
    depth = models.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return depth.withColumns({"layer": X.layer_of(F.col("n_layers"), F.col("fraction")), "layer_label": X.pct_label(F.col("fraction"))})


def mock_answers(jobs: DataFrame, hint: str = "language.script_hint") -> DataFrame:
    """What a stand-in generator says: a fixed text in the script of the language, and the job's view."""
    h = F.col(hint)
    text = F.when(h == "arabic", "مشهد واضح فيه أشياء وأشخاص").when(h == "devanagari", "एक स्पष्ट दृश्य जिसमें वस्तुएं हैं").when(h == "cjk", "画面中有清晰的物体和人物").when(h == "hangul", "물체와 사람이 있는 장면").otherwise("A clear scene with objects and people")
    return jobs.withColumns({"output_text": F.concat_ws(" ", text, F.concat(F.lit("("), F.col("view.view_id"), F.lit(")"))), "generation_status": F.lit("ok"), "backend": F.lit("mock")})
