"""The test tables as the operators take them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.runtime import latest, table

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_SQL}+', ' ', 'g'), ' ')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def last_sql(name: str, key: str, at: str) -> str:
    """Each key's last delivery."""
    return f"(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) AS _n FROM {name}) WHERE _n = 1)"


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``original_id, original_text, label, source, texts, rewrites``."""
    rows = latest(table(spark, sf_dir, "semantic_set_view"), "original_id", "built_at", "label", "source", "texts", "rewrite_meta")
    return rows.select("original_id", F.get("texts", F.lit(0)).alias("original_text"), "label", "source", "texts", F.col("rewrite_meta").alias("rewrites"))


SETS_SQL = f"(SELECT original_id, texts[1] AS original_text, label, source, texts, rewrite_meta AS rewrites FROM {last_sql('semantic_set_view', 'original_id', 'built_at')})"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rewrite as an attempt: ``original_id, attempt_idx, original_text, label, source, rewrite, model_name, length_band, low,
    high``."""
    rows = sets(spark, sf_dir).select("original_id", "original_text", "label", "source", F.posexplode("rewrites").alias("attempt_idx", "r"))
    band = F.split("r.length_band", "-")
    return rows.select("original_id", "attempt_idx", "original_text", "label", "source", F.coalesce("r.text", F.lit("")).alias("rewrite"), "r.model_name", "r.length_band", F.get(band, F.lit(0)).cast("int").alias("low"), F.get(band, F.lit(1)).cast("int").alias("high"))


ATTEMPTS_SQL = f"""(SELECT original_id, i - 1 AS attempt_idx, original_text, label, source, coalesce(r.text, '') AS rewrite, r.model_name AS model_name, r.length_band AS length_band,
  CAST(split_part(r.length_band, '-', 1) AS INT) AS low, CAST(split_part(r.length_band, '-', 2) AS INT) AS high
  FROM (SELECT original_id, original_text, label, source, unnest(rewrites) AS r, generate_subscripts(rewrites, 1) AS i FROM {SETS_SQL}))"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "news_row"), "id", "fetched_at", "text", "source", "label", "title")


NEWS_SQL = last_sql("news_row", "id", "fetched_at")


def latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "latent_set"), "set_id", "built_at", "latent_type", "latent_key", "source_dataset", "source_ids", "domain", "texts", "positive_edges", "hard_negatives", "risk_tag", "usage", "validation", "metadata")


LATENT_SQL = last_sql("latent_set", "set_id", "built_at")


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "rejected"), "source_index", "logged_at", "source_id", "reasons", "claim", "label", "split")


REJECTED_SQL = last_sql("rejected", "source_index", "logged_at")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [c for c in table(spark, sf_dir, "steering_probe").columns if c not in ("probe_id", "generated_at")]
    return latest(table(spark, sf_dir, "steering_probe"), "probe_id", "generated_at", *cols)


PROBES_SQL = last_sql("steering_probe", "probe_id", "generated_at")

#: Words of a rewrite, as the length bands count them.
BAND_WORDS_SQL = "list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'), lambda w: trim(lower(w), '-''_ ')), lambda w: w <> '')"


def band_words_sql(x: str) -> str:
    return BAND_WORDS_SQL.format(x=x)


def banned_sql(x: str, stop: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    words = f"list_filter({band_words_sql(x)}, lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{listed}], w))"
    ranked = f"list_sort(list_transform(list_distinct({words}), lambda w: {{'f': -length(list_filter({words}, lambda q: q = w)), 'n': -length(w), 'w': w}}))"
    return f"list_transform(list_slice({ranked}, 1, 8), lambda s: s.w)"
