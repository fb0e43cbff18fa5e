import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from loomset.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_news_text_cuts_before_a_word(spark):
    assert one(spark, "a\\nb \t c", T.news_text) == "a b c"
    assert one(spark, "one two three", lambda c: T.news_text(c, 9)) == "one two"
    assert one(spark, "onetwothree", lambda c: T.news_text(c, 5)) == "onetw"
    assert one(spark, None, T.news_text) == ""


def test_word_counts_and_tokens(spark):
    assert one(spark, "A fast, clear rewrite works well.", T.word_count) == 6
    assert one(spark, "well-made don't x-y-z", T.band_words) == ["well-made", "don't", "x-y", "z"]
    assert one(spark, "Fox released FOX.", T.plain_tokens) == ["fox", "released", "fox"]
    assert one(spark, "", T.word_count) == 0


def test_banned_words_rank_by_frequency_length_alphabet(spark):
    text = "Profits grew as profits and markets, markets improved overseas 2024"
    assert one(spark, text, T.banned_words) == ["markets", "profits", "improved", "overseas", "grew"]
    assert one(spark, text, lambda c: T.banned_words(c, max_words=2, extra_stopwords=["Markets"])) == ["profits", "improved"]


def test_banned_hits_compare_whole_words(spark):
    hit = lambda s: one(spark, s, lambda c: T.banned_hits(c, F.array(F.lit("cloud"))))
    assert hit("Clouds gathered at dusk.") == []
    assert hit("Cloud demand increased.") == ["cloud"]


def test_clean_answer(spark):
    assert one(spark, "Rewrite: Fresh demand lifted company income.", T.clean_answer) == "Fresh demand lifted company income."
    assert one(spark, "```text\nRewrite: a\nOutput: \"b c\"\nd```", T.clean_answer) == "b c"
    assert one(spark, "“- quoted ”", T.clean_answer) == "quoted"


def test_jaccard_of_tokens(spark):
    row = spark.createDataFrame([(["fox", "released"], ["fox", "film"], [])], "a array<string>, b array<string>, c array<string>")
    got = row.select(T.token_jaccard(F.col("a"), F.col("b"), 1.0), T.token_jaccard(F.col("c"), F.col("c"), 1.0), T.token_jaccard(F.col("c"), F.col("a"), 1.0)).first()
    assert got[0] == pytest.approx(1 / 3) and got[1] == 1.0 and got[2] == 0.0


def test_script_and_fragments(spark):
    hint = lambda s, h: one(spark, s, lambda c: T.script_matches(c, F.lit(h)))
    assert hint("مرحبا", "arabic") and not hint("hello", "arabic")
    assert hint("12 !", "latin") and hint("héllo", "latin") and not hint("привет hi", "latin") and hint("x", "other")
    assert one(spark, "I'm SORRY", T.refusal_like) and not one(spark, "fine", T.refusal_like)
    assert one(spark, "the Filename", T.leaks_metadata)


@pytest.mark.parametrize("value", ["plain", 'q"uote', "tab\tline\n", "naïve é", "back\\slash", "", "{a}"])
def test_stable_hash_is_sha_of_json(spark, value):
    want = hashlib.sha256(json.dumps(value, ensure_ascii=False).encode()).hexdigest()[:16]
    assert one(spark, value, T.stable_hash) == want
    want = hashlib.sha256(json.dumps({"image_id": value}, ensure_ascii=False).encode()).hexdigest()[:16]
    assert one(spark, value, lambda c: T.keyed_hash("image_id", c)) == want


def test_seed_is_the_first_eight_bytes(spark):
    want = int.from_bytes(hashlib.sha256(b"0abc").digest()[:8], "big")
    assert one(spark, "abc", T.seed_number) == str(want)


def test_model_keys(spark):
    key = "setcode__llama3__mid_3b__meta-llama__llama-3.2-3b__layer_17_60pct__s16"
    p = lambda name: one(spark, key, lambda c: T.key_parts(c)[name])
    assert (p("model_slug"), p("layer_name"), p("set_token")) == ("meta-llama__llama-3.2-3b", "layer_17_60pct", "s16")
    assert one(spark, key, T.model_path) == "models/setcode/llama3/mid_3b/meta-llama__llama-3.2-3b/layer_17_60pct/s16"
    assert one(spark, "a__b", T.short_key) == "a__b" and one(spark, key, T.depth_pct) == "60"
    with pytest.raises(Exception, match="not a model key"):
        one(spark, "a__b", T.model_path)


def test_layers_and_labels(spark):
    assert one(spark, 0.07, T.pct_label, "double") == "07pct"
    assert one(spark, 0.5, lambda c: T.layer_of(F.lit(5), c), "double") == 2  # halves go to the even neighbour
    with pytest.raises(Exception, match="fraction"):
        one(spark, 1.5, lambda c: T.layer_of(F.lit(5), c), "double")


def test_keywords(spark):
    text = "Microsoft released a Windows security update."
    hits = one(spark, text, lambda c: T.keyword_hits(c, F.array(F.lit("windows"), F.lit("security"), F.lit("ipo"))))
    assert hits == ["windows", "security"]
    assert "windows" in one(spark, "Windows security", lambda c: T.guessed_keywords(c, F.lit("")))
    assert one(spark, "a /big_ small-thing tree", lambda c: T.guessed_keywords(c, F.lit(""))) == ["small-thing", "tree"]
    assert one(spark, " A ; ;b", T.keywords) == ["a", "b"]


def test_small_formats(spark):
    assert one(spark, 3661, T.elapsed, "int") == "1h 1m 1s" and one(spark, 59, T.elapsed, "int") == "59s" and one(spark, 61, T.elapsed, "int") == "1m 1s"
    assert one(spark, "x" * 10, lambda c: T.short_text(c, 8)) == "xxxxx..."
    assert one(spark, "a|b, c;", T.tags) == ["a", "b", "c"]
    assert T.bands("5-7, 10-12") == [("5-7", 5, 7), ("10-12", 10, 12)]
    assert T.set_sizes("2-6:2,9") == [2, 4, 6, 9] and T.shard("1/4") == (1, 4) and T.shard(None) is None
    for bad in ("4/4", "x", "1/0"):
        with pytest.raises(ValueError):
            T.shard(bad)
    assert one(spark, '[{"text": "t"}]', T.generated_text) == "t"


def test_prompt_holds_the_original_as_it_is(spark):
    got = one(spark, "use {banned_words} here", lambda c: T.rewrite_prompt(c, F.array().cast("array<string>"), F.lit(5), F.lit(7)))
    assert "use {banned_words} here" in got and "(none)" in got and re.search(r"5-7 words", got)
