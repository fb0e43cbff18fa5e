import pytest
from pyspark.sql import functions as F

from loomset.operators import evidence, jobs, sets, steering, validation

LATENT = "set_id string, latent_type string, latent_key string, source_dataset string, source_ids array<string>, domain string, texts array<struct<id:string,text:string,view_type:string,source_id:string,generated:boolean,metadata:string>>, positive_edges array<struct<source:string,target:string,relation:string,evidence:string,metadata:string>>, hard_negatives array<struct<id:string,text:string,negative_type:string,source_id:string,metadata:string>>, risk_tag string, usage string, validation string, metadata string"


def latent(**changes):
    row = {"set_id": "s", "latent_type": "fact", "latent_key": "k", "source_dataset": "d", "source_ids": ["x"], "domain": None, "texts": [("claim", "c", "claim", "x", False, None), ("evidence", "e", "evidence", "y", False, None)], "positive_edges": [("claim", "evidence", "supported_by", None, None)], "hard_negatives": [], "risk_tag": None, "usage": "train", "validation": None, "metadata": None}
    return tuple((row | changes).values())


def issues(spark, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), LATENT).select(validation.latent_issues()).collect()]


def test_latent_issues(spark):
    claim = ("claim", "c", "claim", "x", False, None)
    got = issues(
        spark, latent(), latent(texts=[claim, ("b", "t", "claim", None, None, None)]), latent(positive_edges=[("claim", "missing", "r", None, None)]), latent(positive_edges=[("0", "1", None, None, None)]), latent(risk_tag="r"), latent(risk_tag="r", usage="eval"),
        latent(texts=None, positive_edges=None, hard_negatives=None, source_ids=None, set_id=None), latent(texts=[claim, ("claim", " ", "e", None, None, None)]), latent(hard_negatives=[(None, None, "", None, None)]),
    )
    assert got[0] == [] and "too_few_view_types<2" in got[1] and got[2] == ["edge_unknown_target:missing"] and got[3] == [] and got[4] == ["risk_tagged_row_marked_train"] and got[5] == []
    assert got[6] == ["missing_set_id", "missing_source_ids", "too_few_views<2", "too_few_view_types<2"]
    assert got[7] == ["duplicate_view_ids", "empty_view_text:claim", "edge_unknown_target:evidence"]
    assert got[8] == ["empty_negative_text:negative_00", "missing_negative_type:negative_00"]


def test_rewrite_rules(spark):
    rows = [("Profits grew as overseas demand improved",), ("Overseas demand lifted company income",), ("abc",), ("",)]
    df = spark.createDataFrame(rows, "t string").select(validation.rewrite_reasons(F.col("t"), F.array(F.lit("profits")), F.lit(5), F.lit(7)))
    got = [r[0] for r in df.collect()]
    assert got[0] == ["banned_words=profits"] and got[1] == [] and got[2] == ["word_count=1, expected=5-7", "empty_or_too_short"] and len(got[3]) == 2


def test_latent_summary(spark):
    ref = ("evidence", "Evidence sentence 1", "evidence_reference", None, True, None)
    second = latent(set_id="t", texts=[("claim", "Fox released FOX.", "claim", None, None, None), ref], hard_negatives=[("n", "x", "placeholder_requires_mining", None, None)])
    df = spark.createDataFrame([latent(texts=[("claim", "fox released", "claim", None, None, None), ("evidence", "fox film", "evidence", None, None, None)], metadata='{"label": "SUPPORTS"}'), second], LATENT)
    got = {(r["counter"], r["key"]): r["n"] for r in sets.latent_counts(df).collect()}
    assert got["view_type", "claim"] == 2 and got["view_type", "evidence"] == 1 and got["evidence", "present"] == 1 and got["evidence", "missing"] == 1 and got["negative", "placeholder"] == 1 and got["label", "SUPPORTS"] == 1
    row = sets.claim_evidence(df).first()
    assert row["n_sets"] == 2 and row["mean_views"] == 2.0 and row["mean_jaccard"] == pytest.approx(1 / 3, abs=1e-6)
    none = sets.claim_evidence(df.limit(0)).first()
    assert none["n_sets"] == 0 and none["mean_views"] == 0.0 and none["mean_jaccard"] is None


def test_set_statistics(spark):
    schema = "original_id string, label string, rewrites array<struct<text string, model_name string, length_band string>>"
    df = spark.createDataFrame([("a", "x", [("t", "m1", "5-7"), ("u", "m1", "5-7")]), ("b", None, [("v", "m2", "10-12")])], schema)
    got = {(r["metric"], r["key"]): r["value"] for r in sets.set_stats(df, (1, 2)).collect()}
    assert got["n_sets", ""] == 2 and got["n_rewrites", ""] == 3 and got["sets_at_least", "1"] == 2 and got["sets_at_least", "2"] == 1 and got["model", "m1"] == 2 and got["length_band", "5-7"] == 2 and got["label", "None"] == 1
    assert [r["original_id"] for r in sets.with_rewrites(df, 2).collect()] == ["a"]
    empty = sets.set_totals(df.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0)


def test_grouping_keeps_order(spark):
    df = spark.createDataFrame([("a", "A", 2, "second"), ("a", "A", 1, "first"), ("b", "B", 3, "only")], "original_id string, original_text string, o int, rewrite string")
    got = {r["original_id"]: [x["text"] for x in r["rewrites"]] for r in sets.group_accepted(df, "o").collect()}
    assert got == {"a": ["first", "second"], "b": ["only"]}


CLAIM = "id string, label string, claim string, evidence_wiki_url string, evidence_sentence_id string, evidence_annotation_id string, evidence string"


def test_claims(spark):
    pages = spark.createDataFrame([("Page", "0\tFirst  one.\n7\tSeventh.\tentity\ttail\nx\tno number\n7\tLast one wins.\n8\t"), (None, None)], "id string, lines string")
    sentences = evidence.wiki_sentences(pages)
    assert {(r["sentence_id"], r["sentence"]) for r in sentences.collect()} == {(0, "First one."), (7, "Last one wins.")}
    rows = [
        ("1", "SUPPORTS", " a  claim ", "Page", "7", "9", None), ("2", "refutes", "c", None, None, None, '[[[92206, 104971, "Page", 0]]]'), ("3", "SUPPORTS", "c", "Other", "1", None, None), ("x", "NOT ENOUGH INFO", "", None, "-1", None, None), ("4", None, None, None, None, None, None),
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    got = {r["id"]: r["reasons"] for r in evidence.judge_claims(claims, sentences).collect()}
    assert got["1"] == [] and got["2"] == [] and got["3"] == ["missing_evidence_text"]
    assert got["x"] == ["unsupported_label:NOT ENOUGH INFO", "missing_claim", "missing_evidence_wiki_url", "missing_or_invalid_id", "missing_evidence_sentence_id"]
    assert got["4"][0] == "unsupported_label:missing"
    made = {r["set_id"]: r for r in evidence.claim_sets(evidence.judge_claims(claims, sentences, reference_view=True), "dev").collect()}
    assert made["fever_dev_000001_9"]["texts"][0]["text"] == "a claim" and made["fever_dev_000002_92206"]["positive_edges"][0]["relation"] == "refuted_by"
    third = made["fever_dev_000003_unknown"]
    assert third["texts"][1]["view_type"] == "evidence_reference" and not third["evidence_text_present"]
    assert {r["page"] for r in evidence.required_pages(claims).collect()} == {"Page", "Other"}


def test_registry_issues(spark):
    schema = "source_id string, hf_dataset string, builder string, status string, splits array<string>, latent_types array<string>"
    ok = ("a", "h", "b", "build_now", ["train"], ["fact"])
    df = spark.createDataFrame([ok, ("b", None, "b", "odd", [], ["fact"]), ("c", "h", "b", "future_work", ["t"], ["f"]), ("c", "h", "b", "future_work", ["t"], ["f"])], schema)
    got = sorted(map(tuple, validation.source_issues(df).collect()))
    assert got == [("b", "invalid_status:odd"), ("b", "missing_hf_dataset"), ("b", "missing_splits"), ("c", "duplicate_source_id")]


def test_jobs(spark):
    images = spark.createDataFrame([("i1",), ("i2",)], "image_id string")
    models = spark.createDataFrame([("m1", None), ("m2", False)], "source_id string, enabled boolean")
    langs = spark.createDataFrame([("en", "English", "latin"), ("ko", "Korean", "hangul")], "code string, name string, script_hint string")
    views = spark.createDataFrame([("v", "look")], "view_id string, instruction string")
    made = jobs.mock_answers(jobs.render_jobs(images, models, langs, views, "{language_name} {view_instruction}")).collect()
    assert len(made) == 4 and len({r["job_id"] for r in made}) == 4 and {r["prompt"] for r in made} == {"English look", "Korean look"}
    with pytest.raises(ValueError, match="settings"):
        jobs.combine(images, a=spark.range(200), b=spark.range(200))
    known = spark.createDataFrame([("m1", 1)], "source_id string, n int")
    assert jobs.lookup(models.filter("source_id = 'm1'"), known, "source_id").first()["n"] == 1
    with pytest.raises(Exception, match="unknown source_id: m2"):
        jobs.lookup(models, known, "source_id").collect()


def test_candidates(spark):
    concepts = spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "target_concept_dim int, o int")
    labels = spark.createDataFrame([(1, "Windows security", "", "yes"), (2, "x", "", "no"), (9, "far", "", "yes")], "rank int, candidate string, label string, use_for_steering string")
    got = steering.candidates(concepts, labels, "o").collect()
    assert len(got) == 1 and got[0]["target_concept_dim"] == 7 and "windows" in got[0]["keywords"].split(";")
    typed = steering.typed_candidates(spark.createDataFrame([("1", "7", "0.5", "a; b")], "rank string, target_concept_dim string, inspection_score string, keywords string")).first()
    assert typed["rank"] == 1 and typed["inspection_score"] == 0.5 and typed["keywords"] == ["a", "b"]


def test_generators_lose_no_row(spark):
    from loomset.operators import generation

    def make(model):
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [f"{model}:{p}" for p in prompts]

        return run

    rows = [("a", f"p{i}") for i in range(5)] + [("b", "bad one"), ("b", "fine"), ("b", None)]
    got = {(r["model_id"], r["prompt"]): r for r in generation.generate(spark.createDataFrame(rows, "model_id string, prompt string"), make, batch=3).collect()}
    assert len(got) == 8 and got["a", "p0"]["output_text"] == "a:p0" and got["b", "fine"]["output_text"] == "b:fine" and got["b", None]["generation_status"] == "ok"
    assert got["b", "bad one"]["generation_status"] == "error" and "RuntimeError: no" in got["b", "bad one"]["generation_error"]


def test_runs_are_collected(spark):
    from loomset.operators import transfer

    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert sorted(map(tuple, transfer.collect_runs({"one": a, "two": b}).select("run", "x", "y").collect())) == [("one", 1, None), ("two", 2, 3)]
