"""Queries over sources and sinks: tables are written in every form there is and read back."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from loomset.functions import text as X
from loomset.functions import vectors as V
from loomset.operators import codes, evidence, selection, steering, transfer
from loomset.plans import tables as Q
from loomset.plans import vector_queries as VQ
from loomset.plans.registry import query
from loomset.runtime import scratch, table
from loomset.sources import files


@query("lines_of_shards", f"SELECT source_index, claim, label, coalesce(length(reasons), 0) AS n_reasons FROM {Q.REJECTED_SQL}")
def lines_of_shards(spark, d):
    """Rows written by three workers as JSON lines, read back together with a shard that was never written."""
    rows = Q.rejected(spark, d)
    path = scratch(spark, "shards")
    for i in range(3):
        files.write_jsonl(selection.model_shard(rows, "source_index", i, 3), f"{path}/{i}")
    got = files.read_shards(spark, [f"{path}/{i}" for i in range(4)], "claim string, label string, reasons array<string>, source_index int")
    return got.select("source_index", "claim", "label", F.coalesce(F.size("reasons"), F.lit(0)).alias("n_reasons"))


@query("appended_lines", f"SELECT original_id, count(*) AS n FROM {Q.SETS_SQL} WHERE original_id IS NOT NULL GROUP BY 1")
def appended_lines(spark, d):
    """JSON lines written in two steps, the second appended, and read as a whole."""
    rows, path = Q.sets(spark, d).filter("original_id is not null").select("original_id", "texts"), scratch(spark, "lines")
    first = F.pmod(F.xxhash64("original_id"), F.lit(2)) == 0
    files.write_jsonl(rows.filter(first), path)
    files.write_jsonl(rows.filter(~first), path, mode="append")
    return files.read_jsonl(spark, path, "original_id string, texts array<string>").groupBy("original_id").agg(F.count("*").alias("n"))


@query("csv_rows", f"SELECT probe_id, nullif(prompt, '') AS prompt, nullif(steered, '') AS steered, CAST(alpha AS DOUBLE) AS alpha FROM {Q.PROBES_SQL}")
def csv_rows(spark, d):
    """Quotes, separators, line ends and blanks through a CSV; empty text and null are one there."""
    path = scratch(spark, "csv")
    files.write_csv(Q.probes(spark, d).select("probe_id", "prompt", "steered", "alpha"), path)
    got = files.read_csv(spark, path)
    return got.select(F.col("probe_id").cast("bigint").alias("probe_id"), "prompt", "steered", F.col("alpha").cast("double").alias("alpha"))


@query("run_manifest", f"SELECT 'build' AS run, count(*) AS n_sets, CAST(sum(length(rewrites)) AS BIGINT) AS n_rewrites FROM {Q.SETS_SQL}")
def run_manifest(spark, d):
    """Counts of a run written as one JSON value and read back."""
    path = scratch(spark, "manifest")
    counts = Q.sets(spark, d).agg(F.count("*").alias("n_sets"), F.sum(F.size("rewrites")).alias("n_rewrites"))
    files.write_manifest(spark, path, run="build", counts=counts)
    return files.read_json(spark, path, "run string, counts struct<n_sets bigint, n_rewrites bigint>").select("run", "counts.n_sets", "counts.n_rewrites")


_PAGES = "(SELECT n_name AS page, n_nationkey AS k, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("archived_pages", f"""
SELECT page, 0 AS sentence_id, page || ' is nation ' || k || '.' AS sentence FROM {_PAGES} WHERE k % 4 <> 3 UNION ALL SELECT page, 7, 'It lies in ' || region || '.' FROM {_PAGES} WHERE k % 4 <> 3""")
def archived_pages(spark, d):
    """Sentences of the pages asked for, of an archive of pages as JSON lines."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        listed = sorted(rows.limit(1_000).collect())  # a fixed table of 25 nations
        for part in range(2):
            z.writestr(f"pages/{part}.jsonl", "\n\n".join(json.dumps({"id": n, "lines": f"0\t{n}  is nation {k}.\tlink\n1\t\n7\t It lies in {r}.\t{r}\nno number"}) for k, n, r in listed if k % 2 == part))
        z.writestr("__MACOSX/0.jsonl", '{"id": "CHINA", "lines": "0\\tnothing"}')
        z.writestr("pages/readme.txt", "none")
    path = scratch(spark, "pages")
    files.put_file(spark, f"{path}/pages.zip", packed.getvalue())
    wanted = table(spark, d, "nation").filter("n_nationkey % 4 <> 3").select(F.concat(F.lit(" "), "n_name").alias("page"))
    return evidence.wiki_sentences(files.wiki_archive(spark, path, wanted)).select("page", "sentence_id", "sentence")


def _images(spark, d) -> str:
    path = scratch(spark, "images")
    for k, name in sorted((r[0], r[1]) for r in table(spark, d, "nation").select("n_nationkey", "n_name").limit(1_000).collect()):
        files.put_file(spark, f"{path}/{'sub/' if k % 3 == 0 else ''}nation_{k:02d}.{('jpg', 'PNG', 'txt', 'webp')[k % 4]}", name.encode())
    return path


@query("listed_images", "SELECT printf('nation_%02d', n_nationkey) AS image_id, CAST(length(n_name) AS BIGINT) AS n_bytes FROM nation WHERE n_nationkey % 4 <> 2")
def listed_images(spark, d):
    """The images in a folder and those below, by listing."""
    return files.scan_images(spark, _images(spark, d), recursive=True).select("image_id", "n_bytes")


@query("image_urls", "SELECT printf('nation_%02d', n_nationkey) AS image_id, 'data:image/' || CASE n_nationkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'webp' END || ';base64,' || base64(n_name::BLOB) AS url FROM nation WHERE n_nationkey % 4 <> 2 AND n_nationkey % 3 <> 0")
def image_urls(spark, d):
    """Images as addresses that hold their content."""
    path = _images(spark, d)
    content = spark.read.format("binaryFile").load(f"{path}/*.*").select(F.col("path").alias("image_path"), "content")
    kind = F.lower(F.regexp_extract("image_path", r"\.([A-Za-z]+)$", 1))
    mime = F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").otherwise(kind))
    return files.scan_images(spark, path).join(content, "image_path").select("image_id", X.data_url(F.col("content"), mime).alias("url"))


@query("image_manifest", """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'part-' || p_partkey ELSE printf('image_%08d', p_partkey) END AS image_id, CASE WHEN p_partkey % 3 = 0 THEN 'http://images/' || p_partkey ELSE 'img/' || p_partkey || '.jpg' END AS image_path,
  replace(p_type, ' ', '/') AS tags, p_brand AS brand FROM part""")
def image_manifest(spark, d):
    """A CSV of images as a manifest: ids made where they are missing, addresses in place of paths, tags, all else as facts."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k, F.when(k % 2 == 0, F.concat(F.lit("part-"), k)).alias("image_id"), F.when(k % 3 != 0, F.concat(F.lit("img/"), k, F.lit(".jpg"))).alias("image_path"), F.concat(F.lit("http://images/"), k).alias("url"),
        F.concat(F.replace("p_type", F.lit(" "), F.lit(" | ")), F.lit(";")).alias("topic_tags"), "p_brand",
    )
    path = scratch(spark, "images")
    files.write_csv(rows, path)
    got = files.image_manifest(files.read_csv(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint")), "parts", "p_partkey")
    return got.select("image_id", "image_path", F.array_join("topic_tags", "/").alias("tags"), F.col("metadata")["p_brand"].alias("brand"))


@query("banks_by_folder", """
SELECT split_part(bank_id, '_', 1) || '__mid_3b__' || split_part(bank_id, '_', 3) || '__' || split_part(bank_id, '_', 2) AS bank, '3b' AS size_label, count(*) AS n_vectors, CAST(sum(length(hidden)) AS BIGINT) AS n_values
FROM activation_bank WHERE split_part(bank_id, '_', 1) IN ('lumen', 'marl') GROUP BY ALL""")
def banks_by_folder(spark, d):
    """Vectors in folders by family, size, model and layer; of other families nothing is read."""
    rows = table(spark, d, "activation_bank").withColumns(codes.bank_parts(F.col("bank_id")))
    path = scratch(spark, "banks")
    files.write_banks(rows.select("family", F.lit("mid_3b").alias("size"), F.col("run").alias("model_slug"), "layer_name", "vec_id", "hidden"), path)
    found = files.discover_banks(spark, path).filter(F.col("family").isin("lumen", "marl"))
    return found.groupBy(F.col("bank_id").alias("bank"), "size_label").agg(F.count("*").alias("n_vectors"), F.sum(F.size("hidden")).alias("n_values"))


@query("runs_compared", f"""
SELECT CASE WHEN alpha = 0 THEN 'plain' ELSE 'steered' END AS run, target_model_id, count(*) AS n, round(avg(keyword_gain), 6) AS mean_gain FROM {Q.PROBES_SQL} WHERE alpha IS NOT NULL AND target_model_id IS NOT NULL GROUP BY ALL""")
def runs_compared(spark, d):
    """Summary tables of two runs, each in the folder of its run, as one table with the labels of the runs."""
    rows = Q.probes(spark, d).filter("alpha is not null and target_model_id is not null")
    runs = {}
    for label, of in (("plain", "alpha = 0"), ("steered", "alpha <> 0")):
        path = scratch(spark, "run")
        files.write_csv(rows.filter(of).groupBy("target_model_id").agg(F.count("*").alias("n"), F.avg("keyword_gain").alias("mean_gain")), f"{path}/models.csv", single=True)
        runs[label] = files.load_run(spark, label, path, ("models", "missing"))["models"].drop("run")
    return transfer.collect_runs(runs).select("run", "target_model_id", F.col("n").cast("bigint").alias("n"), F.round(F.col("mean_gain").cast("double"), 6).alias("mean_gain"))


@query("stored_candidates", f"""
SELECT rank, candidate, target_concept_dim, length(list_filter(list_transform(string_split(coalesce(min(keywords), ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS n_keywords FROM {Q.PROBES_SQL} WHERE candidate IS NOT NULL GROUP BY 1, 2, 3""")
def stored_candidates(spark, d):
    """A manifest of candidates written as CSV and read in its types."""
    path = scratch(spark, "candidates")
    files.write_csv(Q.probes(spark, d).filter("candidate is not null").groupBy("rank", "candidate", "target_concept_dim").agg(F.min("keywords").alias("keywords")), path)
    return steering.typed_candidates(files.read_csv(spark, path)).select("rank", "candidate", "target_concept_dim", F.size("keywords").alias("n_keywords"))


@query("stored_codes", f"SELECT key, set_idx, round(list_sum(list_transform(z, lambda x: x * x)), 5) AS energy FROM {VQ._CODES} WHERE key = (SELECT min(bank_id) FROM activation_bank)")
def stored_codes(spark, d):
    """Codes in a folder for each bank; one bank read back."""
    path = scratch(spark, "codes")
    files.write_codes(VQ._codes(spark, d), path)
    key = table(spark, d, "activation_bank").agg(F.min("bank_id")).first()[0]
    return files.read_codes(spark, path, key).select("key", "set_idx", F.round(V.dot(F.col("z"), F.col("z")), 5).alias("energy"))


@query("stored_model", f"SELECT key, set_idx, round(list_sum(list_transform(z, lambda x, i: x * i / 48)), 5) AS total FROM {VQ._CODES}")
def stored_model(spark, d):
    """Codes decoded by a matrix that was written and read back."""
    path = scratch(spark, "model")
    files.write_model(spark, path, decoder=np.diag(np.arange(1, VQ.DIM + 1) / VQ.DIM), bias=np.zeros(VQ.DIM))
    decoder = files.read_model(spark, path)["decoder"]
    return codes.multiply(VQ._codes(spark, d), "z", decoder, "recon").select("key", "set_idx", F.round(V.total(F.col("recon")), 5).alias("total"))


@query("exported_rows", "SELECT count(*) AS n, count(DISTINCT id) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM news_row")
def exported_rows(spark, d):
    """A table copied whole."""
    copy = files.export(spark, f"{d}/news_row.parquet", scratch(spark, "export"))
    return copy.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum(F.length("text")).alias("n_chars"))


@query("prompt_files", "SELECT form, i - 1 AS ord, p AS prompt FROM (SELECT form, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (VALUES ('default', [" + ", ".join(f"'{p}'" for p in files.PROMPTS) + "]), ('list', ['One \"a\"', 'Two']), ('object', ['Three', 'Four, five']), ('csv', ['Six, \"seven\"', 'Eight'])) AS t(form, ps))")
def prompt_files(spark, d):
    """Prompts in the four forms in which they are given."""
    path = scratch(spark, "prompts")
    files.put_file(spark, f"{path}/list.json", json.dumps(["One \"a\"", "Two"], indent=1).encode())
    files.put_file(spark, f"{path}/object.json", json.dumps({"prompts": [{"prompt": "Three"}, {"prompt": "Four, five"}]}).encode())
    files.put_file(spark, f"{path}/p.csv", b'id,prompt\n1,"Six, ""seven"""\n2,Eight\n')
    forms = {"default": None, "list": f"{path}/list.json", "object": f"{path}/object.json", "csv": f"{path}/p.csv"}
    out = None
    for form, at in forms.items():
        rows = files.read_prompts(spark, at).select(F.lit(form).alias("form"), "ord", "prompt")
        out = rows if out is None else out.unionByName(rows)
    return out
