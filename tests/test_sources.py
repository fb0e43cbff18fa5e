import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomset.sources import files
from loomset.sources.http import JsonLinesSource
from loomset.streaming import attempts as stream


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, "x\n\"y\"é")], "z string, n int, t string")
    files.write_jsonl(df, str(tmp_path / "out"))
    lines = [line for p in (tmp_path / "out").glob("*.json") for line in p.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines) == sorted(['{"n":1,"z":"b"}', '{"n":2,"t":"x\\n\\"y\\"é","z":"a"}'])
    files.write_jsonl(df, str(tmp_path / "out"), mode="append")
    back = files.read_jsonl(spark, str(tmp_path / "out"), df.schema)
    assert back.count() == 4 and back.distinct().count() == 2
    (tmp_path / "blank.jsonl").write_text('{"z": "q"}\n\n  \n', encoding="utf-8")
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "blank.jsonl"), df.schema).filter("z is not null").collect()] == [("q", None, None)]


def test_shards_that_are_missing_are_empty(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "1"}\n', encoding="utf-8")
    assert files.read_shards(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none.jsonl")], "k string").count() == 1
    assert files.read_shards(spark, [str(tmp_path / "none.jsonl")], "k string").count() == 0


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes('﻿id,text\n1,"a ""q"" \nline, two"\n'.encode())
    rows = files.read_csv(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("1", 'a "q" \nline, two')]
    files.write_csv(spark.createDataFrame([(1, 'a "b"')], "n int, t string"), str(tmp_path / "o"), single=True)
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "o")).collect()] == [("1", 'a "b"')]


def test_json_value(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1), encoding="utf-8")
    assert files.read_json(spark, str(tmp_path / "x.json"), "a int").agg(F.sum("a")).first()[0] == 3


def test_images_are_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.jpg", "b.PNG", "c.txt", "sub/d.webp"):
        (tmp_path / name).write_bytes(b"x")
    assert {r["image_id"] for r in files.scan_images(spark, str(tmp_path)).collect()} == {"a", "b"}
    assert files.scan_images(spark, str(tmp_path), recursive=True, hashed_ids=True).count() == 3
    assert [r["image_id"] for r in files.scan_images(spark, str(tmp_path), limit=1).collect()] == ["a"]


def test_manifest_of_images(spark):
    df = spark.createDataFrame([(0, "i", "/p", None, "a|b", "v"), (1, None, " ", "http://u", None, "")], "ord int, image_id string, image_path string, url string, topic_tags string, extra string")
    rows = files.image_manifest(df, "src", "ord").collect()
    assert rows[0]["topic_tags"] == ["a", "b"] and rows[0]["metadata"] == {"extra": "v"} and rows[1]["image_id"] == "image_00000001" and rows[1]["image_path"] == "http://u" and rows[1]["metadata"] == {}
    with pytest.raises(Exception, match="without path"):
        files.image_manifest(df.withColumn("url", F.lit(None).cast("string")), "src", "ord").collect()


def test_archive_of_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("wiki/a.jsonl", '{"id": "P", "lines": "0\\tx"}\n\n{"id": "Q", "lines": "0\\ty"}\n')
        z.writestr("__MACOSX/a.jsonl", '{"id": "bad"}')
        z.writestr("wiki/._a.jsonl", '{"id": "bad"}')
        z.writestr("wiki/readme.txt", "no")
    assert {r["id"] for r in files.wiki_archive(spark, str(tmp_path)).collect()} == {"P", "Q"}
    pages = spark.createDataFrame([("Q ",)], "page string")
    assert [tuple(r) for r in files.wiki_archive(spark, str(tmp_path), pages).collect()] == [("Q", "0\ty")]


def test_banks_by_folder(spark, tmp_path):
    df = spark.createDataFrame([("fam", "mid_3b", "slug", "layer_09_60pct", 0, [1.0])], "family string, size string, model_slug string, layer_name string, set_idx int, hidden array<double>")
    files.write_banks(df, str(tmp_path / "banks"))
    row = files.discover_banks(spark, str(tmp_path / "banks")).first()
    assert row["bank_id"] == "fam__mid_3b__slug__layer_09_60pct" and row["size"] == "mid" and row["size_label"] == "3b"
    plan = files.discover_banks(spark, str(tmp_path / "banks")).filter("family = 'fam'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan


def test_run_manifest_and_tables(spark, tmp_path):
    facts = spark.createDataFrame([(3,)], "n int")
    files.write_manifest(spark, str(tmp_path / "m"), counts=facts, name="run")
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"counts": {"n": 3}, "name": "run"}
    rows = spark.createDataFrame([("b|c", "x\ny"), ("a", None)], "k string, v string")
    lines = [r["line"] for r in files.markdown_table(rows, {"k": "Key", "v": "Value"}, ["k"]).orderBy("ord").collect()]
    assert lines == ["| Key | Value |", "|---|---|", "| a |  |", "| b\\|c | x y |"]


def test_lines_behind_addresses(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n', encoding="utf-8")
    spark.dataSource.register(JsonLinesSource)
    url = (tmp_path / "x.jsonl").as_uri()
    rows = spark.read.format("json_lines").option("urls", url).option("limit", 2).load().collect()
    assert [(r["ord"], r["value"]) for r in rows] == [(0, '{"a": 1}'), (1, '{"a": 2}')]


def test_stream_of_attempts(spark, tmp_path):
    schema = "slot string, ok boolean, at timestamp, reasons array<string>"
    (tmp_path / "in").mkdir()
    put = lambda name, *rows: (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    put("1.json", {"slot": "a", "ok": True, "at": "2025-01-01 00:00:00"}, {"slot": "b", "ok": False, "at": "2025-01-01 00:00:01", "reasons": ["x=1"]})
    path = str(tmp_path / "out")

    def run():
        first = stream.first_accepted(stream.read_attempts(spark, str(tmp_path / "in"), schema), ["slot"], F.col("ok"), "at")
        q = first.select("slot").writeStream.foreachBatch(stream.append_new(["slot"], path)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in spark.read.schema("slot string").parquet(path).collect())

    assert run() == ["a"]
    put("2.json", {"slot": "a", "ok": True, "at": "2025-01-01 00:00:02"}, {"slot": "b", "ok": True, "at": "2025-01-01 00:00:03"})
    assert run() == ["a", "b"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from loomset import runtime

    def session(master, at=None):
        kept = {"spark.checkpoint.dir": at}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kept.get(k) or d, set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="share"):
        runtime.shared_dir(session("spark://host:7077"))
    assert runtime.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert runtime.shared_dir(session("local[4]")).startswith("file://")


def test_written_tables_are_removed(spark, monkeypatch):
    from loomset import runtime

    monkeypatch.setattr(runtime, "_made", set())
    table, seen = runtime.measured(spark.range(5).toDF("x"), "five", n=F.count(F.lit(1)))
    path = next(iter(runtime._made))
    assert seen == {"n": 5} and table.count() == 5 and files._fs(spark, path)[0].exists(files._fs(spark, path)[1](path))
    runtime.clear(spark)
    assert not files._fs(spark, path)[0].exists(files._fs(spark, path)[1](path)) and not runtime._made


def test_last_deliveries(spark):
    from loomset.runtime import latest

    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "p"), ("c", 1, "q"), (None, 1, "n"), (None, 2, "m")]
    got = latest(spark.createDataFrame(rows, "k string, at int, v string"), "k", "at", "v").collect()
    assert sorted((r["k"] or "", r["v"]) for r in got) == [("", "m"), ("a", "y"), ("b", "z"), ("c", "q")]


def test_prompts_runs_codes_and_models(spark, tmp_path):
    assert [r["prompt"] for r in files.read_prompts(spark).orderBy("ord").collect()] == list(files.PROMPTS)
    files.put_file(spark, str(tmp_path / "p.json"), b'{"prompts": [{"prompt": "a"}, {"prompt": "b"}]}')
    assert [tuple(r) for r in files.read_prompts(spark, str(tmp_path / "p.json")).orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    files.write_csv(spark.createDataFrame([(" x ", 1)], "t string, n int"), str(tmp_path / "run" / "one.csv"))
    got = files.load_run(spark, "r", str(tmp_path / "run"), ("one", "none"))
    assert list(got) == ["one"] and tuple(got["one"].first()) == (" x ", "1", "r")
    codes = spark.createDataFrame([("k", 1, [0.5]), ("l", 1, [1.5])], "key string, set_idx int, z array<double>")
    files.write_codes(codes, str(tmp_path / "codes"))
    one = files.read_codes(spark, str(tmp_path / "codes"), "k")
    assert [r["z"] for r in one.collect()] == [[0.5]] and "PartitionFilters: [isnotnull(key" in one._jdf.queryExecution().executedPlan().toString()
    import numpy as np

    files.write_model(spark, str(tmp_path / "m"), a=np.eye(2), b=np.arange(3.0))
    model = files.read_model(spark, str(tmp_path / "m"))
    assert np.array_equal(model["a"], np.eye(2)) and np.array_equal(model["b"], [[0.0, 1.0, 2.0]])
