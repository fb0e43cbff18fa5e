"""Reading and writing: JSON lines, CSV, shards, listings of images, archives of pages, tables of vectors."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.functions import text as X

#: Prompts that are used where none are given.
PROMPTS = ("Write one short news headline about a current event:", "Complete this news sentence in one sentence: Officials announced", "Write a neutral one-sentence news brief:", "In one sentence, describe a recent development:")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A whole file as one JSON value, or a list of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """A JSON object a line; blank lines are no rows. With a schema no pass over the data is spent on inferring
    one. Several paths, such as the shards of a run, are read together."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV with a header, all columns strings unless a schema is given; quoted line ends and a byte order mark
    are allowed."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    df = (spark.read.schema(schema) if schema else spark.read).options(**options).csv(path)
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])


def read_shards(spark: SparkSession, paths: list[str], schema: str | T.StructType) -> DataFrame:
    """Shards of a run, those that are missing as empty."""
    there = [p for p in paths for fs, at in [_fs(spark, p)] if fs.exists(at(p))]
    return read_jsonl(spark, there, schema) if there else spark.createDataFrame([], schema)


def read_prompts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``ord, prompt``: the default prompts, a JSON list, a JSON object with ``prompts`` of objects, or the column
    ``prompt`` of a CSV. A small file that people write, in its own order."""
    if path is None:
        return spark.createDataFrame(list(enumerate(PROMPTS)), "ord int, prompt string")
    if path.lower().endswith(".json"):
        value = spark.read.text(path, wholetext=True)
        listed = F.trim("value").startswith("[")
        named = F.transform(F.from_json("value", "prompts array<struct<prompt string>>")["prompts"], lambda x: x["prompt"])
        return value.select(F.posexplode(F.when(listed, F.from_json(F.when(listed, F.col("value")), "array<string>")).otherwise(named)).alias("ord", "prompt"))
    rows = read_csv(spark, path)  # one file, read in its order by one task
    return rows.select(F.monotonically_increasing_id().cast("int").alias("ord"), "prompt")


def load_run(spark: SparkSession, label: str, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The named CSV tables of a run's folder, each with the run's label; tables that are missing are left out."""
    fs, at = _fs(spark, path)
    there = [n for n in names if fs.exists(at(f"{path}/{n}.csv"))]
    return {n: read_csv(spark, f"{path}/{n}.csv").withColumn("run", F.lit(label)) for n in there}


def read_codes(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Codes of ``write_codes``; of one key only its folder is read."""
    rows = spark.read.parquet(path)
    return rows if key is None else rows.filter(F.col("key") == key)


def read_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The matrices of a model. A model is small: it is held whole wherever it is used."""
    parts: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "i").collect():
        parts.setdefault(r["name"], []).append(r["row"])
    return {k: np.array(v) for k, v in parts.items()}


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, on whatever file system the path is of."""
    fs, at = _fs(spark, path)
    out = fs.create(at(path), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def scan_images(spark: SparkSession, path: str, recursive: bool = False, limit: int | None = None, hashed_ids: bool = False) -> DataFrame:
    """``image_id, image_path, n_bytes`` of the images in a folder, by listing only: no image is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = files.select((X.stable_hash(F.col("path")) if hashed_ids else stem).alias("image_id"), F.col("path").alias("image_path"), F.col("length").alias("n_bytes"))
    return rows if limit is None else rows.orderBy("image_path").limit(limit)


def image_manifest(rows: DataFrame, source_dataset: str, order: str) -> DataFrame:
    """Manifest of a CSV of images, numbered by ``order`` from 0: the path or the address, tags, and all other columns as a map. A
    row with neither path nor address is an error."""
    blank = lambda c: F.nullif(X.strip(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    path = F.coalesce(blank("image_path"), blank("url"))
    known = {"image_id", "image_path", "url", "topic_tags", order}
    rest = [c for c in rows.columns if c not in known]
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    return rows.select(
        F.coalesce(blank("image_id"), F.format_string("image_%08d", F.col(order))).alias("image_id"), F.coalesce(path, F.raise_error(F.lit("an image without path or address")).cast("string")).alias("image_path"),
        F.lit(source_dataset).alias("source_dataset"), X.tags(F.col("topic_tags") if "topic_tags" in rows.columns else F.lit("")).alias("topic_tags"), meta.alias("metadata"),
    )


ID = re.compile(r'"id"\s*:\s*("(?:[^"\\\\]|\\\\.)*")')


def wiki_archive(spark: SparkSession, path: str, pages: DataFrame | None = None, most_pages: int = 1_000_000) -> DataFrame:
    """``id, lines`` of the pages in zip archives of JSON lines; members of other kinds are skipped. Each archive is
    read by one task, line by line. Pages asked for, where they are at most ``most_pages``, are sent to the tasks,
    and a line of another page is dropped by its id, before it is parsed; more of them take a join."""
    wanted = None
    if pages is not None:
        asked = pages.select(X.title(F.col("page")).alias("_p")).distinct()
        few = asked.limit(most_pages + 1).toArrow().column(0).to_pylist()
        wanted = spark.sparkContext.broadcast(frozenset(few)) if len(few) <= most_pages else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted else None
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for name in sorted(z.namelist()):
                        base = name.rsplit("/", 1)[-1]
                        if name.startswith("__MACOSX") or base.startswith("._") or not base.endswith(".jsonl"):
                            continue
                        ids, lines = [], []
                        with z.open(name) as f:
                            for raw in io.TextIOWrapper(f, encoding="utf-8"):
                                if not raw.strip():
                                    continue
                                if keep is not None and all(json.loads(m).strip() not in keep for m in ID.findall(raw)):
                                    continue
                                row = json.loads(raw)
                                ids.append(str(row.get("id", "")))
                                lines.append(str(row.get("lines") or ""))
                                if len(ids) >= 1000:
                                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines)], names=["id", "lines"])
                                    ids, lines = [], []
                        if ids:
                            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines)], names=["id", "lines"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content").mapInArrow(run, "id string, lines string")
    return rows if pages is None else rows.join(asked, F.col("_p") == X.title(F.col("id")), "left_semi")


def discover_banks(spark: SparkSession, path: str) -> DataFrame:
    """Vectors laid out as ``family=/size=/model_slug=/layer_name=`` folders, with those as columns: filters on them
    skip folders unread."""
    banks = spark.read.option("basePath", path).parquet(path)
    size, label = F.split_part("size", F.lit("_"), F.lit(1)), F.when(F.contains("size", F.lit("_")), F.regexp_replace("size", "^[^_]*_", "")).otherwise(F.col("size"))
    return banks.withColumns({"bank_id": X.stable_id(F.concat_ws("/", "family", "size", "model_slug", "layer_name")), "size_label": label, "size": size})


# ---- sinks


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", sort_names: bool = True) -> None:
    """A JSON object a line, names in order, null fields left out."""
    (df.select(*sorted(df.columns)) if sort_names else df).write.mode(mode).option("ignoreNullFields", True).json(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; ``single`` for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_banks(vectors: DataFrame, path: str) -> None:
    """Vectors in folders by family, size, model and layer."""
    by = ["family", "size", "model_slug", "layer_name"]
    vectors.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_codes(codes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Codes in a folder for each key."""
    codes.repartition("key", F.pmod(F.xxhash64("set_idx"), F.lit(16))).write.mode(mode).partitionBy("key").parquet(path)


def write_model(spark: SparkSession, path: str, **matrices: np.ndarray) -> None:
    """The matrices of a model, row by row."""
    rows = [(k, i, [float(x) for x in r]) for k, m in matrices.items() for i, r in enumerate(np.atleast_2d(m))]
    spark.createDataFrame(rows, "name string, i int, row array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def export(spark: SparkSession, path: str, to: str, format: str = "parquet") -> DataFrame:
    """A table copied as it is; gives the copy."""
    spark.read.format(format).load(path).write.format(format).mode("overwrite").save(to)
    return spark.read.format(format).load(to)


def write_manifest(spark: SparkSession, path: str, **facts: object) -> DataFrame:
    """A run's facts as one JSON row. Values that are DataFrames of one row are put in as objects."""
    flat = {k: v.first().asDict(True) if isinstance(v, DataFrame) else v for k, v in facts.items()}
    df = spark.createDataFrame([(json.dumps(flat, ensure_ascii=False, sort_keys=True, default=str),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(path)
    return df


def markdown_table(df: DataFrame, columns: dict[str, str], order: list[str]) -> DataFrame:
    """``ord, line`` of a Markdown table: heading, rule, then a line a row in order. ``columns``: heading of each."""
    from loomset.operators.selection import numbered

    cells = [X.escape_cell(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")) for c in columns]
    body = numbered(df, *order, name="_n").select((F.col("_n") + 2).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns.values()) + " |"), (1, "|" + "---|" * len(columns))], "ord bigint, line string")
    return head.unionByName(body)


def review_table(sets: DataFrame) -> DataFrame:
    """The Markdown review of rewrite sets: a line for each rewrite."""
    rows = sets.select("original_id", "original_text", F.array_join(F.coalesce("banned_words", F.array()), ", ").alias("banned"), F.posexplode("rewrites").alias("i", "r")).select("original_id", "original_text", "banned", "i", "r.model_name", "r.length_band", "r.word_count", "r.text")
    return markdown_table(rows, {"original_id": "Original ID", "original_text": "Original sentence", "banned": "Banned words", "model_name": "Model", "length_band": "Length", "word_count": "Word count", "text": "Rewrite"}, ["original_id", "i"])
