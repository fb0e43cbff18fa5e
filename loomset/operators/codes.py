"""Sparse codes of sets of vectors, and what they look like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions import vectors as V


def bank_parts(bank_id: Column) -> dict[str, Column]:
    """``family_layerNN_runNNNN`` in parts; the number of the layer is -1 where there is none."""
    return {
        "family": F.split_part(bank_id, F.lit("_"), F.lit(1)),
        "layer_name": F.split_part(bank_id, F.lit("_"), F.lit(2)),
        "layer": F.coalesce(F.nullif(F.regexp_extract(bank_id, "layer0*([0-9]+)", 1), F.lit("")).cast("int"), F.lit(-1)),
        "run": F.split_part(bank_id, F.lit("_"), F.lit(3)),
    }


def filter_banks(banks: DataFrame, families: list[str] | None = None, without: list[str] | None = None, size: str | None = None, layer_suffix: str | None = None, first: int | None = None) -> DataFrame:
    """Banks by family, size and layer; ``first`` in order of their ids."""
    if families:
        banks = banks.filter(F.col("family").isin(*families))
    if without:
        banks = banks.filter(~F.col("family").isin(*without))
    if size:
        banks = banks.filter((F.col("size") == size) | (F.col("size_label") == size))
    if layer_suffix:
        banks = banks.filter(F.col("layer_name").endswith(layer_suffix))
    return banks if first is None else banks.orderBy("bank_id").limit(first)


def usable(vectors: DataFrame, dim: int, col: str = "hidden") -> DataFrame:
    """Vectors of the full dimension without null or NaN, as doubles."""
    return vectors.filter((F.size(col) == dim) & ~F.exists(col, lambda x: x.isNull() | F.isnan(x))).withColumn(col, V.doubles(F.col(col)))


def mean_vectors(vectors: DataFrame, by: list[str], dim: int, col: str = "hidden") -> DataFrame:
    """The mean vector of each group: ``dim`` averages with map-side combining, in place of collected vectors."""
    parts = vectors.groupBy(*by).agg(F.count("*").alias("n_views"), *[F.avg(F.get(col, F.lit(i))).alias(f"_{i}") for i in range(dim)])
    return parts.select(*by, "n_views", F.array(*[f"_{i}" for i in range(dim)]).alias("mean"))


def encode_sets(vectors: DataFrame, by: list[str], dim: int, topk: int, weights: np.ndarray | None = None, bias: np.ndarray | None = None, pointwise: bool = False, col: str = "hidden", by_size: bool = True) -> DataFrame:
    """``by, z_dense, z`` of each set of vectors. A set model averages the encoded views, normalises and keeps the
    largest; as the encoder is linear, the mean is taken first. A pointwise model normalises each view, and
    averages after. ``weights``: concepts x dim; without, the vectors stand for themselves."""
    if pointwise:
        dense = vectors.withColumn(col, V.layer_norm(_linear(vectors, col, weights, bias)))
        width = dim if weights is None else len(weights)
        got = mean_vectors(dense, by, width, col).select(*by, F.col("mean").alias("z_dense"))
    else:
        means = mean_vectors(vectors, by, dim, col)
        got = means.select(*by, V.layer_norm(_linear(means, "mean", weights, bias)).alias("z_dense"))
    return got.withColumn("z", V.keep_top(F.col("z_dense"), topk, by_size))


def _linear(df: DataFrame, col: str, weights: np.ndarray | None, bias: np.ndarray | None) -> Column:
    if weights is None:
        return F.col(col)
    rows = F.array(*[V.constant(r) for r in weights])
    out = V.apply_matrix(F.col(col), rows)
    return out if bias is None else V.add(out, V.constant(bias))


def multiply(df: DataFrame, col: str, matrix: np.ndarray, out: str) -> DataFrame:
    """``col`` times a large matrix (len(col) x n), by batches in numpy. The matrix is broadcast; its size is that of
    a model layer, not of the data."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(matrix, dtype=np.float64))
    names = df.columns
    at = names.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = x @ m
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<double>")


def diagnostics(codes: DataFrame, key: str = "key") -> DataFrame:
    """Of each bank's codes: how many are active, how often, how evenly, and how long they are."""
    active = lambda z: F.size(F.filter(z, lambda x: x != 0))
    sizes = codes.groupBy(key).agg(F.count("*").alias("n_codes"), F.max(F.size("z")).alias("concept_dim"), F.avg(active(F.col("z"))).alias("mean_active_count"), F.avg(V.norm(F.col("z"))).alias("mean_code_norm"), F.avg(V.norm(F.col("z_dense"))).alias("mean_dense_code_norm"))
    per = codes.select(key, F.posexplode("z").alias("dim", "v")).groupBy(key, "dim").agg(F.avg((F.col("v") != 0).cast("double")).alias("freq"))
    # p ln p with p = f / sum f, in one pass over the frequencies
    f = F.col("freq")
    spread = per.groupBy(key).agg(F.sum(f).alias("s"), F.sum(F.when(f > 0, f * F.log(f)).otherwise(0.0)).alias("flogf"), F.count("*").alias("d"), F.sum((f > 0).cast("bigint")).alias("concepts_ever_active"), F.avg(f).alias("mean_active_frequency"), F.max(f).alias("max_active_frequency"))
    entropy = F.when(F.col("s") <= 0, 0.0).otherwise((F.log("s") - F.col("flogf") / F.col("s")) / F.log(F.col("d").cast("double")))
    return sizes.join(spread, key).select(key, "n_codes", F.col("concept_dim").cast("bigint").alias("concept_dim"), "mean_active_count", "concepts_ever_active", (F.col("concepts_ever_active") / F.col("concept_dim")).alias("frac_concepts_ever_active"), "mean_active_frequency", "max_active_frequency", entropy.alias("support_entropy"), "mean_code_norm", "mean_dense_code_norm")


def concept_signs(codes: DataFrame, key: str = "key") -> DataFrame:
    """``key, dim, sign``: the sign of the mean of a concept's values that are not 0; +1 where there is none."""
    rows = codes.select(key, F.posexplode("z").alias("dim", "v"))
    mean = F.avg(F.when(F.col("v") != 0, F.col("v")))
    return rows.groupBy(key, "dim").agg(F.when(F.coalesce(mean, F.lit(0.0)) >= 0, 1.0).otherwise(-1.0).alias("sign"))


def top_examples(codes: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """``key, dim, rank, <order>, value``: the k largest values in size of every concept. Ranked within partitions
    first, so a concept's column is never gathered whole."""
    rows = codes.select(key, order, F.posexplode("z").alias("dim", "value"))
    w = W.partitionBy(key, "dim").orderBy(F.desc(F.abs("value")), order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "dim", F.col("rank").cast("bigint").alias("rank"), order, "value")


def reconstruction(rows: DataFrame, x: str, recon: str) -> DataFrame:
    """One row: mean squared error, mean energy of the input, and their ratio, NaN for no energy."""
    d = F.zip_with(x, recon, lambda a, b: (a - b) * (a - b))
    got = rows.agg(F.avg(V.mean_of(d)).alias("mse"), F.avg(V.mean_of(F.transform(x, lambda a: a * a))).alias("input_energy"))
    return got.withColumn("normalized_mse", F.when(F.col("input_energy") > 0, F.col("mse") / F.col("input_energy")).otherwise(float("nan")))


def decoder_directions(decoder: np.ndarray, signs: DataFrame, length: float = 1.0, sign_mode: str = "active_mean") -> DataFrame:
    """``key, dim, direction``: the columns of a decoder (dim x concepts) scaled to ``length``, turned by the concept's
    sign (``active_mean``), as they are (``positive``), or the other way (``opposite_active_mean``, ``negative``)."""
    if sign_mode not in ("active_mean", "opposite_active_mean", "positive", "negative"):
        raise ValueError(f"no sign mode {sign_mode!r}")
    norms = np.linalg.norm(decoder, axis=0)
    scaled = (decoder / np.maximum(norms, 1e-12) * length).T
    table = signs.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(scaled)], "dim int, d array<double>")
    turn = F.lit(-1.0 if sign_mode in ("opposite_active_mean", "negative") else 1.0)
    if sign_mode.endswith("active_mean"):
        turn = turn * F.col("sign")
    # as many rows as the model has concepts
    return signs.join(F.broadcast(table), "dim").select("key", "dim", V.scale(F.col("d"), turn).alias("direction"))
