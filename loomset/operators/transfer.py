"""Every bank of codes against every other: linear bridges fitted on training sets, judged on the others."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions import vectors as V
from loomset.operators import sampling
from loomset.runtime import materialize

BRIDGES = ("identity", "procrustes", "ridge")
PAIR = ["source_key", "target_key"]
#: Rows of a pair of banks that one task maps.
BUCKETS = 16


def code_pairs(codes: DataFrame, same: list[str] = (), include_self: bool = False) -> DataFrame:
    """Codes of one set under every ordered pair of banks: ``source_key, target_key, set_idx, is_train, x, y``. An
    equi-join on the set (and on ``same``), never a product of tables."""
    on = ["set_idx", "is_train", *same]
    a = codes.select(*on, F.col("key").alias("source_key"), F.col("z").alias("x"))
    b = codes.select(*on, F.col("key").alias("target_key"), F.col("z").alias("y"))
    pairs = a.join(b, on)
    return pairs if include_self else pairs.filter("source_key <> target_key")


def grams(pairs: DataFrame) -> DataFrame:
    """``source_key, target_key, n, xx, xy``: X'X and X'Y of each pair, row by row. Tasks add up their own rows in
    numpy, and only their sums are shuffled, one number a row."""
    names = [*PAIR, "n", "what", "i", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list] = {}
        for batch in batches:
            s, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for key in dict.fromkeys(zip(s, t)):
                k = (s == key[0]) & (t == key[1])
                got = [int(k.sum()), x[k].T @ x[k], x[k].T @ y[k]]
                old = sums.get(key)
                sums[key] = got if old is None else [a + b for a, b in zip(old, got)]
                if len(sums) > 256:
                    yield from give(sums)
                    sums = {}
        yield from give(sums)

    def give(sums: dict) -> Iterator[pa.RecordBatch]:
        for (s, t), (n, xx, xy) in sums.items():
            v = np.concatenate((xx.ravel(), xy.ravel()))
            what = np.concatenate((np.zeros(xx.size, dtype=np.int32), np.ones(xy.size, dtype=np.int32)))
            i = np.concatenate((np.arange(xx.size), np.arange(xy.size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(v)), pa.array([t] * len(v)), pa.array(np.full(len(v), n, dtype=np.int64)), pa.array(what), pa.array(i), pa.array(v)], names=names)

    partial = pairs.select(*PAIR, "x", "y").mapInArrow(run, "source_key string, target_key string, n bigint, what int, i int, v double")
    cells = partial.groupBy(*PAIR, "what", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"])  # as many as the model has weights
    both = cells.groupBy(*PAIR, "what").agg(F.max("n").alias("n"), listed.alias("m"))
    return both.groupBy(*PAIR).agg(F.max("n").alias("n"), F.max(F.when(F.col("what") == 0, F.col("m"))).alias("xx"), F.max(F.when(F.col("what") == 1, F.col("m"))).alias("xy"))


def solve_bridge(xx: np.ndarray, xy: np.ndarray, method: str, ridge_alpha: float = 1.0) -> np.ndarray:
    """The matrix that maps source codes to target codes."""
    if method == "identity":
        return np.eye(*xy.shape)
    if method == "procrustes":
        u, _, vt = np.linalg.svd(xy, full_matrices=False)
        return u @ vt
    if method == "ridge":
        return np.linalg.solve(xx + ridge_alpha * np.eye(len(xx)), xy)
    raise ValueError(f"no bridge {method!r}")


def fit_bridges(gram: DataFrame, methods: tuple[str, ...] = BRIDGES, ridge_alpha: float = 1.0, least_rows: int = 2) -> DataFrame:
    """``source_key, target_key, bridge, n_train, dim, matrix`` (row by row) for each pair and method."""
    names = [*PAIR, "bridge", "n_train", "dim", "matrix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = int(round(len(row["xx"]) ** 0.5))
                xx, xy = np.array(row["xx"]).reshape(d, d), np.array(row["xy"]).reshape(d, -1)
                for m in methods:
                    if m == "identity" and xy.shape[0] != xy.shape[1]:
                        continue
                    w = solve_bridge(xx, xy, m, ridge_alpha)
                    yield pa.RecordBatch.from_arrays([pa.array([row["source_key"]]), pa.array([row["target_key"]]), pa.array([m]), pa.array([row["n"]], pa.int64()), pa.array([d], pa.int32()), pa.array([w.ravel().tolist()], pa.list_(pa.float64()))], names=names)

    return gram.filter(F.col("n") >= least_rows).select(*PAIR, "n", "xx", "xy").mapInArrow(run, "source_key string, target_key string, bridge string, n_train bigint, dim int, matrix array<double>")


def map_codes(pairs: DataFrame, bridges: DataFrame) -> DataFrame:
    """``pairs`` with ``bridge`` and ``mapped``, the source code under the bridge. Rows and matrices meet by pair
    and bucket of sets: a task holds a pair's matrices once and streams its rows through them."""
    bucket = F.pmod(F.xxhash64("set_idx"), F.lit(BUCKETS)).cast("int")
    keep = [c for c in pairs.columns if c not in PAIR]
    schema = pairs.select(*PAIR, *keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", bridge string, mapped array<double>"
    names = [*schema.names, "bridge", "mapped"]
    x_at = schema.names.index("x")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, mats: pa.Table) -> pa.Table:
        out = []
        for b in mats.to_pylist():
            w = np.array(b["matrix"]).reshape(b["dim"], -1)
            flat = rows.column(x_at).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            y = flat.reshape(rows.num_rows, b["dim"]) @ w
            mapped = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, max(1, w.shape[1]), dtype=np.int32)), pa.array(y.ravel()))
            out.append(pa.Table.from_arrays([*rows.select(schema.names).columns, pa.array([b["bridge"]] * rows.num_rows, pa.string()), mapped], names=names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, [*rows.select(schema.names).schema.types, pa.string(), pa.list_(pa.float64())])})

    left = pairs.select(*PAIR, *keep).withColumn("_b", bucket)
    right = bridges.select(*PAIR, "bridge", "dim", "matrix").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return left.groupBy(*PAIR, "_b").cogroup(right.groupBy(*PAIR, "_b")).applyInArrow(run, fields)


def _erf(x: np.ndarray) -> np.ndarray:
    """To seven decimals, by a rational approximation."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * (1 - tail)


class CurvedBridge:
    """A bridge with one hidden layer of smooth gates between codes of two banks."""

    def __init__(self, d_in: int, d_out: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda a, *shape: rng.uniform(-(a**-0.5), a**-0.5, shape)
        self.p = {"w1": draw(d_in, d_in, hidden), "b1": draw(d_in, hidden), "w2": draw(hidden, hidden, d_out), "b2": draw(hidden, d_out)}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        u = x @ self.p["w1"] + self.p["b1"]
        return (u * 0.5 * (1 + _erf(u / 2**0.5))) @ self.p["w2"] + self.p["b2"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean squared error."""
        u = x @ self.p["w1"] + self.p["b1"]
        gate = 0.5 * (1 + _erf(u / 2**0.5))
        g = 2 * ((u * gate) @ self.p["w2"] + self.p["b2"] - y) / y.size
        g_u = (g @ self.p["w2"].T) * (gate + u * np.exp(-u * u / 2) / (2 * np.pi) ** 0.5)
        return {"w1": x.T @ g_u, "b1": g_u.sum(axis=0), "w2": (u * gate).T @ g, "b2": g.sum(axis=0)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 1e-3, decay: float = 1e-4) -> CurvedBridge:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for n in range(1, epochs + 1):
            for k, g in self.gradients(x, y).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.p[k] *= 1 - rate * decay
                self.p[k] -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
        return self


def fit_curved(pairs: DataFrame, epochs: int = 100, sample: int = 5_000, seed: int = 0) -> DataFrame:
    """``source_key, target_key, n_train, model`` of ``pairs``: a curved bridge for each pair of banks, fitted by one task on
    at most ``sample`` of its training sets, the first by hash."""
    w = W.partitionBy(*PAIR).orderBy(F.xxhash64("set_idx", F.lit(seed)), "set_idx")
    few = pairs.filter("is_train").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample).select(*PAIR, "_r", "x", "y")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_r")
        x, y = (np.array(rows.column(c).to_pylist()) for c in ("x", "y"))
        made = CurvedBridge(x.shape[1], y.shape[1], max(32, min(512, 2 * x.shape[1])), seed).fit(x, y, epochs)
        return pa.table({"source_key": [key[0].as_py()], "target_key": [key[1].as_py()], "n_train": pa.array([len(x)], pa.int64()), "model": pa.array([pickle.dumps(made.p)], pa.binary())})

    return few.groupBy(*PAIR).applyInArrow(run, "source_key string, target_key string, n_train bigint, model binary")


def map_curved(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """``pairs`` with ``bridge`` and ``mapped``, the source code under its curved bridge. A pair's model meets its rows
    by bucket of sets, so a pair takes as many tasks as buckets."""
    left = pairs.withColumn("_b", F.pmod(F.xxhash64("set_idx"), F.lit(BUCKETS)).cast("int"))
    right = models.select(*PAIR, "model").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["_b"])
        if rows.num_rows == 0 or found.num_rows == 0:
            rows, y = rows.slice(0, 0), np.zeros((0, 0))
        else:
            bridge = CurvedBridge(1, 1, 1)
            bridge.p = pickle.loads(found.column("model")[0].as_py())
            y = bridge(np.array(rows.column("x").to_pylist()))
        return rows.append_column("bridge", pa.array(["curved"] * rows.num_rows, pa.string())).append_column("mapped", pa.array(y.tolist(), pa.list_(pa.float64())))

    return left.groupBy(*PAIR, "_b").cogroup(right.groupBy(*PAIR, "_b")).applyInArrow(run, f"{fields}, bridge string, mapped array<double>")


def with_shuffled(pairs: DataFrame) -> DataFrame:
    """Pairs with ``shuffled_y``: the target code of another set of the same pair and part, a control."""
    return sampling.shifted(pairs, [*PAIR, "is_train"], F.col("set_idx").cast("string"), ["y"])


def evaluate(codes: DataFrame, methods: tuple[str, ...] = BRIDGES, topk: int = 8, alphas: tuple[float, ...] = (0.0,), ridge_alpha: float = 1.0, same: list[str] = ()) -> DataFrame:
    """A row for each pair, bridge and strength of steering: error, overlap of the largest places on training and
    test sets, the same against a shuffled control, cosine, and how near steering along the mapped code comes."""
    pairs = materialize(code_pairs(codes, same), "pairs")
    bridges = materialize(fit_bridges(grams(pairs.filter("is_train")), methods, ridge_alpha), "bridges")
    mapped = map_codes(with_shuffled(pairs.select(*PAIR, "set_idx", "is_train", "x", "y")), bridges)
    m, y, s = F.col("mapped"), F.col("y"), F.col("shuffled_y")
    rows = mapped.select(*PAIR, "bridge", "set_idx", "is_train", "mapped", "y", V.mean_of(F.zip_with(m, y, lambda a, b: (a - b) * (a - b))).alias("mse"), V.top_overlap(m, y, topk).alias("overlap"), V.top_overlap(m, s, topk).alias("shuffled"), V.cosine(m, y).alias("cos"))
    rows = materialize(rows, "mapped")
    test = F.when(~F.col("is_train"), F.lit(1))
    main = rows.groupBy(*PAIR, "bridge").agg(
        F.avg(test * F.col("mse")).alias("transfer_mse"), F.avg(F.when(F.col("is_train"), F.col("overlap"))).alias("train_topk_overlap"), F.avg(test * F.col("overlap")).alias("topk_overlap"),
        F.avg(test * F.col("shuffled")).alias("shuffled_topk_overlap"), F.avg(test * F.col("cos")).alias("cosine"), F.count(test).alias("n_test"),
    ).filter("n_test > 0")
    steered = steering(rows.filter(~F.col("is_train")), alphas)
    got = main.join(steered, [*PAIR, "bridge"])
    return got.withColumns({"train_test_topk_gap": F.col("train_topk_overlap") - F.col("topk_overlap"), "real_minus_shuffled_topk": F.col("topk_overlap") - F.col("shuffled_topk_overlap"), "steering_gain_vs_random": F.col("structured_similarity") - F.col("random_similarity")})


def steering(rows: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Targets moved along the mapped code, and along that of another set, by ``alpha``: how near each comes to it."""
    unit = rows.select(*PAIR, "bridge", "set_idx", V.unit(F.col("y")).alias("t"), V.unit(F.col("mapped")).alias("d"))
    both = sampling.shifted(unit, [*PAIR, "bridge"], F.col("set_idx").cast("string"), ["d"], seed=1)
    each = both.withColumn("steering_alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    moved = lambda d: V.cosine(V.add(F.col("t"), V.scale(d, F.col("steering_alpha"))), F.col("d"))
    scored = each.select(*PAIR, "bridge", "steering_alpha", moved(F.col("d")).alias("a"), moved(F.col("shuffled_d")).alias("b"))
    return scored.groupBy(*PAIR, "bridge", "steering_alpha").agg(F.avg("a").alias("structured_similarity"), F.avg("b").alias("random_similarity"))


MEASURES = ("topk_overlap", "shuffled_topk_overlap", "real_minus_shuffled_topk", "train_test_topk_gap", "transfer_mse", "cosine")


def relation(source: Column, target: Column) -> Column:
    return F.when(source == target, "within_family").otherwise("cross_family")


def summaries(results: DataFrame, groupings: dict[str, list[str]], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Several groupings of one table in one scan: ``summary``, the grouping columns (null where not grouped by), n
    and the means; a mean of no value is NaN."""
    names = list(dict.fromkeys(c for g in groupings.values() for c in g))
    sets = [[F.col(c) for c in g] for g in groupings.values()]
    got = results.groupingSets(sets, *[F.col(c) for c in names]).agg(F.grouping_id(*names).alias("_g"), F.count("*").alias("n"), *[F.coalesce(F.avg(m), F.lit(float("nan"))).alias(m) for m in measures])
    label = F.lit(None).cast("string")
    for name, g in groupings.items():
        bits = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in g)
        label = F.when(F.col("_g") == bits, name).otherwise(label)
    return got.select(label.alias("summary"), *names, "n", *measures)


def pivoted(results: DataFrame, rows: str, columns: str, values: list[str], measure: str) -> DataFrame:
    """A mean for each row and each of ``values``, NaN where there is none."""
    got = results.groupBy(rows).pivot(columns, values).agg(F.avg(measure))
    return got.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(float("nan"))).alias(v) for v in values])


def last_epoch(history: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each key's measures after its last epoch; missing ones are NaN."""
    got = history.groupBy(key).agg(F.max("epoch").alias("epoch"), F.max_by(F.struct(*fields), "epoch").alias("_m"))
    return got.select(key, "epoch", *[F.coalesce(F.col(f"_m.{f}"), F.lit(float("nan"))).alias(f) for f in fields])


def candidate_pairs(results: DataFrame, bridge: str = "ridge", top: int = 8, **equal) -> DataFrame:
    """``source_key, target_key`` of the pairs to inspect: of the results without steering under ``bridge`` (and with
    the values of ``equal``), those that overlap most beyond their shuffled control."""
    rows = results.filter((F.col("bridge") == bridge) & (F.col("steering_alpha") == 0))
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc_nulls_last("real_minus_shuffled_topk"), *PAIR).limit(top).select(*PAIR)


def inspect(codes: DataFrame, source: str, target: str, method: str = "ridge", example_k: int = 10, ridge_alpha: float = 1.0) -> DataFrame:
    """``inspect_pairs`` of one pair of banks."""
    one = codes.sparkSession.createDataFrame([(source, target)], "source_key string, target_key string")
    return inspect_pairs(codes.filter(F.col("key").isin(source, target)), one, method, example_k, ridge_alpha)


def inspect_pairs(codes: DataFrame, chosen: DataFrame, method: str = "ridge", example_k: int = 10, ridge_alpha: float = 1.0) -> DataFrame:
    """Of each chosen pair of banks, each target concept: how well the mapped codes line up with it, how many of the same
    examples they put first, both less a shuffled control, and the source concept with the greatest weight."""
    pairs = code_pairs(codes).join(F.broadcast(chosen), PAIR)
    pairs = materialize(pairs.select(*PAIR, "set_idx", "is_train", "x", "y"), "pairs")
    bridges = materialize(fit_bridges(grams(pairs.filter("is_train")), (method,), ridge_alpha), "bridges")
    mapped = materialize(map_codes(with_shuffled(pairs.filter(~F.col("is_train"))), bridges), "mapped")
    cells = mapped.select(*PAIR, "set_idx", F.posexplode(F.arrays_zip(F.col("mapped").alias("m"), F.col("y").alias("y"), F.col("shuffled_y").alias("s"))).alias("dim", "c")).select(*PAIR, "set_idx", "dim", "c.m", "c.y", "c.s")
    first = None  # the first examples of each concept by each value: cut within partitions, no column is gathered whole
    for c in ("m", "y", "s"):
        w = W.partitionBy(*PAIR, "dim").orderBy(F.desc("v"), "set_idx")
        top = cells.select(*PAIR, "dim", "set_idx", F.abs(F.col(c)).alias("v"), F.lit(c).alias("by")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= example_k).select(*PAIR, "dim", "set_idx", "by")
        first = top if first is None else first.unionByName(top)
    has = lambda c: F.max((F.col("by") == c).cast("int")).alias(c)
    shared = first.groupBy(*PAIR, "dim", "set_idx").agg(has("m"), has("y"), has("s")).groupBy(*PAIR, "dim").agg(F.sum(F.col("m") * F.col("y")).alias("my"), F.sum(F.col("m") * F.col("s")).alias("ms"))
    cosine = lambda a, b: F.when((F.sum(F.abs(a)) == 0) | (F.sum(F.abs(b)) == 0), 0.0).otherwise(F.abs(F.sum(F.col(a) * F.col(b))) / F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b))))
    sums = cells.groupBy(*PAIR, "dim").agg(cosine("m", "y").alias("alignment"), cosine("m", "s").alias("shuffled_alignment"), F.avg((F.col("y") != 0).cast("double")).alias("target_active_freq"), F.least(F.lit(example_k), F.count("*")).alias("most"))
    scored = sums.join(shared, [*PAIR, "dim"]).withColumns({"top_example_overlap": F.col("my") / F.col("most"), "shuffled_top_example_overlap": F.col("ms") / F.col("most")}).drop("my", "ms", "most")
    weights = bridges.select(*PAIR, (F.size("matrix") / F.col("dim")).cast("int").alias("wide"), F.posexplode("matrix").alias("at", "w"))
    width = F.col("wide")
    cell = weights.select(*PAIR, (F.col("at") % width).alias("dim"), F.floor(F.col("at") / width).cast("int").alias("source_concept_dim"), "w")
    best = cell.groupBy(*PAIR, "dim").agg(F.max_by(F.struct("source_concept_dim", F.col("w").alias("bridge_weight")), F.struct(F.abs("w"), -F.col("source_concept_dim"))).alias("b")).select(*PAIR, "dim", "b.*")
    freq = pairs.filter(~F.col("is_train")).select(*PAIR, F.posexplode("x").alias("source_concept_dim", "v")).groupBy(*PAIR, "source_concept_dim").agg(F.avg((F.col("v") != 0).cast("double")).alias("source_active_freq"))
    got = scored.join(best, [*PAIR, "dim"]).join(freq, [*PAIR, "source_concept_dim"])
    score = F.col("alignment") - F.col("shuffled_alignment") + F.col("top_example_overlap") - F.col("shuffled_top_example_overlap")
    return got.withColumns({"bridge": F.lit(method), "inspection_score": score}).withColumnRenamed("dim", "target_concept_dim")


def rank_concepts(concepts: DataFrame, top: int) -> DataFrame:
    """The best concepts of each pair with their rank from 1."""
    w = W.partitionBy(*PAIR).orderBy(F.desc("inspection_score"), "target_concept_dim")
    return concepts.withColumn("concept_rank_in_pair", F.row_number().over(w)).filter(F.col("concept_rank_in_pair") <= top)


def collect_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Tables of several runs as one, with the label of each run."""
    out = None
    for label, df in runs.items():
        tagged = df.withColumn("run", F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out
