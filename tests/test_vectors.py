import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import vectors as V
from loomset.operators import codes, training, transfer

rng = np.random.default_rng(3)


@pytest.fixture(scope="module")
def code_table(spark):
    a = rng.normal(size=(40, 6))
    b = a @ rng.normal(size=(6, 6)) + 0.01 * rng.normal(size=(40, 6))
    rows = [(k, i, i % 5 != 0, m[i].tolist(), m[i].tolist()) for k, m in (("a", a), ("b", b)) for i in range(40)]
    return a, b, spark.createDataFrame(rows, "key string, set_idx bigint, is_train boolean, z array<double>, z_dense array<double>")


def test_vector_functions(spark):
    x, y = rng.normal(size=8), rng.normal(size=8)
    row = spark.createDataFrame([(x.tolist(), y.tolist(), [0.0] * 8)], "x array<double>, y array<double>, o array<double>")
    got = row.select(V.cosine(F.col("x"), F.col("y")), V.layer_norm(F.col("x")), V.keep_top(F.col("x"), 3), V.top_overlap(F.col("x"), F.col("y"), 3), V.cosine(F.col("x"), F.col("o")), V.unit(F.col("o"))).first()
    assert got[0] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert np.allclose(got[1], (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    top = lambda v: set(np.argsort(-np.abs(v))[:3])
    assert np.allclose(got[2], [v if i in top(x) else 0 for i, v in enumerate(x)]) and got[3] == pytest.approx(len(top(x) & top(y)) / 3)
    assert got[4] == 0.0 and got[5] == [0.0] * 8


def test_pooling(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [0, 0, 0])], "s array<array<double>>, m array<int>, o array<int>")
    got = row.select(V.last_position(F.col("s"), F.col("m")), V.masked_mean(F.col("s"), F.col("m")), V.last_position(F.col("s"), F.col("o"))).first()
    assert got[0] == [3.0, 4.0] and got[1] == [2.0, 3.0] and got[2] == [1.0, 2.0]


def test_gaussian_numbers(spark):
    v = spark.range(400).select(F.explode(V.gaussian_vector(F.col("id").cast("string"), 8)).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(v[0]) < 0.08 and abs(v[1] - 1) < 0.06


def test_encoders_against_numpy(spark):
    x, w = rng.normal(size=(5, 3, 6)), rng.normal(size=(4, 6))
    rows = [(i, x[i, j].tolist()) for i in range(5) for j in range(3)]
    df = spark.createDataFrame(rows, "s int, hidden array<double>")
    norm = lambda u: (u - u.mean(-1, keepdims=True)) / np.sqrt(u.var(-1, keepdims=True) + 1e-5)
    got = {r["s"]: r["z_dense"] for r in codes.encode_sets(df, ["s"], 6, 2, w, np.ones(4)).collect()}
    assert np.allclose([got[i] for i in range(5)], norm(x.mean(1) @ w.T + 1))
    got = {r["s"]: r["z_dense"] for r in codes.encode_sets(df, ["s"], 6, 2, w, np.ones(4), pointwise=True).collect()}
    assert np.allclose([got[i] for i in range(5)], norm(x @ w.T + 1).mean(1))
    out = codes.multiply(df, "hidden", w.T, "y").collect()
    assert np.allclose([r["y"] for r in out], np.array([r["hidden"] for r in out]) @ w.T)


def test_bridges_against_numpy(spark, code_table):
    a, b, df = code_table
    train, test = [i for i in range(40) if i % 5], [i for i in range(40) if i % 5 == 0]
    got = {(r["source_key"], r["target_key"], r["bridge"]): r for r in transfer.evaluate(df, topk=2, alphas=(0.0, 2.0)).filter("steering_alpha = 0").collect()}
    assert len(got) == 6
    xx, xy = a[train].T @ a[train], a[train].T @ b[train]
    for m in transfer.BRIDGES:
        w = {"identity": np.eye(6), "ridge": np.linalg.solve(xx + np.eye(6), xy)}.get(m)
        if w is None:
            u, _, vt = np.linalg.svd(xy)
            w = u @ vt
        mapped = a[test] @ w
        row = got["a", "b", m]
        assert row["transfer_mse"] == pytest.approx(((mapped - b[test]) ** 2).mean()) and row["n_test"] == 8
        cos = (mapped * b[test]).sum(1) / np.linalg.norm(mapped, axis=1) / np.linalg.norm(b[test], axis=1)
        assert row["cosine"] == pytest.approx(cos.mean())
    assert got["a", "b", "ridge"]["topk_overlap"] > got["a", "b", "ridge"]["shuffled_topk_overlap"]


def test_inspection(spark, code_table):
    a, b, df = code_table
    rows = {r["target_concept_dim"]: r for r in transfer.inspect(df, "a", "b", example_k=3).collect()}
    train = [i for i in range(40) if i % 5]
    w = np.linalg.solve(a[train].T @ a[train] + np.eye(6), a[train].T @ b[train])
    for d, r in rows.items():
        assert r["source_concept_dim"] == np.argmax(np.abs(w[:, d])) and r["bridge_weight"] == pytest.approx(w[r["source_concept_dim"], d]) and r["alignment"] > 0.9
    ranked = transfer.rank_concepts(transfer.inspect(df, "a", "b", example_k=3), 2).collect()
    assert [r["concept_rank_in_pair"] for r in sorted(ranked, key=lambda r: -r["inspection_score"])] == [1, 2]


def test_inspection_of_candidate_pairs(spark, code_table):
    _, _, df = code_table
    third = df.filter("key = 'a'").withColumn("key", F.lit("c"))
    rows = df.unionByName(third)
    results = spark.createDataFrame([(s, t, b, x, m) for s, t, m in (("a", "b", 0.1), ("b", "c", 0.5), ("c", "a", 0.9), ("c", "b", 0.5)) for b, x in (("ridge", 0.0), ("ridge", 1.0), ("identity", 0.0))], "source_key string, target_key string, bridge string, steering_alpha double, real_minus_shuffled_topk double")
    chosen = transfer.candidate_pairs(results, "ridge", 3)
    assert [tuple(r) for r in chosen.collect()] == [("c", "a"), ("b", "c"), ("c", "b")]
    got = transfer.inspect_pairs(rows, chosen, example_k=3).collect()
    assert {(r["source_key"], r["target_key"]) for r in got} == {("c", "a"), ("b", "c"), ("c", "b")} and len(got) == 18
    alone = {r["target_concept_dim"]: r["inspection_score"] for r in transfer.inspect(rows, "c", "b", example_k=3).collect()}
    assert {r["target_concept_dim"]: r["inspection_score"] for r in got if r["source_key"] == "c" and r["target_key"] == "b"} == pytest.approx(alone)


def test_diagnostics(spark):
    df = spark.createDataFrame([("k", [1.0, 0.0, 0.0], [1.0, 1.0, 0.0]), ("k", [0.0, -2.0, 0.0], [0.0, 2.0, 0.0])], "key string, z array<double>, z_dense array<double>")
    r = codes.diagnostics(df).first()
    assert r["n_codes"] == 2 and r["concepts_ever_active"] == 2 and r["mean_active_count"] == 1.0 and r["support_entropy"] == pytest.approx(np.log(2) / np.log(3)) and r["mean_code_norm"] == 1.5
    zero = codes.diagnostics(df.withColumn("z", F.transform("z", lambda x: x * 0))).first()
    assert zero["support_entropy"] == 0.0
    signs = {r["dim"]: r["sign"] for r in codes.concept_signs(df).collect()}
    assert signs == {0: 1.0, 1: -1.0, 2: 1.0}
    none = codes.reconstruction(df.withColumn("x", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), "x", "z").first()
    assert none["input_energy"] == 0.0 and np.isnan(none["normalized_mse"])


def test_losses_and_training(spark):
    x = rng.normal(size=(64, 4, 6))
    m = training.SetCoder(6, 12, 4)
    before = m.losses(x)
    assert set(before) == {*training.LOSS_WEIGHTS, "total"}
    negative = x[rng.permutation(64)]
    first = m.losses(x, negative)
    for _ in range(150):
        m.step(x, 5e-3, negative)
    last = m.losses(x, negative)
    assert last["total"] < 0.8 * first["total"] and last["shared_recon"] + 0.05 * last["full_recon"] < 0.98 * (before["shared_recon"] + 0.05 * before["full_recon"])
    a = np.eye(3)
    assert training.info_nce(a, a) < training.info_nce(a, a[::-1]) and training.margin(a, a, None) == 0.0 and training.margin(a, a, a) == pytest.approx(0.2)
    assert training.decorrelation(np.ones((1, 3))) == 0.0 and training.halves(x[:, :1])[1].shape == (64, 1, 6) and training.halves(x[:, :3])[0].shape == (64, 1, 6)
    rows = [("b", i, j, x[i, j].tolist()) for i in range(64) for j in range(4)]
    rows += [("b", 64, 0, x[0, 0].tolist())]  # a set of another size takes part
    got = training.train_banks(spark.createDataFrame(rows, "bank_id string, set_idx bigint, view_idx bigint, hidden array<double>"), 6, 8, 3, epochs=4, rate=5e-3).orderBy("epoch").collect()
    total = [r for r in got if r["part"] == "total"]
    assert [r["epoch"] for r in total] == [1, 2, 3, 4] and total[-1]["train_loss"] < total[0]["train_loss"] and (total[0]["n_train"], total[0]["n_test"]) == (52, 13)
    assert {r["part"] for r in got} == {*training.LOSS_WEIGHTS, "total"} and all(r["test_loss"] is not None for r in got)


@pytest.mark.parametrize("rank, with_negatives, views", [(None, True, 4), (3, True, 3), (None, False, 1)])
def test_gradients_against_differences(rank, with_negatives, views):
    r = np.random.default_rng(5)
    m, x = training.SetCoder(6, 10, 4, residual_scale=0.3, rank=rank, seed=1), r.normal(size=(7, views, 6))
    negative = x[r.permutation(7)] if with_negatives else None
    grads = m.gradients(x, negative)
    for k, g in grads.items():
        flat = m.p[k].reshape(-1)
        for i in r.choice(len(flat), min(6, len(flat)), replace=False):
            at, h = flat[i], 1e-6
            flat[i] = at + h
            up = m.losses(x, negative)["total"]
            flat[i] = at - h
            down = m.losses(x, negative)["total"]
            flat[i] = at
            assert (up - down) / (2 * h) == pytest.approx(g.reshape(-1)[i], abs=1e-6)


def test_losses_of_all_set_sizes(spark):
    x = rng.normal(size=(12, 8, 6))
    has = {10: 3, 11: 1}
    rows = [("b", i, j, x[i, j].tolist()) for i in range(12) for j in range(has.get(i, 8))]
    got = training.bank_losses(spark.createDataFrame(rows, "bank_id string, set_idx bigint, view_idx bigint, hidden array<double>"), 6, 12, 4).collect()
    n = {(r["set_size"], r["n_views"]): r["n_sets"] for r in got}
    assert n == {(2, 2): 11, (2, 1): 1, (4, 4): 10, (4, 3): 1, (4, 1): 1, (8, 8): 10, (8, 3): 1, (8, 1): 1}
    want = training.SetCoder(6, 12, 4).losses(x[:10])
    assert {r["part"]: r["loss"] for r in got if r["n_views"] == 8} == pytest.approx(want)


def test_curved_bridge(spark):
    from loomset.operators import transfer

    r = np.random.default_rng(3)
    x = r.normal(size=(40, 3))
    y = np.stack((np.abs(x[:, 0]), x[:, 1] * x[:, 2]), axis=1)
    m = transfer.CurvedBridge(3, 2, 16)
    for k, g in m.gradients(x, y).items():
        flat, at = m.p[k].reshape(-1), 0
        old, h = flat[at], 1e-4
        flat[at] = old + h
        up = ((m(x) - y) ** 2).mean()
        flat[at] = old - h
        down = ((m(x) - y) ** 2).mean()
        flat[at] = old
        assert (up - down) / (2 * h) == pytest.approx(g.reshape(-1)[at], abs=1e-4)
    rows = [("a", "b", i, i % 5 > 0, x[i].tolist(), y[i].tolist()) for i in range(40)]
    pairs = spark.createDataFrame(rows, "source_key string, target_key string, set_idx int, is_train boolean, x array<double>, y array<double>")
    models = transfer.fit_curved(pairs, epochs=800)
    got = transfer.map_curved(pairs, models).collect()
    line = np.linalg.lstsq(np.c_[x, np.ones(40)], y, rcond=None)[0]
    error = np.mean([(np.array(r["mapped"]) - r["y"]) ** 2 for r in got if r["is_train"]])
    assert len(got) == 40 and error < 0.7 * ((np.c_[x, np.ones(40)] @ line - y) ** 2).mean()
