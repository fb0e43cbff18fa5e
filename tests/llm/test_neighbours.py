"""Problem 7 against brute force."""

import numpy as np
import pytest

from loomset.llm.neighbours import Model, nearest_lists, neighbour_pairs

SCHEMA = "vec_id bigint, bank_id string, hidden array<float>, cell int, rank int"


def exact(rows, k, dim):
    out = {}
    for bank in {b for _, b, *_ in rows}:
        v = {i: np.array(h[:dim], dtype=np.float32).astype(np.float64) for i, b, h, *_ in rows if b == bank and i is not None and h is not None and len(h) >= dim and all(x is not None and np.isfinite(x) for x in h[:dim]) and any(h[:dim])}
        ids = sorted(v)
        if not ids or bank is None:
            continue
        m = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
        s = np.round(m @ m.T, 9)
        for a, i in enumerate(ids):
            order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)
            out[bank, i] = [j for _, j in order[:k]]
    return out


def test_lists_with_dirt(spark):
    rng = np.random.default_rng(0)
    dim = 6
    rows = [(i, "a", rng.normal(size=dim).tolist(), 1, 2) for i in range(60)]
    same = rng.normal(size=dim).tolist()
    rows += [(100 + i, "a", same, 1, 2) for i in range(40)]  # many equal vectors
    rows += [(200, "a", [2 * x for x in same], 1, 2), (201, "a", [0.0] * dim, 1, 2), (202, "a", [float("nan")] + [1.0] * (dim - 1), 1, 2), (203, "a", None, 1, 2), (204, "a", [1.0], 1, 2), (205, "a", [None] + [1.0] * (dim - 1), 1, 2), (206, None, same, 1, 2), (None, "a", same, 1, 2)]
    rows += [(300 + i, "small", rng.normal(size=dim).tolist(), 1, 2) for i in range(4)] + [(400, "one", same, 1, 2)]
    got = {}
    for r in nearest_lists(spark.createDataFrame(rows, SCHEMA), 10, dim=dim, cell=10_000).collect():
        got.setdefault((r["bank"], r["id"]), {})[r["rank"]] = r["neighbour"]
    want = {k: v for k, v in exact(rows, 10, dim).items() if v}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    pairs = {tuple(r) for r in neighbour_pairs(spark.createDataFrame(rows, SCHEMA), 10, dim=dim, cell=10_000).collect()}
    assert pairs == {(min(i, j), max(i, j)) for (_, i), v in want.items() for j in v}


def test_recall_over_many_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16)) * 2
    rows = [(i, "a", (centres[rng.integers(60)] + rng.normal(size=16) * 0.7).tolist(), 0, 0) for i in range(2500)]
    want = exact(rows, 10, 16)
    got = {}
    for r in nearest_lists(spark.createDataFrame(rows, SCHEMA), 10, dim=16, cell=40, probes=12).collect():
        got.setdefault((r["bank"], r["id"]), set()).add(r["neighbour"])
    assert np.mean([len(got[k] & set(v)) / 10 for k, v in want.items()]) > 0.95


def test_small_banks_beside_a_large_one(spark):
    rng = np.random.default_rng(4)
    sizes = {"large": 12_000, "some": 300, "tiny": 10, "two": 2}
    rows = [(1000 * i + at, bank, rng.normal(size=48).tolist(), 0, 0) for at, (bank, n) in enumerate(sizes.items()) for i in range(n)]
    got = {}
    for r in nearest_lists(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["bank"], r["id"]), {})[r["rank"]] = r["neighbour"]
    want = exact([r for r in rows if r[1] != "large"], 10, 48)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items() if k[0] != "large"} == want
    assert all(len(want["tiny", 1000 * i + 2]) == 9 for i in range(10))
    assert all(len(got["large", 1000 * i]) == 10 for i in range(12_000))


def test_short_queries_are_completed(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", rng.normal(size=16).tolist(), 0, 0) for i in range(600)]
    got = {}
    for r in nearest_lists(spark.createDataFrame(rows, SCHEMA), 59, dim=16, cell=30, probes=1).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    want = {i: v for (_, i), v in exact(rows, 59, 16).items()}
    assert {i: len(v) for i, v in got.items()} == {i: 59 for i in want}
    assert np.mean([[v[r] for r in range(59)] == want[i] for i, v in got.items()]) > 0.5


def test_empty(spark):
    assert nearest_lists(spark.createDataFrame([], SCHEMA)).count() == 0 and neighbour_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_come_close():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = Model.fit(x, 8)
    cell, codes, norm = m.encode(x)
    back = m.centres[cell] + sum(m.books[i][codes[:, i]] for i in range(len(m.books)))
    assert np.allclose(np.linalg.norm(back, axis=1), norm, atol=1e-4)
    beam = ((x - back) ** 2).sum(axis=1).mean()
    rest = x - m.centres[cell]
    for book in m.books:
        rest = rest - book[((rest[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)]
    assert beam <= (rest**2).sum(axis=1).mean() + 1e-6 and beam < 0.3
    table = m.tables(x[:5])
    assert table.shape == (5, *m.books.shape[:2]) and table[0, 0, 0] == pytest.approx(float(x[0] @ m.books[0][0]), abs=1e-4)
