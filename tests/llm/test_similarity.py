"""Problems 1, 3, 5 and 6 against brute force on small tables."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from loomset.llm import formatting, neardup, overlap, setsim, splits
from loomset.llm.neardup import near_duplicate_groups, near_duplicates

WORDS = re.compile(r"[^\W_]+").findall
RECORD = "kind string, key string, text string"


def sets(rows):
    return {(k, i): frozenset(WORDS(t.lower())) for k, i, t in rows if i is not None and t and WORDS(t.lower())}


def brute(rows, t):
    s = sets(rows)
    return {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in s for b in s if a[0] == b[0] and a[1] < b[1] and len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def make(seed, n=160):
    """Records of common and rare words, many of them edits of one another, a third copies of one."""
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.5:
            w = r.choice(texts)[:]
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(common + rare)] if r.random() < 0.6 else []
                w = w or ["x"]
            r.shuffle(w)
        else:
            w = r.choices(common, k=r.randint(1, 8)) + r.sample(rare, r.randint(1, 8))
        texts.append(w)
        rows.append(("news" if i % 4 else "set", f"k{i:03d}", r.choice([" ", " - ", " "]).join(w).title()))
    rows += [("news", f"copy{i:03d}", "Same Words Every time here") for i in range(n // 3)]
    return rows + [("news", "null", None), ("news", "blank", " \t"), ("news", "signs", "!?"), ("news", None, "Same words every time here")]


@pytest.mark.parametrize("seed, frequent", [(1, 200), (2, 3), (3, 0)])
def test_near_duplicates_are_all_found(spark, seed, frequent):
    rows = make(seed)
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, RECORD), 0.7, frequent).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)


def test_large_groups_go_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_GROUP", 5)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    # by value, so that the workers take the small limits too
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(neardup)
    try:
        rows = make(4, 90)
        got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, RECORD), 0.7).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(neardup)
    assert got == brute(rows, 0.7)


def test_groups_count_classes_and_links(spark):
    rows = [("n", "a", "one two three four five"), ("n", "b", "five four three two one"), ("n", "c", "one two three four five six"), ("n", "d", "else")]
    got = {r["key"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in near_duplicate_groups(spark.createDataFrame(rows, RECORD), 0.8).collect()}
    assert got == {"a": ("a", 2, 1), "b": ("a", 2, 1), "c": ("c", 1, 1), "d": ("d", 1, 0)}


def test_meeting_keys_miss_no_similar_pair():
    rng, t = np.random.default_rng(0), Fraction(7, 10)
    counts = rng.integers(0, 500, setsim.BUCKETS)
    for _ in range(200):
        n = int(rng.integers(3, 40))
        x = rng.integers(-(1 << 62), 1 << 62, n)
        drop = int(rng.integers(0, max(1, int(0.3 * n)) + 1))
        y = np.concatenate((x[drop:], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, 3)))))
        both = len(set(x) & set(y))
        if both / len(set(x) | set(y)) < 0.7 or len(y) < 3:
            continue
        x, y = np.sort(x), np.sort(y)
        owner, key = setsim.meeting_keys(np.concatenate((x, y)), np.array([len(x), len(y)]), counts, 1000, t, 50)
        assert set(key[owner == 0]) & set(key[owner == 1])
        maps = setsim.bitmaps(np.concatenate((x, y)), np.array([len(x), len(y)]))
        assert setsim.may_reach(np.array([len(x)]), np.array([len(y)]), maps[:1], maps[1:], t)[0]


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("n", "a", "x y z", 1, 2), ("n", "b", "z y x", 3, 4)], RECORD + ", cid int, hashes int")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [("n", "a", "b")]
    none = spark.createDataFrame([], RECORD)
    assert near_duplicates(none).count() == 0 and near_duplicate_groups(none).count() == 0
    assert overlap.cross_split(spark.createDataFrame([], "key string, side string, text string")).count() == 0
    assert formatting.copies(spark.createDataFrame([], "kind string, key string, num bigint, at timestamp, text string")).count() == 0
    assert splits.source_groups(spark.createDataFrame([], "kind string, rec_key string, sources array<string>")).count() == 0
    assert splits.assign_splits(spark.createDataFrame([], "kind string, rec_key string, sources array<string>")).count() == 0


@pytest.mark.parametrize("seed, shard_words", [(5, 1_000_000), (6, 150)])
def test_cross_split_overlaps(spark, seed, shard_words):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(70)}" if side != "e" else f"e{r.randrange(50)}", side, t) for (_, _, t), side in ((x, r.choice(["t", "t", "e", None])) for x in make(seed, 120))]
    got = [tuple(x) for x in overlap.cross_split(spark.createDataFrame(rows, "key string, side string, text string"), 0.7, shard_words).collect()]
    s = [(k, side, frozenset(WORDS((t or "").lower()))) for k, side, t in rows if side]
    want = {(a, b) for a, x, v in s for b, y, w in s if x == "t" and y == "e" and v and w and len(v & w) / len(v | w) >= 0.7}
    assert len(got) == len(set(got)) and set(got) == want


def test_split_names(spark):
    rows = [(None,), ("",), (" Train\t",), ("DEV",), ("labelled_dev ",), ("test",), ("diagnostic",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(overlap.side(df["s"])).collect()] == ["t", "t", "t", "e", "e", "e", None]


WRITTEN = "kind string, key string, num bigint, at int, text string"


def test_copies_by_formatting(spark):
    rows = [
        ("news", "b", 0, 1, "Héllo,  World!"), ("news", "a", 0, 1, "hÉLLO world"), ("news", "c", 0, 1, "hello world"), ("news", "n", 0, 1, None), ("news", "e", 0, 1, "—"), (None, None, 0, 1, "hello world"), ("rejected", "10", 10, 1, "Same"), ("rejected", "9", 9, 1, "s a m e"),
        ("news", "p1", 0, 1, "title: A b | place : C"), ("news", "p2", 0, 1, "PLACE:c|TITLE:a B"), ("news", "j", 0, 1, '{"place": "C",\n "title": "A b"}'), ("news", "broken", 0, 1, '{"place": "C", "title"'), ("news", "q", 0, 1, "title: A b | C"), ("news", "twice", 0, 1, "once"), ("news", "twice", 0, 2, "hello: world"), ("news", "dup", 0, 1, '{"a": "1", "a": "2"}'),
    ]
    got = {tuple(r) for r in formatting.copies(spark.createDataFrame(rows, WRITTEN)).collect()}
    assert got == {("news", "a", "b"), ("rejected", "9", "10"), ("news", "j", "p1"), ("news", "j", "p2"), ("news", "c", "twice")}


def test_hot_keys_give_the_same_rows(spark):
    r = random.Random(0)
    rows = [("n", f"k{i:04d}", i % 7, 1, "Hot Text" if i % 3 == 0 else f"text {r.randrange(60)}") for i in range(400)]
    df = spark.createDataFrame(rows, WRITTEN)
    key = lambda out: sorted(map(tuple, out.collect()))
    assert key(formatting.copies(df, hot_copies=20)) == key(formatting.copies(df))
    counts = {r["key"]: r["n_records"] for r in formatting.collapsed(df, hot_copies=20).collect()}
    assert sum(counts.values()) == 400 and max(counts.values()) == 134


def linked(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def name(s):
        s = (s or "").strip().lower()
        return None if s in ("", "unknown") else re.sub(r"^(wiki:.*):[^:]*$", r"\1", s)

    for kind, key, sources in rows:
        for s in sources or []:
            if name(s):
                parent[find((kind, key, "r"))] = find(name(s))
        find((kind, key, "r"))
    groups = {}
    for kind, key, _ in rows:
        groups.setdefault(find((kind, key, "r")), []).append(key)
    return {k: (min(g), len(g)) for g in groups.values() for k in g}


SOURCED = "kind string, rec_key string, sources array<string>"


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_splits(spark, seed):
    r = random.Random(seed)
    name = lambda i: r.choice([f"s{i}", f" S{i}\t", f"s{i}"])
    rows = [("latent", f"k{i:03d}", [name(r.randrange(150)) for _ in range(r.randint(0, 2))] + [r.choice(["unknown", None, " ", "hub" if i % 3 == 0 else "Unknown "])]) for i in range(150)]
    rows += [("chain", f"c{i:03d}", [f"wiki:P{i}:1", f"WIKI:p{i + 1}:9"]) for i in range(60)] + [("latent", "none", None)]
    df = spark.createDataFrame(rows, SOURCED)
    want = linked(rows)
    got = {x["rec_key"]: (x["group_key"], x["n"]) for x in splits.source_groups(df).collect()}
    assert got == want
    given = splits.assign_splits(df).collect()
    assert len(given) == len(rows) and all(len({x["split"] for x in given if x["group_key"] == g}) == 1 for g in {x["group_key"] for x in given})
    n_test = sum(x["split"] == "test" for x in given)
    assert abs(n_test - 0.1 * len(rows)) <= 1 or n_test == min(want.values(), key=lambda v: v[1])[1]


def test_subset_sums():
    for seed in range(40):
        r = random.Random(seed)
        sizes = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        target = r.randint(0, sum(s * m for s, m in sizes.items()))
        sums = {0}
        for s, m in sizes.items():
            sums = {a + s * k for a in sums for k in range(m + 1)}
        taken = splits.closest_counts(sizes, target)
        total = sum(s * k for s, k in taken.items())
        assert all(k <= sizes[s] for s, k in taken.items()) and abs(total - target) == min(abs(x - target) for x in sums)
    big = splits.closest_counts({1: 10**9, 5_000_000: 20}, 110_000_000)
    assert sum(s * k for s, k in big.items()) == 110_000_000


def test_subset_sums_of_many_small_groups():
    for sizes, target in (({3: 4_000_000}, 1_200_000), ({3: 2_000_000, 5: 700_000, 7: 300_001}, 1_160_001)):
        taken = splits.closest_counts(sizes, target)
        assert all(k <= sizes[s] for s, k in taken.items()) and sum(s * k for s, k in taken.items()) == target


def test_keys_grow_with_the_length_of_a_text():
    rng = np.random.default_rng(3)
    for load in (0, 1_000, 10**9):  # of every bucket: even where all words are frequent
        counts = np.full(setsim.BUCKETS, load)
        for n in (100, 300, 3_000):
            owner, key = setsim.meeting_keys(np.sort(rng.integers(-(1 << 62), 1 << 62, n)), np.array([n]), counts, 10**6, Fraction(8, 10), 1_000)
            assert len(key) <= 0.4 * n + 2


def test_edits_in_sets_of_frequent_words():
    rng, t = np.random.default_rng(7), Fraction(7, 10)
    words = rng.integers(-(1 << 62), 1 << 62, 60)
    counts = np.zeros(setsim.BUCKETS, dtype=np.int64)
    counts[words % setsim.BUCKETS] = rng.integers(0, 9, 60) * 100_000
    met = 0
    for _ in range(2_000):
        x = np.sort(rng.choice(words, int(rng.integers(1, 40)), replace=False))
        y = np.sort(np.unique(np.concatenate((x[rng.random(len(x)) > 0.12], rng.choice(words, int(rng.integers(0, 4)))))))
        if len(y) and len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.7 and not np.array_equal(x, y):
            owner, key = setsim.meeting_keys(np.concatenate((x, y)), np.array([len(x), len(y)]), counts, 1000, t, 1000)
            assert set(key[owner == 0]) & set(key[owner == 1])
            met += 1
    assert met > 300


def test_a_key_in_a_third_of_the_sets_is_parted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_GROUP", 50)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(neardup)
    try:
        r = random.Random(8)
        rows = [("n", f"k{i:03d}", " ".join(["hot", "words", "all", "have", "in", "common", *(f"w{r.randrange(6)}" for _ in range(2))]) if i % 3 == 0 else f"a{i} b{r.randrange(9)} c{r.randrange(9)} d") for i in range(400)]
        df = spark.createDataFrame(rows, RECORD)
        _, classes = neardup.word_classes(df)
        counts = {"n": setsim.bucket_counts(classes)}
        got = {tuple(x) for x in near_duplicates(df, 0.7, 3).collect()}
        hot = neardup.hot_keys(classes.select("kind", "cid", "hashes"), counts, Fraction(7, 10), 3)
    finally:
        cloudpickle.unregister_pickle_by_value(neardup)
    assert got == brute(rows, 0.7) and (hot[1] > 50).all()


def test_deliveries_count_by_the_last(spark):
    rows = [("n", "a", 1, "one two three"), ("n", "a", 2, "four five six"), ("n", "b", 1, "six five four"), ("n", "c", 1, "one two three"), ("n", "c", 2, None), ("n", "d", 1, "three two one"), ("n", "d", 1, "three two one")]
    df = spark.createDataFrame(rows, "kind string, key string, at int, text string")
    assert [tuple(x) for x in near_duplicates(df).collect()] == [("n", "a", "b")]


def test_runs_that_all_similar_sets_share():
    assert [overlap.longest_run(Fraction(x, 100)) for x in (70, 75, 80, 90)] == [3, 3, 4, 9]
    rng, t = np.random.default_rng(2), Fraction(7, 10)
    words = rng.integers(-(1 << 62), 1 << 62, 80)
    sets = [np.sort(rng.choice(words, int(rng.integers(1, 25)), replace=False)) for _ in range(60)]
    sets += [np.sort(np.unique(np.append(s[rng.random(len(s)) > 0.1], rng.choice(words, 2)))) for s in sets[:50]]
    ids = np.stack((np.arange(len(sets)), np.arange(len(sets))), axis=1)
    sizes = np.array([len(s) for s in sets])
    shard = overlap.Shard(np.concatenate(sets), sizes, ids, t)
    got = {(int(x), int(y)): int(n) for a, b, _, both in shard.stream(np.concatenate(sets), sizes) for x, y, n in zip(a, b[:, 0], both)}
    want = {(i, j): len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.7}
    assert got == want


def test_records_that_overlap(spark):
    rows = [("t1", "t", "one two three four five six"), ("e1", "e", "six five four three two one zero"), ("e2", "e", "something else here"), ("e1", "e", "one two three four five six"), ("e3", "e", None)]
    df = spark.createDataFrame(rows, "key string, side string, text string")
    assert [tuple(x) for x in overlap.overlapping(df).collect()] == [("e1", 1, 6)]
