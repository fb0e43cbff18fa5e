from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomset.operators import sampling, selection

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
attempts = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 1), st.booleans()), max_size=25, unique_by=lambda x: x[:3])


@SLOW
@given(attempts)
def test_first_success_and_made_attempts_as_a_loop_gives_them(spark, rows):
    df = spark.createDataFrame(rows, "slot int, attempt int, cand int, ok boolean")
    first, made = {}, set()
    for slot in {r[0] for r in rows}:
        done = False
        for a in sorted({r[1] for r in rows if r[0] == slot}):
            if done:
                break
            for r in sorted(r for r in rows if r[:2] == (slot, a)):
                made.add(r[:3])
                if r[3] and not done:
                    first.setdefault(slot, r[:3])
            done = slot in first
    got = {r[0]: tuple(r)[:3] for r in selection.first_success(df, ["slot"], F.col("ok"), "attempt", "cand").collect()}
    assert got == first
    assert {tuple(r)[:3] for r in selection.until_success(df, ["slot"], F.col("ok"), "attempt").collect()} == made


@SLOW
@given(st.lists(st.booleans(), max_size=30), st.integers(0, 6))
def test_prefix_until_the_limit_is_reached(spark, oks, limit):
    df = spark.createDataFrame(list(enumerate(oks)), "ord bigint, ok boolean")
    want, accepted = [], 0
    for i, ok in enumerate(oks):
        if accepted >= limit:
            break
        want.append(i)
        accepted += ok
    assert sorted(r[0] for r in selection.accepted_prefix(df, "ord", F.col("ok"), limit).collect()) == want


@SLOW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 2), st.booleans()), max_size=30))
def test_repeats_of_accepted_rows_only(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, g int, k int, clean boolean")
    seen, want = set(), set()
    for i, (g, k, clean) in enumerate(rows):
        if (g, k) in seen:
            want.add(i)
        elif clean:
            seen.add((g, k))
    got = selection.flag_repeats(df, ["g"], F.col("k"), F.col("clean"), "ord").filter("repeated")
    assert {r[0] for r in got.collect()} == want


def test_numbering_ranges_and_splits(spark):
    df = spark.range(23).select((F.col("id") * 7 % 23).alias("x"))
    rows = selection.numbered(df, "x")
    assert sorted(map(tuple, rows.select("x", "ord").collect())) == [(i, i) for i in range(23)]
    shards = selection.even_ranges(rows, "ord", 5).groupBy("shard").agg(F.count("*").alias("n"), F.min("ord").alias("a")).orderBy("shard").collect()
    assert [r["n"] for r in shards] == [5, 5, 5, 4, 4] and [r["a"] for r in shards] == [0, 5, 10, 15, 19]
    assert selection.prefix_split(rows, "ord", 0.8).filter("is_train").count() == 18
    assert selection.numbered(df.limit(0), "x").count() == 0
    assert {r[0] for r in selection.model_shard(rows, "ord", 1, 4).select("ord").collect()} == set(range(1, 23, 4))


def test_last_wins_and_resume(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {tuple(r) for r in selection.last_wins(df, ["k"], "o", "v").collect()} == {("a", "y"), ("b", None)}
    assert [r["k"] for r in selection.not_done(df.filter("o = 1"), df.filter("k = 'a'"), ["k"]).collect()] == ["b"]


def test_balanced_tops_up(spark):
    df = spark.createDataFrame([(f"a{i}", "a") for i in range(10)] + [("b0", "b"), ("c0", "c"), ("z", "other")], "id string, label string")
    got = sampling.balanced(df, 8, ["a", "b", "c"], F.col("label"), F.col("id")).collect()
    labels = [r["label"] for r in got]
    assert len(got) == 8 and labels.count("a") == 6 and labels.count("b") == 1 and labels.count("c") == 1
    assert sampling.balanced(df, 3, ["a", "b", "c"], F.col("label"), F.col("id")).count() == 3


def test_shifted_has_no_fixed_point(spark):
    df = spark.createDataFrame([("g", i) for i in range(7)] + [("one", 99)], "g string, x int")
    rows = sampling.shifted(df, ["g"], F.col("x").cast("string"), ["x"]).collect()
    assert all(r["x"] != r["shuffled_x"] for r in rows if r["g"] == "g") and {r["shuffled_x"] for r in rows if r["g"] == "g"} == set(range(7))


def test_matched_controls_come_from_other_sets(spark):
    rows = [(f"s{i % 4}", f"v{i}", "en" if i % 3 else "fr") for i in range(24)] + [("alone", "w", "de")]
    views = spark.createDataFrame(rows, "set_id string, view_id string, lang string")
    got = sampling.matched_controls(views, "lang", "same_language").collect()
    home, lang = {v: s for s, v, _ in rows}, {v: x for _, v, x in rows}
    assert {r["set_id"] for r in got} == {"s0", "s1", "s2", "s3"}  # the view alone in its language finds none
    for r in got:
        own = sorted(v for s, v, _ in rows if s == r["set_id"])
        assert [lang[v] for v in own] == [lang[p] for p in r["picks"]] and all(home[p] != r["set_id"] for p in r["picks"])


def test_sampled_views_put_the_original_first(spark):
    schema = "original_id string, original_text string, rewrites array<struct<text string>>"
    df = spark.createDataFrame([("a", "A", [("r1",), ("r2",)]), ("b", "B", [("r3",)]), ("c", "C", None)], schema)
    got = {r["original_id"]: r["texts"] for r in sampling.sample_views(df, 2).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == "A" and len(got["a"]) == 2 and got["b"] == ["B", "r3"]
    assert [r["texts"] for r in sampling.sample_views(df, 1, include_original=False).filter("original_id = 'b'").collect()] == [["r3"]]


def test_stratified_takes_each_row_once(spark):
    df = spark.createDataFrame([(i, ["x", "y"] if i % 2 else ["x"]) for i in range(10)] + [(99, [])], "id int, tags array<string>")
    got = [r["id"] for r in sampling.stratified(df, "tags", "id", 3).collect()]
    assert len(got) == len(set(got)) and 3 <= len(got) <= 6 and 99 not in got
    assert sampling.stratified(df, "tags", "id", 3, max_total=2).count() == 2


def test_numbers_within_groups(spark):
    rows = [(g, x) for g, n in (("a", 40), ("b", 3), (None, 2)) for x in range(n)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(3)
    got = {(r["g"], r["x"]): r["n"] for r in selection.numbered(df, F.desc("x"), name="n", by=("g",)).collect()}
    assert got == {(g, x): n - 1 - x for g, n in (("a", 40), ("b", 3), (None, 2)) for x in range(n)}


def test_shifts_within_groups_of_any_name(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("one", 3)], "g string, x int")
    got = {r["x"]: r["shuffled_x"] for r in sampling.shifted(df, ["g"], F.col("x").cast("string"), ["x"]).collect()}
    assert got == {1: 2, 2: 1, 3: 3}


def test_a_seeded_sample_of_ids(spark):
    df = spark.createDataFrame([(f"i{k % 40}",) for k in range(80)] + [(None,)], "id string")
    a, b = ([r[0] for r in sampling.sampled_ids(d, "id", 7, seed=2).collect()] for d in (df, df.repartition(5)))
    assert a == b and len(set(a)) == 7
