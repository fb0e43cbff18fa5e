"""Problems 8, 9 and 10, and the full-text index."""

import random
import re

import numpy as np
import pytest

from loomset.llm import bpe, leaks, spans
from loomset.llm.fmindex import FMIndex, suffix_array

rng = np.random.default_rng(1)
WORDS = re.compile(r"[^\W_]+").findall


@pytest.mark.parametrize("sigma", [1, 2, 5, 3000])
def test_index_against_scanning(sigma):
    for _ in range(15):
        text = rng.integers(0, sigma + 1, rng.integers(0, 500))
        index = FMIndex(text, rate=4)
        for length in (1, 2, 4):
            patterns = rng.integers(0, sigma + 2, (40, length))
            if len(text) > 10:
                patterns[:20] = [text[a : a + length] for a in rng.integers(0, len(text) - length, 20)]
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()] if (p > 0).all() else []
                assert sorted(index.locate(np.arange(a, b))) == want


def test_suffixes_of_repeated_text():
    text = np.append(np.tile([1, 2, 1, 3], 300), 0)
    sa = suffix_array(text)
    assert sorted(sa) == list(range(len(text))) and all(tuple(text[a:]) < tuple(text[b:]) for a, b in zip(sa[:-1], sa[1:]))


@pytest.fixture(scope="module")
def reference():
    pytest.importorskip("tiktoken")
    import tiktoken

    e = bpe.Encoder.from_file(bpe.VOCABULARY)
    return e, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.merges, special_tokens={})


def test_encoder_against_the_library(reference):
    e, lib = reference
    r = random.Random(0)
    texts = ["", " ", "  a", "a  b", " \n x\r\n\n y ", "it's we'll I'm", "x<|endoftext|>y", "naïve façade ½ Ⅷ 日本語 🙂🙂", "​  z", "1234567 12", "tab\tend\t", "a" * 5000, "ab" * 3000 + "!", "é" * 2000]
    texts += ["".join(r.choices(" \n\tabcdé.,'0128日", k=r.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(e.encode(t), dtype=np.int32).tolist() == lib.encode_ordinary(t), t


def test_rank_queue_pops_in_order():
    q = bpe.RankQueue(50_000)
    pushed = [(int(rng.integers(50_000)), int(rng.integers(100))) for _ in range(2000)]
    for r, p in pushed:
        q.push(r, p)
    out = []
    while (got := q.pop()) is not None:
        out.append(got)
    assert out == sorted(pushed)


def test_long_pre_tokens_end_soon(reference):
    e, lib = reference
    text = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    assert e.merge(text.encode()) == lib.encode_ordinary(text)


def test_encoded_table(spark, reference):
    _, lib = reference
    rows = [(1, "a b"), (2, None), (3, ""), (3, " x"), (None, "y")]
    df = spark.createDataFrame([(i, t, "ids") for i, t in rows], "doc_id bigint, text string, ids string")
    got = [tuple(r) for r in bpe.encode_corpus(df).collect()]
    assert got == [(i, lib.encode_ordinary(t or "")) for i, t in rows]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    with pytest.raises(FileNotFoundError):
        bpe.encode_corpus(df, vocabulary="/nowhere")


def leak_rows(docs, items, n):
    grams = lambda t: {tuple(w[k : k + n]) for w in [WORDS((t or "").lower())] for k in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, s in items if d is not None and grams(t) & grams(s)}


def test_leaks(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 20)))) for i in range(25)] + [(90, None), (91, ""), (92, items_text := "One two, three-four five SIX seven"), (93, items_text)]
    docs = []
    for d in range(120):
        w = r.choices(vocabulary + ["other", "more"], k=r.randint(0, 60))
        if r.random() < 0.5:
            s = r.choice(items)[1] or ""
            w[5:5] = WORDS(s)[r.randint(0, 3) :]
        docs.append((d, (r.choice([" ", "\n", " ; "])).join(w)))
    docs += [(500, None), (501, ""), (502, "one TWO three. four five six seven"), (None, docs[0][1]), (503, "pad " * 4000 + "one two three four five six seven" + " pad" * 4000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(x) for x in leaks.leaks(d, i, min_words=6).collect()]
    assert len(got) == len(set(got)) and set(got) == leak_rows(docs, items, 6)
    assert {tuple(x) for x in leaks.leaks(d, i, min_words=6, block_words=40).collect()} == set(got)
    span = [tuple(x) for x in leaks.leaked_spans(d, i, min_words=6).filter("doc_id = 503 and item_id = 92").collect()]
    assert span == [(503, 92, 4000, 7)]
    assert leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


def test_documents_longer_than_a_shard(monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_SYMBOLS", 64)
    import pyarrow as pa

    from types import SimpleNamespace

    passages = SimpleNamespace(value=leaks._Passages(*leaks._patterns([(1, [f"a{i}" for i in range(8)])], 6)))
    text = " ".join(["a0"] * 100 + [f"a{i}" for i in range(8)] + ["a1"] * 150 + [f"a{i}" for i in range(1, 7)])
    out = list(leaks._search(passages, 6)(iter([pa.record_batch([pa.array([7]), pa.array([text])], names=["d", "t"])])))
    got = {(a, b) for x in out for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist())}
    covered = {w for a, n in got for w in range(a, a + n)}
    assert covered == set(range(100, 108)) | set(range(258, 264))


def span_pairs(docs, n):
    win = {d: {t[i : i + n] for i in range(len(t) - n + 1)} for d, t in docs if t and d is not None}
    return {(a, b) for a in win for b in win if a < b and win[a] & win[b]}


def make_docs(seed):
    r = random.Random(seed)
    letters = "abcdefghij é\n🙂"
    parts = ["".join(r.choices(letters, k=r.randint(20, 120))) for _ in range(12)]
    docs = [(i, "".join(r.choices(letters, k=r.randint(0, 60))) + r.choice(parts)[r.randint(0, 15) :] + "".join(r.choices(letters, k=r.randint(0, 40)))) for i in range(90)]
    docs += [(200 + i, docs[3][1]) for i in range(4)] + [(300, None), (301, ""), (302, "a" * 400), (303, "a" * 300 + "b"), (304, "ab" * 150)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans(spark, seed):
    docs = make_docs(seed)
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, doc int")
    got = [tuple(r) for r in spans.shared_pairs(df, min_chars=40, phrase_chars=12).collect()]
    assert len(got) == len(set(got)) and set(got) == span_pairs(docs, 40)
    cover = {r["doc_id"]: r for r in spans.coverage(df, min_chars=40, phrase_chars=12).collect()}
    assert len(cover) == len(docs)
    text = dict(docs)
    windows = {}
    for d, t in docs:
        for i in range(len(t or "") - 39):
            windows.setdefault(t[i : i + 40], set()).add(d)
    for d, t in text.items():
        want = {p for i in range(len(t or "") - 39) if len(windows[t[i : i + 40]]) > 1 for p in range(i, i + 40)}
        assert cover[d]["n_shared"] == len(want), d


def test_hot_phrases(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_PHRASE", 3)
    monkeypatch.setattr(spans, "HOT_STEP", 4)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(spans)
    try:
        docs = make_docs(3)
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        got = {tuple(r) for r in spans.shared_pairs(df, min_chars=40, phrase_chars=12).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(spans)
    assert got == span_pairs(docs, 40)


def test_many_copies_of_a_segment(spark):
    docs = [(i, f"{i:04d}" + "the same long stretch of text in every one of them " * 2) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_pairs(df, min_chars=40, phrase_chars=12).collect()} == span_pairs(docs, 40)
    assert spans.shared_pairs(df.limit(0)).count() == 0 and spans.coverage(df.limit(0)).count() == 0


def test_a_passage_that_many_items_share(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(9))
    items = spark.createDataFrame([(i, f"own{i} {words}") for i in range(200)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"{words} and {words}" if i % 3 else "other") for i in range(60)], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "SPANS_AT_ONCE", 50)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(leaks)
    try:
        got = {tuple(r) for r in leaks.leaked_spans(docs, items, min_words=6).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(leaks)
    assert got == {(d, i, at, 9) for d in range(60) if d % 3 for i in range(200) for at in (0, 10)}


def test_places_come_from_the_automaton(spark, monkeypatch):
    """Without it nothing is found: the hashes say which phrases a shard needs, not where they are."""
    import ahocorasick

    docs = make_docs(1)

    class Blind:
        def __init__(self):
            self.words = 0

        def add_word(self, *_):
            self.words += 1

        def __len__(self):
            return self.words

        def make_automaton(self):
            pass

        def iter(self, _):
            return iter(())

    import pyarrow as pa

    text = dict(docs)[3]
    shard = pa.table({"shard": [0, 0], "doc": [1, 2], "text": ["x" + text, text + "y"]})
    phrases = pa.table({"shard": [0], "h": pa.array([5], pa.int64()), "doc": [2], "pos": [0], "n": [2]})
    found = spans._locate(40, 12)(shard, phrases)
    places = {(d, a) for ds, at in zip(found.column("docs").to_pylist(), found.column("at").to_pylist()) for d, a in zip(ds, at)}
    assert {(1, 1), (2, 0)} <= places  # document 1 was never said to have it
    monkeypatch.setattr(ahocorasick, "Automaton", Blind)
    assert spans._locate(40, 12)(shard, phrases).num_rows == 0


def test_many_contexts_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "GROUP", 4)
    docs = make_docs(2)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_pairs(df, min_chars=40, phrase_chars=12).collect()} == span_pairs(docs, 40)
    want = {r["doc_id"]: r["n_shared"] for r in spans.coverage(df, min_chars=40, phrase_chars=12).collect()}
    monkeypatch.setattr(spans, "GROUP", 20_000)
    assert want == {r["doc_id"]: r["n_shared"] for r in spans.coverage(df, min_chars=40, phrase_chars=12).collect()}


def test_an_id_with_several_texts(spark):
    base = make_docs(1)
    docs = base + [(base[5][0], "z" * 7 + base[9][1]), (base[5][0], base[5][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = set()
    win = {}
    for d, t in docs:
        win.setdefault(d, set()).update(t[i : i + 40] for i in range(len(t or "") - 39))
    want = {(a, b) for a in win for b in win if a < b and win[a] & win[b]}
    assert {tuple(r) for r in spans.shared_pairs(df, min_chars=40, phrase_chars=12).collect()} == want
