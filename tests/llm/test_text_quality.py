"""Problems 2 and 4: rules, parser, and accuracy on texts that were not used for fitting."""

import random

import numpy as np
import pytest

from loomset.llm import pairs, truncation
from loomset.llm.truncation import Model, left_open


@pytest.mark.parametrize("text, want", [
    ("plain.", []), ("(a [b] c", ["("]), ("“quoted", ["“"]), ("“done.” then", []), ("```py\nx = (1", ["```"]), ("<b>bold", ["<b"]), ("<b>bold</b><br>", []), ("list:\n- ", ["item"]), ("a) b", []), ('"open', ['"']), ('"a" b', []), ("„zu“ «ici", ["«"]),
])
def test_parser(text, want):
    assert left_open(text) == want


def corpus(seed, n):
    r = random.Random(seed)
    adjectives, nouns, verbs = ["joint", "rare", "empty", "public"], ["tariff", "library", "engine", "harbour"], ["sold", "opened", "tested", "moved"]
    name = lambda: r.choice("BDGKLMNPRST") + "".join(r.choice("aeiou") + r.choice("bdgklmnprst") for _ in range(2))
    out = []
    for _ in range(n):
        a, b, v, x, y = r.choice(adjectives), r.choice(nouns), r.choice(verbs), name(), name()
        out.append(r.choice([
            f"On Monday {x} {v} the {a} {b} under No. {r.randint(10, 99)} of the {y} plan.", f"The {a} {b} in {x} grew {r.randint(10, 99)}.{r.randint(0, 9)} per cent, {y} said.", f"“We {v} a {a} {b},” said {x} from {y}.", f"Shares of {x} closed at {r.randint(10, 99)}.{r.randint(0, 9)}.",
            f"Was the {b} of {x} {v}? {y} confirmed it (cause: {a} {b}).", f"{x} Works {v.title()} {a.title()} {b.title()} in {y}",
        ]))
    return out


@pytest.fixture(scope="module")
def model():
    return Model.fit(corpus(1, 600))


def test_held_out_accuracy(model):
    r, right, total = random.Random(9), 0, 0
    for t in corpus(2, 400):
        right += not model.is_cut(t)
        total += 1
        if t.endswith("."):
            at = r.randrange(len(t) // 3, len(t) - 1)
            if not t[:at].rstrip().endswith(("?", ".”")):
                right += model.is_cut(t[:at] + r.choice(["", "...", "…", " [...]", ","]))
                total += 1
    assert right / total > 0.97


@pytest.mark.parametrize("text, cut", [
    (None, False), ("", False), (" \n", False), ("…", False), ("On Monday Bad sold the tariff under No.", True), ("The engine in Bad grew 24.", True), ("Shares of Bad closed at 24.6.", False), ("Bad Works Sold Joint Tariff in Lum", False),
    ("The engine was sold. \n", False), ("The engine was sold by the", True), ("The engine was sold…", True), ("“We sold a joint engine", True), ("The engine was sold!", False), ("x" * 100_000 + " was sold.", False),
])
def test_endings(model, text, cut):
    assert model.is_cut(text) == cut


def test_nothing_to_fit_on():
    m = Model.fit([])
    assert m.is_cut("this stops in the") and not m.is_cut("This ends.")


def test_lengths_that_stand_out(spark):
    texts = [("a" * 60,)] * 40 + [("a" * n,) for n in range(20, 100)] + [("Done.",)] * 30 + [(None,)]
    limits = truncation.limit_counts(spark.createDataFrame(texts, "text string"))
    assert limits[0].argmax() == 60 and limits[0][5] == 0
    assert truncation.limit_counts(spark.createDataFrame([], "text string")).shape == (2, truncation.LONGEST + 1)


def test_flags_and_shares(spark, model):
    df = spark.createDataFrame([("s", "The engine was sold by the", 1), ("s", "It ended.", 2), (None, None, 3), ("s", "N/A", 4)], "source string, text string, cut_no int")
    rows = truncation.flag(df, model, unless=pairs.unanswered)
    assert [r["cut"] for r in rows.orderBy("cut_no").collect()] == [True, False, False, False]
    got = {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.share(rows, rows["source"]).collect()}
    assert got == {"s": (3, 1), None: (1, 0)}
    assert truncation.flag(df.limit(0), truncation.fit(df.limit(0))).count() == 0


PROMPT = "Officials in Bad said the joint tariff had been sold by Lum because of a rare engine."


@pytest.mark.parametrize("answer, want", [
    (None, "empty"), ("", "empty"), ("​—", "empty"), ("N/A", "empty"), ("[no output]", "empty"), ("<empty>", "empty"), ("none.", "empty"), ("I'm sorry, but I cannot provide a paraphrase here.", "refusal"), ("As a language model, I must decline to produce this rewrite.", "refusal"),
    ("Rewrite: I won’t generate that version", "refusal"), ("My guidelines say this request falls outside what I may answer.", "refusal"), ("Lo siento, no puedo ayudar con eso.", "refusal"), ("“We declined a joint tariff,” said Lum from Bad.", None), ("Lum refused the tariff in Bad (sorry for the delay).", None), ("Lum, unable to sell, cannot move the tariff.", None),
    (PROMPT, "copy"), ("Output - " + PROMPT.upper(), "copy"), ("Because of a rare engine the joint tariff had been sold by Lum, officials in Bad said.", "copy"), ("Rewrite: Les élus de Bad ont vendu le tarif parce que le moteur était trop rare.", "other_language"), ("Der Rat von Bad sagte, dass der Tarif nicht verkauft wird.", "other_language"),
    ("Чиновники в Бад сказали, что тариф был продан.", "other_language"), ("Lum sold the Bad tariff owing to a scarce", "truncated"), ("Lum sold the Bad tariff owing to a scarce motor.", None), ("Lum Sold Joint Tariff in Bad", None),
])
def test_defects(model, answer, want):
    assert pairs.defect(PROMPT, answer, model) == want


def test_prompts_without_text(model):
    assert pairs.defect(None, "Les élus de Bad ont vendu le tarif.", model) is None and pairs.defect(" ", PROMPT, model) is None
    assert pairs.defect("Les élus ont vendu le port parce que le canal était plein.", "The port was sold because of the canal.", model) == "other_language"


def test_tiling_covers_the_common_words():
    r = random.Random(4)
    for _ in range(200):
        a, b = (r.choices("abcdefgh", k=r.randint(0, 25)) for _ in range(2))
        found = pairs.tiles(a, b)
        assert {a[i + k] for i, _, n in found for k in range(n)} == set(a) & set(b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
        for side in (0, 1):
            used = [x for t in found for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        assert [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)


def test_pairs_table(spark, model):
    rows = [("set", "k", 1, PROMPT, None), ("set", "k", 2, PROMPT, "Lum sold the Bad tariff owing to a scarce motor."), ("rejected", "7", 0, None, "n/a"), ("rejected", "7", 0, None, "n/a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, rec_key string, view_idx int, prompt string, answer string, defect int")
    assert [tuple(r) for r in pairs.defects(df, model).collect()] == [("set", "k", 1, "empty"), ("rejected", "7", 0, "empty"), ("rejected", "7", 0, "empty")]
    assert pairs.defects(df.limit(0), model).count() == 0


def test_fitting_does_not_depend_on_order():
    texts = corpus(3, 80)
    a, b = Model.fit(texts), Model.fit(texts[::-1])
    assert np.array_equal(a.weights, b.weights)


def test_refusals_behind_blanks():
    assert pairs.is_refusal("I" + " " * 700 + "cannot help with that request.")


@pytest.mark.parametrize("answer, want", [
    ("Tariffen har sålts av staden eftersom den inte var till nytta.", "other_language"), ("Bu tarife çok eski olarak görüldü ve bir daha satılmadı.", "other_language"), ("Taryfa została sprzedana, ale nie jest to jeszcze pewne.", "other_language"), ("La tariffa è stata venduta dal comune perché non era più utile.", "other_language"),
    ("Het tarief werd door de stad verkocht omdat het niet meer nodig was.", "other_language"), ("Taksten er blevet solgt af byen, og den var ikke til nytte.", "other_language"),
    ("I'd rather not write that.", "refusal"), ("Mi dispiace, ma non posso scrivere questo testo.", "refusal"), ("Desculpe, mas não posso ajudar com isso.", "refusal"), ("Helaas, ik kan deze vraag niet beantwoorden.", "refusal"), ("I'm sorry," + " " * 700 + "but I cannot help.", "refusal"),
])
def test_languages_and_refusals_that_were_not_seen(model, answer, want):
    assert pairs.defect(PROMPT, answer, model) == want


def test_a_cut_last_word_is_of_no_language(model):
    assert pairs.defect(PROMPT, "Owing to packed co", model) == "truncated"


def test_long_copies_are_tiled_too():
    r = random.Random(1)
    words = [f"w{r.randrange(400)}" for _ in range(3_000)]
    parts = [words[a : a + 50] for a in range(0, 3_000, 50)]
    r.shuffle(parts)
    alike, in_order = pairs.similarity(" ".join(words), " ".join(sum(parts, [])))
    assert alike == 1.0 and in_order > 0.9
    assert pairs.similarity("a b c d e f g h", "h g f e d c b a") == (1.0, 0.0)


def test_long_headlines_are_whole(model):
    line = " ".join(f"Bad Works Sold Joint Tariff in {x}" for x in ("Lum", "Gat", "Dor", "Kib") * 5)
    assert len(line) > 400 and not model.is_cut(line) and not Model.fit([]).is_cut(line)


def test_limits_beyond_a_few_thousand_characters(spark):
    limits = truncation.limit_counts(spark.createDataFrame([("a" * 65_535,)] * 30 + [("a" * n,) for n in (9_000, 70_000)], "text string"))
    assert limits[0].argmax() == 65_535 and limits[1].argmax() == 65_535


def test_many_copies_do_not_fill_the_sample(spark):
    texts = [("The engine was sold by the city.",)] * 3_000 + [(t,) for t in corpus(5, 400)]
    df = spark.createDataFrame(texts, "text string").repartition(4)
    m = truncation.fit(df, sample=600)
    assert m.is_cut("The engine was sold by the") and not m.is_cut("The engine was sold by the city.")


def test_share_that_is_copied_in_order(spark, model):
    df = spark.createDataFrame([("set", "k", 1, PROMPT, PROMPT), ("set", "k", 2, PROMPT, "Lum sold it.")], "kind string, rec_key string, view_idx int, prompt string, answer string")
    assert [tuple(r) for r in pairs.judged(df, model).collect()] == [("set", "k", 1, "copy", 1.0)]


@pytest.mark.parametrize("after", [" ", "\n", " \n\n", "\t"])
def test_blanks_after_a_headline_do_not_make_it_cut(model, after):
    assert not model.is_cut("Bad Works Sold Joint Tariff in Lum" + after)
    assert model.is_cut("Bad Works Sold Joint Tariff in" + after) and model.is_cut("The engine was sold by" + after)
