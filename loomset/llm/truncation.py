"""Problem 4: texts that were cut off by a field limit or in transfer.

No labels are needed: values that end as texts do are taken as intact, cut at random places to give positives,
and a logistic regression over hashed features learns to tell them apart: what the text closes with, its
punctuation, what a pushdown parser finds left open (quotations, brackets, fences, tags, list items), and how
often unfinished texts have just this length, in characters or bytes, which shows a field limit. It then scores
every record. The regression is fitted on a bounded sample of texts, taken by hash; the counts of lengths cover
all of them.

Defined results: null and blank texts are not cut, nor are those that hold no letter or digit; white space after
the end is ignored; marks added to show a cut are set aside before judging; a headline is whole; very long texts
are judged by the whole text; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 1 << 15
#: The regression is fitted on at most this many texts.
SAMPLE = 20_000
LONGEST = 1 << 20  # no field has a limit beyond it

#: Marks that are put where a text was cut.
CUT_MARK = re.compile(r"(?:\s*(?:\.\.\.+|…|�|,,+|\[\s*(?:\.\.\.|…|cut|truncated|continued|more)[^\]\n]{0,20}\]|\((?:cut|truncated|continued|more)\)))+$", re.IGNORECASE)
MARKS = frozenset(".…�,])")  # what a cut mark can end with
#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = frozenset("no nr nos vol art sec par p pp fig ch cf vs v mr mrs ms dr prof st hon gen col sen rep rev jr sr messrs approx ca bzw z.b d.h u.a abs str núm sr.a mme mlle n° e.g i.e a.m u.s u.k jan feb mar apr jun jul aug sept sep oct nov dec".split())
#: Words that stay small in headlines.
SMALL = frozenset("a an and as at but by for from in into of on or over the to up with vs via nor per en de la le les du des et y el los del und von der die das im zu".split())

WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
STRUCTURE = re.compile(r"```|[()\[\]{}“”„«»\"`]|</?[a-zA-Z][^<>]{0,40}>|\n\s*(?:[-*•]|\d{1,3}[.)])\s*$")
OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
END = re.compile(r"[.!?。！？](?:[\"'”’»)\]}]|\s)*$")


def left_open(text: str) -> list[str]:
    """What a text opens and doesn't close: a stack over its quotations, brackets, fences, tags and list items."""
    stack: list[str] = []
    for m in STRUCTURE.finditer(text):
        x = m.group()
        if x[0] == "\n":
            stack.append("item")
        elif x == "```" or x == '"' or (x == "`" and "```" not in stack):
            if x in stack:
                del stack[len(stack) - 1 - stack[::-1].index(x) :]
            else:
                stack.append(x)
        elif "```" in stack:
            continue
        elif x[0] == "<":
            name = re.match(r"</?([a-zA-Z]+)", x).group(1).lower()
            if x[1] == "/":
                if f"<{name}" in stack:
                    del stack[stack.index(f"<{name}") :]
            elif not x.endswith("/>") and name not in ("br", "hr", "img", "p", "li", "empty"):
                stack.append(f"<{name}")
        elif stack and stack[-1] == _opener(x):
            stack.pop()
        elif x in OPENERS:
            stack.append(x)
        elif x == "”" and "“" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("“") :]
    return stack


def _opener(x: str) -> str | None:
    return {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "“": "„"}.get(x)


def headline(words: list[str], text: str) -> bool:
    """Every word but small ones capitalised, none of it shouted, the last no small one, at least five."""
    if len(words) < 5 or words[-1].lower() in SMALL or END.search(text) or not text[-1:].isalnum():
        return False
    big = [w for w in words if w.lower() not in SMALL]
    return len(big) >= 3 and all(w[0].isupper() or w[0].isdigit() for w in big) and sum(w.isupper() and len(w) > 1 for w in words) * 2 <= len(words) and not re.search(r"[.;?!]\s|\(|\) -", text)


def stripped(text: str) -> tuple[str, bool]:
    """The text without white space and cut marks at its end, and whether there was a mark."""
    s = text.rstrip(" \t\r\n\f\v\u00a0\u200b\u200c\u200d\ufeff\u2028\u2029")
    base = CUT_MARK.sub("", s) if s[-1:] in MARKS else s
    marked = base != s
    return base.rstrip(" \t\r\n\u00a0\u200b"), marked


def goes_on(base: str) -> str | None:
    """Why a final full stop ends no sentence: after an abbreviation, or inside a number."""
    if not base.endswith("."):
        return None
    last = base[-40:].split()[-1] if base[-40:].split() else ""
    token = last[:-1].lstrip("(\"'“‘[").lower()
    if token in ABBREVIATIONS:
        return "abbreviation"
    if token.isdigit():
        return "number"
    return None


@lru_cache(1 << 16)
def shape(s: str) -> str:
    return re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", s))


@lru_cache(1 << 16)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (SIZE - 1)


def features(text: str, limits: dict[tuple[int, int], float] | None = None) -> list[tuple[int, float]]:
    """Hashed features of one text."""
    base, marked = stripped(text)
    tail = base[-400:]
    ended = END.search(tail) is not None
    on = goes_on(base)
    words = WORD.findall(tail if ended or len(base) <= 400 else base)
    top = not ended and headline(words, base)  # white space after it says nothing: whole texts have it as often
    state = "headline" if top and not marked else f"on-{on}" if on else "ended" if ended else "stopped"
    last = words[-1].lower() if words else ""
    before = words[-2].lower() if len(words) > 1 else ""
    names = ["bias", f"state={state}", f"close={base[-1:] if not base[-1:].isalnum() else shape(base[-1:])}", f"shape={shape(base[-3:])}", f"state={state},marked={marked}"]
    names.append(f"small={last in SMALL},{state}")
    names.append(f"capital={bool(words) and words[-1][0].isupper()},{state}")
    if not ended or on:
        names += [f"last={last}", f"two={before} {last}", f"long={min(len(last), 8)}"]
    opened = left_open(base)
    names += [f"open={x},{state}" for x in sorted(set(opened))]
    if opened:
        names.append("open")
    names.append(f"comma={base[-1:] in ',;:-–—('}")
    found = [(_bucket(n), 1.0) for n in names]
    if limits is not None:
        for which, n in enumerate((len(text), len(text.encode("utf-8", "replace")))):
            if (crowd := limits.get((which, n))) is not None:
                found.append((_bucket(f"limit{which},{state}"), crowd))
    return found


def _crowded(limits: np.ndarray | None) -> dict[tuple[int, int], float] | None:
    """The lengths that stand out at all: few, so a model stays small."""
    if limits is None:
        return None
    which, n = np.nonzero(limits)
    return {(int(w), int(k)): float(limits[w, k]) for w, k in zip(which, n)}


class Model:
    """Logistic regression over hashed features, and how far each length stands out among unfinished texts."""

    def __init__(self, weights: np.ndarray, limits: np.ndarray | None):
        self.weights, self.limits = weights, _crowded(limits)

    @classmethod
    def fit(cls, texts: list[str], limits: np.ndarray | None = None, seed: int = 0, rounds: int = 60) -> Model:
        """``texts``: a sample of whatever there is. What is intact among it is left whole and cut."""
        rng, crowded = np.random.default_rng(seed), _crowded(limits)
        rows, labels = [], []
        for t in sorted(texts):
            base, marked = stripped(t)
            words = WORD.findall(base)
            top = headline(words, base)
            if marked or len(words) < 4 or not (top or (END.search(base) and not goes_on(base))):
                continue
            rows.append(features(t, crowded))
            labels.append(0.0)
            if top:
                continue
            for at in (*rng.integers(len(base) // 4, len(base), 2), *_traps(base)):
                part = base[:at]
                clean = stripped(part)[0]
                after = base[at:].lstrip()
                if END.search(clean) and not goes_on(clean) and (not after or not after[0].islower()):
                    continue  # a sentence ended here
                if headline(WORD.findall(clean), clean):
                    continue  # nobody could tell
                part = part + str(rng.choice(["", "", "", "...", "…", " [...]", ",", "�"]))
                rows.append(features(part, crowded))
                labels.append(1.0)
        weights = np.zeros(SIZE)
        # without anything to learn from, what the state of the end says by itself
        for name, w in (("state=stopped", 2.0), ("state=ended", -2.0), ("state=headline", -2.0), ("state=on-abbreviation", 2.0), ("state=on-number", 2.0)):
            weights[zlib.crc32(name.encode()) & (SIZE - 1)] = w
        if rows:
            of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            col = np.array([f for r in rows for f, _ in r])
            val = np.array([v for r in rows for _, v in r])
            y = np.array(labels)
            balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
            step = np.zeros(SIZE)
            for _ in range(rounds):  # full gradients, scaled by their own history
                p = 1 / (1 + np.exp(-np.bincount(of, weights[col] * val, minlength=len(rows))))
                g = np.bincount(col, ((p - y) * balance)[of] * val, minlength=SIZE) / len(rows) + 1e-5 * weights
                step += g * g
                weights -= 0.5 * g / (np.sqrt(step) + 1e-8)
        return cls(weights, limits)

    def score(self, text: str) -> float:
        z = sum(self.weights[f] * v for f, v in features(text, self.limits))
        return float(1 / (1 + np.exp(-z)))

    def is_cut(self, text: str | None) -> bool:
        return bool(text) and any(c.isalnum() for c in text) and self.score(text) > 0.5


def _traps(base: str) -> list[int]:
    """Cuts after a full stop that ends no sentence."""
    return [m.end() for m in re.finditer(r"\b(?:No|Nr|vol|\d+)\.(?=\d| \d)", base)][:2]


def limit_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """For lengths in characters and in bytes: how far the number of unfinished texts of a length exceeds that
    of the lengths around it. At most twice LONGEST rows come to the driver."""
    t = F.col(text_col)
    open_end = texts.filter(t.isNotNull() & ~t.rlike(r"[.!?](?:[\"'”’»)\]}]|\s)*$"))
    both = F.array(F.length(t), F.octet_length(t))
    rows = open_end.select(F.posexplode(both).alias("which", "n")).filter(F.col("n") <= LONGEST).groupBy("which", "n").count().collect()
    counts = np.zeros((2, LONGEST + 1), dtype=np.float32)
    for which, n, c in rows:
        counts[which, n] = c
    around = np.stack([np.convolve(c, [1 / 6, 1 / 6, 1 / 6, 0, 1 / 6, 1 / 6, 1 / 6], mode="same") for c in counts])
    return np.clip(np.log2((counts + 1) / (around + 1)), 0, 4)


def fit(texts: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model of ``texts``, from counts over all and a bounded sample."""
    limits = limit_counts(texts, text_col)
    some = texts.select(text_col).filter(F.length(text_col) > 0)
    total = some.count()
    if total > sample:
        some = some.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 40)) < int(sample / total * (1 << 40)))
    # copies count once: of a text that very many rows have, one goes into the sample
    digest = [F.xxhash64(text_col).alias("x"), F.xxhash64(F.lit("second"), text_col).alias("y")]
    got = [r[0] for r in some.groupBy(*digest).agg(F.first(text_col).alias("t")).orderBy("x", "y").limit(2 * sample).select("t").collect()]
    return Model.fit(sorted(set(got)), limits)


def flag(texts: DataFrame, model: Model, text_col: str = "text", unless: Callable[[str | None], bool] = lambda _: False) -> DataFrame:
    """``texts`` with a column ``cut``, false for texts that ``unless`` holds of. Map-only."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    names = [c for c in texts.columns if c != text_col] + [text_col]
    ordered = texts.select(*names)
    schema = T.StructType([*ordered.schema.fields, T.StructField("cut", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_cut = shared.value.is_cut
        for batch in batches:
            coded = batch.column(len(names) - 1).dictionary_encode()  # texts that come again are judged once
            judged = np.array([is_cut(t) and not unless(t) for t in coded.dictionary.to_pylist()] + [False])
            cut = judged[coded.indices.fill_null(len(judged) - 1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.bool_())], names=[*names, "cut"])

    return ordered.mapInArrow(run, schema)


def share(flagged: DataFrame, by: Column) -> DataFrame:
    """``source, n_texts, n_cut, share``: how often each source truncates."""
    cut = F.count(F.when(F.col("cut"), 1))
    return flagged.groupBy(by.alias("source")).agg(F.count("*").alias("n_texts"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("share"))
