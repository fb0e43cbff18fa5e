"""Text expressions. All of them are built-in Spark expressions, evaluated row by row in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.binding import let

# White space as Python's str.split() takes it.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Words that are never banned.
STOPWORDS = "a an and are as at after be by for from has have in into is it its of on or that the their to was were with without during new".split()

#: A word has at most one inner hyphen or apostrophe.
BAND_WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"

#: Markers before a model's answer.
ANSWER_MARKERS = ("Rewrite:", "Sentence:", "Output:", "Paraphrase:")

#: Fragments of answers that describe no image, and of answers that repeat their prompt.
REFUSAL_FRAGMENTS = ("i cannot see", "i can't see", "cannot view", "can't view", "as an ai", "i do not have access", "no image provided", "unable to determine", "sorry")
LEAK_FRAGMENTS = ("dataset", "filename", "prompt", "instruction", "language_name", "view_instruction")

#: Words without content in English and French image descriptions.
CONTENT_STOPWORDS = """
a an the and or but if then while with without of in on at to for from by as is are was were be been being it this that
these those there here below above under over into onto within between against around near beside another other some several
many one two three image shows show scene visible appears featuring features includes including has have had close likely suggests
setting area foreground background front back top bottom left right
un une le la les des de du et ou mais dans sur sous avec sans pour par comme est sont était étaient ce cette ces il elle ils
elles au aux en l image montre visible semble plusieurs groupe personne personnes autre certains autour près devant derrière haut
bas gauche droite
""".split()

#: Keywords of a candidate that contains a marker; the first marker counts.
MARKED_KEYWORDS = {
    "google ipo": ["google", "ipo", "offering", "shares", "stock", "sec", "bid"],
    "windows": ["microsoft", "windows", "xp", "security", "update", "software", "service pack"],
    "stock market": ["stock", "stocks", "market", "earnings", "prices", "shares", "profit"],
    "corporate earnings": ["earnings", "profit", "revenue", "shares", "stock", "company"],
    "sports": ["olympic", "sports", "soccer", "tennis", "medal", "athlete", "team"],
}

#: Fixed value: the instruction a rewrite is asked for with.
REWRITE_TEMPLATE = (
    "You are creating a controlled paraphrase dataset for a scientific experiment. "
    "Rewrite the sentence so that factual meaning is preserved, but wording is as different as possible.\n\n"
    "Original sentence:\n{original}\n\n"
    "Forbidden words. Do not use any of these exact words:\n{banned_words}\n\n"
    "Required length: {min_words}-{max_words} words.\n\n"
    "Rules:\n"
    "1. Return exactly one sentence.\n"
    "2. Preserve factual meaning, entities, polarity, time, and event relation.\n"
    "3. Do not add new facts.\n"
    "4. Do not use any forbidden word.\n"
    "5. Change syntax and vocabulary substantially.\n\n"
    "Final rewrite only:"
)


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def news_text(text: Column, max_chars: int = 500) -> Column:
    """Escaped line ends as blanks, white space collapsed; a longer text loses the word it would be cut in."""
    t = collapse(F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit(" ")))
    return let(t, lambda x: F.when(F.length(x) > max_chars, strip(F.regexp_replace(F.substring(x, 1, max_chars), " [^ ]*$", ""))).otherwise(x))


def normal_token(token: Column) -> Column:
    return F.btrim(F.lower(token), F.lit("-'_ "))


def band_words(text: Column) -> Column:
    """The words that count for a length band, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(BAND_WORD), F.lit(0)), normal_token), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(band_words(text))


def banned_words(text: Column, max_words: int = 8, min_len: int = 4, extra_stopwords: Iterable[str] = ()) -> Column:
    """The words a rewrite must avoid: by falling frequency, then length, then alphabet."""
    stop = [*STOPWORDS, *(w.lower().strip("-'_ ") for w in extra_stopwords)]
    kept = F.filter(band_words(text), lambda w: (F.length(w) >= min_len) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))
    rank = lambda tokens: lambda w: F.struct((-F.size(F.filter(tokens, lambda x: x == w))).alias("f"), (-F.length(w)).alias("n"), w.alias("w"))
    ranked = let(kept, lambda tokens: F.array_sort(F.transform(F.array_distinct(tokens), rank(tokens))))
    return F.transform(F.slice(ranked, 1, max_words), lambda x: x["w"])


def banned_hits(text: Column, banned: Column) -> Column:
    """Banned words that occur, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_intersect(F.transform(F.coalesce(banned, _strings([])), normal_token), band_words(text))))


def clean_answer(text: Column) -> Column:
    """A model's answer without fence, quotes, marker and all lines but the first."""
    quotes = "[\"'“”‘’ ]"
    t = strip(text)
    t = strip(F.regexp_replace(t, r"(?i)^```(?:json|text)?", ""))
    t = strip(F.regexp_replace(t, r"```$", ""))
    t = F.regexp_replace(t, f"^{quotes}+|{quotes}+$", "")
    for marker in ANSWER_MARKERS:
        # a text without the marker stays as it is; one with it is stripped too
        t = strip(F.regexp_replace(t, f"(?is)^.*{marker}", ""))
    lines = F.filter(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(x) != "")
    first = F.coalesce(F.regexp_replace(F.get(lines, F.lit(0)), r"^[ \-\t]+|[ \-\t]+$", ""), F.lit(""))
    return F.regexp_replace(first, f"^{quotes}+|{quotes}+$", "")


def plain_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def content_tokens(text: Column) -> Column:
    """Distinct words of three letters or more of the Latin script, without stop words."""
    raw = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-zÀ-ÖØ-öø-ÿ']+"), F.lit(0)), lambda w: F.btrim(w, F.lit("'")))
    return F.array_distinct(F.filter(raw, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(set(CONTENT_STOPWORDS)))))


def token_jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Distinct tokens in common by distinct tokens in either; ``both_empty`` where neither has any."""
    union = F.size(F.array_union(a, b))
    return let(union, lambda n: F.when(n == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / n))


def contains_any(text: Column, fragments: Iterable[str]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for f in fragments:
        found = found | F.contains(low, F.lit(f))
    return found


def refusal_like(text: Column) -> Column:
    return contains_any(text, REFUSAL_FRAGMENTS)


def leaks_metadata(text: Column) -> Column:
    return contains_any(text, LEAK_FRAGMENTS)


def script_matches(text: Column, hint: Column) -> Column:
    """Whether a text has letters of the script; for Latin, at least three quarters of its letters."""
    latin = F.regexp_count(text, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]"))
    letters = F.regexp_count(text, F.lit(r"[\p{L}\p{Nl}\p{No}]"))
    return (
        F.when(hint == "arabic", text.rlike("[\\u0600-\\u06ff]"))
        .when(hint == "devanagari", text.rlike("[\\u0900-\\u097f]"))
        .when(hint == "cjk", text.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]"))
        .when(hint == "hangul", text.rlike("[\\uac00-\\ud7af]"))
        .when(hint == "latin", (letters == 0) | (latin / F.greatest(letters, F.lit(1)) >= 0.75))
        .otherwise(True)
    )


def short_text(text: Column, limit: int = 180) -> Column:
    return let(collapse(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("..."))))


def escape_cell(text: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def stable_id(text: Column) -> Column:
    t = F.replace(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), F.lit("/"), F.lit("__"))
    return F.replace(F.replace(t, F.lit(" "), F.lit("_")), F.lit(":"), F.lit(""))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(F.lower(text), F.lit("/"), F.lit("__")), "[^a-z0-9_.-]+", "_"), F.lit("_"))


def safe_name(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")))


def key_parts(key: Column) -> dict[str, Column]:
    """Parts of ``method__family__size__slug__layer__sNN``, in which the slug may hold ``__``. Null for a key of
    fewer than seven parts."""
    p = F.split(key, "__")
    n = F.size(p)
    whole = n >= 7
    part = lambda i: F.when(whole, F.element_at(p, i))
    return {
        "method": part(1), "family": part(2), "size": part(3), "layer_name": part(-2), "set_token": part(-1),
        "model_slug": F.when(whole, F.array_join(F.slice(p, F.lit(4), F.greatest(n - 5, F.lit(0))), "__")),
    }


def short_key(key: Column) -> Column:
    p = key_parts(key)
    return F.when(p["family"].isNull(), key).otherwise(F.concat_ws(" ", p["family"], p["size"], p["layer_name"]))


def model_path(key: Column, root: str = "models") -> Column:
    """Folder of the model that a key names; an error for a key of another form."""
    p = key_parts(key)
    path = F.concat_ws("/", F.lit(root), p["method"], p["family"], p["size"], p["model_slug"], p["layer_name"], p["set_token"])
    return F.when(p["family"].isNull(), F.raise_error(F.concat(F.lit("not a model key: "), key)).cast("string")).otherwise(path)


def depth_pct(layer_name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(layer_name, "_(20|60|90)pct", 1), F.lit("")), F.lit("unknown"))


def pct_label(fraction: Column) -> Column:
    """``07pct`` of 0.07; halves go to the even neighbour."""
    return F.format_string("%02dpct", F.bround(fraction * 100).cast("int"))


def layer_of(n_layers: Column, fraction: Column) -> Column:
    layer = F.greatest(F.lit(1), F.least(n_layers, F.bround(n_layers * fraction).cast("int")))
    return F.when((fraction > 0) & (fraction <= 1), layer).otherwise(F.raise_error(F.lit("a layer fraction lies in (0, 1]")).cast("int"))


def stable_hash(value: Column, length: int = 16) -> Column:
    """Of a string: sha256 over its JSON form, in hexadecimal digits."""
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")
    return F.substring(F.sha2(F.when(value.isNull(), F.lit("null")).otherwise(quoted), 256), 1, length)


def keyed_hash(key: str, value: Column, length: int = 16) -> Column:
    """``stable_hash`` of an object with one string in it."""
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")
    return F.substring(F.sha2(F.concat(F.lit(f'{{"{key}": '), quoted, F.lit("}")), 256), 1, length)


def order_key(*parts: Column, seed: int = 0) -> Column:
    """A hexadecimal key that puts rows in an order fixed by seed and parts: the first eight bytes of a sha256."""
    return F.substring(F.sha2(F.concat(F.lit(str(seed)), *parts), 256), 1, 16)


def seed_number(*parts: Column, seed: int = 0) -> Column:
    """The key as an unsigned number, in decimal digits."""
    return F.conv(order_key(*parts, seed=seed), 16, 10)


def tags(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[|,;]"), strip), lambda x: x != "")


def fill(template: str, **values: Column) -> Column:
    """A template with named places."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def rewrite_prompt(original: Column, banned: Column, low: Column, high: Column, template: str = REWRITE_TEMPLATE) -> Column:
    listed = F.when(F.size(banned) > 0, F.array_join(banned, ", ")).otherwise("(none)")
    # the original comes last: what it holds is text, not a place
    return fill(template, min_words=low.cast("string"), max_words=high.cast("string"), length_band=F.concat_ws("-", low, high), banned_words=listed, original=original)


def wiki_sentence(line: Column) -> Column:
    return collapse(F.get(F.split(line, "\t"), F.lit(0)))


def title(raw: Column) -> Column:
    return strip(F.coalesce(raw, F.lit("")))


def relation_of(label: Column) -> Column:
    return F.when(label == "SUPPORTS", "supported_by").when(label == "REFUTES", "refuted_by").otherwise("evidence_for")


def record_id(prefix: str, split: str, number: Column) -> Column:
    return F.format_string(f"{prefix}_{split}_%06d", number.cast("bigint"))


def keywords(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: F.lower(strip(x))), lambda x: x != "")


def keyword_hits(text: Column, words: Column) -> Column:
    """The keywords that occur anywhere in a text, repeated ones repeatedly."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.transform(words, lambda k: strip(F.lower(k))), lambda k: (k != "") & F.contains(low, k))


def guessed_keywords(candidate: Column, label: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(candidate, F.lit("")), F.coalesce(label, F.lit(""))))
    trimmed = F.transform(F.split(F.coalesce(candidate, F.lit("")), rf"{SPACE}+"), lambda w: F.lower(F.btrim(w, F.lit(" /_-"))))
    out = F.slice(F.array_sort(F.array_distinct(F.filter(trimmed, lambda w: F.length(w) > 3))), 1, 8)
    for marker, found in reversed(MARKED_KEYWORDS.items()):
        out = F.when(F.contains(both, F.lit(marker)), _strings(found)).otherwise(out)
    return out


def display(value: Column, known: dict[str, str]) -> Column:
    """A label for reports: the known one, else the words in title case."""
    out = F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))
    for k, v in known.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def sample_texts(items: Column, n: int = 3, limit: int = 120) -> Column:
    """The first texts of an array of structs, shortened."""
    return F.array_join(F.transform(F.slice(items, 1, n), lambda x: short_text(F.coalesce(x["text"], F.lit("")), limit)), " | ")


def generated_text(answer: Column) -> Column:
    """The text in a generator's JSON: an object or the first of a list, under one of three names."""
    out = F.lit(None).cast("string")
    for root in ("$", "$[0]"):
        for name in ("generated_text", "text", "answer"):
            out = F.coalesce(out, F.get_json_object(answer, f"{root}.{name}"))
    return out


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def bands(raw: str | None) -> list[tuple[str, int, int]]:
    """Length bands from ``5-7,10-12``; the usual four without."""
    out = []
    for part in (raw or "5-7,10-12,15-17,20-22").split(","):
        low, high = part.strip().split("-")
        out.append((part.strip(), int(low), int(high)))
    return out


def set_sizes(raw: str) -> list[int]:
    """``2,4`` or ``2-16:2``."""
    sizes: list[int] = []
    for part in raw.split(","):
        span, _, step = part.partition(":")
        low, dash, high = span.partition("-")
        sizes += range(int(low), int(high) + 1, int(step or 1)) if dash else [int(low)]
    return sizes


def shard(raw: str | None) -> tuple[int, int] | None:
    """``INDEX/TOTAL``."""
    if not raw:
        return None
    try:
        index, total = (int(x) for x in raw.split("/", 1))
    except ValueError as e:
        raise ValueError("a shard reads INDEX/TOTAL, as 0/4") from e
    if not 0 <= index < total:
        raise ValueError("a shard's INDEX lies in 0..TOTAL-1")
    return index, total
