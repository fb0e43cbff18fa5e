"""Problem 2: prompts whose answers are empty, decline the task, copy the prompt, are in another language or stop
short; each pair gets the first of these that holds.

* ``empty``: null, no letter or digit, or nothing but a sign that there is no answer.
* ``refusal``: a small grammar over the beginning of the answer, an opening and what the speaker says not to do.
* ``copy``: word similarity to the prompt of at least 0.8. Where counts of distinct words leave room for it, greedy
  string tiling decides: the words in its tiles are the overlap, and tiles of three words or more say how much of
  the answer is copied in order (``in_order``).
* ``other_language``: letters of another script, or more function words of another language than of the prompt's;
  a label before the answer is left out.
* ``truncated``: as in ``truncation``, with its pushdown parser and its regression.

Defined results: a null or blank prompt can be neither copied nor of another language; texts whose language shows in
no word are of the prompt's; texts are used whole; equal pairs are judged alike; empty tables give no rows; further columns are never read.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomset.llm.truncation import Model

COPY = 0.8
COPIED_RUN = 3
WORD = re.compile(r"[^\W_]+").findall
LATIN = re.compile("[A-Za-z]")
BEYOND = re.compile(r"[^\W\d_\x00-\u024f]")  # letters beyond those of Latin script

#: What stands, without other characters, where there is no answer.
NO_ANSWER = frozenset("na none null nil nan empty blank nooutput notext noanswer noresponse noreply noresult noresults nocontent notavailable notapplicable unavailable undefined missing tbd noanswergiven noanswerprovided nooutputgenerated nothing void ".split())

#: How a label before an answer reads.
LABEL = re.compile(r"^\s*[\"“]?\s*(?:(?:sure|certainly|of course|okay|ok|yes)[,!.]?\s*)?(?:here(?:'s| is| are)(?: the| a| your| my)?(?: it)?(?: \w+){0,3}|here it is|rewrite|rewritten|rewording|paraphrase|answer|response|output|result|text|translation|summary|version|note)\s*(?:\d+)?(?:\s*[:：]|\s+[-–—])\s*", re.IGNORECASE)

#: The refusal grammar. An opening, as many as there are, then what is declined.
OPENING = r"(?:(?:i'?m (?:so |very |truly )?sorry|i am (?:so |very )?sorry|sorry|my apologies|apologies|i apologi[sz]e(?: for [\w ]{1,30})?|regrettably|unfortunately|sadly|to be honest|honestly|thank you(?: for [\w ]{1,40})?|thanks(?: for [\w ]{1,40})?|as an? (?:ai|artificial intelligence|large language|language)(?: \w+){0,3}|(?:my|our|the) (?:guidelines|policy|policies|rules|instructions)(?: \w+)? (?:say|state|mean|require)s?(?: that)?|i(?:'m| am) afraid(?: that)?|please understand(?: that)?|i understand[^,.;]{0,60})[\s,;:.!–—-]*(?:but|however|yet|and|that)?[\s,]*)"
DECLINED = r"(?:(?:i|we) (?:really |simply |just )?(?:cannot|can ?not|can'?t|could not|couldn'?t|won'?t|will not|would not|wouldn'?t|must not|may not|must (?:respectfully |politely )?(?:decline|refuse)|have to (?:decline|refuse)|(?:respectfully |politely )?(?:decline|refuse) to|am unable to|are unable to|am not able to|are not able to|do not feel comfortable|don'?t feel comfortable|am not (?:allowed|permitted|comfortable|authori[sz]ed|in a position)|are not (?:allowed|permitted))|i'?m (?:unable to|not able to|not (?:allowed|permitted|comfortable|authori[sz]ed|in a position)|declining)|(?:it is|it'?s) (?:not|im)\s?possible for (?:me|us) to|(?:this|that|the|your) (?:request|task|question|content|prompt|text|topic) (?:falls outside|is outside|goes against|violates|is against|cannot be|can'?t be|is not something|is beyond|breaches|isn'?t something)|(?:this|that) is not something (?:i|we) (?:can|may)|i'?d (?:rather|prefer) not|i would (?:rather|prefer) not|no puedo|no podemos|lamento no|non posso|non possiamo|não posso|não podemos|ik kan [\w ]{0,40}niet|jag kan (?:tyvärr )?inte|nie mogę|je ne (?:peux|puis) pas|nous ne pouvons pas|il m'est impossible|je suis dans l'impossibilité|ich kann (?:das|dies|diese[nrsm]?|hier|leider|ihnen)?[\w ]{0,40}nicht|es ist mir nicht möglich|ich darf [\w ]{0,30}nicht)\b"
FOREIGN_OPENING = r"(?:(?:lo siento|lo lamento|lamentablemente|désolée?|je suis désolée?|je regrette|malheureusement|es tut mir leid|tut mir leid|leider|entschuldigung|mi dispiace|purtroppo|desculpe|infelizmente|het spijt me|helaas|tyvärr|przykro mi|niestety)[\s,;:.!]*(?:pero|mais|aber|ma|mas|maar|men|ale)?[\s,]*)"
REFUSAL = re.compile(rf"^(?:{OPENING}|{FOREIGN_OPENING}){{0,4}}{DECLINED}", re.IGNORECASE)

#: The commonest articles, pronouns, prepositions, conjunctions and auxiliaries of some languages.
FUNCTION_WORDS = {
    "en": "the of and to in is was were be been that for on it with as at by this have has had not are or an from but they which you we he she his her their its who what when if would will can all there than then after before because so no into about".split(),
    "fr": "le la les de des du et est un une que qui dans pour sur pas au aux avec par ce cette ces il elle ils elles nous vous je ne se sa son ses leur mais ou où été être ont a à en très plus comme sont si".split(),
    "de": "der die das und ist ein eine einen einem einer nicht mit von zu den dem des im am auf für als auch es an werden wird wurde bei hat haben sich aus nach dass sie er wir ich oder war zum zur über wie um".split(),
    "es": "el la los las de y que en un una por con no se del al es lo su sus para como más pero fue ser está este esta son era muy ha han sido si sobre entre cuando ya todo hay".split(),
    "it": "il lo la gli le di e che un una per con non si del della dei delle al alla è sono nel nella come più ma anche dal dalla questo questa ha hanno era stato su ed".split(),
    "pt": "o a os as de e que em um uma por com não se do da dos das no na ao à é foi para como mas mais são este esta muito ser tem seu sua ou quando pelo pela".split(),
    "nl": "de het een van en in is dat op te zijn met voor niet aan er maar om ook als dan bij nog naar uit door over wordt werd heeft hebben was deze die dit ik je wij ze".split(),
    "sv": "och att det som en på är av för med den till inte om ett han hon var jag har de vi sig från men så kan när där ska efter eller hade blev vid också".split(),
    "da": "og at det som en på er af for med den til ikke om et han hun var jeg har de vi sig fra men så kan når der skal efter eller havde blev ved også".split(),
    "fi": "ja on ei se että hän oli ovat mutta kun niin myös tai jos joka ollut sen ole mitä tämä kuin jo vain minä sitä sekä".split(),
    "pl": "i w z na do nie się że jest to o jak po co za od ale przez był była było są dla oraz tym jego jej który która które tego ze".split(),
    "tr": "ve bir bu da de için ile olarak olan daha çok gibi kadar ne o ama en var yok değil mi sonra ya her ise şu dedi oldu".split(),
}
WORDS_OF = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
TONGUES = tuple(WORDS_OF)
#: For each word the languages that have it; a word of several counts half.
_votes = {w: (tuple(i for i, k in enumerate(TONGUES) if w in WORDS_OF[k])) for w in set().union(*WORDS_OF.values())}


def unlabelled(answer: str) -> str:
    """The answer without a label before it."""
    label = LABEL.match(answer)
    return answer[label.end() :] if label else answer


def is_empty(answer: str | None, words: list[str] | None = None) -> bool:
    found = WORD((answer or "").lower()) if words is None else words
    return not found or (len(found) <= 4 and "".join(found) in NO_ANSWER)


def is_refusal(answer: str) -> bool:
    s = unlabelled(answer.replace("’", "'").replace("‘", "'")).lstrip(" \t\r\n\"'*_>-")
    return REFUSAL.match(" ".join(s.split())) is not None


def tiles(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest common runs of unmarked words first, down to single words. All maximal runs
    wait in a heap; one that is partly marked by then goes back as what is left of it."""
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    heap = []
    for i, w in enumerate(a):
        for j in at.get(w, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # a run that began before
            n = 1
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            heap.append((-n, i, j))
    heapq.heapify(heap)
    free_a, free_b, found = bytearray(b"\1" * len(a)), bytearray(b"\1" * len(b)), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        if 0 not in free_a[i : i + n] and 0 not in free_b[j : j + n]:
            free_a[i : i + n] = free_b[j : j + n] = bytes(n)
            found.append((i, j, n))
            continue
        k = 0
        while k < n:
            z = k
            while z < n and free_a[i + z] and free_b[j + z]:
                z += 1
            if z > k:
                heapq.heappush(heap, (k - z, i + k, j + k))
            k = z + 1
    return found


@lru_cache(1 << 10)
def _words(prompt: str) -> tuple[list[str], frozenset[str]]:
    found = WORD(prompt.lower())
    return found, frozenset(found)


def similarity(prompt: str | None, answer: str, words: list[str] | None = None) -> tuple[float, float]:
    """Word similarity, and the share of the answer's words that stand in tiles of at least COPIED_RUN words. Where
    counts of distinct words leave room for a copy, the words in the tiles are the words in common."""
    (a, x), b = _words(prompt or ""), WORD(answer.lower()) if words is None else words
    y = set(b)
    if not x or not y:
        return 0.0, 0.0
    both = len(x & y)
    if both < COPY * (len(x) + len(y) - both):
        return both / (len(x) + len(y) - both), 0.0
    found = tiles(a, b)
    both = len({a[i + k] for i, _, n in found for k in range(n)})
    return both / (len(x) + len(y) - both), sum(n for _, _, n in found if n >= COPIED_RUN) / len(b)


@lru_cache(1 << 12)
def _script_of(c: str) -> str:
    name = unicodedata.name(c, "").split(" ")[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK"}.get(name, name)


def script(text: str) -> str | None:
    """The script most letters are of, by the first word of their Unicode names."""
    if text.isascii() or not BEYOND.search(text):
        return "LATIN" if LATIN.search(text) else None
    counts: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            name = "LATIN" if c < "ɐ" else _script_of(c)
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=lambda k: (counts[k], k)) if counts else None


def votes(words: list[str]) -> list[float]:
    """The function words of each language; those of several count half."""
    got = [0.0] * len(TONGUES)
    get = _votes.get
    for w in words:
        if of := get(w):
            for i in of:
                got[i] += 1.0 if len(of) == 1 else 0.5
    return got


@lru_cache(1 << 10)
def _home(prompt: str) -> tuple[str | None, int | None]:
    """The script and the language of a prompt; of languages that are even, English, else the first."""
    found = votes(WORD(prompt.lower()))
    return script(prompt), max(range(len(TONGUES)), key=lambda i: (found[i], i == 0)) if any(found) else None


def other_language(prompt: str | None, answer: str, words: list[str] | None = None) -> bool:
    if not prompt or not prompt.strip():
        return False
    own = unlabelled(answer)
    one, home = _home(prompt)
    other = script(own)
    if one and other and one != other:
        return True
    if home is None:
        return False
    found = WORD(own.lower()) if words is None or len(own) < len(answer) else words
    q = votes(found[:-1] if len(found) > 1 and own.rstrip()[-1:].isalnum() else found)  # a last word without a mark after it may be cut
    best = max(q)
    return q[home] < best and best >= 1 and best - q[home] >= 0.5 * (1 + q[home])


def judge(prompt: str | None, answer: str | None, model: Model) -> tuple[str | None, float]:
    """The defect of a pair and, for copies, the share of the answer that is copied in order."""
    words = WORD((answer or "").lower())
    if is_empty(answer, words):
        return "empty", 0.0
    if is_refusal(answer):
        return "refusal", 0.0
    alike, in_order = similarity(prompt, answer, words)
    if alike >= COPY:
        return "copy", in_order
    if other_language(prompt, answer, words):
        return "other_language", 0.0
    return ("truncated" if model.is_cut(answer) else None), 0.0


def defect(prompt: str | None, answer: str | None, model: Model) -> str | None:
    return judge(prompt, answer, model)[0]


def judged(pairs: DataFrame, model: Model) -> DataFrame:
    """``kind, rec_key, view_idx, defect, in_order`` of ``kind, rec_key, view_idx, prompt, answer``, a row for each
    defective pair. Map-only; a pair of texts that comes again in a batch is judged once."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    names = ["kind", "rec_key", "view_idx", "defect", "in_order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            known: dict[tuple[str | None, str | None], tuple[str | None, float]] = {}
            found = []
            for pair in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if (got := known.get(pair)) is None:
                    got = known[pair] = judge(*pair, m)
                found.append(got)
            keep = pa.array([x is not None for x, _ in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=names).filter(keep)

    return pairs.select("kind", "rec_key", "view_idx", "prompt", "answer").mapInArrow(run, "kind string, rec_key string, view_idx int, defect string, in_order double")


def defects(pairs: DataFrame, model: Model) -> DataFrame:
    """``kind, rec_key, view_idx, defect`` of the defective pairs."""
    return judged(pairs, model).drop("in_order")


def unanswered(text: str | None) -> bool:
    """Whether a text is an empty answer or a refusal: those are not called cut."""
    return is_empty(text) or is_refusal(text)
