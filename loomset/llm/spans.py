"""Problem 10: long verbatim spans that several documents share.

1. Anchors. Of every stretch of ``min_chars`` code points the phrase of ``phrase_chars`` with the least hash is
   kept (winnowing), so documents that share such a stretch keep the same phrase inside it. Each document
   keeps about two phrases for each stretch length; no stretch is left out.
2. Recurring phrases: those that more than one document keeps, counted with map-side combining. A phrase goes, once,
   to every shard of documents in which one keeps it.
3. Each task compiles the recurring phrases of a shard of documents into an Aho-Corasick automaton and streams all
   documents of the shard through it. The automaton locates every occurrence; the hashes only say which phrases a
   shard needs. An automaton holds no more phrases than its shard has anchors, so shards bound its size.
4. Around every occurrence stands its context: the phrase and as much text on either side as a stretch can reach.
   Equal contexts form one class, with the places that have it. The classes of a phrase are compared to the left and
   right: equal ones once, others only if they agree over half the distance on one side, as any shared stretch
   must. A phrase with very many occurrences is parted by the windows around it; what still has very many classes
   is compared in pairs of blocks, so no task holds an unbounded group.

Whole texts that are equal are collapsed before step 2 and stand for all their copies again in the pairs. How much of
a document is shared follows from the classes alone, without pairs of documents.

Defined results: null, empty and short texts (under ``min_chars``) share nothing; a stretch repeated inside one
document is no pair; copies are pairs; text counts verbatim, case, blanks and line ends included; further
columns are never read; an id with several texts stands for all of them; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.runtime import materialize

MIN_CHARS, PHRASE_CHARS = 320, 64
BATCH_CHARS = 1 << 22  # code points hashed at once; a longer document is hashed alone
#: Code points of documents in a shard, about; one automaton is compiled for each.
SHARD_CHARS = 2_000_000
#: Contexts of a key that are compared in place, and at most how many keys can be too large.
GROUP, HOT_KEYS = 20_000, 100_000
#: A phrase with more occurrences is parted by the text around it; see ``_locate``.
HOT_PHRASE, HOT_STEP = 2_000, 16

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, _U(b))
            p[0] = _U(1)
            both.append(np.cumprod(p, dtype=_U))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def phrase_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k code points from each position, equal for equal phrases wherever they stand."""
    n = len(codes)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def anchors(texts: list[str], min_chars: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of at least ``min_chars``: hash, number of the text, and position of each kept phrase."""
    w = min_chars - k + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = phrase_hashes(codes, k)
    m = len(h)
    bits = _U(max(1, int(m).bit_length()))
    low = (_U(1) << bits) - _U(1)
    packed = ((h >> bits) << bits) | (low - np.arange(m, dtype=_U))  # ties go to the right
    blocks = -(-m // w) + 1
    x = np.full(blocks * w, _U(2**64 - 1))
    x[:m] = packed
    x = x.reshape(blocks, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    lens = np.array([len(t) for t in texts])
    starts = np.cumsum(lens) - lens
    ok = np.zeros(m - w + 1, dtype=bool)
    for s, n in zip(starts.tolist(), lens.tolist()):
        ok[s : s + n - min_chars + 1] = True
    at = np.unique((low - (least[ok] & low)).astype(np.int64))
    doc = np.searchsorted(starts, at, side="right") - 1
    return h[at], doc, at - starts[doc]


def _anchor_rows(min_chars: int, k: int):
    names = ["h", "doc", "pos"]

    def give(docs: list[int], texts: list[str]) -> pa.RecordBatch:
        h, doc, pos = anchors(texts, min_chars, k)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(docs, dtype=np.int64)[doc]), pa.array(pos.astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size + len(text) > BATCH_CHARS and docs:
                    yield give(docs, texts)
                    docs, texts, size = [], [], 0
                docs.append(doc)
                texts.append(text)
                size += len(text)
        if docs:
            yield give(docs, texts)

    return run


def _locate(min_chars: int, k: int):
    """For cogrouped shards, documents ``shard, doc, text`` and phrases ``shard, h, doc, pos, n`` (h null: a copy, to be
    passed over): the contexts of all occurrences of the phrases in the documents, by the key under which they meet:
    the phrase's hash or, for a phrase with very many occurrences, the windows around it, at every HOT_STEP-th place,
    that a shared stretch must hold whole, so only documents that agree over nearly ``min_chars`` meet."""
    import ahocorasick

    reach = min_chars - k

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        h, home, pos, n = (phrases.column(c).to_pylist() for c in ("h", "doc", "pos", "n"))
        skip = {d for x, d in zip(h, home) if x is None}
        texts: dict[int, list[str]] = defaultdict(list)
        for d, t in zip(docs.column("doc").to_pylist(), docs.column("text").to_pylist()):
            if d not in skip and t not in texts[d]:
                texts[d].append(t)
        automaton = ahocorasick.Automaton()
        for x, d, at, many in zip(h, home, pos, n):
            if x is not None:
                named = [t[at : at + k] for t in texts[d] if len(t) >= at + k]
                if len(named) > 1:  # an id with several texts: the one that has the phrase there
                    named = [t for t in named if phrase_hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), k).view(np.int64)[0] == x]
                automaton.add_word(named[0], (x, many > HOT_PHRASE))
        found: dict[tuple[int, int, str], list[tuple[int, int]]] = defaultdict(list)
        if len(automaton):
            automaton.make_automaton()
            for doc, text in ((d, t) for d, ts in texts.items() for t in ts):
                for end, (x, hot) in automaton.iter(text):
                    at = end - k + 1
                    a = max(0, at - reach)
                    seg, off = text[a : at + k + reach], at - a
                    if len(seg) < min_chars:
                        continue
                    keys = [x]
                    if hot:
                        keys = [hash64(f"{x} {b} {seg[off - b : off - b + min_chars - HOT_STEP]}") for b in range(0, min(off, reach) + 1, HOT_STEP) if len(seg) - off + b >= min_chars - HOT_STEP]
                    for key in keys:
                        found[key, off, seg].append((doc, at))
        return pa.table({
            "key": pa.array([x[0] for x in found], pa.int64()), "off": pa.array([x[1] for x in found], pa.int32()), "seg": pa.array([x[2] for x in found], pa.string()),
            "docs": pa.array([[d for d, _ in x] for x in found.values()], pa.list_(pa.int64())), "at": pa.array([[p for _, p in x] for x in found.values()], pa.list_(pa.int32())),
        })

    return run


CONTEXTS = "key bigint, off int, seg string, docs array<bigint>, at array<int>"


def _sides(segs: list[str], offs: list[int], k: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What stands left of the phrase, from it outwards, and right of it, as padded matrices with lengths."""
    n = len(segs)
    left, right = np.zeros((n, reach), dtype=np.uint32), np.zeros((n, reach), dtype=np.uint32)
    ll, rl = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, (seg, off) in enumerate(zip(segs, offs)):
        codes = np.frombuffer(seg.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ll[i], rl[i] = off, len(codes) - off - k
        left[i, : ll[i]] = codes[:off][::-1]
        right[i, : rl[i]] = codes[off + k :]
    return left, ll, right, rl


def _common(side: np.ndarray, size: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    differ = side[js] != side[i]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    return np.minimum(first, np.minimum(size[i], size[js]))


def _class_pairs(segs: list[str], offs: list[int], min_chars: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of distinct segments around one phrase: i, the js > i that share a stretch with it, and how far both
    agree to the left and right."""
    n, reach = len(segs), min_chars - k
    left, ll, right, rl = _sides(segs, offs, k, reach)
    half = reach // 2
    near: dict[int, list[np.ndarray]] = defaultdict(list)
    if n <= 16:
        for i in range(n - 1):
            near[i] = [np.arange(i + 1, n)]
    else:  # a stretch reaches at least half the distance on one side
        for side, size in ((left, ll), (right, rl)):
            same: dict[bytes, list[int]] = defaultdict(list)
            for i in np.flatnonzero(size >= half).tolist():
                same[side[i, :half].tobytes()].append(i)
            for group in same.values():
                members = np.array(group)
                for a in range(len(members) - 1):
                    near[int(members[a])].append(members[a + 1 :])
    for i, found in near.items():
        js = np.unique(np.concatenate(found))
        for a in range(0, len(js), 4096):
            part = js[a : a + 4096]
            l, r = _common(left, ll, i, part), _common(right, rl, i, part)
            ok = l + r >= reach
            if ok.any():
                yield i, part[ok], l[ok], r[ok]


def _grouped(compare):
    """For mapInArrow over ``key, other, blk, off, seg, docs, at`` in order of key and other: ``compare`` on the classes
    of each group. A class is a block, an offset, a context and the places (document, position) that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, int, str], list] = defaultdict(list)
        last = None
        for batch in batches:
            for key, other, blk, off, seg, docs, at in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (key, other) != last:
                    if classes:
                        yield from compare(list(classes), [np.array(x, dtype=np.int64) for x in classes.values()])
                    classes.clear()
                    last = (key, other)
                classes[blk, off, seg].extend(zip(docs, at))
        if classes:
            yield from compare(list(classes), [np.array(x, dtype=np.int64) for x in classes.values()])

    return run


def _met(classes: list, min_chars: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``_class_pairs`` of the classes of a group; of two blocks, those across."""
    blk = np.array([x[0] for x in classes])
    for i, js, l, r in _class_pairs([x[2] for x in classes], [x[1] for x in classes], min_chars, k):
        ok = (blk[js] != blk[i]) | (blk[i] < 0)
        if ok.any():
            yield i, js[ok], l[ok], r[ok]


def _pair_rows(min_chars: int, k: int):
    """The pairs of documents of each group of classes."""
    at_once = 1 << 18

    def product(p: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
        for a in range(0, len(p), 512):
            for b in range(0, len(q), 512):
                x, y = np.repeat(p[a : a + 512], len(q[b : b + 512])), np.tile(q[b : b + 512], len(p[a : a + 512]))
                differ = x != y
                yield np.stack((np.minimum(x, y)[differ], np.maximum(x, y)[differ]))

    def compare(classes: list, members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        docs = [np.unique(m[:, 0]) for m in members]
        if len(docs) == 1 and len(docs[0]) < 2:
            return
        held, size = [], 0

        def give() -> pa.RecordBatch:
            got = np.unique(np.concatenate(held, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["doc_a", "doc_b"])

        def made() -> Iterator[np.ndarray]:
            for (blk, *_), d in zip(classes, docs):
                if blk < 0 and len(d) > 1:
                    yield from product(d, d)
            if len(classes) > 1:
                for i, js, _, _ in _met(classes, min_chars, k):
                    yield from product(docs[i], np.unique(np.concatenate([docs[j] for j in js])))

        for x in made():
            held.append(x)
            size += x.shape[1]
            if size > at_once:
                yield give()
                held, size = [], 0
        if size:
            yield give()

    return _grouped(compare)


def _reach_rows(min_chars: int, k: int):
    """How far each place shares its context with other documents: ``doc, s, e``. All that a place shares around a
    phrase holds the phrase, so it is one stretch: as far to the left, and to the right, as with any."""

    def compare(classes: list, members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        docs = [np.unique(m[:, 0]) for m in members]
        near: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # partner's only document or -1, left, right
        sole = [int(d[0]) if len(d) == 1 else -1 for d in docs]
        for i, (blk, off, seg) in enumerate(classes):
            if blk < 0 and len(docs[i]) > 1:
                near[i].append((-1, off, len(seg) - off - k))
        if len(classes) > 1:
            for i, js, l, r in _met(classes, min_chars, k):
                for j, a, b in zip(js.tolist(), l.tolist(), r.tolist()):
                    near[i].append((sole[j], a, b))
                    near[j].append((sole[i], a, b))
        out = []
        for i, found in near.items():
            known = np.array(found)
            for own in {int(d) for d in docs[i]} & {x[0] for x in found} or {-2}:  # documents that some partner is only of
                other = known[known[:, 0] != own]
                places = members[i] if own < -1 else members[i][members[i][:, 0] == own]
                if len(other):
                    out.append((places[:, 0], places[:, 1] - other[:, 1].max(), places[:, 1] + k + other[:, 2].max()))
            rest = np.isin(members[i][:, 0], known[:, 0])
            if rest.any() and not rest.all():
                places = members[i][~rest]
                out.append((places[:, 0], places[:, 1] - known[:, 1].max(), places[:, 1] + k + known[:, 2].max()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["doc", "s", "e"])

    return _grouped(compare)


def _copies(documents: DataFrame) -> DataFrame:
    """``doc, rep``: documents whose whole text has a copy with a smaller id."""
    same = documents.select("doc", F.xxhash64("text").alias("x"), F.xxhash64(F.lit("second"), "text").alias("y"))
    least = same.groupBy("x", "y").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return same.join(least, ["x", "y"]).filter("doc > rep").select("doc", "rep")


def contexts(documents: DataFrame, id_col: str, text_col: str, min_chars: int, phrase_chars: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``key, other, blk, off, seg, docs, at``, the contexts of recurring phrases, in the groups in which
    they are to be compared; and ``doc, rep`` for copies of whole texts."""
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
    copies = materialize(_copies(docs), "copies")
    kept = materialize(docs.mapInArrow(_anchor_rows(min_chars, phrase_chars), "h bigint, doc bigint, pos int").join(copies, "doc", "left_anti"), "anchors")
    n_shards = 1 + kept.count() * (min_chars - phrase_chars) // (2 * SHARD_CHARS)
    shard = F.pmod(F.xxhash64("doc"), F.lit(n_shards)).cast("int").alias("shard")
    recurring = kept.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).filter("a < b").select("h", "n")
    needed = kept.groupBy(shard, "h").agg(F.min(F.struct("doc", "pos")).alias("p")).join(recurring, "h").select("shard", "h", "p.doc", "p.pos", "n")
    passed = copies.select(shard, F.lit(None).cast("bigint").alias("h"), "doc", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("n"))
    found = docs.select(shard, "doc", "text").groupBy("shard").cogroup(needed.unionByName(passed).groupBy("shard")).applyInArrow(_locate(min_chars, phrase_chars), CONTEXTS)
    found = materialize(found, "contexts")
    # keys with very many contexts are compared in pairs of blocks
    sizes = found.groupBy("key").agg(F.count("*").alias("n"))
    limit = max(GROUP, found.count() // HOT_KEYS)
    hot = sizes.filter(F.col("n") > limit).select("key", F.ceil(F.col("n") / F.lit(GROUP)).cast("int").alias("parts"))
    known = found.join(F.broadcast(hot), "key", "left")  # at most HOT_KEYS rows
    many = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("off", "seg", F.get("docs", F.lit(0))), many).cast("int").alias("mine")
    spread = known.select("key", mine, F.explode(F.sequence(F.lit(0), many - 1)).alias("to"), "off", "seg", "docs", "at")
    blk = F.when(F.col("mine") == F.col("to"), -1).otherwise(F.col("mine"))
    pair = F.least("mine", "to").cast("bigint") * F.lit(1 << 32) + F.greatest("mine", "to")
    return spread.select("key", pair.alias("other"), blk.alias("blk"), "off", "seg", "docs", "at").repartition("key", "other").sortWithinPartitions("key", "other"), copies


def shared_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, phrase_chars: int = PHRASE_CHARS) -> DataFrame:
    """``doc_a, doc_b``, doc_a < doc_b: documents with a stretch of at least ``min_chars`` in common."""
    found, copies = contexts(documents, id_col, text_col, min_chars, phrase_chars)
    pairs = materialize(found.mapInArrow(_pair_rows(min_chars, phrase_chars), "doc_a bigint, doc_b bigint").distinct(), "pairs")
    # every copy stands for its text: beside the pairs' own ends, and with the other copies
    group = copies.unionByName(copies.select(F.col("rep").alias("doc"), "rep").distinct())
    out = pairs
    for end, other in (("doc_a", "doc_b"), ("doc_b", "doc_a")):
        more = out.join(copies.withColumnRenamed("rep", end), end).select(F.col("doc").alias(end), other)
        out = out.unionByName(more.select("doc_a", "doc_b"))
    within = group.select("rep", F.col("doc").alias("doc_a")).join(group.select("rep", F.col("doc").alias("doc_b")), "rep").filter("doc_a < doc_b").select("doc_a", "doc_b")
    return out.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).unionByName(within)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for found in batch.column(1).to_pylist():
            total, at = 0, -1
            for x in sorted(found, key=lambda x: (x["s"], x["e"])):
                total += max(0, x["e"] - max(x["s"], at))
                at = max(at, x["e"])
            out.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "n_shared"])


def coverage(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, phrase_chars: int = PHRASE_CHARS) -> DataFrame:
    """``doc_id, n_chars, n_shared, share``, a row for each document: how many of its code points lie in
    stretches that another document holds too. No pairs of documents are made."""
    found, copies = contexts(documents, id_col, text_col, min_chars, phrase_chars)
    ends = found.mapInArrow(_reach_rows(min_chars, phrase_chars), "doc bigint, s bigint, e bigint")
    # a document has few starts; of each the furthest end is enough
    most = ends.groupBy("doc", "s").agg(F.max("e").alias("e")).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    shared = most.mapInArrow(_merged, "doc_id bigint, n_shared bigint")
    whole = copies.select("doc").union(copies.select("rep")).distinct().select(F.col("doc").alias("doc_id"), F.lit(True).alias("copied"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", n.alias("n_chars"))
    got = docs.join(shared, "doc_id", "left").join(whole, "doc_id", "left")
    total = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("n_shared", F.lit(0)))
    return got.select("doc_id", "n_chars", total.cast("bigint").alias("n_shared"), F.when(F.col("n_chars") > 0, F.round(total / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))
