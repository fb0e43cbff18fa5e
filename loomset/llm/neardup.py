"""Problem 1: records that share most of their words although small edits, additions or a new order set them
apart.

Sets of words that are equal form one class, which is compared once. Classes meet under the keys of
``setsim``; within a key they lie in order of size, and each is compared with the tile of those not larger
than its size allows. A hashed bitmap for each set bounds the overlap from above by bit counts; what passes
is decided by exact intersection of the sorted arrays.

Keys with very many sets are counted before anything gathers them: first in hashed buckets, then, of the keys in
full buckets, one by one. Their sets go to the tasks in blocks, each pair of blocks a key of its own, so no task
holds an unbounded group and none is cut short.

The operator's result are links between classes and the membership of records; pairs of records are made from them
only where they are asked for.

Defined results: a key delivered several times counts once, by its last delivery (``at``, ties by the greater digest
of the words); null keys and texts without a word take no part; copies are one class; a text is used whole;
further columns are never read; empty tables give no rows; classes are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import setsim
from loomset.runtime import materialize

TILE_GROUP = 20_000  # sets under one key that are compared in place
BLOCK = 10_000
#: Keys that are sent to all tasks as too large are at most this many; a key is too large from 1 / HOT_KEYS of all
#: rows, or TILE_GROUP.
HOT_KEYS = 100_000
KEY_BUCKETS = 1 << 18
PAIRS_AT_ONCE = 1 << 19
#: Members of a class that one task joins to its links.
MEMBERS = 50_000

POSTINGS = "key bigint, cid bigint, n int, blk int, b0 bigint, b1 bigint, b2 bigint, b3 bigint"


def _bucket_rows(counts: dict, t: Fraction, frequent: int):
    """For mapInArrow over ``kind, cid, hashes``: how many keys of the task fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(KEY_BUCKETS, dtype=np.int64)
        for *_, key in setsim.keyed_sets(batches, counts, t, frequent):
            n += np.bincount((key % np.uint64(KEY_BUCKETS)).astype(np.int64), minlength=KEY_BUCKETS)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full])], names=["bucket", "n"])

    return run


def _keys_in(buckets: np.ndarray, counts: dict, t: Fraction, frequent: int):
    """For mapInArrow: the keys that fall into the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, key in setsim.keyed_sets(batches, counts, t, frequent):
            key = key[np.isin((key % np.uint64(KEY_BUCKETS)).astype(np.int64), buckets)]
            values, n = np.unique(key.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["key", "n"])

    return run


def hot_keys(sets: DataFrame, counts: dict, t: Fraction, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that more sets have than one task compares in place, in order, and how many have them."""
    buckets = sets.mapInArrow(_bucket_rows(counts, t, frequent), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = buckets.column(1).to_numpy()
    limit = max(TILE_GROUP, int(n.sum()) // HOT_KEYS)
    full = np.sort(buckets.column(0).to_numpy()[n > limit])
    if len(full) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found = sets.mapInArrow(_keys_in(full, counts, t, frequent), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).toArrow()
    key, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _posting_rows(counts: dict, t: Fraction, frequent: int, hot: tuple[np.ndarray, np.ndarray]):
    """For mapInArrow: a row for each key of each set, with its bitmap. A set under a hot key is in a block of it
    and goes to all pairs of blocks it is in; ``blk`` is the block, -1 where the sets are all of one block."""
    hot_key, hot_n = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, flat, sizes, owner, key in setsim.keyed_sets(batches, counts, t, frequent):
            maps = setsim.bitmaps(flat, sizes).view(np.int64)
            many = np.ones(len(key), dtype=np.int64)
            if len(hot_key):
                at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                many = np.where(hot_key[at] == key, -(-hot_n[at] // BLOCK), 1)
            total, a = np.cumsum(many), 0
            while a < len(key):  # a row under a very hot key becomes many
                z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
                row, other = setsim.expand(many[a:z])
                of, k, n = owner[a:z][row], key[a:z][row], many[a:z][row]
                mine = (setsim.mix(cid[of], np.full(len(of), 5)) % n.astype(np.uint64)).astype(np.int64)
                pair = setsim.mix(setsim.mix(k, np.minimum(mine, other)), np.maximum(mine, other))
                blk = np.where((n == 1) | (mine == other), -1, mine).astype(np.int32)
                columns = [np.where(n == 1, k, pair).view(np.int64), cid[of], sizes[of].astype(np.int32), blk, *(maps[of, c] for c in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["key", "cid", "n", "blk", "b0", "b1", "b2", "b3"])
                a = z

    return run


def _tiles(t: Fraction):
    """For mapInArrow over postings in order of key and size: candidate pairs ``a, b``."""

    def pairs(key: np.ndarray, cid: np.ndarray, n: np.ndarray, blk: np.ndarray, maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        place = (group.astype(np.int64) << 32) + n
        last = np.searchsorted(place, (group.astype(np.int64) << 32) + n * t.denominator // t.numerator, side="right")
        count = last - np.arange(len(key)) - 1
        total = np.cumsum(count)
        a = 0
        while a < len(key):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
            e, k = setsim.expand(count[a:z])
            i = e + a
            j = i + 1 + k
            ok = setsim.may_reach(n[i], n[j], maps[i], maps[j], t) & (cid[i] != cid[j])
            ok &= (blk[i] != blk[j]) | (blk[i] < 0)  # sets of one block are compared under a key of their own
            i, j = i[ok], j[ok]
            a = z
            if len(i):
                got = np.unique(np.stack((np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def whole() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held)]

        def give(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            # rows whose key no neighbour shares have nobody to meet
            same = c[0][1:] == c[0][:-1]
            met = np.append(same, False) | np.insert(same, 0, False)
            c = [x[met] for x in c]
            if len(c[0]):
                yield from pairs(*c[:4], np.stack(c[4:8], axis=1))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = [batch.column(x).to_numpy() for x in range(8)]
            c[2] = c[2].astype(np.int64)
            c[4:8] = [x.view(np.uint64) for x in c[4:8]]
            held.append(c)
            rows += batch.num_rows
            if rows > 50_000 and c[0][-1] != held[0][0][0]:
                c = whole()
                cut = int(np.searchsorted(c[0] == c[0][-1], True))
                yield from give([x[:cut] for x in c])
                held, rows = [[x[cut:] for x in c]], len(c[0]) - cut
        if held:
            yield from give(whole())

    return run


def candidate_pairs(classes: DataFrame, counts: dict, t: Fraction, frequent: int = setsim.FREQUENT) -> DataFrame:
    """``a, b``: pairs of class ids that the bitmaps leave possible, each once. ``classes``: kind, cid, hashes."""
    sets = classes.select("kind", "cid", "hashes")
    postings = sets.mapInArrow(_posting_rows(counts, t, frequent, hot_keys(sets, counts, t, frequent)), POSTINGS)
    return postings.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_tiles(t), "a bigint, b bigint").distinct()


def word_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``kind, key, text`` and, where keys are delivered several times, ``at``: members ``kind, key, cid, second``
    and classes ``kind, cid, second, hashes, class_id, n_copies``, of the texts with a word. ``cid`` and ``second`` are
    the digest of the words. Texts are parsed where they are read; digests and word hashes are what is sent."""
    at = F.col("at") if "at" in records.columns else F.lit(0)
    hashes = setsim.word_hashes(F.col("text")).alias("hashes")
    rows = records.filter(F.col("key").isNotNull()).select("kind", "key", at.alias("at"), hashes)
    some = F.size("hashes") > 0
    rows = materialize(rows.select("kind", "key", "at", F.when(some, F.xxhash64("kind", "hashes")).alias("cid"), F.when(some, F.xxhash64(F.lit("second"), "kind", "hashes")).alias("second"), F.when(some, F.col("hashes")).alias("hashes")), "words")
    last = rows.groupBy("kind", "key").agg(F.max(F.struct("at", "cid", "second")).alias("p"))
    members = materialize(last.filter("p.cid is not null").select("kind", "key", "p.cid", "p.second"), "members")
    named = members.groupBy("kind", "cid", "second").agg(F.min("key").alias("class_id"), F.count("*").alias("n_copies"))
    sets = rows.filter("cid is not null").groupBy("kind", "cid", "second").agg(F.first("hashes").alias("hashes"))
    return members, materialize(named.join(sets, ["kind", "cid", "second"]), "classes")


def class_links(classes: DataFrame, t: Fraction, frequent: int = setsim.FREQUENT) -> DataFrame:
    """``kind, a, a2, b, b2``: pairs of classes of one kind, by both their digests, whose word similarity is at
    least t, decided exactly."""
    kinds = [r[0] for r in classes.select("kind").distinct().collect()]
    counts = {k: setsim.bucket_counts(classes.filter(F.col("kind") == k)) for k in kinds}
    found = candidate_pairs(classes, counts, t, frequent)
    one = classes.select(F.col("cid").alias("a"), "kind", F.col("second").alias("a2"), F.col("hashes").alias("x"))
    other = classes.select(F.col("cid").alias("b"), F.col("kind").alias("kind_b"), F.col("second").alias("b2"), F.col("hashes").alias("y"))
    near = setsim.similar(F.col("x"), F.col("y"), t) & (F.col("kind") == F.col("kind_b"))
    return found.join(one, "a").join(other, "b").filter(near).select("kind", "a", "a2", "b", "b2")


def near_duplicate_links(records: DataFrame, threshold: float, frequent: int = setsim.FREQUENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between classes (``class_links``), members and classes (``word_classes``)."""
    members, classes = word_classes(records)
    return class_links(classes, Fraction(str(threshold)), frequent), members, classes


def near_duplicates(records: DataFrame, threshold: float = 0.7, frequent: int = setsim.FREQUENT) -> DataFrame:
    """``kind, key_a, key_b`` of ``kind, key, text``: all pairs with word similarity >= threshold. Classes with
    very many members are salted: their members are spread over parts, and links go to each part."""
    links, members, classes = near_duplicate_links(records, threshold, frequent)
    total = classes.agg(F.sum("n_copies")).first()[0] or 0
    by = ["kind", "cid", "second"]
    hot = classes.filter(F.col("n_copies") > max(MEMBERS, total // HOT_KEYS)).select(*by, F.ceil(F.col("n_copies") / F.lit(MEMBERS)).cast("int").alias("parts"))

    def parted(rows: DataFrame, part) -> DataFrame:
        known = rows.join(F.broadcast(hot), by, "left")  # at most HOT_KEYS rows
        return known.withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("parts")

    in_one = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    in_all = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = parted(members, in_one)
    from_a = parted(links.withColumnsRenamed({"a": "cid", "a2": "second"}), in_all).join(placed.withColumnRenamed("key", "p"), [*by, "part"]).select("kind", "p", F.col("b").alias("cid"), F.col("b2").alias("second"))
    across = parted(from_a, in_all).join(placed.withColumnRenamed("key", "q"), [*by, "part"])
    copied = members.join(classes.filter("n_copies > 1").select(*by), by, "left_semi")
    within = parted(copied.withColumnRenamed("key", "p"), in_all).join(parted(copied, in_one).withColumnRenamed("key", "q"), [*by, "part"]).filter("p < q")
    both = across.select("kind", "p", "q").unionByName(within.select("kind", "p", "q"))
    return both.select("kind", F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b"))


def near_duplicate_groups(records: DataFrame, threshold: float = 0.8, frequent: int = setsim.FREQUENT) -> DataFrame:
    """``kind, key, class_id, n_copies, n_links``, a row for each record with a word: its class of equal word
    sets (the smallest key in it), the records in the class, and the other classes it is similar to."""
    links, members, classes = near_duplicate_links(records, threshold, frequent)
    by = ["kind", "cid", "second"]
    ends = links.select("kind", F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("a2").alias("second")), F.struct(F.col("b").alias("cid"), F.col("b2").alias("second")))).alias("e"))
    counted = ends.groupBy("kind", "e.cid", "e.second").agg(F.count("*").alias("n_links"))
    per = classes.select(*by, "class_id", "n_copies").join(counted, by, "left")
    return members.join(per, by).select("kind", "key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
