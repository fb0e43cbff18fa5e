"""Word sets for similarity joins: sets as sorted arrays of 64-bit word hashes, and the keys under which sets must
meet.

Two sets of sizes a and b with Jaccard similarity >= t > 1/2 have o >= t (a + b) / (1 + t) words in common and
a + b - 2 o that are not.

* Rare words. With the words of each set in one global order, rare ones first, the first common word stands among
  the first a - ceil(t a) + 1 of either. A set gives a key for each of these that is rare.
* Frequent words. If a set has r rare words and all of them gave keys, a partner that met under none has only
  frequent words in common with it. Put the frequent words of a set on a circle, in order of their hashes: of the
  o neighbouring pairs of common words every other word breaks at most one, so at least 3 o - a - b + r pairs of
  neighbours are on both circles, and the rarest of these is among the others less that many, plus one. A set gives
  a key for each of its rarest pairs of neighbours up to that number.

A set of n words gives at most (0.6 n + 1) keys at t = 0.7, whatever the collection holds: keys grow with the
length of a text and not with its square. What is frequent follows from counts of all sets in a fixed number of
hashed buckets, which bounds what is sent to tasks; it is relative to the mean bucket, so it means the same at every
size. Words that share a bucket only get a less exact place in the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.runtime import words

BUCKETS = 1 << 18
#: A word is frequent if its bucket counts more sets than this, and more than LOADED times the mean bucket.
FREQUENT = 1_000
LOADED = 4
#: Sets whose keys are made at once.
SETS_AT_ONCE = 2_000

_U = np.uint64


def word_hashes(text: Column) -> Column:
    """The distinct words of a text as sorted 64-bit hashes; null for a null text."""
    return F.sort_array(F.array_distinct(F.transform(F.array_distinct(words(text)), lambda w: F.xxhash64(w))))


def bucket_counts(sets: DataFrame, hashes: str = "hashes") -> tuple[np.ndarray, int]:
    """In how many sets the words of each bucket are, and the number of sets. At most BUCKETS rows come to the
    driver, whatever the collection."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    got = sets.select(F.explode(hashes).alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("b")).count().toArrow()
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return counts, sets.count()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(_U) * _U(0x9E3779B97F4A7C15) + b.astype(_U)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[i] entries: (i, 0..count[i]-1)."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def least_common(sizes: np.ndarray, t: Fraction, run: int = 1) -> np.ndarray:
    """How many runs of ``run`` neighbours on its circle a set has in common with any set similar to it, at least:
    o - (run - 1) (a + b - 2 o), for the smallest partner. No bound (0 or less) where run >= 1 / (1 - t)."""
    p, q = t.numerator, t.denominator
    both = sizes + -(-sizes * p // q)
    return -(-both * (run * p - (run - 1) * q) // (p + q))


def may_differ(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether a set of this size can be similar to one that is not its equal."""
    p, q = t.numerator, t.denominator
    return (sizes * q >= (sizes + 1) * p) | ((sizes - 1) * q >= sizes * p)


def place(of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of each entry within its set, for entries in order of their sets."""
    return np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]


def meeting_keys(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, n_sets: int, t: Fraction, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Set number and key (uint64) of every key of the sets, whose hashes stand one after another in ``flat``."""
    if 2 * t <= 1:
        raise ValueError("the similarity must be over 1/2")
    live, of = may_differ(sizes, t), np.repeat(np.arange(len(sizes)), sizes)
    flat, of, sizes = flat[live[of]], of[live[of]], np.where(live, sizes, 0)
    postings = int(counts.sum())
    limit = max(frequent, LOADED * postings // BUCKETS)
    df = counts[flat.astype(np.int64) % BUCKETS]
    hot = df > limit
    rare = np.bincount(of[~hot], minlength=len(sizes))
    spare = sizes + (-sizes * t.numerator // t.denominator)
    # rare words, the rarest first
    word, home, seen = flat[~hot], of[~hot], df[~hot]
    order = np.lexsort((word, seen, home))
    word, home = word[order], home[order]
    first = place(home, rare) <= spare[home]
    owners, keys = [home[first]], [mix(word[first], np.full(first.sum(), 1))]
    # neighbours on the circle of frequent words
    several = np.where(rare <= spare, sizes - rare, 0)
    want = several - (least_common(sizes, t, 2) + rare) + 1
    pick = hot & (several[of] > 0) & (want[of] > 0)
    word, home, seen = flat[pick], of[pick], df[pick]
    order = np.lexsort((word, home))
    word, home, seen = word[order].astype(_U), home[order], np.log(seen[order])
    n = np.bincount(home, minlength=len(sizes))
    start = np.cumsum(n) - n
    nxt = np.arange(len(word)) + 1
    end = start + n
    nxt = np.where(nxt == end[home], start[home], nxt)
    gap = (word[nxt] - word).astype(np.float64) / 2.0**64
    weight = seen + seen[nxt] - gap * (postings / max(1, n_sets))  # how often both are there with nothing between
    pair = mix(mix(word, word[nxt]), np.full(len(word), 2))
    order = np.lexsort((pair, weight, home))
    kept = order[place(home[order], n) < want[home[order]]]
    owners.append(home[kept])
    keys.append(pair[kept])
    return np.concatenate(owners), np.concatenate(keys)


def bitmaps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """256 bits for each set, one set by each word: four uint64 columns."""
    h = flat.astype(_U) * _U(0x9E3779B97F4A7C15)
    bit = (h >> _U(56)).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    maps = np.zeros((len(sizes), 4), dtype=_U)
    np.bitwise_or.at(maps, (of, bit >> 6), _U(1) << (bit & 63).astype(_U))
    return maps


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and the lengths. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def keyed_sets(batches: Iterator[pa.RecordBatch], counts: dict[str, tuple[np.ndarray, int]], t: Fraction, frequent: int):
    """Of batches of ``kind, cid, hashes``, for some sets at a time: their cids, hashes and sizes, and the set and
    key of each of their keys. Kinds never meet."""
    for whole in batches:
        for at in range(0, whole.num_rows, SETS_AT_ONCE):
            batch = whole.slice(at, SETS_AT_ONCE)
            kinds = np.array(batch.column(0).to_pylist(), dtype=object)
            flat_all, sizes_all = lists(batch.column(2))
            cid = batch.column(1).to_numpy()
            ends = np.cumsum(sizes_all)
            for number, kind in enumerate(sorted(counts)):
                pick = np.flatnonzero(kinds == kind)
                if len(pick) == 0:
                    continue
                sizes = sizes_all[pick]
                e, k = expand(sizes)
                flat = flat_all[(ends[pick] - sizes)[e] + k]
                owner, key = meeting_keys(flat, sizes, *counts[kind], t, frequent)
                yield cid[pick], flat, sizes, owner, mix(key, np.full(len(key), number + 11))


def may_reach(n_a: np.ndarray, n_b: np.ndarray, maps_a: np.ndarray, maps_b: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether the bit counts leave room for similarity t: each bit that differs is a word not in common."""
    apart = np.bitwise_count(maps_a ^ maps_b).sum(axis=1, dtype=np.int64)
    total = n_a + n_b
    most = (total - apart) // 2
    return most * (t.numerator + t.denominator) >= total * t.numerator


def similar(a: Column, b: Column, t: Fraction) -> Column:
    """Exact: overlap / union >= t, of two sorted arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("bigint")
    return both * (t.numerator + t.denominator) >= (F.size(a) + F.size(b)).cast("bigint") * t.numerator
