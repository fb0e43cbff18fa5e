"""Problem 6: records of evaluation splits that are also, exactly or almost, in the training split.

Evaluation texts are indexed as sequences of words, in shards of bounded size and of texts of like size: a compressed
full-text index for each, built in a task. A shard at a time is sent to all tasks, and the training texts whose size
allows a similar one, which are not shuffled, are streamed through backward search.

Words stand in an order in which texts of another order read alike: first those that are rare in the shard, then, on
a circle, those that are frequent, both by their hashes. Of two texts with similarity >= t, a and b words, and o of
them in common, either a rare word is in common, or all common words are on the circle, where the other words break
them into runs: o - (L - 1) (a + b - r - 2 o) runs of L neighbours at least are left whole, r being the rare words of
one. The backward search gives how often every rare word and every run of L = 1, 2, 3 .. words of a training text
occurs in the shard, without locating any. Of each text the L is taken with which, all but that many of its most
frequent runs left out, the fewest occurrences remain: this misses no similar text, and words that a third of all
texts have cost nothing as long as a text has others. The occurrences are located by sampled suffix positions and
joined along diagonals to maximal matches; spans and counts are merged for each pair of texts. Sizes and hashed
bitmaps bound the overlap, and exact intersection of the two sequences decides.

Defined results: a record delivered several times counts once, by its last delivery; null and wordless texts
overlap nothing; a record with several texts overlaps if one of them does; equal texts overlap; values of the
split that are neither training nor evaluation take no part; empty tables give no rows; texts are told apart by
128 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import setsim
from loomset.llm.fmindex import FMIndex, ranges
from loomset.runtime import materialize

#: How splits are named.
TRAIN, EVALUATION = ("", "train"), ("validation", "dev", "labelled_dev", "test")
#: Words of evaluation texts in a shard: what is sent to a task has this bound, about 20 bytes a word.
SHARD_WORDS = 1_000_000
#: A word in more texts of a shard than this goes on the circle. Shards have one size, so this means the same anywhere.
FREQUENT = 32
RATE = 2  # of the suffix positions that are kept
ROWS_AT_ONCE = 1 << 19
#: Keys of copies that one task joins to its pairs.
MEMBERS, HOT_TEXTS = 50_000, 100_000


def side(split: Column) -> Column:
    """``t`` for training, ``e`` for evaluation, else null."""
    s = F.lower(F.regexp_replace(F.coalesce(split, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(s.isin(*TRAIN), "t").when(s.isin(*EVALUATION), "e")


def longest_run(t: Fraction) -> int:
    """The greatest L < 1 / (1 - t): any two similar sets have a run of so many neighbours in common."""
    return -(-1 // (1 - t)) - 1 if t < 1 else 4


class Shard:
    """Evaluation sets as sequences of words in a full-text index. A circle ends with its first words again, so that
    runs over its end are found."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, t: Fraction):
        self.t, self.run = t, longest_run(t) + 1
        self.vocabulary, symbol = np.unique(flat, return_inverse=True)
        self.frequent = np.append(False, np.bincount(symbol) > FREQUENT)
        symbol, self.hot = self._ordered(symbol.astype(np.int64) + 1, sizes)
        over = np.minimum(self.run - 1, self.hot)
        whole = sizes + over + 1
        e, k = setsim.expand(whole)
        rare = sizes - self.hot
        start = np.cumsum(sizes) - sizes
        at = np.where(k < rare[e], k, rare[e] + (k - rare[e]) % np.maximum(self.hot, 1)[e])
        end = k == whole[e] - 1
        self.index = FMIndex(np.where(end, 0, symbol[start[e] + np.where(end, 0, at)]), RATE)
        self.begin = np.cumsum(whole) - whole  # of each sequence in the text
        self.symbol, self.start, self.sizes, self.ids = symbol.astype(np.int32), start, sizes, ids
        self.maps = setsim.bitmaps(flat, sizes)

    def _ordered(self, symbol: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare words before frequent ones, and how many are frequent. Symbols are numbered in order of hashes."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        hot = self.frequent[symbol]
        return symbol[np.lexsort((symbol, hot, of))], np.bincount(of[hot], minlength=len(sizes))

    def _runs(self, symbol: np.ndarray, of: np.ndarray, sizes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the run of each length from each place, lengths x places; of one word where it is rare."""
        n = len(symbol)
        circle = (np.cumsum(sizes) - hot)[of]  # where it begins
        lo, hi = np.zeros((self.run, n), dtype=np.int64), np.zeros((self.run, n), dtype=np.int64)
        rows = np.flatnonzero(symbol)
        lo[0, rows], hi[0, rows] = self.index.first[symbol[rows]], self.index.first[symbol[rows] + 1]
        rows = np.flatnonzero(self.frequent[symbol])
        for length in range(2, self.run + 1):  # the run of one word less from the next place, with the word before it
            nxt = circle[rows] + (rows - circle[rows] + 1) % hot[of[rows]]
            live = (hot[of[rows]] >= length) & (hi[length - 2, nxt] > lo[length - 2, nxt])
            at, nxt = rows[live], nxt[live]
            lo[length - 1, at], hi[length - 1, at] = self.index.extend(symbol[at], lo[length - 2, nxt], hi[length - 2, nxt])
        return lo, hi

    def stream(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For training sets: set, evaluation set, maximal matches and words in common, of each similar pair."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        maps = setsim.bitmaps(flat, sizes)
        symbol, hot = self._ordered(np.where(self.vocabulary[place] == flat, place + 1, 0), sizes)
        lo, hi = self._runs(symbol, of, sizes, hot)
        circle = self.frequent[symbol]
        rare, n_of = sizes - hot, of[circle]
        # the rarest of the rare words, as many as one of them must be in common, or all
        count = hi[0] - lo[0]
        spare = sizes - setsim.least_common(sizes, self.t)
        kept = ~circle
        order = np.flatnonzero(kept)
        order = order[np.lexsort((count[order], of[order]))]
        kept[order] = setsim.place(of[order], rare) <= spare[of[order]]
        single = kept & (count > 0)
        # what each length would cost each set whose rare words need not be in common
        keep, cost = [], []
        for length in range(1, self.run + 1):
            count = (hi[length - 1] - lo[length - 1])[circle]
            need = setsim.least_common(sizes, self.t, length) + (length - 1) * rare
            order = np.lexsort((count, n_of))
            kept = np.zeros(len(n_of), dtype=bool)
            kept[order] = setsim.place(n_of[order], hot) <= (hot - need)[n_of[order]]
            keep.append(np.zeros(len(of), dtype=bool))
            keep[-1][circle] = kept & (count > 0)
            cost.append(np.where((need > 0) & (length <= np.maximum(hot, 1)), np.bincount(n_of[kept], count[kept], minlength=len(sizes)), np.inf))
        best = self.run - 1 - np.argmin(np.stack(cost[::-1]), axis=0)  # the longest of equals
        best[rare > spare] = -1
        keep[0] = single | (keep[0] & (best[of] == 0))
        best[best == 0] = -1
        picked = [np.flatnonzero(k & ((best[of] == i) | (i == 0))) for i, k in enumerate(keep)]
        where = np.concatenate(picked)
        length = np.repeat(np.arange(1, self.run + 1), [len(x) for x in picked])
        low, high = lo[length - 1, where], hi[length - 1, where]
        order = np.argsort(where, kind="stable")
        where, low, high = where[order], low[order], high[order]
        total = np.cumsum(high - low)
        ends = np.append(np.flatnonzero(of[where][1:] != of[where][:-1]) + 1, len(where))  # sets stay whole
        a = 0
        while a < len(where):
            room = np.searchsorted(total, (total[a - 1] if a else 0) + ROWS_AT_ONCE, side="right")
            z = ends[max(np.searchsorted(ends, room, side="right") - 1, np.searchsorted(ends, a, side="right"))]
            parts = [self._matches(a, z, where, low, high, of, sizes, maps)] if total[z - 1] - (total[a - 1] if a else 0) <= 8 * ROWS_AT_ONCE else self._one_by_one(a, z, where, low, high, of, sizes, maps)
            for x, y in parts:
                for b in range(0, len(x), 50_000):
                    u, v = x[b : b + 50_000], y[b : b + 50_000]
                    n, both = self._common(symbol, sizes, u, v)
                    p, q = self.t.numerator, self.t.denominator
                    ok = both * (p + q) >= (sizes[u] + self.sizes[v]) * p
                    yield u[ok], self.ids[v[ok]], n[ok], both[ok]
            a = z

    def _one_by_one(self, a: int, z: int, where, low, high, *rest) -> Iterator[tuple[np.ndarray, ...]]:
        """A set whose runs occur very often, a block of occurrences at a time."""
        seen = np.zeros(len(self.sizes), dtype=bool)
        for i in range(a, z):
            for b in range(low[i], high[i], ROWS_AT_ONCE):
                x, y = self._matches(0, 1, where[i : i + 1], np.array([b]), np.array([min(high[i], b + ROWS_AT_ONCE)]), *rest)
                new = ~seen[y]
                seen[y] = True
                yield x[new], y[new]

    def _matches(self, a: int, z: int, where, low, high, of, sizes, maps) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that may be similar and share a run."""
        rows, i = ranges(low[a:z], high[a:z])
        i = i + a
        there = self.index.locate(rows)
        y = np.searchsorted(self.begin, there, side="right") - 1
        x = of[where[i]]
        n, m = sizes[x], self.sizes[y]
        p, q = self.t.numerator, self.t.denominator
        ok = (m * q >= n * p) & (n * q >= m * p)
        x, y = x[ok], y[ok]
        ok = setsim.may_reach(sizes[x], self.sizes[y], maps[x], self.maps[y], self.t)
        x, y = x[ok], y[ok]
        pair = np.unique(x.astype(np.int64) * len(self.sizes) + y)
        return pair // len(self.sizes), pair % len(self.sizes)

    def _common(self, symbol: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of sets the maximal matches of their sequences and the words in them, which are the words they
        share, exactly."""
        start = np.cumsum(sizes) - sizes
        e, k = setsim.expand(sizes[x])
        one = symbol[start[x][e] + k]
        e, k, one = e[one > 0], k[one > 0], one[one > 0]
        f, j = setsim.expand(self.sizes[y])
        width = len(self.vocabulary) + 1
        words = np.concatenate((e * width + one, f * width + self.symbol[self.start[y][f] + j]))  # distinct within a set
        order = np.argsort(words, kind="stable")
        hit = np.flatnonzero(words[order][1:] == words[order][:-1])
        here, there = order[hit], order[hit + 1] - len(e)
        pair, here, there = e[here], k[here], j[there]
        order = np.lexsort((here, pair))
        pair, here, there = pair[order], here[order], there[order]
        new = np.ones(len(pair), dtype=np.int64)
        new[1:] = (pair[1:] != pair[:-1]) | (here[1:] != here[:-1] + 1) | (there[1:] != there[:-1] + 1)
        return np.bincount(pair, new, minlength=len(x)).astype(np.int64), np.bincount(pair, minlength=len(x))


def _build(t: Fraction):
    """For applyInArrow over a shard's ``shard, cid, second, hashes``: its index, pickled."""

    def run(rows: pa.Table) -> pa.Table:
        flat, sizes = setsim.lists(rows.column("hashes"))
        ids = np.stack((rows.column("cid").to_numpy(), rows.column("second").to_numpy()), axis=1)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "data": pa.array([pickle.dumps(Shard(flat, sizes, ids, t))], pa.binary())})

    return run


MATCHES = "t_cid bigint, t_second bigint, e_cid bigint, e_second bigint, n_spans bigint, n_words bigint"


def _stream_rows(index):
    """For mapInArrow over ``cid, second, hashes`` of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = pickle.loads(index.value)
        for whole in batches:
            for at in range(0, whole.num_rows, setsim.SETS_AT_ONCE):
                batch = whole.slice(at, setsim.SETS_AT_ONCE)
                ids = np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy()), axis=1)
                _, first = np.unique(ids, axis=0, return_index=True)  # copies near each other go once
                flat, sizes = setsim.lists(batch.column(2).take(pa.array(first)))
                for x, e, spans, both in shard.stream(flat, sizes):
                    if len(x):
                        mine = ids[first[x]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (mine[:, 0], mine[:, 1], e[:, 0], e[:, 1], spans, both)], names=["t_cid", "t_second", "e_cid", "e_second", "n_spans", "n_words"])

    return run


def matches(rows: DataFrame, t: Fraction, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``t_cid, t_second, e_cid, e_second, n_spans, n_words`` of ``side, cid, second, hashes``: each pair of a
    training and an evaluation text that are similar, each once, with its maximal matches and the words in common. One pass over the training texts for each shard of evaluation texts."""
    spark = rows.sparkSession
    texts = rows.filter("side = 'e'").groupBy("cid", "second").agg(F.first("hashes").alias("hashes"))
    texts = materialize(texts.select("cid", "second", "hashes", F.size("hashes").alias("n")), "evaluation")
    # shards of texts of like size; a row for each size that occurs
    shards: list[list[int]] = []  # least size, largest size
    placed, room = [], 0
    for n, many in sorted(texts.groupBy("n").count().collect()):
        if n * many > room:
            shards += [[n, n] for _ in range(-(-n * many // shard_words))]
            room = shard_words - n * many if n * many <= shard_words else 0
            placed.append((n, len(shards) - max(1, -(-n * many // shard_words)), max(1, -(-n * many // shard_words))))
        else:
            shards[-1][1] = n
            room -= n * many
            placed.append((n, len(shards) - 1, 1))
    if not shards:
        return spark.createDataFrame([], MATCHES)
    of = F.broadcast(spark.createDataFrame(placed, "n int, first int, among int"))
    shard = (F.col("first") + F.pmod(F.xxhash64("cid"), F.col("among"))).cast("int").alias("shard")
    built = materialize(texts.join(of, "n").select(shard, "cid", "second", "hashes").groupBy("shard").applyInArrow(_build(t), "shard int, data binary"), "index")
    training = rows.filter("side = 't'").select("cid", "second", "hashes")
    found = None
    for r, (least, most) in enumerate(shards):
        data = built.filter(F.col("shard") == r).select("data").collect()  # one shard, of bounded size
        if not data:
            continue
        index = spark.sparkContext.broadcast(bytes(data[0][0]))
        near = training.filter(F.size("hashes").between(-(-least * t.numerator // t.denominator), most * t.denominator // t.numerator))
        part = materialize(near.mapInArrow(_stream_rows(index), MATCHES), "matches")
        index.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], MATCHES)
    pair = ["t_cid", "t_second", "e_cid", "e_second"]
    return found.groupBy(*pair).agg(F.max("n_spans").alias("n_spans"), F.max("n_words").alias("n_words"))


def split_texts(records: DataFrame) -> DataFrame:
    """``key, side, cid, second, hashes`` of ``key, side, text``: the texts with a word that are in a split."""
    rows = records.filter("key is not null and side is not null").select("key", "side", setsim.word_hashes(F.col("text")).alias("hashes")).filter(F.size("hashes") > 0)
    return materialize(rows.select("key", "side", F.xxhash64("hashes").alias("cid"), F.xxhash64(F.lit("second"), "hashes").alias("second"), "hashes"), "words")


def cross_split(records: DataFrame, threshold: float = 0.7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``train_key, eval_key`` of ``key, side, text``: each training record with each evaluation record of which
    some text has word similarity >= threshold with some text of its own. Texts that very many records of one side
    have are salted where they are joined to their records."""
    rows = split_texts(records)
    pairs = materialize(matches(rows, Fraction(str(threshold)), shard_words).drop("n_spans", "n_words"), "pairs")
    keys = rows.select("side", "cid", "second", "key")
    by = ["side", "cid", "second"]
    total = keys.count()
    hot = keys.groupBy(*by).count().filter(F.col("count") > max(MEMBERS, total // HOT_TEXTS)).select(*by, F.ceil(F.col("count") / F.lit(MEMBERS)).cast("int").alias("parts"))

    def named(pairs: DataFrame, which: str, name: str) -> DataFrame:
        by = [f"{which}_cid", f"{which}_second"]
        large = F.broadcast(hot.filter(F.col("side") == which).select(F.col("cid").alias(by[0]), F.col("second").alias(by[1]), "parts"))  # at most HOT_TEXTS rows
        mine = keys.filter(F.col("side") == which).select(F.col("cid").alias(by[0]), F.col("second").alias(by[1]), F.col("key").alias(name)).distinct()
        n = F.coalesce("parts", F.lit(1))
        spread = mine.join(large, by, "left").withColumn("part", F.pmod(F.xxhash64(name), n).cast("int")).drop("parts")
        return pairs.join(large, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts").join(spread, [*by, "part"]).drop("part")

    return named(named(pairs, "t", "train_key"), "e", "eval_key").select("train_key", "eval_key").distinct()


def overlapping(records: DataFrame, threshold: float = 0.7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``key, n_spans, n_words``, a row for each evaluation record with a similar training text: its maximal
    matches and words in common with the training text it has most in common with, in the fewest matches. No pairs of records are made."""
    rows = split_texts(records)
    pairs = matches(rows, Fraction(str(threshold)), shard_words)
    best = pairs.groupBy("e_cid", "e_second").agg(F.max(F.struct("n_words", (-F.col("n_spans")).alias("far"))).alias("p")).select(F.col("e_cid").alias("cid"), F.col("e_second").alias("second"), (-F.col("p.far")).alias("n_spans"), "p.n_words")
    return rows.filter("side = 'e'").select("key", "cid", "second").join(best, ["cid", "second"]).groupBy("key").agg(F.max(F.struct("n_words", (-F.col("n_spans")).alias("far"))).alias("p")).select("key", (-F.col("p.far")).alias("n_spans"), "p.n_words")
