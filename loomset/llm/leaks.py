"""Problem 9: passages of held-out items inside a corpus.

Each task builds full-text indexes over shards of its own documents, as words: the shard's alphabet are the
words of the items, every other word is a separator, for no passage can run over it. All passages of
``min_words`` words are searched backward through the wavelet ranks at once, the rows found are located by
the sampled suffix positions, and overlapping places in a document are merged to spans.

Items are few and do not grow with the corpus; they are still handled in blocks of at most ``block_words``
words, one pass over the corpus for each, so what a task is sent has a fixed bound.

Defined results: null, empty and blank texts hold nothing; items with fewer than ``min_words`` words leak
nowhere; items that share a passage each count; equal items each give their rows; very long documents are
indexed in overlapping parts; empty tables give no rows; further columns of either table are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.fmindex import FMIndex, ranges

WORDS = re.compile(r"[^\W_]+").findall
SHARD_SYMBOLS = 1_000_000
SPANS_AT_ONCE = 1 << 20


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        found = WORDS((row[1] or "").lower())
        if block and size + len(found) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], found))
        size += len(found)
    if block:
        yield block


def _patterns(block: list[tuple[int, list[str]]], min_words: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Vocabulary (from 1), passages as a matrix, and the item of each passage."""
    vocabulary: dict[str, int] = {}
    lines, owner = [], []
    for item, found in block:
        if len(found) < min_words:
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        for k in range(len(ids) - min_words + 1):
            lines.append(ids[k : k + min_words])
            owner.append(item)
    return vocabulary, np.array(lines, dtype=np.int64).reshape(-1, min_words), np.array(owner, dtype=np.int64)


class _Passages:
    """The distinct passages of a block of items, and the items each is of: one passage of many items is searched and
    located once."""

    def __init__(self, vocabulary: dict[str, int], patterns: np.ndarray, owner: np.ndarray):
        self.vocabulary = vocabulary
        self.patterns, of = np.unique(patterns, axis=0, return_inverse=True)
        of = of.reshape(-1)
        both = np.unique(np.stack((of, owner), axis=1), axis=0) if len(of) else np.zeros((0, 2), dtype=np.int64)
        self.items = both[:, 1]
        self.count = np.bincount(both[:, 0], minlength=len(self.patterns)) if len(of) else np.zeros(0, dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count


class _Shard:
    """Documents as one sequence of symbols, without runs of separators."""

    def __init__(self, passages: _Passages, min_words: int):
        self.passages, self.min_words = passages, min_words
        self.reset()

    def reset(self) -> None:
        self.parts, self.places, self.docs, self.starts, self.size = [], [], [], [], 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        keep = ids > 0
        keep[1:] |= ids[:-1] > 0  # the first separator of each run
        at = np.flatnonzero(keep)
        if len(at) < self.min_words:
            return
        self.docs.append(doc)
        self.starts.append(self.size)
        self.parts += [ids[at], np.zeros(1, dtype=ids.dtype)]
        self.places += [at, np.zeros(1, dtype=np.int64)]
        self.size += len(at) + 1

    def find(self) -> Iterator[dict[str, np.ndarray]]:
        """Merged spans: doc, item, first word, words."""
        p = self.passages
        if self.size == 0 or len(p.patterns) == 0:
            return
        index = FMIndex(np.concatenate(self.parts))
        rows, of = ranges(*index.search(p.patterns))  # a place holds one passage at most: no more rows than symbols
        if len(rows) == 0:
            return
        pos = index.locate(rows)
        order = np.argsort(pos)
        pos, of = pos[order], of[order]
        at = np.searchsorted(np.array(self.starts), pos, side="right") - 1
        place = np.concatenate(self.places)[pos]
        # the items of each place, some documents at a time
        total = np.cumsum(p.count[of])
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at))
        a = 0
        while a < len(at):
            room = np.searchsorted(total, (total[a - 1] if a else 0) + SPANS_AT_ONCE, side="right")
            z = int(ends[max(np.searchsorted(ends, room, side="right") - 1, np.searchsorted(ends, a, side="right"))])
            item_at, hit = ranges(p.first[of[a:z]], p.first[of[a:z]] + p.count[of[a:z]])
            doc, item, word = at[a:z][hit], p.items[item_at], place[a:z][hit]
            order = np.lexsort((word, item, doc))
            doc, item, word = doc[order], item[order], word[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + self.min_words)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            yield {"doc": np.array(self.docs)[doc[first]], "item": item[first], "first_word": word[first], "n_words": word[last] + self.min_words - word[first]}
            a = z


def leaked_spans(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 12, block_words: int = 200_000) -> DataFrame:
    """``doc_id, item_id, first_word, n_words``: every maximal run of words of a document all of whose
    windows of ``min_words`` words are words of the item. Map-only over the documents."""
    schema = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint"
    spark = documents.sparkSession
    found = None
    for block in _blocks(items.select(F.col(item_col).cast("bigint"), item_text), block_words):
        passages = spark.sparkContext.broadcast(_Passages(*_patterns(block, min_words)))  # of at most ``block_words`` words, or one item
        part = documents.select(F.col(doc_col).cast("bigint"), text_col).mapInArrow(_search(passages, min_words), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _search(passages, min_words: int):
    step = SHARD_SYMBOLS - min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(passages.value, min_words)
        get = passages.value.vocabulary.get

        def emit() -> Iterator[pa.RecordBatch]:
            for got in shard.find():
                yield pa.RecordBatch.from_arrays([pa.array(got[c].astype(np.int64)) for c in ("doc", "item", "first_word", "n_words")], names=["doc_id", "item_id", "first_word", "n_words"])
            shard.reset()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or doc is None:
                    continue
                found = WORDS(text.lower())
                ids = np.fromiter(map(get, found, repeat(0)), dtype=np.int64, count=len(found))
                for a in range(0, max(1, len(ids)), step):
                    part = ids[a : a + step + min_words - 1]
                    if shard.size + len(part) >= SHARD_SYMBOLS:
                        yield from emit()
                    if a == 0:
                        shard.add(doc, part)
                    else:
                        before = shard.size
                        shard.add(doc, part)
                        if shard.size > before:
                            shard.places[-2] = shard.places[-2] + a
        yield from emit()

    return run


def leaks(documents: DataFrame, items: DataFrame, **named) -> DataFrame:
    """``doc_id, item_id``: the documents that hold a passage of an item."""
    return leaked_spans(documents, items, **named).select("doc_id", "item_id").distinct()
