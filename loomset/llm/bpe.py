"""Problem 8: encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokens are merged with a rank queue: one bucket of list positions for each merge rank, a three-level
bitmap over the buckets whose find-first-set gives the next rank, linked lists for the parts, and entries
that a merge made stale are skipped when they come up. One pre-token of n bytes costs O(n log n), however
long it is; texts without white space are one such pre-token.

Equal pieces of text recur, so each worker keeps what it has encoded: first by stretches between single
blanks, then by pre-tokens. The stores only save time; they are emptied when they hold too much. The ids
leave Python as one flat Arrow buffer with offsets, never as Python integers.

Defined results: null and empty texts give an empty list; blank texts are encoded like any other; strings
of special tokens are ordinary text; each row is encoded by itself, so repeated rows, ties of doc_id and
extra columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STORE_ENTRIES = 1_000_000


class RankQueue:
    """Positions waiting under their merge rank. ``pop`` gives the smallest rank and its leftmost position."""

    __slots__ = ("l0", "l1", "top", "buckets")

    def __init__(self, n_ranks: int):
        n0 = (n_ranks >> 6) + 1
        self.l0 = [0] * n0
        self.l1 = [0] * ((n0 >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        waiting = self.buckets.get(rank)
        if waiting:
            heapq.heappush(waiting, pos)
            return
        self.buckets[rank] = [pos]
        w, v = rank >> 6, rank >> 12
        self.l0[w] |= 1 << (rank & 63)
        self.l1[v] |= 1 << (w & 63)
        self.top |= 1 << v

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        v = (self.top & -self.top).bit_length() - 1
        word = self.l1[v]
        w = (v << 6) | ((word & -word).bit_length() - 1)
        word = self.l0[w]
        rank = (w << 6) | ((word & -word).bit_length() - 1)
        waiting = self.buckets[rank]
        pos = heapq.heappop(waiting)
        if not waiting:
            del self.buckets[rank]
            self.l0[w] &= ~(1 << (rank & 63))
            if not self.l0[w]:
                self.l1[v] &= ~(1 << (w & 63))
                if not self.l1[v]:
                    self.top &= ~(1 << v)
        return rank, pos


class Encoder:
    """Encodes texts to int32 ids; ``merges`` maps the bytes of a token to its rank, which is its id."""

    def __init__(self, merges: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.merges = merges
        self.n = max(merges.values()) + 1
        self.queue = RankQueue(self.n)
        self.findall = regex.compile(pattern).findall
        self.parts = _Store(self._pre_token)
        self.pieces = _Store(self._piece)

    @classmethod
    def from_file(cls, path: str, pattern: str = PATTERN) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        merges = self.merges
        whole = merges.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        end = list(range(1, n + 1))  # the part at i is raw[i:end[i]]
        before = list(range(-1, n - 1))
        now = [-1] * n  # rank of the part at i joined with the next one
        q = self.queue
        push = q.push
        for i in range(n - 1):
            r = merges.get(raw[i : i + 2], -1)
            if r >= 0:
                now[i] = r
                push(r, i)
        while (got := q.pop()) is not None:
            rank, i = got
            if now[i] != rank:
                continue
            j = end[i]
            k = end[j]
            end[i] = k
            now[j] = -2
            if k < n:
                before[k] = i
                r = merges.get(raw[i : end[k]], -1)
                now[i] = r
                if r >= 0:
                    push(r, i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = merges.get(raw[h:k], -1)
                if r != now[h]:
                    now[h] = r
                    if r >= 0:
                        push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(merges[raw[i : end[i]]])
            i = end[i]
        return ids

    def _pre_token(self, part: str) -> bytes:
        return np.array(self.merge(part.encode("utf-8", "surrogatepass")), dtype=np.int32).tobytes()

    def _piece(self, piece: str) -> bytes:
        parts = self.parts
        return b"".join([parts[x] for x in self.findall(piece)])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each. A single blank after a character that is none always begins
        a pre-token, so the stretches between such blanks are encoded one by one."""
        if not text:
            return b""
        if "  " in text:
            parts = self.parts
            return b"".join([parts[x] for x in self.findall(text)])
        first, *rest = text.split(" ")
        pieces = self.pieces
        return pieces[first] + b"".join([pieces[" " + x] for x in rest])


class _Store(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= STORE_ENTRIES:
            self.clear()
        got = self.make(key)
        if len(key) <= 64:
            self[key] = got
        return got


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One encoder for each vocabulary in each Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder.from_file(path, pattern)
    return _encoders[path, pattern]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and ``ids`` of every row of ``df``. Map-only: no shuffle, two columns are read."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode
        for batch in batches:
            encoded = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
            np.cumsum([len(x) >> 2 for x in encoded], out=offsets[1:])
            ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(encoded))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
