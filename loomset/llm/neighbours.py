"""Problem 7: the k most similar vectors of every vector, by cosine, within its bank.

For each large bank a model is fitted on a bounded sample of its unit vectors: centroids, as many as the bank's own
size asks for, and additive codebooks whose entries have the full dimension, each fitted to what the ones before left
over. A vector is sent once to the cell of its nearest centroid, where it is an answer and a query, and as a query to
the next nearest cells. A task encodes the answers of a cell by beam search over the codebooks and keeps their codes
and the norm of the sum they stand for; scores of queries are sums of entries of their lookup tables, divided by the
stored norms, and the best are ranked again by the exact cosine. The lists of the cells are merged by query.

Cells hold about ``cell`` vectors whatever the size of a bank, and a query visits ``probes`` of them, so what a query
costs does not grow with the collection, up to MOST_CELLS cells (some 130 million vectors in one bank); beyond that
cells grow. A cell with more than PART vectors is parted, and a query visits all parts, so no task holds an unbounded
cell. Banks of no more than ``cell`` vectors are searched exactly, and so is, against its whole bank, every query whose
visited cells hold fewer than k + 1 classes. Nothing is compared between banks.

Vectors of one bank that are equal form one class: one query, and at most k + 1 of its smallest ids as answers,
for no more can be among anyone's k best. Classes are found by digests; vectors are not shuffled for it.

Defined results: null vectors, and those that are shorter than ``dim``, all zero or hold a null, NaN or infinite
value take no part; longer ones count by their first ``dim`` values; null ids or banks take no part; a repeated
id counts once, by its greatest vector; equal similarities (to nine decimals) go by id; a bank with fewer than
k + 1 vectors gives all its pairs; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomset.llm.setsim import lists
from loomset.runtime import materialize

#: The model of a bank is fitted on about this many of its vectors at most, taken by hash of their ids: SAMPLE, or
#: SAMPLE_EACH for each cell; the codebooks on BOOK_SAMPLE of them.
SAMPLE, SAMPLE_EACH, BOOK_SAMPLE = 40_000, 8, 12_000
CELL, MOST_CELLS = 2_048, 1 << 16
PART = 32_768  # classes of a cell that are searched at once
BOOKS, ENTRIES, BEAM = 8, 128, 4
PROBES = 4
RERANK = 160
DECIMALS = 9
QUERIES, ANSWERS = 256, 512  # scored at once


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = np.empty((len(x), k), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        d = half - x[a : a + 4096] @ centres.T
        if k == 1:
            out[a : a + 4096, 0] = d.argmin(axis=1)
        else:
            best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
            out[a : a + 4096] = np.take_along_axis(best, np.take_along_axis(d, best, 1).argsort(axis=1, kind="stable"), 1)
    return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)[:, 0]
        n = np.bincount(of, minlength=k)
        order = of.argsort(kind="stable")
        filled = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled], axis=0)
        centres[filled] = sums / n[filled, None]
        if (empty := np.flatnonzero(n == 0)).size:
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


class Model:
    """Centroids (cells x dim) and codebooks (books x entries x dim)."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres.astype(np.float32), books.astype(np.float32)

    @classmethod
    def fit(cls, sample: np.ndarray, n_cells: int, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        centres = _k_means(sample, min(n_cells, len(sample)), rng, 12)
        if len(sample) > BOOK_SAMPLE:
            sample = sample[rng.choice(len(sample), BOOK_SAMPLE, replace=False)]
        rest = sample - centres[_nearest(sample, centres)[:, 0]]
        books = []
        for _ in range(BOOKS):
            book = _k_means(rest, min(ENTRIES, len(rest)), rng, 6)
            rest = rest - book[_nearest(rest, book)[:, 0]]
            books.append(book)
        return cls(centres, np.stack(books))

    def encode(self, x: np.ndarray, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and norm of the decoded vector, by beam search."""
        cell = _nearest(x, self.centres)[:, 0] if cell is None else cell
        codes = np.zeros((len(x), len(self.books)), dtype=np.uint8)
        norm = np.zeros(len(x), dtype=np.float32)
        width = min(BEAM, self.books.shape[1])
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024].astype(np.float32)
            n, dim = part.shape
            rest = (part - self.centres[cell[a : a + 1024]])[:, None, :]  # one beam to begin with
            kept = np.zeros((n, 1, 0), dtype=np.uint8)
            for book in self.books:
                beams = rest.shape[1]
                left = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, dim) @ book.T).reshape(n, beams, -1) + (book**2).sum(axis=1)
                left = left.reshape(n, -1)
                best = np.argpartition(left, width - 1, axis=1)[:, :width]
                beam, entry = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[entry]
                kept = np.concatenate((np.take_along_axis(kept, beam[:, :, None], 1), entry[:, :, None].astype(np.uint8)), axis=2)
            first = (rest**2).sum(axis=2).argmin(axis=1)
            rows = np.arange(n)
            codes[a : a + 1024] = kept[rows, first]
            norm[a : a + 1024] = np.linalg.norm(part - rest[rows, first], axis=1)
        return cell, codes, np.maximum(norm, 1e-12)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """The products of each query with every entry: queries x books x entries."""
        return np.einsum("qd,med->qme", q, self.books, optimize=True)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return lists(column)[0].reshape(-1, dim)


FOUND = "bank string, q bigint, near array<struct<far:int,cid:bigint>>"
ROLES = "bank string, cell int, part int, role int, cid bigint, vec array<float>"
UNIT = 10**DECIMALS  # similarities are kept as whole numbers of the last decimal


def _route_rows(model, dim: int, probes: int):
    """For mapInArrow over ``bank, cid, vec``: a row in the vector's cell (role 0, answer and query) and one in each
    further cell it visits (role 1, query). Parts are given later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bank = batch.column(0).to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(bank):
                m: Model = model.value[name]
                k = min(probes, len(m.centres))
                b = batch.take(pa.array(np.flatnonzero(bank == name)))
                near = _nearest(_unit(_matrix(b.column(2), dim)).astype(np.float32), m.centres, k)
                whole = b.take(pa.array(np.repeat(np.arange(b.num_rows), k)))
                role = np.tile((np.arange(k) > 0).astype(np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0), pa.array(near.ravel().astype(np.int32)), pa.array(np.zeros(len(role), dtype=np.int32)), pa.array(role), whole.column(1), whole.column(2)],
                    names=["bank", "cell", "part", "role", "cid", "vec"],
                )

    return run


def _lists(bank: str, q: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """A row for each query, whose found ids and similarities lie in a row of the matrices."""
    far = pa.array(np.rint(-sims * UNIT).astype(np.int32).ravel())
    near = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * ids.shape[1]), pa.StructArray.from_arrays([far, pa.array(ids.ravel())], names=["far", "cid"]))
    return pa.RecordBatch.from_arrays([pa.array([bank] * len(q), pa.string()), pa.array(q), near], names=["bank", "q", "near"])


class _Cell:
    """The answers of a part of a cell. Without a model every answer is compared exactly."""

    def __init__(self, m: Model | None, cell: int, cid: np.ndarray, unit: np.ndarray, k: int, rerank: int):
        self.m, self.cid, self.unit, self.k = m, cid, unit, k
        self.take = min(rerank, len(cid)) if m else len(cid)
        if self.take < len(cid):
            self.centre = m.centres[cell]
            _, codes, self.norm = m.encode(unit.astype(np.float32), np.full(len(cid), cell))
            self.codes = np.ascontiguousarray(codes.T)

    def best(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the k + 1 best answers of each query, as matrices."""
        if self.take < len(self.cid):
            near = self._scored(q.astype(np.float32))
            exact = np.round(np.einsum("qd,qrd->qr", q, self.unit[near], optimize=True), DECIMALS)
            ids = self.cid[near]
        else:
            exact = np.round(q @ self.unit.T, DECIMALS)
            keep = min(self.k + 1, len(self.cid))
            if len(self.cid) > 4 * keep:
                least = np.partition(exact, len(self.cid) - keep, axis=1)[:, len(self.cid) - keep]
                tied = (exact >= least[:, None]).sum(axis=1)
                width = int(tied.max())  # ties of the last included
                near = np.argpartition(-exact, width - 1, axis=1)[:, :width]
                exact, ids = np.take_along_axis(exact, near, 1), self.cid[near]
            else:
                ids = np.broadcast_to(self.cid, exact.shape)
        order = np.lexsort((ids, -exact), axis=1)[:, : self.k + 1]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)

    def _scored(self, q: np.ndarray) -> np.ndarray:
        """The answers with the highest scores from lookup tables: queries x take."""
        table = np.ascontiguousarray(self.m.tables(q).transpose(1, 2, 0))  # books x entries x queries
        base = q @ self.centre
        score = np.empty((len(self.cid), len(q)), dtype=np.float32)
        for a in range(0, len(self.cid), ANSWERS):
            part = score[a : a + ANSWERS]
            part[:] = base
            for i in range(len(self.codes)):
                part += table[i].take(self.codes[i, a : a + ANSWERS], axis=0)
            part /= self.norm[a : a + ANSWERS, None]
        score = np.ascontiguousarray(score.T)
        return np.argpartition(score, len(self.cid) - self.take, axis=1)[:, len(self.cid) - self.take :]


def _search_rows(model, dim: int, k: int, rerank: int):
    """For mapInArrow over rows in order of bank, cell, part and role (answers first): ``bank, q, near``, the best
    k + 1 classes of each query in each part. Role 0 asks and answers, 1 asks, -1 answers."""

    def ask(cell: _Cell, bank: str, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cid, unit = rows.column(4).to_numpy(), _unit(_matrix(rows.column(5), dim))
        for a in range(0, len(cid), QUERIES):
            yield _lists(bank, cid[a : a + QUERIES], *cell.best(unit[a : a + QUERIES]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cell, held = None, None, []

        def load() -> Iterator[pa.RecordBatch]:
            nonlocal cell, held
            if held:
                t = pa.Table.from_batches(held)
                cell = _Cell(model.value[place[0]] if model else None, place[1], t.column(4).to_numpy(), _unit(_matrix(t.column(5), dim)), k, rerank)
                both, held = held, []
                for rows in both:
                    asking = rows.filter(pa.array(rows.column(3).to_numpy() == 0))
                    if asking.num_rows:
                        yield from ask(cell, place[0], asking)

        for batch in batches:
            bank = batch.column(0).to_numpy(zero_copy_only=False)
            at, part, asks = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy() > 0
            change = np.flatnonzero((bank[1:] != bank[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), len(bank)]):
                if a == z:
                    continue
                here = (bank[a], int(at[a]), int(part[a]))
                if here != place:
                    yield from load()
                    place, cell, held = here, None, []
                rows = batch.slice(a, z - a)
                if not asks[a]:
                    held.append(rows)
                    continue
                yield from load()
                if cell is not None:
                    yield from ask(cell, here[0], rows)
        yield from load()

    return run


def _rows(vectors: DataFrame, id_col: str, vec_col: str, bank_col: str, dim: int) -> DataFrame:
    """``bank, id, vec, x, y`` of the vectors that take part, one row an id. Only what is repeated is grouped."""
    v = F.transform(F.slice(vec_col, 1, dim), lambda x: x.cast("float"))
    rows = vectors.select(F.col(bank_col).alias("bank"), F.col(id_col).cast("bigint").alias("id"), v.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col("bank").isNotNull() & F.col("id").isNotNull() & (F.size("vec") == dim) & ~bad & F.exists("vec", lambda x: x != 0))
    good = materialize(good.select("bank", "id", "vec", F.xxhash64("vec").alias("x"), F.xxhash64(F.lit("second"), "vec").alias("y")), "vectors")
    repeated = materialize(good.groupBy("bank", "id").count().filter("count > 1").select("bank", "id"), "repeated")
    if repeated.isEmpty():
        return good
    one = good.join(repeated, ["bank", "id"], "left_semi").groupBy("bank", "id").agg(F.max(F.struct("vec", "x", "y")).alias("p")).select("bank", "id", "p.vec", "p.x", "p.y")
    return materialize(good.join(repeated, ["bank", "id"], "left_anti").unionByName(one), "vectors")


def _fit_rows(dim: int):
    """For applyInArrow over a bank's sample ``bank, cid, vec, cells``: its model."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cid")
        m = Model.fit(_unit(_matrix(rows.column("vec").combine_chunks(), dim)), rows.column("cells")[0].as_py())
        return pa.table({"bank": rows.column("bank").slice(0, 1), "centres": pa.array([m.centres.tobytes()]), "books": pa.array([m.books.tobytes()])})

    return run


def _exact(queries: DataFrame, answers: DataFrame, dim: int, k: int) -> DataFrame:
    """``bank, q, near`` of ``bank, cid, vec, parts``: each query compared with all answers of its bank, which are
    parted so that no task holds many of them."""
    cols = ["bank", F.lit(0).alias("cell"), "part", "role", "cid", "vec"]
    to = answers.withColumns({"part": F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), "role": F.lit(-1)})
    asked = queries.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(1)})
    placed = to.select(*cols).unionByName(asked.select(*cols))
    ordered = placed.repartition("bank", "cell", "part").sortWithinPartitions("bank", "cell", "part", "role")
    return ordered.mapInArrow(_search_rows(None, dim, k, 0), FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``bank, q, near`` with the k + 1 best of all lists of a query."""
    return found.groupBy("bank", "q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))


def _approximate(classes: DataFrame, dim: int, k: int, probes: int, rerank: int, sample: int) -> DataFrame:
    """``bank, q, near`` of ``bank, cid, vec, many, cells, parts``, the classes of banks that have at most MOST_CELLS cells
    together."""
    size = F.greatest(F.lit(sample), F.col("cells") * SAMPLE_EACH)
    share = F.pmod(F.xxhash64("cid", "bank"), F.lit(1 << 40)) < F.lit(1.05 * (1 << 40)) * size / F.col("many")
    picked = classes.filter((F.col("many") <= size) | share).select("bank", "cid", "vec", "cells")
    fitted = picked.groupBy("bank").applyInArrow(_fit_rows(dim), "bank string, centres binary, books binary").collect()
    models = {r["bank"]: Model(np.frombuffer(r["centres"], np.float32).reshape(-1, dim), np.frombuffer(r["books"], np.float32).reshape(BOOKS, -1, dim)) for r in fitted}
    model = classes.sparkSession.sparkContext.broadcast(models)  # at most MOST_CELLS centroids, and BOOKS * ENTRIES entries for each bank of over ``cell`` vectors

    routed = classes.select("bank", "cid", "vec").mapInArrow(_route_rows(model, dim, probes), ROLES)
    large = classes.select("bank", "cid", "vec").mapInArrow(_route_rows(model, dim, 1), ROLES).groupBy("bank", "cell").count().filter(F.col("count") > PART)
    parts = large.select("bank", "cell", F.ceil(F.col("count") / F.lit(PART)).cast("int").alias("parts"))
    split = routed.drop("part").join(F.broadcast(parts), ["bank", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # fewer than the centroids
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    spread = split.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = spread.select("bank", "cell", F.col("to").alias("part"), F.when(F.col("to") == own, F.col("role")).otherwise(1).alias("role"), "cid", "vec")
    ordered = placed.repartition("bank", "cell", "part").sortWithinPartitions("bank", "cell", "part", "role")
    return ordered.mapInArrow(_search_rows(model, dim, k, rerank), FOUND)


def nearest_lists(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "hidden", bank_col: str = "bank_id", dim: int = 48, probes: int = PROBES, rerank: int = RERANK, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``bank, id, rank, neighbour, sim``: up to k neighbours of every vector that takes part."""
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vec_col, bank_col, dim)
    digest = ["bank", "x", "y"]
    several = rows.groupBy(*digest).agg(F.min("id").alias("cid"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ids = materialize(rows.select(*digest, "id").join(several, digest).select("bank", "cid", "id"), "copies")
    classes = rows.join(ids.filter("id <> cid").select("bank", "id"), ["bank", "id"], "left_anti").select("bank", F.col("id").alias("cid"), "vec")
    # banks with more classes than a cell: few
    large = classes.groupBy("bank").agg(F.count("*").alias("many")).filter(F.col("many") > cell).orderBy("bank").collect()
    known = [(r["bank"], r["many"], min(MOST_CELLS, -(-r["many"] // cell)), -(-r["many"] // PART)) for r in large]
    schema = "bank string, many bigint, cells int, parts int"
    every = F.broadcast(spark.createDataFrame(known, schema))
    rest = classes.join(every, "bank", "left_anti").withColumn("parts", F.lit(-(-cell // PART)))
    found = _exact(rest, rest, dim, k)
    if known:
        near, some_banks = None, [[]]
        for one in known:  # as many banks at a time as have MOST_CELLS cells together, each with its codebooks
            if sum(x[2] + BOOKS * ENTRIES for x in [*some_banks[-1], one]) > MOST_CELLS + BOOKS * ENTRIES:
                some_banks.append([])
            some_banks[-1].append(one)
        for banks in filter(None, some_banks):
            some = classes.join(F.broadcast(spark.createDataFrame(banks, schema)), "bank")
            part = _approximate(some, dim, k, probes, rerank, sample)
            near = part if near is None else near.unionByName(part)
        near = materialize(_merged(near, k), "lists")
        # queries that saw too few go to their whole bank
        short = near.filter(F.size("near") < k + 1).select("bank", F.col("q").alias("cid"))
        if not short.isEmpty():
            asked = classes.join(short, ["bank", "cid"], "left_semi").join(every, "bank")
            near = near.filter(F.size("near") >= k + 1).unionByName(_merged(_exact(asked, classes.join(every, "bank").join(F.broadcast(asked.select("bank").distinct()), "bank", "left_semi"), dim, k), k))
        found = found.unionByName(near)

    # of each class the ids that may be among someone's k best
    salted = W.partitionBy("bank", "cid", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    least = W.partitionBy("bank", "cid").orderBy("id")
    few = ids.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
    answers = few.groupBy("bank", "cid").agg(F.collect_list("id").alias("more"))
    top = _merged(found, k).select("bank", "q", F.inline("near")).join(answers, ["bank", "cid"], "left")
    listed = top.select("bank", "q", "far", F.explode(F.coalesce("more", F.array("cid"))).alias("neighbour"))
    wide = listed.groupBy("bank", "q").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "neighbour"))), 1, k + 1).alias("near"))  # at most (k + 1)^2 each
    askers = classes.select("bank", "cid", F.col("cid").alias("id")).unionByName(ids.filter("id <> cid"))
    each = wide.withColumnRenamed("q", "cid").join(askers, ["bank", "cid"])
    own = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return each.select("bank", "id", F.posexplode(own).alias("rank", "x")).select("bank", "id", "rank", "x.neighbour", (-F.col("x.far") / F.lit(float(UNIT))).alias("sim"))


def neighbour_pairs(vectors: DataFrame, k: int = 10, **named) -> DataFrame:
    """``vec_a, vec_b``: vec_a < vec_b, at least one among the k most similar of the other."""
    near = nearest_lists(vectors, k, **named)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()
