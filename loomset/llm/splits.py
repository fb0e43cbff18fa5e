"""Problem 3: splits that keep together all records that name a common source, directly or over others.

Records of one source are tied to the record with the smallest number among them, a star in place of all pairs.
Over these edges components are found by parallel hooking and shortcutting: each vertex hooks onto its smallest
neighbour, parents are joined with themselves until every tree is a star, edges are rewritten to the roots, and
what is left goes on. Each round writes its tables, so no plan grows and the loss of an executor costs one round.
Nothing but counts comes to the driver.

Splits are then filled with whole groups. From how many groups there are of each size, a subset-sum bitset over
the multiplicities finds the total closest to that of the test split, then of the validation split; which groups
of a size go there is decided by a hash of the group key.

Defined results: a record delivered several times counts once, by its last delivery; ids are compared trimmed and
lower-cased, ``wiki:<page>:<sentence>`` names the page; null, blank and ``unknown`` ids name nothing, and a record
without a name is a group of its own; null keys take no part; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomset.runtime import materialize, measured

HOT_ROWS = 100_000
HASH_BUCKETS = 1 << 10


def source_name(raw: Column) -> Column:
    """What an id names; null for nothing."""
    s = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    s = F.when(s.rlike(r"^wiki:.*:[^:]*$"), F.regexp_replace(s, r":[^:]*$", "")).otherwise(s)
    return F.when((s != "") & (s != "unknown"), s)


def attach(rows: DataFrame, groups: DataFrame, by: list[str], n: str, total: int | None, most: int | None) -> DataFrame:
    """``rows`` joined with one row of ``groups`` for each of its keys. ``groups`` says in ``n`` how many rows
    have the key, ``total`` of them in all and ``most`` the most: the few keys with very many are sent to the rows
    by broadcast, at most 10,000 of them, the others take a shuffle in which no key is large."""
    limit = max(HOT_ROWS, (total or 0) // 10_000)
    if (most or 0) <= limit:
        return rows.join(groups, by)
    hot = groups.filter(F.col(n) > limit)
    return rows.join(F.broadcast(hot), by).unionByName(rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(groups, by))


def follow(rows: DataFrame, n_rows: int, parent: DataFrame, by: str, to: str, how: str = "inner") -> DataFrame:
    """``rows`` with ``to``, the parent of the vertex in ``by``. Many rows may hold one vertex: those that very many
    hold get their parent by broadcast."""
    up = parent.select(F.col("v").alias(by), F.col("p").alias(to))
    if n_rows <= HOT_ROWS:  # then no vertex is in more
        return rows.join(up, by, how)
    hot = rows.groupBy(by).count().filter(F.col("count") > max(HOT_ROWS, n_rows // 10_000)).select(by)  # at most 10,000 rows
    known = F.broadcast(up.join(F.broadcast(hot), by, "left_semi"))
    return rows.join(F.broadcast(hot), by, "left_semi").join(known, by, how).unionByName(rows.join(F.broadcast(hot), by, "left_anti").join(up, by, how))


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``a, b``: the smallest vertex of its component. What was moved is counted
    while it is written."""
    n = F.count(F.lit(1))
    edges, seen = measured(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n=n)
    label, n_label = None, 0
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # hook: onto the smallest neighbour, where that is smaller
        parent, got = measured(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")), "parent", n=n)
        while True:  # shortcut: every parent becomes the grandparent, until all are roots
            step = follow(parent, got["n"], parent, "p", "g").select("v", F.col("g").alias("p"), (F.col("p") != F.col("g")).alias("moved"))
            parent, got = measured(step, "parent", n=n, moved=F.count(F.when(F.col("moved"), 1)))
            parent = parent.select("v", "p")
            if not got["moved"]:
                break
        if label is None:
            label, n_label = parent.select("v", F.col("p").alias("root")), got["n"]
        else:
            label = materialize(follow(label, n_label, parent, "root", "g", "left").select("v", F.coalesce("g", "root").alias("root")), "label")
        moved = follow(follow(edges, seen["n"], parent, "a", "pa"), seen["n"], parent, "b", "pb").filter("pa <> pb")
        edges, seen = measured(moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges", n=n)
    return label if label is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def source_groups(records: DataFrame) -> DataFrame:
    """``kind, rec_key, group_key, n`` of ``kind, rec_key, sources``: every record with the smallest key of its
    group and the group's size."""
    rows = materialize(records.filter("rec_key is not null").select(F.monotonically_increasing_id().alias("v"), "kind", "rec_key", F.array_distinct(F.array_compact(F.transform(F.coalesce("sources", F.array()), source_name))).alias("names")), "records")
    named = rows.select("v", F.explode("names").alias("name"))
    stars, many = measured(named.groupBy("name").agg(F.min("v").alias("b"), F.count("*").alias("many")).filter("many > 1"), "stars", total=F.sum("many"), most=F.max("many"))
    label = components(attach(named, stars, ["name"], "many", **many).select(F.col("v").alias("a"), "b"))
    rooted = materialize(rows.join(label, "v", "left").select("kind", "rec_key", F.coalesce("root", "v").alias("root")), "rooted")
    groups, sizes = measured(rooted.groupBy("root").agg(F.min("rec_key").alias("group_key"), F.count("*").alias("n")), "groups", total=F.sum("n"), most=F.max("n"))
    return attach(rooted, groups, ["root"], "n", **sizes).select("kind", "rec_key", "group_key", "n", "root")


def closest_counts(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to ``target`` as can be; of two
    totals equally close, the smaller. Sums are exact: a bitset has as many bits as the target and the largest size."""
    room = target + max(sizes, default=0)
    mask = (1 << (room + 1)) - 1
    pieces: list[tuple[int, int]] = []  # size and number of groups that are taken together
    for s in sorted(sizes, reverse=True):
        left, k = sizes[s], 1
        while left > 0:
            if s * min(k, left) <= room:
                pieces.append((s, min(k, left)))
            left -= k
            k *= 2

    def reach(sums: int, a: int, z: int) -> int:
        for s, k in pieces[a:z]:
            sums = (sums | (sums << (k * s))) & mask
        return sums

    sums = reach(1, 0, len(pieces))
    best = (sums & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = sums >> (target + 1)
    if above:
        high = target + 1 + (above & -above).bit_length() - 1
        if high - target < target - best:
            best = high
    taken: dict[int, int] = {}

    def back(a: int, z: int, before: int, best: int) -> int:
        """What is left of ``best`` before ``pieces[a:z]``. Halves are reached anew, so few bitsets are held at once."""
        if z - a == 1:
            s, k = pieces[a]
            if (before >> best) & 1:
                return best
            taken[s] = taken.get(s, 0) + k
            return best - k * s
        mid = (a + z) // 2
        return back(a, mid, before, back(mid, z, reach(before, a, mid), best))

    if pieces:
        back(0, len(pieces), 1, best)
    return taken


def assign_splits(records: DataFrame, proportions: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``kind, rec_key, group_key, split`` with the groups of ``source_groups``."""
    grouped = materialize(source_groups(records), "grouped")
    groups = materialize(grouped.groupBy("root", "n").agg(F.min("group_key").alias("g")).select("root", "n", F.xxhash64("g", "root").alias("h"), F.pmod(F.xxhash64("g", "root"), F.lit(HASH_BUCKETS)).alias("bucket")), "sizes")
    # as many rows as there are sizes: at most the root of twice the number of records
    sizes = {r[0]: r[1] for r in groups.groupBy("n").count().collect()}
    total = sum(s * m for s, m in sizes.items())
    test = closest_counts(sizes, round(total * proportions[2]))
    left = {s: m - test.get(s, 0) for s, m in sizes.items() if m > test.get(s, 0)}
    validation = closest_counts(left, round(total * proportions[1]))
    quota = grouped.sparkSession.createDataFrame([(s, test.get(s, 0), validation.get(s, 0)) for s in sizes], "n bigint, t bigint, v bigint")
    # rank within a size without one task for all groups of it: buckets of the hash, and ranks within them
    before = W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.groupBy("n", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = groups.withColumn("r", F.row_number().over(W.partitionBy("n", "bucket").orderBy("h", "root"))).join(offsets, ["n", "bucket"])
    rank = F.col("r") + F.col("before")
    named = ranked.join(quota, "n").select("root", "n", F.when(rank <= F.col("t"), "test").when(rank <= F.col("t") + F.col("v"), "validation").otherwise("train").alias("split"))
    named, most = measured(named, "splits", total=F.sum("n"), most=F.max("n"))
    return attach(grouped.drop("n"), named, ["root"], "n", **most).select("kind", "rec_key", "group_key", "split")
