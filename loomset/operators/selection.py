"""Order-dependent selection as window expressions: first successes, prefix limits, earlier duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.runtime import materialize


def numbered(df: DataFrame, *order: Column | str, name: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with an ordinal from 0 in the order given, of all rows or within ``by``. The rows are range-partitioned
    by ``by`` and the order, numbered within partitions and shifted by the sizes of those before, so no task holds
    more than its range, however large a group is."""
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    ranged = df.select("*", *keys).repartitionByRange(*names, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged.sortWithinPartitions(*names, *order), "ranged")  # a range keeps its number
    within = W.partitionBy(*names) if by else W.partitionBy()
    sizes = ranged.groupBy("_part", *names).agg(F.count("*").alias("_n"))  # as many rows as ranges and groups
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_part", *names).orderBy(*order)) - 1)
    if by:
        other = before.select(F.col("_part").alias("_p"), *[F.col(n).alias(f"{n}o") for n in names], "_before")
        same = F.col("_part") == F.col("_p")
        for n in names:
            same &= F.col(n).eqNullSafe(F.col(f"{n}o"))
        joined = local.join(other, same)
    else:
        joined = local.join(F.broadcast(before), "_part")
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name))


def first_success(attempts: DataFrame, slot: list[str], ok: Column, *order: str) -> DataFrame:
    """At most one row a slot: the first that succeeded."""
    kept = attempts.filter(ok)
    return kept.withColumn("_r", F.row_number().over(W.partitionBy(*slot).orderBy(*order))).filter("_r = 1").drop("_r")


def until_success(attempts: DataFrame, slot: list[str], ok: Column, attempt: str) -> DataFrame:
    """The attempts that were made: none after the one with the first success, whose candidates all stay."""
    first = F.min(F.when(ok, F.col(attempt))).over(W.partitionBy(*slot))
    return attempts.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(attempt) <= F.col("_first"))).drop("_first")


def accepted_prefix(rows: DataFrame, order: str, ok: Column, limit: int) -> DataFrame:
    """The rows that are looked at until ``limit`` have been accepted: the prefix that ends with the limit-th.
    Its end is the limit-th smallest order among the accepted, found by a bounded sort in place of a running
    count over all rows."""
    if limit <= 0:
        return rows.limit(0)
    last = rows.filter(ok).select(F.col(order).alias("_o")).orderBy("_o").limit(limit).agg(F.max("_o").alias("_last"), F.count("*").alias("_n"))
    return rows.join(F.broadcast(last)).filter((F.col("_n") < limit) | (F.col(order) <= F.col("_last"))).drop("_last", "_n")


def flag_repeats(rows: DataFrame, group: list[str], key: Column, clean: Column, order: str, name: str = "repeated") -> DataFrame:
    """Whether an earlier row of the group that is clean itself has the same key."""
    earliest = F.min(F.when(clean, F.col(order))).over(W.partitionBy(*group, key))
    return rows.withColumn(name, F.coalesce(earliest < F.col(order), F.lit(False)))


def last_wins(rows: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """The last row of each key, as an assignment repeated in that order leaves it."""
    return rows.groupBy(*by).agg(*[F.max_by(v, order).alias(v) for v in values])


def not_done(rows: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(*by).distinct(), by, "left_anti")


def model_shard(rows: DataFrame, position: str, index: int, total: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(position), F.lit(total)) == index)


def even_ranges(rows: DataFrame, order: str, n: int, name: str = "shard") -> DataFrame:
    """Contiguous ranges whose sizes differ by one at most, the larger first. ``order``: an ordinal from 0."""
    total = rows.agg(F.count("*").alias("_n"))
    base, more = F.floor(F.col("_n") / n), F.col("_n") % n
    cut = more * (base + 1)
    at = F.col(order)
    which = F.when(at < cut, F.floor(at / (base + 1))).otherwise(more + F.floor((at - cut) / F.greatest(base, F.lit(1))))
    return rows.join(F.broadcast(total)).withColumn(name, which.cast("bigint")).drop("_n")


def prefix_split(rows: DataFrame, order: str, fraction: float = 0.8, name: str = "is_train") -> DataFrame:
    """The first part for training, by the ordinal ``order`` from 0."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(total)).withColumn(name, F.col(order) < F.floor(F.col("_n") * fraction)).drop("_n")
