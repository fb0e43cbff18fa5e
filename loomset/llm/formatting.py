"""Problem 5: records that differ only in how they are written.

The canonical form of a text is its letters and digits, lower-cased, all else left out; accents stay. Where the
text consists of ``name: value`` fields parted by ``|``, or is a JSON object, the canonical fields are sorted
first. All of it is built-in expressions, and what is shuffled is a 128-bit digest, not the text.

Keys held by very many records are found exactly by partial counts. Their records are reduced in two levels,
salted, and the few results are sent back to the records by broadcast: the number of hot keys is at most the
number of records divided by the threshold, which grows with the records, so that table has a fixed bound. All
other keys take one shuffle. The representative is the smallest identifier.

Defined results: null texts and texts without a letter or digit take no part; a record delivered several times
counts once, by its last delivery; null keys take no part; a field text with a part that has no name is plain
text; broken JSON is plain text; empty tables give no rows; further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomset.runtime import materialize

HOT_COPIES = 10_000
MOST_HOT_KEYS = 100_000
SALTS = 64


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def canonical(text: Column) -> Column:
    """The canonical form; null or empty where there is none."""
    parts = F.split(text, r"\|")
    named = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^\s*[\p{L}\p{N}][\p{L}\p{N}_ .\-]{0,60}:"))
    entries = F.map_entries(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    from_json = F.transform(entries, lambda e: F.concat(plain(e["key"]), plain(F.coalesce(e["value"], F.lit("")))))
    is_json = text.rlike(r"^\s*\{") & (F.size(entries) > 0)
    return (
        F.when(is_json, F.array_join(F.array_sort(from_json), ""))
        .when(named, F.array_join(F.array_sort(F.transform(parts, plain)), ""))
        .otherwise(plain(text))
    )


def digests(records: DataFrame) -> DataFrame:
    """``kind, num, key, x, y`` of ``kind, key, num, at, text``: one row a record, of those with a form."""
    c = canonical(F.col("text"))
    formed = records.filter(F.col("key").isNotNull()).select("kind", "num", "key", "at", c.alias("c"))
    digest = formed.select("kind", "num", "key", "at", F.when(F.length("c") > 0, F.struct(F.xxhash64("c").alias("x"), F.xxhash64(F.lit("second"), "c").alias("y"))).alias("d"))
    last = digest.groupBy("kind", "num", "key").agg(F.max(F.struct("at", "d")).alias("m"))
    return last.select("kind", "num", "key", "m.d.x", "m.d.y").filter("x is not null")


def _groups(records: DataFrame, hot_copies: int) -> DataFrame:
    """``kind, num, key, first, n``: every record with the first of its group and the group's size."""
    rows = materialize(digests(records), "digests")
    threshold = max(hot_copies, rows.count() // MOST_HOT_KEYS)
    by = ["kind", "x", "y"]
    hot = materialize(rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > threshold), "hot")
    one = F.struct("num", "key")
    if hot.isEmpty():
        heavy, rest = None, rows
    else:
        of_hot = rows.join(F.broadcast(hot), by)
        salted = of_hot.groupBy(*by, F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")).agg(F.min(one).alias("m"))
        firsts = salted.groupBy(*by).agg(F.min("m").alias("m")).select(*by, F.col("m.key").alias("first"))
        heavy = of_hot.join(F.broadcast(firsts), by).select(*rows.columns, "first", "n")
        rest = rows.join(F.broadcast(hot.select(*by)), by, "left_anti")
    w = W.partitionBy(*by)
    light = rest.select(*rows.columns, F.min(one).over(w).getField("key").alias("first"), F.count("*").over(w).alias("n"))
    whole = light if heavy is None else light.unionByName(heavy)
    return whole.select("kind", "num", "key", "first", "n")


def copies(records: DataFrame, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``kind, first_key, copy_key``: a row for each record that is a copy of a smaller one. Keys are compared
    by ``num``, then as strings."""
    return _groups(records, hot_copies).filter((F.col("n") > 1) & (F.col("key") != F.col("first"))).select("kind", F.col("first").alias("first_key"), F.col("key").alias("copy_key"))


def collapsed(records: DataFrame, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``kind, key, n_records``: one row for each group, copied or not."""
    return _groups(records, hot_copies).filter(F.col("key") == F.col("first")).select("kind", "key", F.col("n").alias("n_records"))
