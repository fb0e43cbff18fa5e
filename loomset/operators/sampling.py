"""Balanced, stratified and matched samples in an order fixed by hashes: the same rows wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import selection
from loomset.runtime import materialize


def sample_views(sets: DataFrame, views: int, seed: int = 0, include_original: bool = True, max_sets: int | None = None, order: str | None = None) -> DataFrame:
    """Sets of ``original_id, original_text, rewrites`` with enough rewrites, as ``texts`` of exactly ``views``
    texts: the original first, then rewrites in hash order. In the row, no shuffle."""
    need = views - include_original
    ranked = F.array_sort(F.transform("rewrites", lambda r, i: F.struct(T.order_key(F.col("original_id"), i.cast("string"), seed=seed).alias("k"), r["text"].alias("text"))))
    picked = F.transform(F.slice(ranked, 1, need), lambda x: x["text"]) if need else F.array().cast("array<string>")
    texts = F.concat(F.array("original_text"), picked) if include_original else picked
    kept = sets.filter(F.coalesce(F.size("rewrites"), F.lit(0)) >= need).withColumn("texts", texts)
    return kept if max_sets is None else kept.orderBy(order or "original_id").limit(max_sets)


def balanced(rows: DataFrame, total: int, labels: list[str], label: Column, key: Column, seed: int = 0) -> DataFrame:
    """``total`` rows spread evenly over ``labels``, the remainder to the first; what a label lacks is made up
    from what others have over. Only each label's first ``total`` rows in hash order leave their partitions."""
    base, rest = divmod(total, len(labels))
    place = F.lit(None).cast("int")
    for i, x in enumerate(labels):
        place = F.when(label == x, i).otherwise(place)
    ranked = rows.withColumn("_l", place).filter("_l is not null").withColumn("_k", T.order_key(key, seed=seed))
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy("_l").orderBy("_k"))).filter(F.col("_r") <= total)
    want = base + (F.col("_l") < rest).cast("int")
    ranked = ranked.withColumn("_over", (F.col("_r") > want).cast("int"))
    # wanted rows first, then leftovers in hash order: at most len(labels) * total rows to sort
    return ranked.orderBy("_over", "_k").limit(total).drop("_l", "_k", "_r", "_over")


def stratified(rows: DataFrame, tags: str, key: str, per_tag: int, max_total: int | None = None, seed: int = 0) -> DataFrame:
    """Up to ``per_tag`` rows of each tag; a row in several tags once; rows without a tag never."""
    each = rows.withColumn("_tag", F.explode(tags)).withColumn("_k", T.order_key(F.col("_tag"), F.col(key), seed=seed))
    taken = each.withColumn("_r", F.row_number().over(W.partitionBy("_tag").orderBy("_k"))).filter(F.col("_r") <= per_tag)
    once = taken.dropDuplicates([key]).drop("_tag", "_k", "_r")
    return once if max_total is None else once.orderBy(T.order_key(F.col(key), seed=seed)).limit(max_total)


def shifted(rows: DataFrame, group: list[str], key: Column, values: list[str], seed: int = 0) -> DataFrame:
    """Each row with the values of the next one in hash order, the last with the first's: a shuffled control
    without fixed points, for groups of two or more. Only keys are put in order, by ranges; the values are joined by
    their places, so no task holds a group."""
    rows = materialize(rows.withColumns({"_id": F.monotonically_increasing_id(), "_k": T.order_key(key, seed=seed), "_g": F.struct(*group)}), "shifted")
    ring = materialize(selection.numbered(rows.select("_g", "_id", "_k"), "_k", "_id", name="_n", by=("_g",)), "ring")
    back = ring.filter("_n > 0").select("_g", F.col("_id").alias("_next"), (F.col("_n") - 1).alias("_n"))  # the one at place n goes to place n - 1
    closing = ring.groupBy("_g").agg(F.max("_n").alias("_n"), F.min_by("_id", "_n").alias("_next")).select("_g", "_next", "_n")
    pairs = ring.join(back.unionByName(closing), ["_g", "_n"]).select("_id", "_next")
    taken = rows.select(F.col("_id").alias("_next"), *[F.col(v).alias(f"shuffled_{v}") for v in values])
    return rows.drop("_k", "_g").join(pairs, "_id").join(taken, "_next").drop("_id", "_next")


def matched_controls(views: DataFrame, match: str, control: str, seed: int = 0) -> DataFrame:
    """Of ``set_id, view_id, <match>``: for each view another one with the same value that is in another set;
    only sets whose every view found one. Candidates lie in a ring in hash order by value; a view takes the
    first that is not of its own set, so sets take no join with all their candidates. The ring is numbered by
    ranges: no task holds all views of a value."""
    ring = views.select(F.coalesce(match, F.lit("")).alias("m"), "set_id", "view_id").withColumn("k", T.order_key(F.col("view_id"), F.col("set_id"), seed=seed))
    ring = materialize(selection.numbered(ring, "m", "k", "set_id", "view_id", name="n"), "ring")
    # runs of one set in the ring: what follows a run is the first view of another set
    before = ring.select((F.col("n") + 1).alias("n"), F.col("m").alias("m0"), F.col("set_id").alias("s0"))
    starts = (F.col("m0").isNull() | (F.col("m") != F.col("m0")) | (F.col("set_id") != F.col("s0"))).cast("int")
    marked = ring.join(before, "n", "left").select("n", "m", "set_id", "view_id", starts.alias("starts"))
    heads = selection.numbered(marked.filter("starts = 1").select("n", "m", "set_id", "view_id"), "n", name="run")
    heads = materialize(heads.select("run", "n", "m", F.struct("set_id", "view_id").alias("head")), "heads")
    after = heads.select((F.col("run") - 1).alias("run"), F.col("m").alias("m1"), F.col("head").alias("after"), F.col("n").alias("end"))
    linked = materialize(heads.join(after, "run", "left"), "runs")
    ends = linked.groupBy("m").agg(F.min_by("head", "run").alias("one"), F.min_by(F.when(F.col("m1") == F.col("m"), F.col("after")), "run").alias("two"))
    # the ring closes: where its first run is of the same set as its last, the second run is meant
    inside = linked.filter("m1 = m").select("run", "n", "end", F.col("after").alias("pick"))
    other = F.when(F.col("one.set_id") != F.col("head.set_id"), F.col("one")).when(F.col("two.set_id") != F.col("head.set_id"), F.col("two"))
    closing = linked.filter("m1 is null or m1 <> m").join(ends, "m").select("run", "n", "end", other.alias("pick"))
    picks = inside.unionByName(closing)
    # a run holds views of one set, next to each other
    span = picks.withColumn("end", F.coalesce("end", F.lit(1) + F.lit(ring.agg(F.max("n")).first()[0] or 0)))
    each = span.select(F.explode(F.sequence("n", F.col("end") - 1)).alias("n"), "pick")
    found = ring.join(each, "n")
    sets = found.groupBy("set_id").agg(F.count("*").alias("n_views"), F.count("pick").alias("n_found"), F.array_sort(F.collect_list(F.struct(F.col("view_id").alias("v"), F.col("pick.view_id").alias("p")))).alias("ps"))
    full = sets.filter("n_views = n_found")
    picks = F.transform("ps", lambda x: x["p"])
    return full.select("set_id", F.lit(control).alias("control"), F.concat(F.lit(f"{control}_"), T.stable_hash(F.concat_ws("|", F.col("set_id"), F.array_join(picks, "|")))).alias("control_id"), picks.alias("picks"), F.lit("control_not_train").alias("risk_tag"), F.lit("eval").alias("usage"))


def sampled_ids(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` of the distinct keys, the first in hash order: the same wherever they are drawn."""
    return rows.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(T.order_key(F.col(key).cast("string"), seed=seed), key).limit(n)
