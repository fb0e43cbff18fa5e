"""Session helpers: reading tables, cutting lineage in the shared folder, sizing partitions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a session within one machine, as in local
    tests, may leave it unset and gets a folder of its own; on a cluster that is an error, since no folder of one
    machine is seen by the others."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomset-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_made: set[str] = set()


def clear(spark: SparkSession | None = None) -> None:
    """Remove the tables this process has written to the shared folder. Runs by itself when it ends; call it
    earlier only when no result that reads them is needed any more."""
    spark = spark or SparkSession.getActiveSession()
    jvm = SparkContext._jvm
    if not _made or jvm is None:
        return
    alive = spark is not None and spark.sparkContext._jsc is not None
    hadoop = spark.sparkContext._jsc.hadoopConfiguration() if alive else jvm.org.apache.hadoop.conf.Configuration()
    for path in sorted(_made):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    _made.clear()


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear()
    except Exception:  # the session is gone; its folder goes with the cluster's shared folder
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the written tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives the loss
    of executors, and is compressed on disk, which a checkpoint is not."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates of what is written, taken while writing: no job of their own."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
    return table, seen.get


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latest(df: DataFrame, key: str, at: str, *cols: str) -> DataFrame:
    """One row per key of a table that holds deliveries twice: the values of the last delivery. Ties of
    ``at`` go to the larger values, so the result does not depend on the order of rows. Keys are counted first, and
    only the rows of those that come more than once are grouped; the others go through as they are."""
    rows = df.select(key, F.col(at).alias("_at"), *cols)
    several = rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    pick = F.max(F.struct("_at", *cols)).alias("_p")
    last = rows.join(several, same, "left_semi").groupBy(key).agg(pick).select(key, *[F.col(f"_p.{c}").alias(c) for c in cols])
    return rows.join(several, same, "left_anti").select(key, *cols).unionByName(last)


#: A word is a longest run of letters or digits, lower-cased.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
