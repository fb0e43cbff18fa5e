"""Attempts that arrive as a stream: first successes and resumed runs without reading everything again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_attempts(spark: SparkSession, path: str, schema: str | T.StructType, files_at_once: int = 64) -> DataFrame:
    """JSON lines that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def first_accepted(attempts: DataFrame, slot: list[str], ok: Column, at: str, late: str = "1 hour") -> DataFrame:
    """The first accepted attempt of each slot to arrive; state for a slot is dropped once the watermark has passed."""
    timed = attempts.withColumn(at, F.col(at).cast("timestamp"))
    return timed.filter(ok).withWatermark(at, late).dropDuplicatesWithinWatermark(slot)


def reason_counts(attempts: DataFrame, at: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """How often each kind of reason was given, by window of time."""
    rows = attempts.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(at, F.explode("reasons").alias("reason"))
    kind = F.substring_index("reason", "=", 1).alias("reason")
    return rows.groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))


def append_new(by: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends rows whose key isn't in the table at ``path`` yet. A batch that is tried again
    adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(by)
        try:
            done = spark.read.schema(batch.schema).parquet(path)
            fresh = fresh.join(done.select(*by), by, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return write
