"""Overlapping polls, an outbox whose batches are written once, and marks of what has been delivered from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def polled(events: DataFrame, identity: list[str], delay: str = "10 minutes") -> DataFrame:
    """Events of polls that overlap in time, each once: copies have one identity and come within the delay. Needs `ts`."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(identity)


def outbox(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes a batch under its id. A batch that is run again, as its query ended between the
    write and the commit of its checkpoint, replaces what it wrote: rows are neither lost nor repeated."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return put


def rows(spark: SparkSession, path: str) -> DataFrame:
    """What the outbox holds, with `batch`."""
    return spark.read.parquet(f"{path}/rows").withColumn("batch", F.col("batch").cast("long"))


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the batches marked as delivered."""
    try:
        return spark.read.parquet(f"{path}/delivered").select(F.col("batch").cast("long").alias("batch")).distinct()
    except AnalysisException:  # nothing yet
        return spark.createDataFrame([], "batch long")


def pending(spark: SparkSession, path: str) -> DataFrame:
    """The rows of batches that are not marked."""
    return rows(spark, path).join(delivered(spark, path), "batch", "left_anti")


def deliver(spark: SparkSession, path: str, send: Callable[[DataFrame, int], None]) -> int:
    """Hand on each pending batch, the oldest first, and mark it once `send` has returned; how many. A batch whose mark could
    not be written is sent again under its number, by which a receiver can tell."""
    numbers = sorted(r["batch"] for r in pending(spark, path).select("batch").distinct().collect())  # a number for each micro-batch
    for n in numbers:
        send(rows(spark, path).filter(F.col("batch") == n).drop("batch"), n)
        spark.range(n, n + 1).select(F.col("id").alias("batch")).write.mode("overwrite").parquet(f"{path}/delivered/part={n}")
    return len(numbers)
