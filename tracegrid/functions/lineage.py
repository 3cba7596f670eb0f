"""Cutting the plan of iterative operators."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, which driver and executors share (spark.checkpoint.dir). Only a local session without
    one, as in tests, gets a folder of its own; a cluster must name it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or _own_dir())
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and written in columns to the session's shared folder, so that a loop may have any number of rounds and
    lost executors lose nothing. Dataset.checkpoint() would write whole rows uncompressed, and compute them twice."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """cut() that keeps the rows in so many buckets by a column, so that joins, windows and groups by it need no shuffle. df should be
    in as many partitions by that column; each is then one file. The session's catalog holds the table only until it is read."""
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", f"{folder(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the table's name goes; its files stay
    spark.sql(f"DROP TABLE {name}")
    return out


@contextlib.contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins by a bucket's column and more leave rows in their buckets, where Spark would shuffle them by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
