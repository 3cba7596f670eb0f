"""Runs a stream to the end of what its source holds and gives its rows as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tracegrid.functions.lineage import folder
from tracegrid.streaming.outbox import outbox
from tracegrid.streaming.state import STORE


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of all micro-batches, with `batch`; the checkpoint and the rows are in the session's shared folder."""
    spark, path = stream.sparkSession, f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        stream.writeStream.outputMode(mode).foreachBatch(outbox(path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{path}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
