"""Proportional stratified interleaving: every shard gets the mixture of sources, shard sizes differ by one row at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import stored, unit, with_position

SEED = 20_240_501


def interleave(docs: DataFrame, shards: int, source: str = "source", seed: int = SEED) -> DataFrame:
    """Put each row into a shard.

    Within each source rows are ranked in a seeded shuffle (by hash); a row's fraction is (rank + u) / rows of its source, u a
    hash of the source in [0, 1), which keeps sources of one size from standing in clumps; all rows are sorted by fraction, so that any run of this order has the mixture; the order is cut into `shards` runs.
    Adds to the row's digest: shard, slot (0, 1, ... within the shard). Only ids, sizes and checksums are shuffled.

    Nulls: a null source is a source of its own; null text has size 1 and checksum null-safe 0; a null id is hashed as such.
    Repeated rows are separate rows; equal rows are interchangeable. An empty table gives an empty result; with fewer rows
    than shards some shards stay empty. Other columns are ignored, whatever their names.
    """
    row = docs.select(
        F.col("doc_id"),
        F.col(source).alias("__source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    row = stored(row.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    n = row.count()
    tie = [F.col("__h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    unsigned = unit(F.col("__h"))
    ranked = with_position(row, ["__source"], [unsigned, *tie], unsigned, n, name="__rank")
    of = row.groupBy(F.col("__source").alias("__s")).agg(F.count("*").alias("__of"))
    ranked = ranked.join(of, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    ranked = stored(ranked.withColumn("__part", (F.col("__rank") + unit(F.xxhash64(F.lit(seed), F.col("__source")))) / F.col("__of")))
    mixed = with_position(ranked, [], [F.col("__part"), F.col("__source"), *tie], F.col("__part"), n)
    shard = F.expr(f"cast(pos * {shards} div {max(n, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return mixed.withColumn("shard", shard).withColumn("slot", F.col("pos") - first).select("doc_id", "size", "text_crc32", F.col("__source").alias(source), "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the rows of docs, whose doc_id is unique, as one folder for each shard, rows in slot order."""
    placed = placed.select(F.col("doc_id").alias("__id"), "shard", "slot")
    out = docs.join(placed, F.col("doc_id") == F.col("__id")).drop("__id")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
