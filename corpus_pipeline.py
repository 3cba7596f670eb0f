"""A corpus from raw documents to packed training sequences: toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import minhash, packing, pii, toxicity
from tracegrid.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; their labels come from the table of labels, held-out rows aside."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share four fifths of their five-word shingles, the one of the least id stays.

    Rows that repeat an id are one document: one of them stays. Rows without an id have no class to stand for and stay.
    """
    kept = minhash.classes(docs, k=5, percent=80).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    out = named.join(kept, F.col("doc_id") == F.col("__id"), "left_semi")
    return out.unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the text."""
    return pii.replace(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of power-of-two length, each with its sequence."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", replace_personal_data), ("packing", pack)]

#: SQL has no classifier, surrogates or tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
