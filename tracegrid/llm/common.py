"""What the corpus operators share: tables in the shared folder, stable row ids, distributed positions."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local session without one, as in tests, gets a
    folder of its own; a cluster must name it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by stored(), once nothing will read it again."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if "/stored-" in f:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores behind it as it takes to be none of the taken ones (capitals aside)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def through_python(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], ids: str | Sequence[str], fields: str) -> DataFrame:
    """mapInPandas that hands the columns `ids` through as text, so that a null among them does not turn 64-bit numbers into
    doubles. `run` returns the columns ids and those of `fields`, in this order."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    texts = df.select(*(F.col(c).cast("string").alias(c) if c in ids else c for c in df.columns))
    out = texts.mapInPandas(run, ", ".join([*(f"`{c}` string" for c in ids), fields]))
    return out.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) if c in ids else c for c in out.columns))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_position(df: DataFrame, strata: list[str], order: list[Column], spread: Column, rows: int, per_bucket: int = 2000, name: str = "pos") -> DataFrame:
    """Number the rows of each stratum 0, 1, ... in the given order, without gathering a stratum in one task.

    `spread` is a double in [0, 1) that never falls in that order. Rows are split by it into buckets of about `per_bucket`
    rows, counted, and numbered within each bucket on top of the count of the buckets before. `rows` is the number of rows
    of df. Only the counts (one row per stratum and bucket) meet in one place. df is read twice: store it if it is costly.
    """
    buckets = max(1, min(1 << 16, rows // per_bucket))
    b = df.withColumn("__bucket", F.least(F.floor(spread * buckets), F.lit(buckets - 1)).cast("int"))
    keys = [*strata, "__bucket"]
    counts = b.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    counts = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__before")
    numbered = b.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k).eqNullSafe(F.col(f"__k{i}")) if k != "__bucket" else F.col(k) == F.col(f"__k{i}"))
    joined = numbered.join(counts, same)
    return joined.withColumn(name, (F.col("__before") + F.col("__rn") - 1).cast("long")).select(*df.columns, name)


def unit(h: Column) -> Column:
    """A signed 64-bit hash as a double in [0, 1) that rises with the hash read as unsigned."""
    return F.shiftrightunsigned(h, 12).cast("double") / float(1 << 52)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), component being the least node reachable.

    Each round takes the least label among the neighbours, then the label of that label; rounds are written to the shared
    folder, so a lost executor costs one round at most. Nothing is gathered on the driver but the count of changes.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        moved = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = stored(moved.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        changed = new.filter("label != old").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        if not changed:
            discard(both)
            return labels.withColumnRenamed("label", "component")
