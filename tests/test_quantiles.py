"""Exact quantiles of groups that no task holds, against percentile()."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracegrid.functions import stats

Q = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def same(df, keys, buckets=16):
    got = {tuple(r)[:-1]: r.quantiles for r in stats.exact_quantiles(df, keys, "v", Q, buckets=buckets).collect()}
    want = {tuple(r)[:-1]: r.q for r in df.filter("v is not null").groupBy(*keys).agg(F.percentile("v", Q).alias("q")).collect() if r.q}
    assert set(got) == set(want)
    for k, q in want.items():
        assert got[k] == pytest.approx(q, rel=1e-12, abs=1e-12)
    return got


def test_equal_to_percentile(spark):
    """A hot group, ties, one value alone, nulls as key and value."""
    hot = spark.range(40_000).select(F.lit("hot").alias("k"), (F.rand(1) * 1000 - 500).alias("v"))
    ties = spark.range(3000).select(F.lit("ties").alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    few = spark.createDataFrame([("one", 5.0), ("two", 1.0), ("two", 4.0), ("none", None), (None, 2.0), (None, None)], "k string, v double")
    got = same(hot.union(ties).union(few), ["k"])
    assert len(got) == 5 and got[("one",)] == [5.0] * 6
    same(hot.withColumn("j", (F.col("v") > 0)), ["k", "j"])


def test_without_keys_and_empty(spark):
    df = spark.range(5000).select(F.sqrt("id").alias("v"))
    same(df, [])
    assert stats.exact_quantiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", Q).count() == 0


def test_no_task_sorts_more_than_a_part_of_a_hot_group(spark):
    """The rows of the largest part are few next to the group."""
    df = spark.range(100_000).select(F.lit("hot").alias("k"), F.pow(F.rand(3), 4).alias("v"))
    places = df.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 256).alias("p")).first().p
    part = F.size(F.filter(F.array(*map(F.lit, places)), lambda x: x < F.col("v")))
    assert df.groupBy(part).count().agg(F.max("count")).first()[0] < 5_000
    same(df, ["k"], 64)
