"""Spans in buckets by their trace: the same times and links as otherwise, without a shuffle of spans."""

import random

import pytest
from pyspark.sql import functions as F

from tracegrid.functions.lineage import cut_by, joins_in_place
from tracegrid.operators import spans as S
from tracegrid.plans import registry

SCHEMA = "incident_id string, trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, start_us long, duration_us long, error boolean"


def made(spark):
    """Deep traces, parents that are missing or form cycles, ids that recur, traces without an incident or an id."""
    rng, rows = random.Random(3), []
    for t in range(30):
        n = rng.randrange(2, 14)
        for k in range(n):
            parent = rng.choice([f"s{rng.randrange(n)}", f"s{max(0, k - 1)}", None, "gone"])
            rows.append((rng.choice(["i", "j"]) if t % 5 else None, f"t{t % 20}" if t % 7 else None, f"s{k}", parent, rng.choice("ab"), "o", rng.choice(["SERVER", "CLIENT", "CLIENT"]), 1_000_000 * (k % 3), rng.randrange(9_000_000), False))
    return spark.createDataFrame([*rows, *rows[:9]], SCHEMA)


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def placed(df, n=3):
    return cut_by(df.withColumn(S.PLACE, F.concat_ws("@", "trace_id", "incident_id")).repartition(n, S.PLACE), S.PLACE, n)


def test_same_rows(spark):
    df = made(spark)
    tables = spark.catalog.listTables()
    s = placed(df)
    with joins_in_place(spark):
        assert bag(S.exclusive_time(s, buckets=3).drop(S.PLACE)) == bag(S.exclusive_time(df))
        assert bag(S.with_parent(s).drop(S.PLACE)) == bag(S.with_parent(df))
        assert bag(S.window_summary(s, ["incident_id"], 2, 3)) == bag(S.window_summary(df, ["incident_id"], 2))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true" and spark.catalog.listTables() == tables


def test_no_shuffle_of_spans(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables of a test are small enough for a broadcast, which spans are not
    try:
        with joins_in_place(spark):
            plan = S.with_parent(placed(made(spark)), ("service",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_expected_edges_come_from_windows(spark):
    df = made(spark).filter("trace_id is not null").withColumn("environment", F.lit("e"))
    edges = S.window_edges(df, ["environment"], 2)
    windows = df.select("environment", (F.floor(F.col("start_us") / 2_000_000) * 2_000_000).alias("window_us"))
    for least in (0.4, 0.5, 1.0):
        assert bag(S.expected_of_windows(edges, windows, ["environment"], least)) == bag(S.expected_edges(df, ["environment"], 2, least))


def test_overlap_shuffles_no_spans(spark):
    df = made(spark)
    chain = [("i", "deep", f"s{k}", f"s{k - 1}" if k else None, "a" if k < 18 else "b", "o", "SERVER", k, 50, False) for k in range(19)]  # found levels are gathered in between
    df = df.unionByName(spark.createDataFrame(chain, SCHEMA))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with joins_in_place(spark):
            got = S.dependency_overlap(placed(df), ["incident_id"], buckets=3)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert bag(got) == bag(S.dependency_overlap(df, ["incident_id"]))
            once = S.dependency_overlap(placed(df.filter("trace_id <> 'deep'")), ["incident_id"], buckets=3)
            assert bag(once) == bag(S.dependency_overlap(df.filter("trace_id <> 'deep'"), ["incident_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and [x.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for x in plan.splitlines() if "Exchange" in x] == ["incident_id"]


@pytest.mark.parametrize("name", ["agg10_dependency_overlap", "agg11_overlap_deviation"])
def test_overlap_queries_lay_spans_in_buckets(spark, monkeypatch, name):
    seen = []
    whole = S.dependency_overlap
    monkeypatch.setattr(S, "dependency_overlap", lambda spans, *a, **k: seen.append((spans.columns, a, k)) or whole(spans, *a, **k))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    ((columns, a, k),) = seen
    assert S.PLACE in columns and (k.get("buckets") or a[-1]) == 4
