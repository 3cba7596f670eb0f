"""Small inputs with known outputs, and properties that hold for any order and partitioning of the rows."""

from __future__ import annotations

import itertools
import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.operators import anomaly as A
from tracegrid.operators import evaluation as E
from tracegrid.operators import graph as G
from tracegrid.operators import metrics as M
from tracegrid.operators import ranking as R
from tracegrid.operators import spans as S
from tracegrid.sources import readers

SPAN = "incident_id string, trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, start_us long, duration_us long, error boolean, phase string"


def spans(spark, rows):
    return spark.createDataFrame([("i", "t", s, p, v, "op", k, a, d, False, "current") for s, p, v, k, a, d in rows], SPAN)


def series(spark, values, name="x"):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], f"key string, idx int, {name} double")


def test_interval_union(spark):
    rows = spark.createDataFrame([("a", 10, 60), ("a", 40, 80), ("b", 0, 5), ("b", 5, 7), ("b", 9, 9)], "k string, start_us long, end_us long")
    assert {r.k: r.union_us for r in stats.interval_union(rows, ["k"]).collect()} == {"a": 70, "b": 7}


def test_exclusive_and_wait(spark):
    df = spans(spark, [("r", None, "a", "SERVER", 0, 100), ("c1", "r", "a", "CLIENT", 10, 50), ("c2", "r", "a", "CLIENT", 40, 40)])
    r = S.exclusive_time(df).first()
    assert (r.wait_us, r.exclusive_us) == (70, 30)
    clipped = spans(spark, [("r", None, "a", "SERVER", 0, 100), ("c1", "r", "a", "CLIENT", 50, 500)])
    assert S.exclusive_time(clipped).first().wait_us == 50


def test_kinds_and_lost_parents(spark):
    df = spans(spark, [("r", None, "a", "x", 0, 9), ("b", "r", "b", "x", 1, 5), ("c", "gone", "c", "x", 1, 5), ("d", "r", "a", "x", 1, 1)])
    assert {r.span_id: r.inferred_kind for r in S.inferred_kinds(df).collect()} == {"r": "SERVER", "b": "SERVER", "c": "INTERNAL", "d": "INTERNAL"}
    assert [r.span_id for r in S.unresolved(df).collect()] == ["c"]


def test_dependency_overlap(spark):
    df = spans(spark, [("e", None, "a", "SERVER", 0, 100), ("l", "e", "a", "INTERNAL", 0, 100), ("x", "l", "b", "SERVER", 10, 50), ("y", "l", "c", "SERVER", 50, 40), ("z", "y", "d", "SERVER", 50, 40)])
    r = next(x for x in S.dependency_overlap(df, ["incident_id"]).collect() if x.service == "a")
    assert (r.overlap_median, r.residual_median, r.entries, r.clipped) == (0.8, 20, 1, 0)


def test_walks_reach_the_end_of_deep_traces(spark):
    deep = 24  # spans of one service below the entry; the last two are a client call and another service's server
    rows = [("n0", None, "a", "SERVER", 0, 100), *((f"n{i}", f"n{i - 1}", "a", "INTERNAL", 0, 100) for i in range(1, deep)), ("c", f"n{deep - 1}", "a", "CLIENT", 10, 50), ("x", "c", "b", "SERVER", 20, 40)]
    df = spans(spark, rows)
    below = S.descendants(df).filter("ancestor = 'n0'").collect()
    assert {r.span_id: r.level for r in below} == {**{f"n{i}": i for i in range(1, deep)}, "c": deep, "x": deep + 1} and len(below) == deep + 1
    r = S.exclusive_time(df).filter("span_id = 'n0'").first()
    assert (r.wait_us, r.exclusive_us) == (50, 50)
    r = next(x for x in S.dependency_overlap(df, ["incident_id"]).collect() if x.service == "a")
    assert (r.entries, r.overlap_median, r.residual_median) == (1, 0.4, 60)


def test_walks_end_on_cyclic_parents(spark):
    df = spans(spark, [("e", None, "b", "SERVER", 0, 100), ("p", "q", "a", "CLIENT", 10, 20), ("q", "p", "a", "SERVER", 0, 50), ("s", "s", "a", "SERVER", 0, 9), ("k", "q", "b", "SERVER", 12, 5)])
    assert {(r.ancestor, r.span_id, r.level) for r in S.descendants(df).collect()} == {("p", "q", 1), ("q", "p", 1), ("q", "k", 1), ("p", "k", 2)}
    assert {r.span_id: r.wait_us for r in S.exclusive_time(df).collect()} == {"e": 0, "q": 20, "s": 0, "k": 0}
    # a span of two copies with different parents: the entry's walk meets the cycle x, y
    loop = spans(spark, [("e", None, "a", "SERVER", 0, 100), ("x", "e", "a", "INTERNAL", 0, 9), ("x", "y", "a", "INTERNAL", 0, 9), ("y", "x", "a", "INTERNAL", 0, 9), ("z", "y", "b", "SERVER", 0, 10)])
    r = S.dependency_overlap(loop, ["incident_id"]).filter("service = 'a'").first()
    assert (r.entries, r.overlap_median, r.clipped) == (1, 0.1, 0)


def test_reachable_beyond_64_services(spark):
    got = G.reachable(spark.createDataFrame([(i, i + 1) for i in range(70)], "source long, target long")).filter("source = 0").collect()
    assert {r.target: r.distance for r in got} == {i: i for i in range(1, 71)}


def test_failures(spark):
    df = spark.createDataFrame([(0,), (14,), (500,), (None,)], "c int")
    assert [r[0] for r in df.select(S.failed_code(F.col("c"))).collect()] == [False, True, True, False]
    assert [r[0] for r in df.select(S.failed_code(F.col("c"), unknown_is_ok=False)).collect()] == [False, True, True, None]


def test_duplicate_spans_and_arrival_order_do_not_matter(spark):
    rows = [("r", None, "a", "SERVER", 0, 100), ("c", "r", "a", "CLIENT", 10, 50), ("s", "c", "b", "SERVER", 12, 40)]
    want = S.service_graph(spans(spark, rows), ["incident_id"]).collect()
    for p in itertools.permutations(rows):
        assert S.service_graph(spans(spark, p).repartition(3), ["incident_id"]).collect() == want
    merged, conflicts = S.merge_partial([spans(spark, rows), spans(spark, rows[1:])])
    assert merged.count() == 3 and conflicts.count() == 0
    _, conflicts = S.merge_partial([spans(spark, rows), spans(spark, [("s", "c", "other", "SERVER", 12, 40)])])
    assert [(r.trace_id, r.span_id) for r in conflicts.collect()] == [("t", "s")]


def test_renaming_a_service_changes_names_only(spark):
    rows = [("r", None, "a", "SERVER", 0, 100), ("c", "r", "a", "CLIENT", 10, 50), ("s", "c", "b", "SERVER", 12, 40)]
    one = S.window_summary(spans(spark, rows), ["incident_id"], 10).filter("service = 'b'").drop("service").collect()
    two = S.window_summary(spans(spark, [(s, p, {"b": "zz"}.get(v, v), k, a, d) for s, p, v, k, a, d in rows]), ["incident_id"], 10).filter("service = 'zz'").drop("service").collect()
    assert one == two


def test_latency_stats(spark):
    rows = [("i", i, "s", "o", i, float(i + 1), False, "baseline") for i in range(5)]
    o = spark.createDataFrame(rows, "incident_id string, sample_id long, service string, operation string, ts_us long, latency_ms double, failed boolean, phase string")
    r = A.latency_stats(o).first()
    logs = [math.log1p(x) for x in range(1, 6)]
    mad = statistics.median(abs(x - math.log1p(3)) for x in logs)
    assert r.median_ms == 3 and r.p95_ms == 5 and r.log_median == pytest.approx(math.log1p(3), abs=1e-12) and r.log_mad == pytest.approx(mad, abs=1e-12)
    same = A.latency_stats(o.withColumn("latency_ms", F.lit(10.0))).first()
    assert same.scale == A.LEAST_SCALE


def test_sliding_and_cusum(spark):
    df = series(spark, [1, 2, 3, 4])
    got = df.select("idx", A.sliding_quantile(df, ["key"], "idx", "x", 3, 0.5).alias("m")).orderBy("idx").collect()
    assert [r.m for r in got] == [None, None, 2, 3]
    df = series(spark, [0, 0, 0, 10, 20])
    assert df.select(A.sliding_quantile(df, ["key"], "idx", "x", 5, 0.9).alias("m")).agg(F.max("m")).first()[0] == pytest.approx(16)
    assert [r.cusum for r in stats.cusum(series(spark, [0, 1, 2, 0]), ["key"], "idx", "x", 0.5).orderBy("idx").collect()] == [0, 0.5, 2, 1.5]


def test_cusum_and_runs_against_loops(spark):
    rng = random.Random(1)
    for _ in range(3):
        x = [rng.choice([0, 0.2, 1, 3]) for _ in range(60)]
        s, want = 0.0, []
        for v in x:
            s = max(0.0, s + max(0.0, v) - 0.5)
            want.append(s)
        got = [r.cusum for r in stats.cusum(series(spark, x), ["key"], "idx", "x", 0.5).orderBy("idx").collect()]
        assert got == pytest.approx(want)
        run = max(len(list(g)) if k else 0 for k, g in itertools.groupby(v >= 1 for v in x))
        assert stats.longest_run(series(spark, x).withColumn("on", F.col("x") >= 1), ["key"], "idx", "on").first().longest_run == run


def test_metric_names(spark):
    df = spark.createDataFrame([("orders_latency-90",), ("ts-order-service_diskio",), ("orders_latency",)], "m string")
    entity, family = M.parsed_metric(F.col("m"))
    assert [tuple(r) for r in df.select(entity, family).collect()] == [("orders", "latency_p90"), ("ts-order-service", "disk_io"), ("orders", None)]
    keys = spark.createDataFrame([("orders_service",), ("Orders",), ("ts-order-service",)], "e string").select(M.service_key(F.col("e")))
    assert [r[0] for r in keys.collect()] == ["orders", "orders", "tsorder"]


def test_percentiles(spark):
    df = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 3.0), ("i", "c", 2.0), ("j", "a", 2.0), ("j", "b", 2.0), ("k", "a", 5.0)], "incident_id string, service string, v double")
    got = df.select("incident_id", "service", stats.tied_percentile(["incident_id"], "v", single=1.0).alias("p")).orderBy("incident_id", "service").collect()
    assert [r.p for r in got] == [0, 1, 0.5, 0.5, 0.5, 1.0]


def test_robust_line_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 80)
    y = 2 * x + 1 + rng.normal(0, 0.1, 80)
    y[:6] += 40
    w = np.ones(80)
    for k in range(9):  # least squares, then eight times re-weighted; scaled by the median distance from the median
        if k:
            res = y - b[1] - b[0] * x
            w = np.minimum(1, 1.345 / np.maximum(np.abs(res) / max(1.4826 * np.median(np.abs(res - np.median(res))), 1e-9), 1e-12))
        b = np.linalg.lstsq(np.c_[x, np.ones(80)] * w[:, None], y * w, rcond=None)[0]
    rows = spark.createDataFrame([("k", float(a), float(c)) for a, c in zip(x, y, strict=True)], "k string, x double, y double")
    r = M.robust_line(rows, ["k"]).first()
    assert (r.slope, r.intercept) == (pytest.approx(b[0], rel=1e-6), pytest.approx(b[1], rel=1e-4)) and abs(r.slope - 2) < 0.05


def test_constant_line(spark):
    rows = spark.createDataFrame([("k", 3.0, float(y)) for y in (1, 2, 6)], "k string, x double, y double")
    b = np.linalg.lstsq(np.c_[np.ones(3), np.full(3, 3.0)], np.array([1.0, 2, 6]), rcond=None)[0]
    r = M.robust_line(rows, ["k"], rounds=0).first()
    assert (r.intercept, r.slope) == (pytest.approx(b[0]), pytest.approx(b[1]))


def test_accounting_of_invalid_copies(spark):
    """An invalid copy does not take the place of the valid span."""
    rows = spark.createDataFrame([("t", "s", " ", 1), ("t", "s", "a", 2), ("t", "s", "a", 3)], "trace_id string, span_id string, service string, start_us long")
    r = S.accounting(rows, ["trace_id"]).first()
    assert (r.accepted, r.duplicate, r.ignored) == (1, 1, 1)


def test_frontier(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    shift = lambda rows: spark.createDataFrame(rows, "service string, channel string, delta double")
    on = lambda rows: sorted(r.service for r in G.red_frontier(edges, shift(rows)).filter("frontier").collect())
    assert on([("a", "error", 5.0), ("b", "error", 6.0), ("c", "error", 0.0)]) == ["b"]
    assert on([("a", "error", 5.0)]) == ["a"]
    ranking = spark.createDataFrame([("i", s, k) for k, s in enumerate("cab", 1)], "incident_id string, service string, rank long")
    front = G.red_frontier(edges, shift([("a", "error", 5.0), ("b", "error", 6.0)]))
    assert [r.service for r in G.tiered_order(ranking, front, edges).orderBy("new_rank").collect()] == ["b", "a", "c"]
    cyclic = edges.union(spark.createDataFrame([("c", "a")], "source string, target string"))
    got = G.tiered_order(ranking, front, cyclic).orderBy("new_rank").collect()
    assert [r.service for r in got] == ["c", "a", "b"] and {r.abstained for r in got} == {"cyclic"}


def test_closure_on_random_graphs(spark):
    rng = random.Random(9)
    e = list({(rng.randrange(9), rng.randrange(9)) for _ in range(14)})
    want, reach = {}, {(a, b): 1 for a, b in e}
    frontier = dict(reach)
    while frontier:
        want |= {k: v for k, v in frontier.items() if k not in want}
        frontier = {(a, d): v + 1 for (a, b), v in frontier.items() for c, d in e if b == c and (a, d) not in want}
    got = {(r.source, r.target): r.distance for r in G.reachable(spark.createDataFrame(e, "source long, target long")).collect()}
    assert got == want


def test_conformal_and_abstention(spark):
    cal = spark.createDataFrame([(0.0,), (0.5,)], "truth_score double")
    test = spark.createDataFrame([("i", "x", 0.0, False), ("i", "y", 0.5, True), ("i", "z", 1.0, False)], "incident_id string, service string, rank_score double, is_root boolean")
    r = E.conformal(cal, test, 0.9).first()
    assert (r.quantile, r.mean_size, r.coverage) == (0.5, 2, 1)
    rec = spark.createDataFrame([("a", 0.9, True, 1), ("b", 0.8, True, 1), ("c", 0.2, False, 4)], "incident_id string, quality double, correct boolean, truth_rank int")
    a = E.abstention(rec, 0.9).first()
    assert a.coverage == pytest.approx(2 / 3) and a.accuracy == 1 and a.threshold == 0.8
    assert E.selective(rec, 0.8).first().mrr == 1


def test_exact_mcnemar(spark):
    rows = [(True, True)] * 3 + [(True, False)] * 7 + [(False, True)] * 2 + [(False, False)] * 5
    p = E.mcnemar(spark.createDataFrame([("g", a, b) for a, b in rows], "g string, a boolean, b boolean"), ["g"]).first().p
    assert p == pytest.approx(2 * sum(math.comb(9, i) for i in range(3)) / 2**9)


def test_rerank_keeps_membership_and_tail(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("i", f"s{k}", k, rng.random()) for k in range(1, 11)], "incident_id string, service string, rank int, second double")
    got = R.rerank_top(df, 4, "second").orderBy("new_rank").collect()
    assert {r.service for r in got[:4]} == {f"s{k}" for k in range(1, 5)} and [r.rank for r in got[4:]] == list(range(5, 11))
    assert [r.second for r in got[:4]] == sorted((r.second for r in got[:4]), reverse=True)


def test_folds_keep_clusters_together(spark):
    df = spark.createDataFrame([(f"c{i % 6}", i) for i in range(24)], "cluster string, id int")
    rows = E.grouped_folds(df, "cluster", 3, 1).collect()
    assert len(rows) == 24 and all(len({r.fold for r in rows if r.cluster == c}) == 1 for c in {r.cluster for r in rows})
    assert sorted(len({r.cluster for r in rows if r.fold == f}) for f in range(3)) == [2, 2, 2]


def test_otlp(spark):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    span = lambda **x: {"traceId": "0" * 31 + "1", "spanId": "0" * 15 + "2", "name": "n", "kind": 2, "startTimeUnixNano": "1700000000000001999", "endTimeUnixNano": "1700000000000005000"} | x
    env = lambda *s: json.dumps({"resourceSpans": [{"resource": {"attributes": [attr("service.name", "a")]}, "scopeSpans": [{"spans": list(s)}]}]})
    lines = spark.createDataFrame([(env(span(attributes=[attr("http.method", "GET"), attr("http.request.method", "PUT"), attr("http.status_code", "503")])),), (env(span(spanId="0" * 16), span(endTimeUnixNano="1")),), ("{oops",)], "value string")
    good, bad = readers.otlp_spans(lines)
    r = good.collect()
    assert len(r) == 1 and (r[0].service, r[0].kind, r[0].start_us, r[0].duration_us, r[0].http_method, r[0].error) == ("a", "SERVER", 1700000000000001, 4, "PUT", True)
    assert sorted(x.reason for x in bad.collect()) == ["duration", "json", "span_id"]


def test_jaeger(spark):
    doc = {"data": [{"traceID": "t", "processes": {"p": {"serviceName": "gateway"}, "q": {"serviceName": "orders"}}, "spans": [
        {"traceID": "t", "spanID": "b", "processID": "q", "operationName": "o", "startTime": 2, "duration": 3, "references": [{"refType": "CHILD_OF", "spanID": "a"}], "tags": [{"key": "span.kind", "value": "server"}, {"key": "http.status_code", "value": "500"}]},
        {"traceID": "t", "spanID": "a", "processID": "p", "operationName": "g", "startTime": 1, "duration": 9, "references": [], "tags": []}]}]}
    got = {r.span_id: r for r in readers.jaeger_spans(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()}
    assert tuple(got["b"].observed_edge) == ("gateway", "orders") and got["a"].observed_edge is None
    assert (got["b"].kind, got["b"].error, got["a"].kind, got["a"].error) == ("SERVER", True, "UNKNOWN", False)


def test_matrix_and_logs(spark):
    doc = {"data": {"result": [{"metric": {"service": "a"}, "values": [["1", "2.5"], ["2", "NaN"], ["3", "-1"]]}, {"metric": {"service": "x"}, "values": [["1", "1"]]}]}}
    points, counts = readers.matrix_points(spark.createDataFrame([(json.dumps(doc),)], "value string"), ignored=("x",))
    assert [(r.service, r.ts, r.value) for r in points.collect()] == [("a", 1.0, 2.5)]
    assert {r.state: r.n for r in counts.collect()} == {"kept": 1, "not_finite": 1, "negative": 1}
    lines = [("a", 5, '{"event.name": "x", "secret": "1", "http.response.status_code": "403"}')] * 2 + [("a", 15, '{"error.type": "ReadTimeout"}'), ("a", 6, "plain"), ("a", 30, '{"event.name": "late"}')]
    logs = readers.log_records(spark.createDataFrame(lines, "service string, source_timestamp_ns long, line string"), 10, 20)
    got = {r.source_timestamp_ns: (r.period, r.c, sorted(r.fields)) for r in logs.withColumn("c", readers.event_category(F.col("fields"))).collect()}
    assert got == {5: ("BEFORE_INCIDENT", "access_denied", ["event.name", "http.response.status_code"]), 15: ("INCIDENT", "timeout", ["error.type"])}


def test_seal_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "incident_id string, v int")
    one, two = readers.seal(df).first(), readers.seal(df.repartition(3).select("v", "incident_id")).first()
    assert one == two and one.rows == 3 and readers.seal(df.withColumn("v", F.lit(1))).first().digest != one.digest
    labels = spark.createDataFrame([("a", "x"), ("b", "y")], "incident_id string, root string")
    assert readers.joined_after_seal(df, labels, one.digest).count() == 3
    with pytest.raises(ValueError, match="sealed"):
        readers.joined_after_seal(df.limit(1), labels, one.digest)
    with pytest.raises(ValueError, match="keys"):
        readers.joined_after_seal(df, labels.limit(1), one.digest)
    with pytest.raises(ValueError, match="truth"):
        readers.assert_truth_free(labels.withColumnRenamed("root", "root_service"))
    path = f"{tmp_path}/out"
    readers.append_new(df.dropDuplicates(), path, ["incident_id"])
    readers.append_new(df.union(spark.createDataFrame([("c", 3)], df.schema)), path, ["incident_id"])
    assert sorted(r.incident_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_lifecycle_changes(spark):
    rows = [("s", "1", "start", 1, "v1", 10), ("s", "1", "stop", 2, "v1", 10), ("s", "2", "start", 3, "v2", 10), ("s", "2", "stop", 4, "v2", 10), ("s", "3", "start", 5, "v2", 20), ("t", "9", "start", 1, "v1", 1)]
    got = readers.lifecycle_changes(spark.createDataFrame(rows, "service string, instance string, action string, at long, image string, memory_limit long"))
    assert [(r.instance, r.change) for r in got.orderBy("at").collect()] == [("2", "deployment"), ("3", "configuration_change")]
