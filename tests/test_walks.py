"""Exclusive times and window summaries on deep, cyclic and mixed traces, against plain walks."""

from __future__ import annotations

import random

import pytest

from tracegrid.operators import graph as G
from tracegrid.operators import metrics as M
from tracegrid.operators import spans as S

COLUMNS = "incident_id string, trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, start_us long, duration_us long, error boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def plain(rows, kinds=("SERVER", "UNKNOWN")):
    """(incident, trace, span) -> time waited: the walk down from each span through its children, span by span."""
    out = {}
    for inc, t, s, _, v, _, kind, a, d, _ in rows:
        if kind not in kinds:
            continue
        seen, queue, waits = {s}, [s], []
        while queue:
            at = queue.pop()
            for x in rows:
                if x[:2] == (inc, t) and x[3] == at and x[2] not in seen:
                    seen.add(x[2])
                    queue.append(x[2])
                    if x[4] == v and x[6] == "CLIENT":
                        waits.append((max(a, x[7]), min(a + d, x[7] + x[8])))
        total, end = 0, None
        for lo, hi in sorted(w for w in waits if w[1] > w[0]):
            total += max(0, hi - (lo if end is None else max(lo, end)))
            end = hi if end is None else max(end, hi)
        out[inc, t, s] = total
    return out


def trees(seed, traces, size, cyclic=False):
    rng, rows = random.Random(seed), []
    for inc in ("i", "j"):  # the same trace ids in both
        for t in range(traces):
            for k in range(size):
                parent = f"s{rng.randrange(max(0, k - 3), k)}" if k else None
                if cyclic and k == 0 and t % 2:
                    parent = f"s{size - 1}"
                rows.append((inc, f"t{t}", f"s{k}", parent, f"v{rng.randrange(2)}", "op", rng.choice(["SERVER", "CLIENT", "INTERNAL", "UNKNOWN"]), 1_000_000 + rng.randrange(50_000_000), 1 + rng.randrange(9_000_000), rng.random() < 0.3))
    return rows


@pytest.mark.parametrize("cyclic", [False, True])
def test_waits_equal_a_walk_of_each_span(spark, cyclic):
    rows = trees(3, 4, 25, cyclic)
    got = {(r.incident_id, r.trace_id, r.span_id): r.wait_us for r in S.exclusive_time(frame(spark, rows), ("SERVER", "UNKNOWN")).collect()}
    assert got == plain(rows)
    assert sum(v > 0 for v in got.values()) > 5


def test_window_summary_equals_plain_summaries(spark):
    rows = trees(5, 5, 20)
    got = {(r.incident_id, r.window_us, r.service): r for r in S.window_summary(frame(spark, rows), ["incident_id"], 10).collect()}
    size = 10_000_000
    windows = {(r[0], r[7] // size * size) for r in rows}
    assert len(got) == 2 * len(windows)
    import numpy as np

    for inc, w in windows:
        inside = [r for r in rows if r[0] == inc and r[7] // size * size == w]
        waits = plain(inside)
        for v in ("v0", "v1"):
            local = [r for r in inside if r[4] == v]
            server = [r for r in local if r[6] in ("SERVER", "UNKNOWN")]
            timed, g = server or local, got[inc, w, v]
            q = lambda x, p: float(np.quantile(x, p)) if x else 0.0
            wait = [waits[r[:3]] for r in server]
            want = (len(local) / 10, len(server) / 10, float(np.mean([r[9] for r in timed])) if timed else 0.0, *(q([r[8] for r in timed], p) for p in (0.5, 0.9, 0.99)), q([r[8] - x for r, x in zip(server, wait, strict=True)], 0.5), q([x / r[8] for r, x in zip(server, wait, strict=True)], 0.5))
            assert (g.span_rate, g.request_rate, g.error_rate, g.latency_median_us, g.latency_p90_us, g.latency_p99_us, g.exclusive_median_us, g.downstream_wait_ratio) == pytest.approx(want)
            assert g.last_seen_delta_s == pytest.approx((w + size - max((r[7] for r in local), default=w)) / 1e6) and (g.span_count, g.trace_coverage) == (len(local), float(bool(local)))


def test_a_service_without_server_spans_has_no_requests(spark):
    rows = [("i", "t", "a", None, "x", "o", "CLIENT", 1, 10, True), ("i", "t", "b", None, "y", "o", "SERVER", 2, 10, False), ("i", "u", "c", None, "y", "o", "SERVER", 30_000_000, 10, False)]
    got = {(r.window_us, r.service): r for r in S.window_summary(frame(spark, rows), ["incident_id"], 10).collect()}
    x, silent = got[0, "x"], got[30_000_000, "x"]
    assert (x.request_rate, x.span_rate, x.error_rate, x.latency_median_us, x.downstream_wait_ratio) == (0, 0.1, 1, 10, 0)
    assert (silent.span_count, silent.last_seen_delta_s, silent.trace_coverage) == (0, 10, 0)


def test_temporal_shape(spark):
    res = spark.createDataFrame([("a", "cpu", -1, 99.0), ("a", "cpu", 1, 8.0), ("a", "cpu", 11, -2.0), ("a", "mem", 12, 4.0), ("a", "mem", 13, 99.0)], "service string, family string, ts long, residual double")
    spans = spark.createDataFrame([("a", 2, True), ("a", 3, False), ("b", 20, True), ("b", 9, False)], "service string, ts long, error boolean")
    services = spark.createDataFrame([("a",), ("b",)], "service string")
    got = {r.service: tuple(r)[1:] for r in M.temporal_shape(res, spans, services, 0, 12).collect()}
    assert got["a"] == pytest.approx((8, 4, -4, 1 / 12, 1, 0.5, 0, -0.5, 2 / 12, 1)) and got["b"] == (0, 0, 0, 1, 0, 0, 0, 0, 1, 0)


def test_service_key(spark):
    names = ["cart-service-", " Cart_Service ", "cartservice", "orders", "service", "--a__b--"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.k for r in df.select(M.service_key(df.n).alias("k")).collect()] == ["cart", "cart", "cart", "orders", "", "ab"]


def test_small_graphs_in_a_task_equal_large_ones_by_joins(spark):
    rng = random.Random(8)
    rows = [(f"g{g}", rng.randrange(12), rng.randrange(12)) for g in range(6) for _ in range(14)] + [("chain", i, i + 1) for i in range(25)]
    e = spark.createDataFrame(rows, "incident_id string, source long, target long")
    key = ["incident_id"]
    got = {small: sorted(tuple(r) for r in G.reachable(e, key, small).collect()) for small in (0, 12, 1000)}
    assert got[0] == got[12] == got[1000] and ("chain", 0, 25, 25) in got[0]
    holes = e.unionByName(spark.createDataFrame([(None, 1, 2), (None, 2, 3)], e.schema))
    assert G.reachable(holes, key).filter("incident_id is not null").count() == len(got[0])
