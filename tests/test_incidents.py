"""Small cases of the operators around incidents, worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import diagnosis as D
from tracegrid.operators import incidents as I
from tracegrid.operators import metrics as M


def test_parent_cycles(spark):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(40)]
    ring = [("u", "a", "c"), ("u", "b", "a"), ("u", "c", "b"), ("u", "tail", "a"), ("u", "own", "own"), ("u", "lost", "gone")]
    rows = spark.createDataFrame(chain + ring, "trace_id string, span_id string, parent_span_id string")
    assert sorted(r.span_id for r in I.parent_cycles(rows).collect()) == ["a", "b", "c", "own", "tail"]
    assert I.parent_cycles(rows.filter("trace_id = 't'")).count() == 0


def test_workload_baseline_with_varying_load(spark):
    rows = [("a", "cpu", float(x), 3.0 * x + 1 + (0.1 if x % 2 else -0.1)) for x in range(30)] + [("b", "cpu", float(x), 5.0) for x in range(3)]
    points = spark.createDataFrame(rows, "service string, family string, x double, value double")
    line = M.robust_line(points.filter("service = 'a'").withColumn("y", F.col("value")), ["service"], limit=1.35).first()
    got = {r.service: r for r in D.workload_baseline(points).collect()}
    assert (got["a"].slope, got["a"].intercept) == (pytest.approx(line.slope), pytest.approx(line.intercept)) and abs(got["a"].slope - 3) < 0.01
    assert (got["b"].slope, got["b"].intercept, got["b"].residual_iqr) == (0, 5, 0.05)  # three points: the median, 1 % of it


def test_one_sided_signals(spark):
    base = spark.createDataFrame([("a", s, 0.0, 10.0, 0.0, 2.0) for s in ("error_rate", "span_rate")], "service string, signal string, slope double, intercept double, residual_median double, residual_iqr double")
    now = spark.createDataFrame([("a", "error_rate", 1.0, 4.0), ("a", "span_rate", 1.0, 4.0), ("a", "request_rate", 1.0, 4.0)], "service string, signal string, x double, value double")
    assert {r.signal: r["shift"] for r in D.trace_signal_shift(now, base, ["service"]).collect()} == {"error_rate": 0, "span_rate": 3, "request_rate": 0}


def test_red_states(spark):
    def rows(service, presence, rates, ratio=0.0):
        out = [(service, "presence", t, p) for t, p in enumerate(presence)] + [(service, "request_rate", t, q) for t, q in enumerate(rates)]
        return out + [(service, c, t, ratio) for t in range(len(rates)) for c in ("error_ratio", "latency_p95")]

    data = rows("seen", [1.0, 1.0], [2.0, 3.0]) + rows("quiet", [1.0, 1.0], [0.0, 0.0]) + rows("gap", [1.0, 1.0], [2.0]) + rows("open", [1.0, 1.0], [2.0, 3.0], None) + rows("none", [1.0, 1.0], [None, None]) + rows("away", [1.0, 0.0], [1.0, 1.0])
    df = spark.createDataFrame(data, "service string, channel string, ts int, value double")
    services = df.select("service").union(spark.createDataFrame([("nothing",)], "service string"))
    got = {(r.service, r.channel): r for r in D.red_summary(df, services, 2).collect()}
    assert {s: got[s, "request_rate"].state for s, _ in got} == {"seen": "OBSERVED", "quiet": "NO_ACTIVITY", "gap": "PARTIAL", "open": "PARTIAL", "none": "INCOMPLETE", "away": "UNAVAILABLE", "nothing": "UNAVAILABLE"}
    assert got["quiet", "latency_p95"].channel_state == "NOT_DEFINED_WITHOUT_TRAFFIC" and got["seen", "request_rate"].median == 2.5 and got["gap", "request_rate"].coverage == 0.5


def test_matched_entities_without_traces(spark):
    e = spark.createDataFrame([("i", "Cart_Service"), ("i", "redis"), ("j", "cart"), ("j", "x__y-")], "incident_id string, entity string")
    seen = spark.createDataFrame([("j", "cart"), ("j", "cart-service")], "incident_id string, service string")
    got = {(r.incident_id, r.entity): r.service for r in I.matched_entities(e, seen).collect()}
    assert got == {("i", "Cart_Service"): "cart-service", ("i", "redis"): None, ("j", "cart"): None, ("j", "x__y-"): None}
    assert {r.entity: r.service for r in I.matched_entities(e, seen, resolve=True).filter("incident_id = 'j'").collect()} == {"cart": "cart", "x__y-": "x-y"}


def test_partitions(spark):
    parts = spark.createDataFrame([("a", "fit"), ("a", "test"), ("b", "fit")], "incident_id string, part string")
    got = {(r.incident_id, r.reason) for r in I.partition_faults(parts, ["fit", "calibration", "test"]).collect()}
    assert got == {("a", "shared"), (None, "empty calibration")}
