"""Facts on a small incident, and each rule both firing and staying silent."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import evidence as E

SPAN = "incident_id string, trace_id string, span_id string, parent_span_id string, service string, start_us long, duration_us long, error boolean"


@pytest.fixture(scope="module")
def facts(spark):
    make = spark.createDataFrame
    windows = make([("i", 10, 20, 5.0, True), ("k", 10, 20, 5.0, False)], "incident_id string, start long, end long, load double, traces_collected boolean")
    services = make([("i", "a"), ("i", "b"), ("i", "c"), ("k", "a")], "incident_id string, service string")
    points = make([("i", "a", "cpu", t, v) for t, v in ((9, 99.0), (10, 1.0), (15, 3.0), (20, 2.0), (21, 99.0))] + [("i", "b", "cpu", 12, 40.0), ("i", "x", "cpu", 12, 1.0)], "incident_id string, service string, family string, ts long, value double")
    base = make([("i", "a", "cpu", 0.2, 1.0, 0.0, 1.0, 50), ("i", "b", "cpu", 0.0, 10.0, 0.0, 2.0, 50), ("i", "b", "memory", 0.0, 1.0, 0.0, 1.0, 0)], "incident_id string, service string, family string, slope double, intercept double, residual_median double, residual_iqr double, samples long")
    s = 1_000_000
    spans = [("i", "t", f"a{k}", None, "a", 11 * s, 100 + k, k == 2) for k in range(5)]
    spans += [("i", "t", "b1", "a0", "b", 12 * s, 7, False), ("i", "t", "b2", "a0", "b", 13 * s, 7, False), ("i", "t", "out", "b1", "x", 12 * s, 7, True), ("i", "t", "early", "a0", "b", 9 * s, 7, True), ("i", "bad id!", "q", None, "a", 12 * s, 9999, True), ("k", "t", "a0", None, "a", 11 * s, 5, True)]
    cover = make([("i", "a", "cpu", 0.9), ("i", "b", "cpu", 0.5)], "incident_id string, service string, family string, coverage double")
    return E.catalog(points, base, make(spans, SPAN), services, windows, ["cpu", "memory"], cover).cache()


def test_facts(facts):
    got = {(r.incident_id, r.service, r.kind, r.family): r for r in facts.collect()}
    assert len(got) == 4 * 4 and len({r.id for r in got.values()}) == 16
    a = got["i", "a", "metric", "cpu"]
    assert (a.state, a.samples, a.least, a.median, a.largest, a.expected, a.coverage) == ("OBSERVED", 3, 1, 2, 3, 2, 0.9)
    assert a.residual_p90 == pytest.approx(1.0) and got["i", "b", "metric", "cpu"].residual_p90 == pytest.approx(15)
    assert (got["i", "b", "metric", "memory"].state, got["i", "b", "metric", "memory"].residual_p90) == ("MISSING", None)
    t = got["i", "a", "traces", None]
    assert (t.state, t.spans, t.errors, [x.span_id for x in t.examples]) == ("OBSERVED", 6, 2, ["a2", "a4", "a3"])
    assert [got[k, s, "traces", None].state for k, s in (("i", "b"), ("i", "c"), ("k", "a"))] == ["OBSERVED", "NOT_OBSERVED", "UNAVAILABLE"]
    d = got["i", "b", "dependencies", None]
    assert [tuple(e) for e in d.edges] == [("a", "b", 2)] and d.external == 1 and got["i", "a", "dependencies", None].external == 0 and got["i", "c", "dependencies", None].edges == []


def test_every_rule_fires_and_stays_silent(facts):
    got = {(r.incident_id, r.service, r.code) for r in E.checks(facts).collect()}
    fires = {c: {k[:2] for k in got if k[2] == c} for c in E.RULES}
    assert fires == {
        "CHECK_METRIC_COVERAGE": {("i", "a"), ("i", "b"), ("i", "c"), ("k", "a")},
        "CHECK_METRIC_DEVIATION": {("i", "b")},
        "CHECK_TRACE_AVAILABILITY": {("i", "c"), ("k", "a")},
        "INSPECT_ERROR_TRACES": {("i", "a")},
        "CHECK_CANDIDATE_INVENTORY": {("i", "b")},
    }
    known = facts.select("id", "kind", "family")
    about = E.checks(facts).join(known, F.col("evidence") == F.col("id"))
    assert {(r.service, r.family) for r in about.filter("code = 'CHECK_METRIC_COVERAGE' and incident_id = 'i' and service = 'a'").collect()} == {("a", "memory")}


def test_a_rule_of_the_caller(facts):
    assert E.checks(facts, {"MANY": ("traces", "spans > 5")}).count() == 1


def test_ids_follow_the_contents(facts, spark):
    again = {r.id for r in facts.select("id").collect()}
    assert {r.id for r in E.checks(facts).select(F.col("evidence").alias("id")).collect()} <= again
