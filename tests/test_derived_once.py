"""Queries that read the spans several times derive them once, and lines of JSON are parsed once."""

import json

import pytest

from tracegrid.plans import evidence_queries, registry, span_queries  # noqa: F401
from tracegrid.sources import readers

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["met28_facts", "met29_checks", "agg07_operation_evidence", "agg08_window_summary", "agg09_timing_projection", "agg12_active_topology"])
def test_spans_once(spark, name):
    files = registry.QUERIES[name](spark, DIR).inputFiles()
    assert files and not [f for f in files if f.startswith(f"file://{DIR}")]


def test_checks_look_at_written_facts(spark):
    assert len({f.rsplit("/", 2)[1] for f in registry.QUERIES["met29_checks"](spark, DIR).inputFiles()}) == 1


def test_parsed_once(spark, capsys):
    span = lambda i, **more: {"traceId": f"{i:032x}", "spanId": f"{i:016x}", "name": "a", "startTimeUnixNano": "5000", "endTimeUnixNano": "9000"} | more
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "x"}}]}
    of = lambda *spans: json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": list(spans)}, {"spans": []}]}, {"resource": resource, "scopeSpans": []}]})
    lines = spark.createDataFrame([(of(span(1), span(2, spanId="no")),), (of(span(3)),), ("{",), (json.dumps({"resourceSpans": []}),), (json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [None]}]}]}),)], "value string")
    good, rejects = readers.otlp_spans(lines)
    assert sorted(r.trace_id[-1] for r in good.collect()) == ["1", "3"]
    assert sorted(r.reason for r in rejects.collect()) == ["json", "span_id", "trace_id"]
    good.groupBy("service").count().explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("from_json(") == 1
