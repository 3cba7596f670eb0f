"""All queries of the telemetry library: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

FLAGSHIP = "ano_service_rank"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query function, with its oracle where SQL can express it."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    from tracegrid.plans import anomaly_queries, evidence_queries, graph_queries, incident_queries, metric_queries, ranking_queries, source_queries, span_queries, stream_queries, vector_queries  # noqa: F401


_load()
