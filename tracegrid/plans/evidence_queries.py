"""Facts and checks over the derived spans, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions.lineage import cut
from tracegrid.operators import diagnosis as D
from tracegrid.operators import evidence as E
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

DAY = 86_400
#: A window of the current phase; one incident was not traced, two services are no candidates.
START, END = 915_148_800, 931_000_000
FAMILIES = ["cpu", "traffic_rate", "memory"]
PTS = """pt AS (SELECT incident_id, service, phase, CAST(start_us // 1000000 // 86400 AS BIGINT) * 86400 AS ts, avg(duration_us) AS cpu, CAST(count(*) AS DOUBLE) AS traffic_rate FROM spans WHERE kind = 'SERVER' GROUP BY 1, 2, 3, 4),
pl AS MATERIALIZED (SELECT incident_id, service, 'cpu' AS family, ts, phase, cpu AS value FROM pt UNION ALL SELECT incident_id, service, 'traffic_rate', ts, phase, traffic_rate FROM pt)"""
WINDOW = f"ts BETWEEN {START} AND {END}"
FACTS = f"""WITH {B.SPANS}, {PTS}, sv AS MATERIALIZED (SELECT DISTINCT incident_id, service FROM spans WHERE service NOT IN ('n-3', 'n-7')),
md AS (SELECT incident_id, service, family, quantile_cont(value, 0.5) AS med FROM pl WHERE phase = 'baseline' GROUP BY 1, 2, 3),
bs AS MATERIALIZED (SELECT incident_id, service, family, any_value(med) AS med, quantile_cont(value - med, [0.25, 0.5, 0.75]) AS q FROM pl JOIN md USING (incident_id, service, family) WHERE phase = 'baseline' GROUP BY 1, 2, 3),
pw AS (SELECT incident_id, service, family, count(*) AS samples, min(value) AS least, quantile_cont(value, 0.5) AS median, max(value) AS largest, quantile_cont(abs(value - med - q[2]) / greatest(q[3] - q[1], 0.01 * abs(q[2]), 0.01 * abs(med), 1e-9), 0.9) AS residual_p90
  FROM pl LEFT JOIN bs USING (incident_id, service, family) WHERE {WINDOW} GROUP BY 1, 2, 3),
sw AS MATERIALIZED (SELECT * FROM spans WHERE start_us BETWEEN {START}000000 AND {END}000000),
tr AS (SELECT incident_id, service, count(*) AS spans, count(*) FILTER (error) AS errors FROM sw GROUP BY 1, 2),
ex AS (SELECT incident_id, service, string_agg(trace_id || '/' || span_id, ' ' ORDER BY k) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, service ORDER BY error DESC, duration_us DESC, span_id, trace_id) AS k FROM sw) WHERE k <= 3 GROUP BY 1, 2),
eg AS MATERIALIZED (SELECT c.incident_id, p.service AS source, c.service AS target, count(*) AS calls FROM sw c JOIN spans p ON p.incident_id = c.incident_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service GROUP BY 1, 2, 3),
en AS (SELECT e.*, u.service AS own, (incident_id, source) IN (SELECT (incident_id, service) FROM sv) AND (incident_id, target) IN (SELECT (incident_id, service) FROM sv) AS inner_edge FROM eg e JOIN (SELECT incident_id AS i, service FROM sv) u ON u.i = e.incident_id AND u.service IN (source, target)),
de AS (SELECT incident_id, own AS service, string_agg(source || '>' || target || ':' || calls, ' ' ORDER BY source, target) FILTER (inner_edge) AS edges, coalesce(sum(calls) FILTER (NOT inner_edge), 0)::BIGINT AS external FROM en GROUP BY 1, 2),
st AS (SELECT sv.*, CASE WHEN incident_id = 'inc-3' THEN 'UNAVAILABLE' WHEN spans > 0 THEN 'OBSERVED' ELSE 'NOT_OBSERVED' END AS state FROM sv LEFT JOIN tr USING (incident_id, service)),
facts AS MATERIALIZED (SELECT incident_id, service, 'metric' AS kind, family, CASE WHEN samples > 0 THEN 'OBSERVED' ELSE 'MISSING' END AS state, coalesce(samples, 0) AS samples, round(least, 3) AS least, round(median, 3) AS median, round(largest, 3) AS largest, round(residual_p90, 4) AS residual_p90, NULL::BIGINT AS spans, NULL::BIGINT AS errors, NULL AS examples, NULL AS edges, NULL::BIGINT AS external
  FROM (SELECT sv.*, family FROM sv, (VALUES ('cpu'), ('traffic_rate'), ('memory')) f(family)) LEFT JOIN pw USING (incident_id, service, family)
UNION ALL SELECT incident_id, service, 'traces', NULL, state, NULL, NULL, NULL, NULL, NULL, coalesce(spans, 0), coalesce(errors, 0), coalesce(examples, ''), NULL, NULL FROM st LEFT JOIN tr USING (incident_id, service) LEFT JOIN ex USING (incident_id, service)
UNION ALL SELECT incident_id, service, 'dependencies', NULL, state, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, coalesce(edges, ''), coalesce(external, 0) FROM st LEFT JOIN de USING (incident_id, service))"""


def facts(spark, d):
    # what several kinds of facts read is computed once: the spans, the points of days, the services and their incidents
    s = cut(B.spans(spark, d).drop("operation"))
    day = F.floor(F.col("start_us") / (DAY * 1_000_000)) * DAY
    g = cut(s.filter("kind = 'SERVER'").groupBy("incident_id", "service", "phase", day.alias("ts")).agg(F.avg("duration_us").alias("cpu"), F.count("*").cast("double").alias("traffic_rate")))
    points = g.unpivot(["incident_id", "service", "phase", "ts"], ["cpu", "traffic_rate"], "family", "value")
    base = D.workload_baseline(points.filter("phase = 'baseline'").withColumn("x", F.lit(1.0)), ["incident_id", "service", "family"])
    every = cut(s.select("incident_id", "service").distinct())
    services = every.filter("service not in ('n-3', 'n-7')")
    windows = every.select("incident_id").distinct().select("incident_id", F.lit(START).cast("long").alias("start"), F.lit(END).cast("long").alias("end"), F.lit(1.0).alias("load"), (F.col("incident_id") != "inc-3").alias("traces_collected"))
    return E.catalog(points, base, s, services, windows, FAMILIES)


@query("met28_facts", f"{FACTS} SELECT * FROM facts")
def met28(spark, d):
    f = facts(spark, d)
    shown = {
        "examples": F.array_join(F.transform("examples", lambda x: F.concat_ws("/", x["trace_id"], x["span_id"])), " "),
        "edges": F.array_join(F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(":"), e["calls"].cast("string"))), " "),
        "residual_p90": F.round("residual_p90", 4), **{c: F.round(c, 3) for c in ("least", "median", "largest")},
    }
    return f.withColumns(shown).drop("id", "expected", "coverage")


@query("met29_checks", f"""{FACTS}, c AS (SELECT incident_id, service, family, unnest([CASE WHEN kind = 'metric' AND samples = 0 THEN 'CHECK_METRIC_COVERAGE' END, CASE WHEN kind = 'metric' AND residual_p90 >= 3 THEN 'CHECK_METRIC_DEVIATION' END, CASE WHEN kind = 'traces' AND state <> 'OBSERVED' THEN 'CHECK_TRACE_AVAILABILITY' END,
CASE WHEN kind = 'traces' AND state = 'OBSERVED' AND errors > 0 THEN 'INSPECT_ERROR_TRACES' END, CASE WHEN kind = 'dependencies' AND external > 0 THEN 'CHECK_CANDIDATE_INVENTORY' END]) AS code FROM facts) SELECT incident_id, service, code, family FROM c WHERE code IS NOT NULL""")
def met29(spark, d):
    f = cut(facts(spark, d))  # a row for each service and kind or family
    known = f.select(F.col("id").alias("evidence"), "family")
    return E.checks(f).join(known, "evidence").select("incident_id", "service", "code", "family")
