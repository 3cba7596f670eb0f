"""Queries on spans, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions.lineage import cut, cut_by, joins_in_place
from tracegrid.operators import spans as S
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

WITH = f"WITH {B.SPANS}"
LINK = "spans c LEFT JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id"


OVERLAP_COLUMNS = ["incident_id", "trace_id", "span_id", "parent_span_id", "service", "start_us", "duration_us"]
TIMED_COLUMNS = [*OVERLAP_COLUMNS, "kind"]


def derived(spark, d, *columns):
    """These columns of the spans, derived once and written: for what reads them several times."""
    return cut(B.spans(spark, d).select(*columns))


def placed(spark, d, *columns):
    """derived() in buckets by the trace, and how many: what links and climbs by trace shuffles none of them."""
    n = B.parts(B.read(spark, d, "lineitem"))
    return cut_by(B.spans(spark, d, n).select(S.PLACE, *columns), S.PLACE, n), n


def r(c, n: int = 6):
    return F.round(c, n)


@query("jon01_parent_child", f"{WITH} SELECT c.incident_id, c.kind, p.kind AS parent_kind, count(*) AS n, sum(c.duration_us) AS us FROM {LINK} GROUP BY 1, 2, 3")
def jon01(spark, d):
    return S.with_parent(B.spans(spark, d)).groupBy("incident_id", "kind", "parent_kind").agg(F.count("*").alias("n"), F.sum("duration_us").alias("us"))


@query("jon02_calls_other", f"{WITH} SELECT incident_id, service, count(*) AS n FROM spans a WHERE EXISTS (SELECT 1 FROM spans b WHERE b.trace_id = a.trace_id AND b.parent_span_id = a.span_id AND b.service <> a.service) GROUP BY 1, 2")
def jon02(spark, d):
    return S.calls_other_service(B.spans(spark, d)).groupBy("incident_id", "service").agg(F.count("*").alias("n"))


LOST = "lossy AS (SELECT * FROM spans WHERE NOT (kind = 'CLIENT' AND duration_us % 7 = 0))"


def lossy(spark, d):
    """Spans of which some clients got lost on the way."""
    return B.spans(spark, d).filter("not (kind = 'CLIENT' and duration_us % 7 = 0)")


@query("jon03_unresolved", f"{WITH}, {LOST} SELECT incident_id, service, count(*) AS n, min(start_us) AS first_us FROM lossy a WHERE parent_span_id <> '' AND NOT EXISTS (SELECT 1 FROM lossy b WHERE b.trace_id = a.trace_id AND b.span_id = a.parent_span_id) GROUP BY 1, 2")
def jon03(spark, d):
    return S.unresolved(lossy(spark, d)).groupBy("incident_id", "service").agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"))


@query("agg01_service_graph", f"{WITH} SELECT c.incident_id, p.service AS source, c.service AS target, count(*) AS observations, min(c.start_us) AS first_seen, max(c.start_us) AS last_seen FROM {LINK} WHERE p.service <> c.service GROUP BY 1, 2, 3")
def agg01(spark, d):
    return S.service_graph(B.spans(spark, d), ["incident_id"])


@query("agg02_accounting", f"""{WITH}, s AS (SELECT incident_id, trace_id, span_id, CASE WHEN duration_us % 11 = 0 THEN ' ' ELSE service END AS service, start_us FROM spans UNION ALL SELECT incident_id, trace_id, span_id, service, start_us FROM spans WHERE duration_us % 3 = 0),
m AS (SELECT *, trim(service) <> '' AS ok, row_number() OVER (PARTITION BY trace_id, span_id, trim(service) <> '' ORDER BY start_us, service) = 1 AS one FROM s)
SELECT incident_id, count(*) FILTER (ok AND one) AS accepted, count(*) FILTER (ok AND NOT one) AS duplicate, count(*) FILTER (NOT ok) AS ignored FROM m GROUP BY 1""")
def agg02(spark, d):
    s = B.spans(spark, d)
    worn = s.withColumn("service", F.when(F.col("duration_us") % 11 == 0, " ").otherwise(F.col("service"))).unionByName(s.filter("duration_us % 3 = 0"))
    return S.accounting(worn, ["incident_id"])


KINDS = """kinds AS (SELECT c.*, p.service AS parent_service, p.span_id IS NOT NULL AS found,
  CASE WHEN coalesce(c.parent_span_id, '') = '' OR p.service <> c.service THEN 'SERVER'
       WHEN EXISTS (SELECT 1 FROM lossy k WHERE k.trace_id = c.trace_id AND k.parent_span_id = c.span_id AND k.service <> c.service) THEN 'CLIENT' ELSE 'INTERNAL' END AS inferred_kind
  FROM lossy c LEFT JOIN lossy p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id)"""


@query("agg03_inferred_kinds", f"{WITH}, {LOST}, {KINDS} SELECT incident_id, kind, inferred_kind, count(*) AS n FROM kinds GROUP BY 1, 2, 3")
def agg03(spark, d):
    return S.inferred_kinds(lossy(spark, d)).groupBy("incident_id", "kind", "inferred_kind").agg(F.count("*").alias("n"))


@query("agg04_coverage", f"""{WITH}, {LOST}, {KINDS} SELECT incident_id, count(*) AS spans, count(*) FILTER (inferred_kind = 'SERVER') AS server, count(*) FILTER (inferred_kind = 'CLIENT') AS client,
count(*) FILTER (inferred_kind = 'INTERNAL') AS internal, round(count(*) FILTER (parent_span_id <> '' AND found) / CAST(count(*) FILTER (parent_span_id <> '') AS DOUBLE), 6) AS parent_match, round(count(error) / CAST(count(*) AS DOUBLE), 6) AS error_coverage FROM kinds GROUP BY 1""")
def agg04(spark, d):
    c = S.coverage(lossy(spark, d), ["incident_id"])
    return c.withColumns({x: r(x) for x in ("parent_match", "error_coverage")})


UNION = """marked AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY k1, k2 ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS fresh FROM iv WHERE b > a),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY k1, k2 ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM marked),
un AS (SELECT k1, k2, sum(len) AS union_us FROM (SELECT k1, k2, g, max(b) - min(a) AS len FROM isl GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("agg05_interval_union", f"{WITH}, iv AS (SELECT trace_id AS k1, service AS k2, start_us AS a, start_us + duration_us AS b FROM spans WHERE kind = 'CLIENT'), {UNION} SELECT k2 AS service, count(*) AS traces, CAST(sum(union_us) AS BIGINT) AS union_us FROM un GROUP BY 1")
def agg05(spark, d):
    from tracegrid.functions.stats import interval_union

    s = B.spans(spark, d).filter("kind = 'CLIENT'").withColumn("end_us", F.col("start_us") + F.col("duration_us"))
    return interval_union(s, ["trace_id", "service"]).groupBy("service").agg(F.count("*").alias("traces"), F.sum("union_us").alias("union_us"))


TIMED = f"""below AS (SELECT trace_id, parent_span_id AS anc, span_id FROM spans WHERE parent_span_id <> ''
  UNION ALL SELECT b.trace_id, a.parent_span_id, b.span_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id WHERE a.parent_span_id <> ''
  UNION ALL SELECT c.trace_id, a.parent_span_id, c.span_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id JOIN spans c ON c.trace_id = b.trace_id AND c.parent_span_id = b.span_id WHERE a.parent_span_id <> ''),
iv AS (SELECT s.trace_id AS k1, s.span_id AS k2, greatest(s.start_us, c.start_us) AS a, least(s.start_us + s.duration_us, c.start_us + c.duration_us) AS b
  FROM spans s JOIN below d ON d.trace_id = s.trace_id AND d.anc = s.span_id JOIN spans c ON c.trace_id = d.trace_id AND c.span_id = d.span_id
  WHERE s.kind = 'SERVER' AND c.kind = 'CLIENT' AND c.service = s.service AND c.start_us < s.start_us + s.duration_us AND c.start_us + c.duration_us > s.start_us),
{UNION},
timed AS (SELECT s.*, CAST(coalesce(u.union_us, 0) AS BIGINT) AS wait_us, greatest(0, s.duration_us - CAST(coalesce(u.union_us, 0) AS BIGINT)) AS exclusive_us,
  CASE WHEN s.duration_us > 0 THEN least(1.0, greatest(0, s.duration_us - coalesce(u.union_us, 0)) / CAST(s.duration_us AS DOUBLE)) ELSE 0.0 END AS exclusive_ratio
  FROM spans s LEFT JOIN un u ON u.k1 = s.trace_id AND u.k2 = s.span_id WHERE s.kind = 'SERVER')"""


@query("agg06_exclusive_time", f"{WITH}, {TIMED} SELECT incident_id, service, count(*) AS n, CAST(sum(wait_us) AS BIGINT) AS wait_us, CAST(sum(exclusive_us) AS BIGINT) AS exclusive_us, round(avg(exclusive_ratio), 6) AS ratio FROM timed GROUP BY 1, 2")
def agg06(spark, d):
    return S.exclusive_time(derived(spark, d, *TIMED_COLUMNS)).groupBy("incident_id", "service").agg(F.count("*").alias("n"), F.sum("wait_us").alias("wait_us"), F.sum("exclusive_us").alias("exclusive_us"), r(F.avg("exclusive_ratio")).alias("ratio"))


REFS = "refs AS (SELECT incident_id, service, operation, trace_id, CASE WHEN duration_us % 5 = 0 THEN 'gone' ELSE span_id END AS span_id FROM spans WHERE kind = 'SERVER' AND phase = 'current')"


def refs(spans):
    s = spans.filter("kind = 'SERVER' and phase = 'current'")
    return s.select("incident_id", "service", "operation", "trace_id", F.when(F.col("duration_us") % 5 == 0, "gone").otherwise(F.col("span_id")).alias("span_id"))


@query("agg07_operation_evidence", f"""{WITH}, {TIMED}, {REFS} SELECT q.incident_id, q.service, q.operation, count(*) AS refs, count(t.trace_id) AS matched, round(count(t.trace_id) / CAST(count(*) AS DOUBLE), 6) AS coverage,
round(coalesce(quantile_cont(t.exclusive_ratio, 0.5), 0), 6) AS median_exclusive_ratio, round(coalesce(quantile_cont(CAST(t.duration_us AS DOUBLE), 0.5), 0), 3) AS median_duration_us, round(coalesce(quantile_cont(CAST(t.wait_us AS DOUBLE), 0.5), 0), 3) AS median_wait_us
FROM refs q LEFT JOIN timed t ON t.trace_id = q.trace_id AND t.span_id = q.span_id GROUP BY 1, 2, 3""")
def agg07(spark, d):
    s = derived(spark, d, *TIMED_COLUMNS, "operation", "phase")
    e = S.operation_evidence(S.exclusive_time(s), refs(s))
    return e.withColumns({"coverage": r("coverage"), "median_exclusive_ratio": r("median_exclusive_ratio"), "median_duration_us": r("median_duration_us", 3), "median_wait_us": r("median_wait_us", 3)})


MONTH = 2_592_000
_W = f"CAST(floor(start_us / {MONTH}000000.0) AS BIGINT) * {MONTH}000000"
WINDOWED = f"ws AS (SELECT * REPLACE (trace_id || '@' || ({_W}) AS trace_id), {_W} AS window_us FROM spans)"
SUMMARY = f"""g AS (SELECT incident_id, window_us, service, count(*) AS n, count(*) FILTER (kind IN ('SERVER', 'UNKNOWN')) AS k, max(start_us) AS last, avg(CAST(error AS INT)) AS ea, avg(CAST(error AS INT)) FILTER (kind IN ('SERVER', 'UNKNOWN')) AS er,
  quantile_cont(CAST(duration_us AS DOUBLE), [0.5, 0.9, 0.99]) AS qa, quantile_cont(CAST(duration_us AS DOUBLE), [0.5, 0.9, 0.99]) FILTER (kind IN ('SERVER', 'UNKNOWN')) AS qr FROM ws GROUP BY 1, 2, 3),
x AS (SELECT incident_id, window_us, service, quantile_cont(CAST(exclusive_us AS DOUBLE), 0.5) AS e, quantile_cont(wait_us / CAST(greatest(duration_us, 1) AS DOUBLE), 0.5) AS w FROM timed GROUP BY 1, 2, 3),
grid AS (SELECT * FROM (SELECT DISTINCT incident_id, service FROM ws) JOIN (SELECT DISTINCT incident_id, window_us FROM ws) USING (incident_id))"""


@query("agg08_window_summary", f"""{WITH}, {WINDOWED}, {TIMED.replace("spans", "ws")}, {SUMMARY} SELECT incident_id, window_us, service, round(coalesce(n, 0) / {MONTH}.0, 12) AS span_rate, round(coalesce(k, 0) / {MONTH}.0, 12) AS request_rate, round(coalesce(er, ea, 0), 6) AS error_rate,
round(coalesce(CASE WHEN k > 0 THEN qr[1] ELSE qa[1] END, 0), 3) AS latency_median_us, round(coalesce(CASE WHEN k > 0 THEN qr[2] ELSE qa[2] END, 0), 3) AS latency_p90_us, round(coalesce(CASE WHEN k > 0 THEN qr[3] ELSE qa[3] END, 0), 3) AS latency_p99_us,
round(coalesce(e, 0), 3) AS exclusive_median_us, round(coalesce(w, 0), 6) AS downstream_wait_ratio, round((window_us + {MONTH}000000 - coalesce(last, window_us)) / 1000000.0::DOUBLE, 3) AS last_seen_delta_s, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS trace_coverage,
coalesce(n, 0) AS span_count, coalesce(k, 0) AS request_count FROM grid LEFT JOIN g USING (incident_id, window_us, service) LEFT JOIN x USING (incident_id, window_us, service)""")
def agg08(spark, d):
    s = S.window_summary(derived(spark, d, *TIMED_COLUMNS, "error"), ["incident_id"], MONTH)
    fine = {c: r(c, 3) for c in ("latency_median_us", "latency_p90_us", "latency_p99_us", "exclusive_median_us", "last_seen_delta_s")}
    return s.withColumns(fine | {c: r(c, 12) for c in ("span_rate", "request_rate")} | {c: r(c) for c in ("error_rate", "downstream_wait_ratio")})


@query("agg08_window_edges", f"""{WITH}, g AS (SELECT c.incident_id, {_W.replace("start_us", "c.start_us")} AS window_us, p.service AS source, c.service AS target FROM {LINK} WHERE p.service <> c.service) SELECT *, count(*) AS calls FROM g GROUP BY ALL""")
def agg08_edges(spark, d):
    return S.window_edges(B.spans(spark, d), ["incident_id"], MONTH)


@query("agg09_timing_projection", f"""{WITH}, {TIMED}, a AS (SELECT incident_id, service, round(quantile_cont(CAST(duration_us AS DOUBLE), 0.5), 3) AS duration_median, round(quantile_cont(CAST(duration_us AS DOUBLE), 0.9), 3) AS duration_p90, max(duration_us) AS duration_max, round(quantile_cont(CAST(wait_us AS DOUBLE), 0.5), 3) AS wait_median, round(quantile_cont(CAST(exclusive_us AS DOUBLE), 0.5), 3) AS exclusive_median FROM timed GROUP BY 1, 2),
b AS (SELECT c.incident_id, c.service, count(*) AS spans, count(*) FILTER (c.parent_span_id <> '' AND p.span_id IS NULL) AS lost_parents FROM {LINK} GROUP BY 1, 2) SELECT b.*, a.* EXCLUDE (incident_id, service) FROM b LEFT JOIN a USING (incident_id, service)""")
def agg09(spark, d):
    t = S.timing_projection(derived(spark, d, *TIMED_COLUMNS), ["incident_id"])
    return t.withColumns({c: r(c, 3) for c in ("duration_median", "duration_p90", "wait_median", "exclusive_median")})


OVERLAP = """entry AS (SELECT c.incident_id, c.trace_id, c.span_id, c.service AS own, c.start_us AS ea, c.start_us + c.duration_us AS eb, c.phase, coalesce(c.parent_span_id, '') <> '' AND p.span_id IS NULL AS lost FROM spans c LEFT JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service IS NULL OR p.service <> c.service),
hits AS (SELECT e.trace_id, e.span_id, ea, eb, k.start_us AS s, k.start_us + k.duration_us AS t FROM entry e JOIN spans k ON k.trace_id = e.trace_id AND k.parent_span_id = e.span_id AND k.service <> e.own
  UNION ALL SELECT e.trace_id, e.span_id, ea, eb, k2.start_us, k2.start_us + k2.duration_us FROM entry e JOIN spans k ON k.trace_id = e.trace_id AND k.parent_span_id = e.span_id AND k.service = e.own JOIN spans k2 ON k2.trace_id = k.trace_id AND k2.parent_span_id = k.span_id AND k2.service <> e.own),
iv AS (SELECT trace_id AS k1, span_id AS k2, greatest(s, ea) AS a, least(t, eb) AS b FROM hits)"""
OVERLAP_BY = """cl AS (SELECT trace_id, span_id, sum(CASE WHEN s < ea OR t > eb THEN 1 ELSE 0 END) AS clipped FROM hits GROUP BY 1, 2),
per AS (SELECT e.*, least(eb - ea, coalesce(u.union_us, 0)) / CAST(greatest(eb - ea, 1) AS DOUBLE) AS overlap, CAST(greatest(0, eb - ea - coalesce(u.union_us, 0)) AS DOUBLE) AS residual_us, clipped FROM entry e LEFT JOIN un u ON u.k1 = e.trace_id AND u.k2 = e.span_id LEFT JOIN cl ON cl.trace_id = e.trace_id AND cl.span_id = e.span_id)"""
OVERLAP_OF = "count(*) AS n, count(clipped) AS bo, count(*) FILTER (lost) AS mp, CAST(coalesce(sum(clipped), 0) AS BIGINT) AS cl, quantile_cont(overlap, [0.25, 0.5, 0.75, 0.9]) AS o, quantile_cont(residual_us, [0.5, 0.9]) AS w"


@query("agg10_dependency_overlap", f"""{WITH}, {OVERLAP}, {UNION}, {OVERLAP_BY}, g AS (SELECT incident_id, own AS service, {OVERLAP_OF} FROM per GROUP BY 1, 2)
SELECT incident_id, service, n AS entries, bo AS boundaries, mp AS missing_parents, cl AS clipped, round(o[2], 6) AS overlap_median, round(o[4], 6) AS overlap_p90, round(o[3] - o[1], 6) AS overlap_iqr, round(w[1], 3) AS residual_median, round(w[2], 3) AS residual_p90 FROM g""")
def agg10(spark, d):
    every, n = placed(spark, d, *OVERLAP_COLUMNS)
    with joins_in_place(spark):
        o = cut(S.dependency_overlap(every, ["incident_id"], buckets=n))
    return o.withColumns({c: r(c) for c in ("overlap_median", "overlap_p90", "overlap_iqr")} | {c: r(c, 3) for c in ("residual_median", "residual_p90")})


def thinned(spans):
    """Spans of which every thirteenth call has lost its CLIENT span, and 'n-5' its healthy period."""
    gone = (F.col("kind") == "CLIENT") & (F.col("duration_us") % 13 == 0)
    return spans.filter(~gone & ~((F.col("service") == "n-5") & (F.col("phase") == "baseline")))


THIN = "all_spans AS (SELECT * FROM spans), thin AS (SELECT * FROM all_spans WHERE NOT (kind = 'CLIENT' AND duration_us % 13 = 0) AND NOT (service = 'n-5' AND phase = 'baseline'))"


@query("agg11_overlap_deviation", f"""{WITH}, {THIN}, {OVERLAP.replace("spans", "thin")}, {UNION}, {OVERLAP_BY}, g AS (SELECT incident_id, phase, own AS service, {OVERLAP_OF} FROM per GROUP BY 1, 2, 3),
j AS (SELECT x.incident_id, x.service, c.n > 0 AS seen, h.n > 0 AS normal, c.n, c.bo, c.mp, c.o, c.w, h.o AS ho, h.w AS hw, greatest(0.01, h.o[3] - h.o[1]) AS sc FROM (SELECT DISTINCT incident_id, service FROM spans) x
  LEFT JOIN g c ON c.incident_id = x.incident_id AND c.service = x.service AND c.phase = 'current' LEFT JOIN g h ON h.incident_id = x.incident_id AND h.service = x.service AND h.phase = 'baseline')
SELECT incident_id, service, coalesce(seen AND normal, false) AS comparable, round(coalesce(o[2], 0), 6) AS overlap_median, round(coalesce((o[2] - ho[2]) / sc, 0), 6) AS overlap_shift, round(coalesce((o[4] - ho[4]) / sc, 0), 6) AS overlap_p90_shift, round(coalesce(ln(1 + w[1]) - ln(1 + hw[1]), 0), 6) AS residual_log_ratio,
round(coalesce(ln(1 + w[2]) - ln(1 + hw[2]), 0), 6) AS residual_p90_log_ratio, round(coalesce(bo / CAST(n AS DOUBLE), 0), 6) AS boundary_support, coalesce(seen, false) AS entry_observed, round(coalesce(mp / CAST(n AS DOUBLE), 0), 6) AS missing_parent_ratio, coalesce(normal, false) AS healthy_observed FROM j""")
def agg11(spark, d):
    every, n = placed(spark, d, *OVERLAP_COLUMNS, "kind", "phase")
    services = every.select("incident_id", "service").distinct().withColumn("phase", F.explode(F.array(F.lit("current"), F.lit("baseline"))))
    # both phases in one walk, a trace of each phase alone
    with joins_in_place(spark):
        both = cut(S.dependency_overlap(thinned(every).withColumn("trace_id", F.concat_ws("@", "trace_id", "phase")), ["incident_id", "phase"], services, n))
    o = [both.filter(F.col("phase") == p).drop("phase") for p in ("current", "baseline")]
    v = S.overlap_deviation(*o, ["incident_id"])
    return v.withColumns({c: r(c) for c in ("overlap_median", "overlap_shift", "overlap_p90_shift", "residual_log_ratio", "residual_p90_log_ratio", "boundary_support", "missing_parent_ratio")})


@query("agg12_active_topology", f"""{WITH}, {TIMED}, {REFS}, hit AS (SELECT q.*, t.trace_id IS NOT NULL AS ok FROM refs q LEFT JOIN timed t ON t.trace_id = q.trace_id AND t.span_id = q.span_id),
cov AS (SELECT incident_id, count(*) FILTER (ok) / CAST(count(*) AS DOUBLE) >= 0.8 AS active FROM hit GROUP BY 1),
g AS (SELECT DISTINCT c.incident_id, p.service AS source, c.service AS target, c.trace_id FROM {LINK} WHERE p.service <> c.service)
SELECT DISTINCT g.incident_id, source, target, 'active' AS topology FROM g JOIN cov USING (incident_id) WHERE active AND EXISTS (SELECT 1 FROM hit h WHERE h.ok AND h.trace_id = g.trace_id AND h.incident_id = g.incident_id)
UNION ALL SELECT DISTINCT g.incident_id, source, target, 'global' FROM g JOIN cov USING (incident_id) WHERE NOT active""")
def agg12(spark, d):
    s = derived(spark, d, *TIMED_COLUMNS, "operation", "phase")
    # computed once: evidence and sampled traces both look at it
    timed = cut(S.exclusive_time(s).select("incident_id", "trace_id", "span_id", "duration_us", "wait_us", "exclusive_ratio"))
    e = S.operation_evidence(timed, refs(s))
    here = refs(s).join(timed.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi").select("trace_id").distinct()
    sampled = S.service_graph(s.join(here, "trace_id", "left_semi"), ["incident_id"])
    return S.active_topology(S.service_graph(s, ["incident_id"]), sampled, e, least=0.8)


@query("agg13_expected_edges", f"""{WITH}, g AS (SELECT c.incident_id, p.service AS source, c.service AS target, CAST(floor(c.start_us / 604800000000.0) AS BIGINT) AS w FROM {LINK} WHERE c.phase = 'baseline'),
n AS (SELECT incident_id, count(DISTINCT w) AS windows FROM g GROUP BY 1) SELECT incident_id, source, target, round(count(DISTINCT w) / CAST(min(windows) AS DOUBLE), 6) AS presence FROM g JOIN n USING (incident_id) WHERE source <> target GROUP BY 1, 2, 3 HAVING count(DISTINCT w) / CAST(min(windows) AS DOUBLE) >= 0.1""")
def agg13(spark, d):
    return S.expected_edges(B.spans(spark, d).filter("phase = 'baseline'"), ["incident_id"], 604_800, 0.1).withColumn("presence", r("presence"))


@query("agg14_domain_audit", f"{WITH} SELECT incident_id, service, count(*) FILTER (kind = 'SERVER') AS server, count(*) FILTER (kind = 'CLIENT') AS client, CAST(0 AS BIGINT) AS internal, CAST(0 AS BIGINT) AS producer, CAST(0 AS BIGINT) AS consumer, CAST(0 AS BIGINT) AS unknown, count(*) FILTER (error) AS errors FROM spans GROUP BY 1, 2")
def agg14(spark, d):
    return S.domain_audit(B.spans(spark, d), ["incident_id"])


@query("agg15_duplicate_audit", """WITH g AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate)) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (v > 1) AS conflicts, CAST(coalesce(sum(n) FILTER (v > 1), 0) AS BIGINT) AS conflict_rows FROM g GROUP BY 1""")
def agg15(spark, d):
    return S.duplicate_audit(B.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


PARTS = "pa AS (SELECT * FROM spans WHERE duration_us % 3 <> 0), pb AS (SELECT * REPLACE (CASE WHEN duration_us % 100 = 1 THEN 'other' ELSE operation END AS operation) FROM spans WHERE duration_us % 3 <> 1), u AS (SELECT * FROM pa UNION ALL SELECT * FROM pb)"


@query("src05_partial_merge", f"{WITH}, {PARTS}, v AS (SELECT trace_id, span_id, count(DISTINCT operation) AS k FROM u GROUP BY 1, 2) SELECT 'merged' AS part, service, count(*) AS n FROM (SELECT DISTINCT u.* FROM u JOIN v USING (trace_id, span_id) WHERE k = 1) GROUP BY 2 UNION ALL SELECT 'conflict', NULL, count(*) FROM v WHERE k > 1")
def src05(spark, d):
    s = B.spans(spark, d)
    other = s.filter("duration_us % 3 <> 1").withColumn("operation", F.when(F.col("duration_us") % 100 == 1, "other").otherwise(F.col("operation")))
    merged, conflicts = S.merge_partial([s.filter("duration_us % 3 <> 0"), other])
    out = merged.groupBy(F.lit("merged").alias("part"), "service").agg(F.count("*").alias("n"))
    return out.unionByName(conflicts.agg(F.count("*").alias("n")).select(F.lit("conflict").alias("part"), F.lit(None).cast("string").alias("service"), "n"))


@query("src06_validate", f"{WITH}, t AS (SELECT incident_id, trace_id, count(*) AS n, count(DISTINCT span_id) AS k FROM spans GROUP BY 1, 2) SELECT incident_id, count(*) AS traces, count(*) FILTER (n > 9) AS over_cap, CAST(sum(n - k) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS invalid FROM t GROUP BY 1")
def src06(spark, d):
    return S.validate(B.spans(spark, d), 9, ["incident_id"])


@query("rec02_descendants", f"""{WITH} SELECT level, count(*) AS n, count(DISTINCT trace_id || ancestor) AS ancestors FROM (SELECT trace_id, parent_span_id AS ancestor, span_id, 1 AS level FROM spans WHERE parent_span_id <> ''
UNION ALL SELECT b.trace_id, a.parent_span_id, b.span_id, 2 FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id WHERE a.parent_span_id <> '') GROUP BY 1""")
def rec02(spark, d):
    return S.descendants(B.spans(spark, d)).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct(F.concat("trace_id", "ancestor")).alias("ancestors"))


EVENT = "CASE event_type WHEN 'error' THEN 500 + event_id % 4 WHEN 'click' THEN 0 ELSE 200 + event_id % 300 END"


@query("prj03_05_projections", f"""SELECT CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 3 = 0 THEN '/u/' || (user_id % 5) ELSE 'GET /u/' || (user_id % 5) END AS operation, CASE WHEN {EVENT} = 0 THEN event_id % 2 = 0 ELSE {EVENT} >= 500 END AS failed_http,
({EVENT} BETWEEN 1 AND 16) OR {EVENT} >= 400 AS failed_code, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def prj03(spark, d):
    e = B.read(spark, d, "events")
    status = F.when(F.col("event_type") == "error", 500 + F.col("event_id") % 4).when(F.col("event_type") == "click", 0).otherwise(200 + F.col("event_id") % 300)
    route = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("/u/"), F.col("user_id") % 5))
    method = F.when(F.col("event_id") % 3 != 0, "GET")
    code = F.when(F.col("event_id") % 2 == 0, "error").otherwise("ok")
    return e.groupBy(S.operation_key(F.col("event_type"), method, route).alias("operation"), S.failed_http(status, code).alias("failed_http"), S.failed_code(status).alias("failed_code")).agg(F.count("*").alias("n"))


@query("prj06_canonical_operation", "SELECT 'GET /o/{id}/' || CASE WHEN o_orderkey % 3 = 0 THEN '{uuid}' ELSE lower(o_orderpriority) END AS operation, count(*) AS n FROM orders GROUP BY 1")
def prj06(spark, d):
    o = B.read(spark, d, "orders")
    last = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("0a1b2c3d-0000-4000-8000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).otherwise(F.lower("o_orderpriority"))
    raw = F.concat(F.lit("GET /o/"), F.col("o_orderkey").cast("string"), F.lit("/"), last, F.lit("?page=1"))
    return o.groupBy(S.canonical_operation(F.lit(None).cast("string"), raw).alias("operation")).agg(F.count("*").alias("n"))


@query("prj12_phases", """SELECT o_orderpriority, CASE WHEN s >= t - 86400 * 400 AND s < t THEN 'baseline' WHEN s >= t AND s < t + 86400 * 400 THEN 'current' END AS phase, count(*) AS n
FROM (SELECT o_orderpriority, epoch_us(o_orderdate) // 1000000 AS s, 915148800 + (o_custkey % 3) * 86400 AS t FROM orders) GROUP BY 1, 2""")
def prj12(spark, d):
    o = B.read(spark, d, "orders")
    at = 915_148_800 + (F.col("o_custkey") % 3) * 86_400
    return o.groupBy("o_orderpriority", S.phase(B.micros("o_orderdate"), at, wide=86_400 * 400).alias("phase")).agg(F.count("*").alias("n"))
