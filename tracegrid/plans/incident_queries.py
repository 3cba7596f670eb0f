"""Queries around incidents: names, universes, labels, guards, deviations given the load; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.operators import diagnosis as D
from tracegrid.operators import incidents as I
from tracegrid.operators import metrics as M
from tracegrid.operators import ranking as R
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

C = f"WITH {B.CAND}"
P = f"WITH {B.POINTS}"


def r(c, n=6):
    return F.round(c, n)


# ---- names ---------------------------------------------------------------------------------------------------------------


@query("prj11_aliases", """WITH a AS (SELECT n_name AS label, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'svc-' || n_regionkey END AS service FROM nation WHERE n_nationkey <> 7)
SELECT a.service AS service, a.label IS NULL AS unmapped, count(*) AS n FROM customer c JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN a ON a.label = n.n_name WHERE a.label IS NULL OR a.service IS NOT NULL GROUP BY 1, 2""")
def prj11(spark, d):
    n = B.read(spark, d, "nation")
    aliases = n.filter("n_nationkey <> 7").select(F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("svc-"), "n_regionkey")).alias("service"))
    named = B.read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("service"))
    return I.aliased(named, aliases, "service").groupBy("service", "unmapped").agg(F.count("*").alias("n"))


@query("prj20_root_names", """SELECT CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'frontendservice' WHEN o_orderkey % 3 = 0 THEN 'frontend' ELSE replace(lower(trim(o_orderpriority)), '_', '-') || '-x' END AS root, count(*) AS n FROM orders GROUP BY 1""")
def prj20(spark, d):
    o = B.read(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, " FrontEnd ").otherwise(F.concat("o_orderpriority", F.lit("_X")))
    return o.groupBy(I.root_name(raw, F.when(F.col("o_orderstatus") == "O", "A-OB").otherwise("A-TT")).alias("root")).agg(F.count("*").alias("n"))


ENTITIES = """en AS (SELECT DISTINCT 'o-' || l_orderkey AS incident_id, CASE l_linenumber % 4 WHEN 0 THEN 'SVC__' || (l_suppkey % 10) || '_Service' WHEN 1 THEN 'svc-' || ((l_suppkey + 1) % 10) WHEN 2 THEN 'Redis' ELSE 'orders_db' END AS entity FROM lineitem),
ob AS (SELECT incident_id, service FROM cand UNION SELECT incident_id, 'Svc4' FROM cand WHERE service = 'svc-4'),
ky AS (SELECT *, replace(regexp_replace(regexp_replace(lower(entity), '[_-]+', '-', 'g'), '-?service$', ''), '-', '') AS k, regexp_replace(lower(entity), '[_-]+', '-', 'g') AS plain FROM en),
ok AS (SELECT incident_id, replace(lower(service), '-', '') AS k, count(*) AS n, min(service) AS only_one FROM ob GROUP BY 1, 2), sm AS (SELECT DISTINCT incident_id, true AS filled FROM ob)"""
MATCH = "CASE WHEN plain IN ('redis', 'orders-db') THEN NULL WHEN n = 1 THEN only_one WHEN {} OR filled IS NULL THEN plain END"
FROM = "FROM ky LEFT JOIN ok USING (incident_id, k) LEFT JOIN sm USING (incident_id)"


def entities(spark, d):
    """Metric entities of the incidents, and their services, of which one may stand for two names of one key."""
    line, supp = F.col("l_linenumber") % 4, F.col("l_suppkey")
    entity = F.when(line == 0, F.concat(F.lit("SVC__"), supp % 10, F.lit("_Service"))).when(line == 1, F.concat(F.lit("svc-"), (supp + 1) % 10)).when(line == 2, "Redis").otherwise("orders_db")
    lines = B.read(spark, d, "lineitem")
    named = lines.select(F.concat(F.lit("o-"), "l_orderkey").alias("incident_id"), entity.alias("entity")).repartition(B.parts(lines), "incident_id")
    twice = F.when(F.col("service") == "svc-4", F.array("service", F.lit("Svc4"))).otherwise(F.array("service"))
    return named, B.cand(spark, d).select("incident_id", F.explode(twice).alias("service"))


@query("jon11_matched_entities", f"{C}, {ENTITIES} SELECT incident_id, entity, {MATCH.format('false')} AS strict, {MATCH.format('true')} AS resolved {FROM}")
def jon11(spark, d):
    e, seen = entities(spark, d)
    return I.entity_services(e, seen)


@query("jon12_candidate_universe", f"""{C}, {ENTITIES}, m AS (SELECT DISTINCT incident_id, {MATCH.format('true')} AS service {FROM}), mm AS (SELECT *, true AS m FROM m WHERE service IS NOT NULL), tt AS (SELECT *, true AS t FROM ob), gg AS (SELECT DISTINCT incident_id, service, true AS g FROM cand WHERE score_b >= 20)
SELECT incident_id, service, coalesce(m, false) AS has_metrics, coalesce(t, false) AS has_traces, coalesce(g, false) AS has_topology FROM mm FULL JOIN tt USING (incident_id, service) LEFT JOIN gg USING (incident_id, service)""")
def jon12(spark, d):
    e, seen = entities(spark, d)
    return I.candidate_universe(I.matched_entities(e, seen, resolve=True), seen, B.cand(spark, d).filter("score_b >= 20"))


@query("jon15_subset", f"{C} SELECT incident_id, service, score_b FROM cand WHERE incident_id IN (SELECT 'o-' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def jon15(spark, d):
    ids = B.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o-"), "o_orderkey").alias("incident_id"))
    return I.subset(B.cand(spark, d), ids).select("incident_id", "service", "score_b")


@query("jon17_paired", f"""{C}, a AS (SELECT incident_id, arg_max(service, (score_a, service)) AS service FROM cand WHERE score_b >= 5 GROUP BY 1), b AS (SELECT incident_id, max(service) AS service FROM cand GROUP BY 1), t AS (SELECT incident_id, service FROM cand WHERE is_root AND dataset <> '1-URGENT')
SELECT incident_id, a.service AS challenger_service, b.service AS baseline_service, t.service AS truth_service, a.service IS NOT NULL AND b.service IS NOT NULL AND t.service IS NOT NULL AS complete FROM a FULL JOIN b USING (incident_id) FULL JOIN t USING (incident_id)""")
def jon17(spark, d):
    c = B.cand(spark, d)
    a = c.filter("score_b >= 5").groupBy("incident_id").agg(F.max_by("service", F.struct("score_a", "service")).alias("service"))
    b = c.groupBy("incident_id").agg(F.max("service").alias("service"))
    return I.paired(a, b, c.filter("is_root and dataset <> '1-URGENT'").select("incident_id", "service"))


@query("prj22_applicability", """WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) / 1000000.0::DOUBLE AS a, epoch_us(o_orderdate) / 1000000.0::DOUBLE + (o_custkey % 3 - 1) * 2592000 AS b, 946684800.0::DOUBLE AS s, 949276800.0::DOUBLE AS e,
CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 5 AS DOUBLE) END AS rr, CASE o_orderkey % 4 WHEN 0 THEN 'profile_constant' WHEN 1 THEN 'measured_interval_mean' WHEN 2 THEN 'else' END AS rs, CAST(o_orderkey % 6 AS DOUBLE) AS cr, CASE WHEN o_custkey % 2 = 0 THEN 'profile_constant' ELSE 'measured_interval_mean' END AS cs FROM orders),
k AS (SELECT *, CASE WHEN a >= b THEN 'UNKNOWN' WHEN b < s THEN 'PRECEDES' WHEN a > e THEN 'AFTER' ELSE 'OVERLAPS' END AS temporal_relation, CASE WHEN rr > 0 AND rs IN ('profile_constant', 'measured_interval_mean') THEN rs ELSE 'unknown' END AS src, CASE WHEN cr > 0 THEN cr END AS cur FROM o),
q AS (SELECT *, CASE WHEN src <> 'unknown' THEN rr END AS ref FROM k),
x AS (SELECT *, cur / ref AS rps_ratio, CASE WHEN cur IS NULL OR ref IS NULL THEN 'UNKNOWN' WHEN cur = ref THEN 'SAME_REFERENCE_RPS' ELSE 'DIFFERENT_REFERENCE_RPS' END AS load_relation FROM q)
SELECT temporal_relation, load_relation, concat_ws(',', CASE WHEN temporal_relation <> 'PRECEDES' THEN 'HEALTHY_PERIOD_' || temporal_relation END, CASE src WHEN 'unknown' THEN 'REFERENCE_LOAD_UNKNOWN' WHEN 'profile_constant' THEN 'REFERENCE_LOAD_CONFIGURED_NOT_MEASURED' END,
CASE cs WHEN 'profile_constant' THEN 'CURRENT_LOAD_CONFIGURED_NOT_MEASURED' END, CASE WHEN load_relation = 'DIFFERENT_REFERENCE_RPS' THEN 'LOAD_DIFFERS_FROM_SINGLE_REFERENCE' END, CASE WHEN cur IS NULL THEN 'CURRENT_LOAD_UNKNOWN' END) AS reasons, count(*) AS n, round(sum(rps_ratio), 4) AS ratios FROM x GROUP BY 1, 2, 3""")
def prj22(spark, d):
    o = B.read(spark, d, "orders")
    at, key, cust = B.micros("o_orderdate") / 1_000_000.0, F.col("o_orderkey"), F.col("o_custkey")
    known = lambda c: F.when(c == 0, "profile_constant").when(c == 1, "measured_interval_mean").when(c == 2, "else")
    out = I.applicability((at, at + (cust % 3 - 1) * 2_592_000), (F.lit(946_684_800.0), F.lit(949_276_800.0)), (F.when(key % 3 != 0, (cust % 5).cast("double")), known(key % 4)), ((key % 6).cast("double"), known(cust % 2)))
    x = o.select(*(v.alias(k) for k, v in out.items())).withColumn("reasons", F.array_join("reasons", ","))
    return x.groupBy("temporal_relation", "load_relation", "reasons").agg(F.count("*").alias("n"), r(F.sum("rps_ratio"), 4).alias("ratios"))


@query("src21_container_events", """WITH e AS (SELECT 'svc-' || (user_id % 5) AS service, sha256(CAST(user_id AS VARCHAR)) AS instance, CASE event_type WHEN 'error' THEN 'die' WHEN 'click' THEN 'start' WHEN 'view' THEN 'health_status: healthy' ELSE 'attach' END AS action, epoch_us(ts) * 1000 AS t, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 400 AS VARCHAR) END AS code FROM events WHERE event_id % 11 <> 0),
k AS (SELECT *, CASE action WHEN 'die' THEN 'exit' WHEN 'start' THEN 'start' WHEN 'health_status: healthy' THEN 'health_change' END AS event FROM e WHERE service <> 'svc-4')
SELECT sha256('["' || instance || '", "' || action || '", ' || t || ']') AS id, event, instance, t AS time_ns, min(service) AS service, min(CASE WHEN CAST(code AS INT) <= 255 THEN CAST(code AS INT) END) AS exit_code FROM k WHERE event IS NOT NULL GROUP BY 1, 2, 3, 4""")
def src21(spark, d):
    e, kind = B.read(spark, d, "events"), F.col("event_type")
    action = F.when(kind == "error", "die").when(kind == "click", "start").when(kind == "view", "health_status: healthy").otherwise("attach")
    at = B.micros("ts") * 1000
    raw = e.select(
        F.when(F.col("event_id") % 11 == 0, "image").otherwise("container").alias("type"), F.lit("shop").alias("project"), F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"), F.sha2(F.col("user_id").cast("string"), 256).alias("instance"),
        action.alias("action"), at.alias("time_ns"), (at + 1).alias("observed_ns"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 400).cast("string")).alias("exit_code"),
    )
    return I.container_events(raw, "shop", [f"svc-{i}" for i in range(4)])


# ---- labels and detection ------------------------------------------------------------------------------------------------------

LABELS = """lb AS (SELECT incident_id, CASE WHEN min(fault) = 'F' THEN 'healthy' ELSE 'fault' END AS incident_type, max(CASE WHEN is_root THEN service END) AS root_service, min(dataset) AS dataset FROM cand GROUP BY 1),
sn AS (SELECT incident_id, CASE WHEN max(score_a) > 60000 THEN 'ready' ELSE 'no_anomaly' END AS state, coalesce(list(service) FILTER (score_b >= 25), []) AS ready FROM cand GROUP BY 1),
en AS (SELECT lb.*, state = 'ready' AS detected, incident_type = 'fault' AND state <> 'ready' AS detection_miss, incident_type = 'fault' AND list_contains(ready, root_service) AS root_ready, len(ready) AS ready_group_size FROM lb JOIN sn USING (incident_id)),
lab AS (SELECT *, detected AND root_ready AS localization_eligible, detected AND root_ready AND ready_group_size >= 2 AS training_eligible, detected AND root_ready AND ready_group_size = 1 AS trivial_group FROM en),
oper AS (SELECT incident_id, service, CAST(score_b AS BIGINT) AS current_samples, score_a / 20000.0 AS latency_z, 0.0::DOUBLE AS error_z FROM cand)"""


def labelled(spark, d):
    c = B.cand(spark, d)
    labels = c.groupBy("incident_id").agg(F.when(F.min("fault") == "F", "healthy").otherwise("fault").alias("incident_type"), F.max(F.when(F.col("is_root"), F.col("service"))).alias("root_service"), F.min("dataset").alias("dataset"))
    snapshots = c.groupBy("incident_id").agg(F.when(F.max("score_a") > 60000, "ready").otherwise("no_anomaly").alias("state"), F.collect_set(F.when(F.col("score_b") >= 25, F.col("service"))).alias("ready"))
    return I.enriched_labels(labels, snapshots)


def operations(spark, d):
    return B.cand(spark, d).select("incident_id", "service", F.col("score_b").cast("long").alias("current_samples"), (F.col("score_a") / 20000).alias("latency_z"), F.lit(0.0).alias("error_z"))


@query("eva24_enriched_labels", f"{C}, {LABELS} SELECT * FROM lab")
def eva24(spark, d):
    return labelled(spark, d).withColumn("ready_group_size", F.col("ready_group_size").cast("long"))


@query("eva21_detection_misses", f"""{C}, {LABELS}, ro AS (SELECT incident_id, service AS root_service, max(current_samples) AS n, bool_or(latency_z >= 2.0 OR error_z >= 3.0) AS hot, count(*) AS k FROM oper GROUP BY 1, 2)
SELECT incident_id, root_service, CASE WHEN coalesce(n, 0) < 10 THEN 'insufficient_data' WHEN hot THEN 'propagation_not_detected' ELSE 'below_threshold' END AS reason, coalesce(k, 0) AS root_operations FROM lab LEFT JOIN ro USING (incident_id, root_service) WHERE detection_miss""")
def eva21(spark, d):
    return I.detection_misses(labelled(spark, d), operations(spark, d), latency_z=2.0)


@query("eva21_false_positives", f"{C}, {LABELS} SELECT incident_id, service, current_samples, round(latency_z, 9) AS latency_z, error_z FROM lab JOIN oper USING (incident_id) WHERE incident_type = 'healthy' AND detected")
def eva21b(spark, d):
    return I.false_positives(labelled(spark, d), operations(spark, d)).withColumn("latency_z", r("latency_z", 9))


RANKED = "rk AS (SELECT incident_id, service AS root_service, row_number() OVER (PARTITION BY incident_id ORDER BY score_a DESC, service) AS truth_rank FROM cand)"


@query("eva22_detection_summary", f"""{C}, {LABELS}, {RANKED}, x AS (SELECT *, incident_type = 'fault' AS f FROM lab JOIN rk USING (incident_id, root_service))
SELECT dataset, count(*) FILTER (f) AS faults, count(*) FILTER (NOT f) AS healthy, """ + ", ".join(f"round(count(*) FILTER (f AND {c}) / CAST(greatest(1, count(*) FILTER (f)) AS DOUBLE), 6) AS {n}" for n, c in (("recall", "detected"), ("root_ready_coverage", "root_ready"), ("eligible_rate", "localization_eligible"), ("training_rate", "training_eligible"), ("end_to_end_ac1", "detected AND root_ready AND truth_rank = 1"))) + ", round(count(*) FILTER (NOT f AND detected) / CAST(greatest(1, count(*) FILTER (NOT f)) AS DOUBLE), 6) AS healthy_fpr FROM x GROUP BY 1")
def eva22(spark, d):
    ranks = R.ranked(B.cand(spark, d), "score_a").select("incident_id", F.col("service").alias("root_service"), F.col("rank").alias("truth_rank"))
    s = I.detection_summary(labelled(spark, d).join(ranks, ["incident_id", "root_service"]), ["dataset"])
    return s.withColumns({c: r(c) for c in s.columns if c not in ("dataset", "faults", "healthy")})


@query("eva26_coverage_summary", f"""{C}, {LABELS}, n AS (SELECT incident_id, count(*) AS candidates, count(*) FILTER (score_b >= 10) AS matched, bool_or(is_root AND score_b >= 10) AS observable FROM cand GROUP BY 1)
SELECT dataset, count(*) AS cases, count(*) FILTER (observable) AS observable, count(*) FILTER (localization_eligible) AS eligible, round(count(*) FILTER (observable) / CAST(count(*) AS DOUBLE), 6) AS candidate_recall, round(avg(candidates), 6) AS mean_candidates, round(sum(matched) / CAST(sum(candidates) AS DOUBLE), 6) AS match_ratio FROM lab JOIN n USING (incident_id) GROUP BY 1""")
def eva26(spark, d):
    fine = F.col("score_b") >= 10
    n = B.cand(spark, d).groupBy("incident_id").agg(F.count("*").alias("candidates"), F.count("*").alias("entities"), F.count_if(fine).alias("matched"), F.bool_or(F.col("is_root") & fine).alias("observable"))
    s = I.coverage_summary(labelled(spark, d).join(n, "incident_id").withColumn("eligible", F.col("localization_eligible")), ["dataset"])
    return s.withColumns({c: r(c) for c in ("candidate_recall", "mean_candidates", "match_ratio")})


@query("eva30_feature_stability", """WITH o AS (SELECT CASE l_linenumber % 7 WHEN 0 THEN 'cpu_has' WHEN 1 THEN 'topology_in' ELSE 'f' || (l_suppkey % 9) END AS feature, l_tax >= 0.03 AS used, l_discount AS gain, l_tax - 0.02 AS dr FROM lineitem)
SELECT feature, round(avg(CASE WHEN used THEN 1.0::DOUBLE ELSE 0 END), 6) AS use_frequency, round(avg(gain), 6) AS mean_gain, round(avg(CASE WHEN dr > 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_fraction, feature IN ('cpu_has', 'topology_in') AS structural,
feature IN ('cpu_has', 'topology_in') OR (avg(CASE WHEN used THEN 1.0::DOUBLE ELSE 0 END) >= 0.6 AND avg(CASE WHEN dr > 1e-12 THEN 1.0::DOUBLE ELSE 0 END) >= 0.6) AS eligible FROM o GROUP BY 1""")
def eva30(spark, d):
    feature = F.when(F.col("l_linenumber") % 7 == 0, "cpu_has").when(F.col("l_linenumber") % 7 == 1, "topology_in").otherwise(F.concat(F.lit("f"), F.col("l_suppkey") % 9))
    s = I.feature_stability(B.read(spark, d, "lineitem").select(feature.alias("feature"), (F.col("l_tax") >= 0.03).alias("used"), F.col("l_discount").alias("gain"), (F.col("l_tax") - 0.02).alias("drop")))
    return s.withColumns({c: r(c) for c in ("use_frequency", "mean_gain", "positive_fraction")})


@query("rnk13_reranker_records", f"""{C}, k AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score_a DESC, service) AS rank, count(*) OVER (PARTITION BY incident_id) AS n, min(score_a) OVER (PARTITION BY incident_id) AS lo, max(score_a) OVER (PARTITION BY incident_id) AS hi FROM cand),
s AS (SELECT *, max(CASE WHEN rank = 1 THEN score_a END) OVER (PARTITION BY incident_id) AS f, max(CASE WHEN rank = 2 THEN score_a END) OVER (PARTITION BY incident_id) AS g FROM k)
SELECT incident_id, service, score_b AS component_score_b, score_b / 10 AS support_score, round(CASE WHEN n = 1 THEN 1 ELSE 1 - (rank - 1) / CAST(n - 1 AS DOUBLE) END, 6) AS base_rank_percentile, round(CASE WHEN hi - lo <= 1e-12 THEN 0.5 ELSE (score_a - lo) / (hi - lo) END, 6) AS base_relative_score,
round(CASE WHEN rank = 1 THEN CASE WHEN n = 1 THEN 1 ELSE (f - g) / greatest(abs(f), abs(g), 1e-9) END ELSE 0 END, 6) AS base_margin FROM s""")
def rnk13(spark, d):
    c = R.ranked(B.cand(spark, d), "score_a").withColumn("score", F.col("score_a")).withColumn("support_score", F.col("score_b") / 10)
    return I.reranker_records(c, ["score_b"]).withColumns({x: r(x) for x in ("base_rank_percentile", "base_relative_score", "base_margin")})


# ---- guards ----------------------------------------------------------------------------------------------------------------------


@query("spl07_selection_faults", "SELECT 'o-' || o_orderkey AS incident_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unregistered' ELSE 'locked' END AS reason FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def spl07(spark, d):
    o = B.read(spark, d, "orders").select(F.concat(F.lit("o-"), "o_orderkey").alias("incident_id"), F.col("o_orderpriority").alias("dataset"))
    roles = o.select("dataset").distinct().filter("dataset <> '1-URGENT'").withColumn("role", F.when(F.col("dataset") == "2-HIGH", "LOCKED_NEW_TEST").otherwise("DEVELOPMENT"))
    return I.selection_faults(o, o, roles)


@query("spl11_partition_faults", "SELECT CAST(c_custkey AS VARCHAR) AS incident_id, 'shared' AS reason FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT NULL, 'empty test'")
def spl11(spark, d):
    c = B.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("incident_id"), F.explode(F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("fit"), F.lit("calibration"))).otherwise(F.array(F.when(F.col("c_custkey") % 2 == 0, "fit").otherwise("calibration")))).alias("part"))
    return I.partition_faults(c, ["fit", "calibration", "test"])


@query("rec05_parent_cycles", """WITH RECURSIVE li AS (SELECT DISTINCT l_orderkey AS t, l_linenumber AS s FROM lineitem), ch AS (SELECT t, s, coalesce(lag(s) OVER (PARTITION BY t ORDER BY s), CASE WHEN t % 5 = 0 THEN max(s) OVER (PARTITION BY t) END) AS p FROM li),
w AS (SELECT t, s, p FROM ch WHERE p IS NOT NULL UNION SELECT w.t, w.s, c.p FROM w JOIN ch c ON c.t = w.t AND c.s = w.p WHERE c.p IS NOT NULL), cyc AS (SELECT t, s FROM w WHERE s = p)
SELECT DISTINCT CAST(t AS VARCHAR) AS trace_id, CAST(s AS VARCHAR) AS span_id FROM (SELECT * FROM cyc UNION ALL SELECT w.t, w.s FROM w JOIN cyc c ON c.t = w.t AND c.s = w.p)""")
def rec05(spark, d):
    """Lines as chains of spans; every fifth order's chain is closed to a ring."""
    one = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    w = Window.partitionBy("l_orderkey")
    parent = F.coalesce(F.lag("l_linenumber").over(w.orderBy("l_linenumber")), F.when(F.col("l_orderkey") % 5 == 0, F.max("l_linenumber").over(w)))
    return I.parent_cycles(one.select(F.col("l_orderkey").cast("string").alias("trace_id"), F.col("l_linenumber").cast("string").alias("span_id"), parent.cast("string").alias("parent_span_id")))


# ---- deviations given the load ------------------------------------------------------------------------------------------------------

FIT = """md AS (SELECT service, family, count(*) AS samples, quantile_cont(value, 0.5) AS med FROM points WHERE phase = 'baseline' GROUP BY 1, 2),
rs AS (SELECT service, family, quantile_cont(value - med, 0.25) AS a, quantile_cont(value - med, 0.5) AS b, quantile_cont(value - med, 0.75) AS c FROM points JOIN md USING (service, family) WHERE phase = 'baseline' GROUP BY 1, 2),
ft AS (SELECT *, greatest(c - a, 0.01 * abs(b), 0.01 * abs(med), 1e-9) AS iqr FROM md JOIN rs USING (service, family))"""


def loaded(spark, d):
    """Points under one load: the fit is the median."""
    return B.points(spark, d).withColumn("x", F.lit(20.0))


def fitted(spark, d):
    return D.workload_baseline(loaded(spark, d).filter("phase = 'baseline'"))


@query("met11_workload_baseline", f"{P}, {FIT} SELECT service, family, samples, 0.0::DOUBLE AS slope, round(med, 6) AS intercept, round(b, 6) AS residual_median, round(iqr, 6) AS residual_iqr FROM ft")
def met11(spark, d):
    return fitted(spark, d).withColumns({c: r(c) for c in ("intercept", "residual_median", "residual_iqr")})


@query("met12_metric_residual_shift", f"{P}, {FIT}, z AS (SELECT service, family, abs((value - med - b) / iqr) AS z FROM points JOIN ft USING (service, family) WHERE phase = 'current') SELECT service, family, round(quantile_cont(z, 0.9), 6) AS shift, round(avg(CASE WHEN z >= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS persistence FROM z GROUP BY 1, 2")
def met12(spark, d):
    s = D.metric_residual_shift(loaded(spark, d).filter("phase = 'current'"), fitted(spark, d))
    return s.withColumns({c: r(c) for c in ("shift", "persistence")})


def _joint(rounds: int = 20, eps: float = 1.35) -> str:
    """CTEs of the joint fit of line and scale over ld (service, family, phase, x, value): lf has slope and intercept where the load
    varies, bs the baseline with its residuals' median and scale."""
    e, e2 = f"{eps}::DOUBLE", f"{eps * eps!r}::DOUBLE"
    out = ["""lb AS MATERIALIZED (SELECT * FROM ld WHERE phase = 'baseline'),
lm AS MATERIALIZED (SELECT service, family, avg(x) AS mx, avg(value) AS my, coalesce(nullif(stddev_pop(x), 0), 1) AS dx, coalesce(nullif(stddev_pop(value), 0), 1) AS dy FROM lb GROUP BY 1, 2 HAVING min(x) < max(x) AND count(*) >= 4),
lu AS MATERIALIZED (SELECT service, family, (x - mx) / dx AS x, (value - my) / dy AS y FROM lb JOIN lm USING (service, family)),
j0 AS (SELECT service, family, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1e300::DOUBLE AS s FROM lm)"""]
    for i in range(1, rounds + 1):
        out.append(f"""q{i} AS MATERIALIZED (SELECT service, family, any_value(a) AS pa, any_value(b) AS pb, any_value(s) AS ps, count(*) AS t, count(*) FILTER (k) AS n, coalesce(sum(x) FILTER (k), 0) AS sx, coalesce(sum(y) FILTER (k), 0) AS sy, coalesce(sum(x * x) FILTER (k), 0) AS xx,
  coalesce(sum(x * y) FILTER (k), 0) AS xy, coalesce(sum(y * y) FILTER (k), 0) AS yy, {e} * sum(CASE WHEN k THEN 0 ELSE sign(r) END) AS u, {e} * sum(CASE WHEN k THEN 0 ELSE sign(r) * x END) AS v FROM (SELECT *, y - a * x - b AS r, abs(y - a * x - b) <= {e} * s AS k FROM lu JOIN j{i - 1} USING (service, family)) GROUP BY 1, 2),
w{i} AS (SELECT *, (n * xy - sx * sy) / d AS a0, (xx * sy - sx * xy) / d AS b0, (n * v - sx * u) / d AS a1, (xx * u - sx * v) / d AS b1 FROM (SELECT *, n * xx - sx * sx AS d FROM q{i})),
j{i} AS MATERIALIZED (SELECT service, family, a0 + z * a1 AS a, b0 + z * b1 AS b, z AS s FROM (SELECT *, sqrt(greatest(yy - a0 * xy - b0 * sy, 1e-24) / (t - {e2} * (t - n) - (a1 * a1 * xx + 2 * a1 * b1 * sx + b1 * b1 * n))) AS z FROM w{i}))""")
    out.append(f"""lf AS (SELECT service, family, a * dy / dx AS slope, my + b * dy - a * dy / dx * mx AS intercept FROM j{rounds} JOIN lm USING (service, family)),
lg AS (SELECT service, family, count(*) AS samples, quantile_cont(value, 0.5) AS med FROM lb GROUP BY 1, 2),
lp AS MATERIALIZED (SELECT service, family, samples, med, coalesce(slope, 0) AS slope, coalesce(intercept, med) AS intercept FROM lg LEFT JOIN lf USING (service, family)),
bs AS MATERIALIZED (SELECT service, family, samples, slope, intercept, q[2] AS residual_median, greatest(q[3] - q[1], 0.01 * abs(q[2]), 0.01 * abs(med), 1e-9) AS residual_iqr
  FROM (SELECT service, family, any_value(samples) AS samples, any_value(slope) AS slope, any_value(intercept) AS intercept, any_value(med) AS med, quantile_cont(value - intercept - slope * x, [0.25, 0.5, 0.75]) AS q FROM lb JOIN lp USING (service, family) GROUP BY 1, 2))""")
    return ",\n".join(out)


#: Points of the other families under the traffic of their service at the time.
LOAD = f"ld AS MATERIALIZED (SELECT a.service, a.family, a.ts, a.phase, b.value AS x, a.value FROM points a JOIN points b ON a.service = b.service AND a.ts = b.ts WHERE a.family <> 'traffic_rate' AND b.family = 'traffic_rate'), {_joint()}"


def under_load(spark, d):
    return M.workload_pairs(B.points(spark, d)).withColumnRenamed("y", "value")


def fitted_under_load(spark, d):
    return D.workload_baseline(under_load(spark, d).filter("phase = 'baseline'"))


@query("met11_varied_load", f"{P}, {LOAD} SELECT service, family, samples, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(residual_median, 4) + 0 AS residual_median, round(residual_iqr, 4) AS residual_iqr FROM bs")
def met11_varied(spark, d):
    """The line on a load that varies; tests/test_joint_fit.py holds it against a minimiser of its own."""
    return fitted_under_load(spark, d).withColumns({c: r(c, 4) + 0.0 for c in ("intercept", "residual_median", "residual_iqr")} | {"slope": r("slope", 5)})


@query("met12_varied_load", f"{P}, {LOAD}, z AS (SELECT service, family, abs((value - intercept - slope * x - residual_median) / residual_iqr) AS z FROM ld JOIN bs USING (service, family) WHERE phase = 'current') SELECT service, family, round(quantile_cont(z, 0.9), 4) AS shift, round(avg(CASE WHEN z >= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS persistence FROM z GROUP BY 1, 2")
def met12_varied(spark, d):
    s = D.metric_residual_shift(under_load(spark, d).filter("phase = 'current'"), fitted_under_load(spark, d))
    return s.withColumns({"shift": r("shift", 4), "persistence": r("persistence")})


SIGNALS = {"cpu": "error_rate", "memory": "span_rate", "network": "latency_p90_us", "traffic_rate": "request_rate"}
NAME = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNALS.items()) + " END"


@query("met13_trace_signal_shift", f"{P}, {FIT}, z AS (SELECT service, {NAME} AS signal, ts, (value - med - b) / iqr AS z FROM points JOIN ft USING (service, family) WHERE phase = 'current') SELECT service, signal, ts, round(CASE WHEN signal IN ('error_rate', 'latency_p90_us') THEN greatest(0, z) ELSE abs(z) END, 6) AS shift FROM z")
def met13(spark, d):
    named = loaded(spark, d)
    signal = F.col("family")
    for k, v in SIGNALS.items():
        signal = F.when(F.col("family") == k, v).otherwise(signal)
    named = named.withColumn("signal", signal)
    base = D.workload_baseline(named.filter("phase = 'baseline'"), ["service", "signal"])
    return D.trace_signal_shift(named.filter("phase = 'current'"), base, ["service"]).select("service", "signal", "ts", r("shift").alias("shift"))


@query("met13_varied_load", f"{P}, {LOAD}, z AS (SELECT service, {NAME} AS signal, ts, (value - intercept - slope * x - residual_median) / residual_iqr AS z FROM ld LEFT JOIN bs USING (service, family) WHERE phase = 'current') SELECT service, signal, ts, round(coalesce(CASE WHEN signal IN ('error_rate', 'latency_p90_us') THEN CASE WHEN z IS NULL THEN NULL ELSE greatest(0, z) END ELSE abs(z) END, 0), 4) AS shift FROM z")
def met13_varied(spark, d):
    p = under_load(spark, d)
    signal = F.col("family")
    for k, v in SIGNALS.items():
        signal = F.when(F.col("family") == k, v).otherwise(signal)
    named = p.withColumn("signal", signal)
    base = D.workload_baseline(named.filter("phase = 'baseline'"), ["service", "signal"])
    return D.trace_signal_shift(named.filter("phase = 'current'"), base, ["service"]).select("service", "signal", "ts", r("shift", 4).alias("shift"))


@query("met16_iqr_shifts", f"""{P}, b AS (SELECT service, family, quantile_cont(value, 0.5) AS m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0.01 * abs(quantile_cont(value, 0.5)), 1e-9) AS iqr FROM points WHERE phase = 'baseline' AND NOT (service = 'svc-2' AND family = 'cpu') GROUP BY 1, 2),
z AS (SELECT service, family, abs((value - m) / iqr) AS z FROM points JOIN b USING (service, family) WHERE phase = 'current'), g AS (SELECT service, family, quantile_cont(z, 0.9) AS s, avg(CASE WHEN z >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM z GROUP BY 1, 2),
gr AS (SELECT service, family, s IS NOT NULL AS has, coalesce(s, 0) AS s, coalesce(p, 0) AS p FROM (SELECT DISTINCT service FROM points) CROSS JOIN (SELECT DISTINCT family FROM points) LEFT JOIN g USING (service, family))
SELECT service, family, has, round(s, 6) AS shift, round(p, 6) AS persistence, round(CASE WHEN count(*) OVER w > 1 THEN (rank() OVER (PARTITION BY family ORDER BY s) - 1 + (count(*) OVER (PARTITION BY family, s) - 1) / 2.0::DOUBLE) / (count(*) OVER w - 1) ELSE 0 END, 6) AS percentile FROM gr WINDOW w AS (PARTITION BY family)""")
def met16(spark, d):
    p = B.points(spark, d)
    base = D.iqr_baseline(p.filter("phase = 'baseline' and not (service = 'svc-2' and family = 'cpu')"))
    s = D.iqr_shifts(p.filter("phase = 'current'"), base, p, B.FAMILIES, [])
    return s.withColumns({c: r(c) for c in ("shift", "persistence", "percentile")})


@query("met07_ordinal_percentile", f"{C} SELECT incident_id, service, round(CASE WHEN count(*) OVER (PARTITION BY incident_id) > 1 THEN (row_number() OVER (PARTITION BY incident_id ORDER BY score_b, service) - 1) / CAST(count(*) OVER (PARTITION BY incident_id) - 1 AS DOUBLE) ELSE 0 END, 6) AS percentile FROM cand")
def met07(spark, d):
    return B.cand(spark, d).select("incident_id", "service", r(stats.ordinal_percentile(["incident_id"], "score_b", "service")).alias("percentile"))


@query("prj18_restricted_vector", f"""{P}, v AS (SELECT service, """ + ", ".join(f"max(CASE WHEN family = '{f}' THEN 1 ELSE 0 END) AS has_{f}, coalesce(max(CASE WHEN family = '{f}' THEN value END), 0) AS {f}_peak" for f in B.FAMILIES) + """ FROM points GROUP BY 1)
SELECT service, has_cpu, cpu_peak, has_memory, memory_peak, 0 AS has_network, 0.0::DOUBLE AS network_peak, 0 AS has_traffic_rate, 0.0::DOUBLE AS traffic_rate_peak, has_cpu + has_memory AS family_count, (has_cpu + has_memory) / 4.0::DOUBLE AS family_ratio,
greatest(cpu_peak, memory_peak) AS max_shift, CASE WHEN has_cpu + has_memory > 0 THEN round((cpu_peak + memory_peak) / (has_cpu + has_memory), 6) ELSE 0 END AS top2 FROM v""")
def prj18(spark, d):
    tops = B.points(spark, d).groupBy("service", "family").agg(F.max("value").alias("peak"))
    v = D.restricted_vector(M.feature_vector(tops, B.FAMILIES, ["peak"]), B.FAMILIES, ["cpu", "memory"], "peak")
    return v.withColumn("top2", r("top2"))


# ---- requests, errors, latency ----------------------------------------------------------------------------------------------------

SLOTS, STEP = 81, 2_592_000
RED = f"""sl AS (SELECT 'svc-' || (o_custkey % 8) AS service, (epoch_us(o_orderdate) // 1000000 - 788918400) // {STEP} * {STEP} AS ts, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS e, max(o_totalprice) AS l FROM orders GROUP BY 1, 2),
rd AS (SELECT service, 'presence' AS channel, ts, 1.0::DOUBLE AS value FROM sl UNION ALL SELECT service, 'request_rate', ts, CASE service WHEN 'svc-3' THEN 0 WHEN 'svc-5' THEN NULL ELSE n / 30.0::DOUBLE END FROM sl
  UNION ALL SELECT service, 'error_ratio', ts, CASE WHEN n % 7 = 0 THEN NULL ELSE e END FROM sl UNION ALL SELECT service, 'latency_p95', ts, l FROM sl)"""


def red(spark, d):
    """Observed channels of services in slots of 30 days, one silent and one without rates."""
    o = B.read(spark, d, "orders").select(F.concat(F.lit("svc-"), F.col("o_custkey") % 8).alias("service"), (F.floor((B.micros("o_orderdate") / 1_000_000 - 788_918_400) / STEP) * STEP).alias("ts"), "o_orderstatus", "o_totalprice")
    g = o.groupBy("service", "ts").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("e"), F.max("o_totalprice").alias("l"))
    rate = F.when(F.col("service") == "svc-3", 0.0).when(F.col("service") == "svc-5", F.lit(float("nan"))).otherwise(F.col("n") / 30.0)
    values = {"presence": F.lit(1.0), "request_rate": rate, "error_ratio": F.when(F.col("n") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("e")), "latency_p95": F.col("l")}
    return g.select("service", "ts", F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), v.alias("value")) for k, v in values.items()))).alias("c")).select("service", "c.channel", "ts", "c.value")


@query("src12_red_matrix", f"WITH {RED} SELECT service, channel, CASE WHEN channel = 'error_ratio' AND value > 0.4 THEN 'range' END AS rejected, count(*) AS n, count(value) AS known FROM (SELECT * REPLACE (CASE WHEN channel = 'error_ratio' AND value > 0.4 THEN value + 1 ELSE value END AS value) FROM rd) GROUP BY 1, 2, 3")
def src12(spark, d):
    rows = red(spark, d).withColumn("value", F.when((F.col("channel") == "error_ratio") & ~F.isnan("value") & (F.col("value") > 0.4), F.col("value") + 1).otherwise(F.col("value")))
    return D.red_matrix(rows).groupBy("service", "channel", "rejected").agg(F.count("*").alias("n"), F.count("value").alias("known"))


@query("met20_red_summary", f"""WITH {RED}, wd AS (SELECT service, ts, max(CASE WHEN channel = 'presence' THEN value END) AS p, max(CASE WHEN channel = 'request_rate' THEN value END) AS q, max(CASE WHEN channel = 'error_ratio' THEN value END) AS e, max(CASE WHEN channel = 'latency_p95' THEN value END) AS l FROM rd GROUP BY 1, 2),
st AS (SELECT service, CASE WHEN count(p) <> {SLOTS} THEN 'UNAVAILABLE' WHEN count(q) = 0 THEN 'INCOMPLETE' WHEN count(*) FILTER (q = 0) = {SLOTS} THEN 'NO_ACTIVITY' WHEN count(q) = {SLOTS} AND count(*) FILTER (q > 0 AND (e IS NULL OR l IS NULL)) = 0 THEN 'OBSERVED' ELSE 'PARTIAL' END AS state FROM wd GROUP BY 1),
lo AS (SELECT service, 'request_rate' AS channel, q AS value FROM wd UNION ALL SELECT service, 'error_ratio', CASE WHEN q > 0 THEN e END FROM wd UNION ALL SELECT service, 'latency_p95', CASE WHEN q > 0 THEN l END FROM wd),
sh AS (SELECT service, channel, state, CASE WHEN state IN ('UNAVAILABLE', 'INCOMPLETE') OR (state = 'NO_ACTIVITY' AND channel <> 'request_rate') THEN NULL ELSE value END AS value FROM lo JOIN st USING (service))
SELECT service, state, channel, CASE WHEN state = 'NO_ACTIVITY' AND channel <> 'request_rate' THEN 'NOT_DEFINED_WITHOUT_TRAFFIC' ELSE state END AS channel_state, count(value) AS samples, round(min(value), 6) AS least, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS largest, round(count(value) / {SLOTS}.0::DOUBLE, 6) AS coverage FROM sh GROUP BY 1, 2, 3, 4""")
def met20(spark, d):
    rows = D.red_matrix(red(spark, d))
    s = D.red_summary(rows, rows.select("service"), SLOTS)
    return s.withColumns({c: r(c) for c in ("least", "median", "largest", "coverage")})


@query("met25_workload_intensity", """WITH p AS (SELECT o_custkey % 50 AS k, CASE WHEN o_custkey % 50 = 7 THEN o_orderpriority ELSE 'a' END AS series, epoch_us(o_orderdate) // 1000000 + o_custkey % 1000 AS ts, CASE WHEN o_custkey % 50 = 8 THEN -1 ELSE round(o_totalprice) END AS value FROM orders),
t AS (SELECT k, ts, count(*) FILTER (ts BETWEEN 788918400 AND 946684800) AS n, sum(CASE WHEN ts BETWEEN 788918400 AND 946684800 THEN value END) AS s, min(series) AS a, max(series) AS b, count(*) FILTER (value < 0) AS bad FROM p GROUP BY 1, 2),
g AS (SELECT k, sum(n) AS n, sum(s) AS s, CASE WHEN min(a) <> max(b) THEN 'series' WHEN sum(bad) > 0 THEN 'value' WHEN max(n) > 1 THEN 'repeated' WHEN coalesce(sum(s), 0) <= 0 THEN 'none' END AS fault FROM t GROUP BY 1)
SELECT k, fault, CASE WHEN fault IS NULL THEN round(s / n, 3) END AS intensity FROM g""")
def met25(spark, d):
    cust = F.col("o_custkey")
    p = B.read(spark, d, "orders").select((cust % 50).alias("k"), F.when(cust % 50 == 7, F.col("o_orderpriority")).otherwise("a").alias("series"), (F.floor(B.micros("o_orderdate") / 1_000_000) + cust % 1000).alias("ts"), F.when(cust % 50 == 8, -1.0).otherwise(F.round("o_totalprice")).alias("value"))
    return D.workload_intensity(p, 788_918_400, 946_684_800, ["k"]).withColumn("intensity", r("intensity", 3))


CELLS = [(f"svc-{i}", f) for i in range(10) for f in B.FAMILIES]


@query("met27_complete_matrix", f"{P}, q AS (SELECT service, family, ts // 15552000 AS ts, round(avg(value), 4) AS value FROM points GROUP BY 1, 2, 3) SELECT ts, " + ", ".join(f"""max(CASE WHEN service = '{s}' AND family = '{f}' THEN value END) AS "{s}/{f}" """ for s, f in CELLS) + f" FROM q GROUP BY 1 HAVING count(*) = {len(CELLS)}")
def met27(spark, d):
    q = B.points(spark, d).groupBy("service", "family", F.floor(F.col("ts") / 15_552_000).alias("ts")).agg(r(F.avg("value"), 4).alias("value"))
    return D.complete_matrix(q, [f"svc-{i}" for i in range(10)], B.FAMILIES)
