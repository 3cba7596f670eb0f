"""Queries of the detectors, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegrid.operators import anomaly as A
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

WITH = f"WITH {B.OBS}"
KEYS = "incident_id, service, operation"
BASE = f"""bl AS (SELECT *, ln(1 + latency_ms) AS lg FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts_us DESC, sample_id DESC) AS k FROM obs WHERE phase = 'baseline') WHERE k <= 1000),
b1 AS (SELECT {KEYS}, count(*) AS samples, count(*) FILTER (failed) AS errors, quantile_cont(latency_ms, 0.5) AS median_ms, quantile_cont(lg, 0.5) AS log_median FROM bl GROUP BY ALL),
b2 AS (SELECT {KEYS}, quantile_cont(abs(lg - log_median), 0.5) AS log_mad FROM bl JOIN b1 USING ({KEYS}) GROUP BY ALL),
b3 AS (SELECT {KEYS}, latency_ms AS p95_ms FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY {KEYS}) AS n FROM bl) WHERE r = greatest(1, ceil(round(n * 0.95, 9)))),
base AS (SELECT *, greatest(1.4826 * log_mad, 0.1) AS scale, (errors + 0.5) / (samples + 1) AS error_rate, samples >= 30 AS sufficient FROM b1 JOIN b2 USING ({KEYS}) JOIN b3 USING ({KEYS}))"""
CUR = f"""cr AS (SELECT *, ln(1 + latency_ms) AS lg FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts_us DESC, sample_id DESC) AS k FROM obs WHERE phase = 'current') WHERE k <= 20),
cur AS (SELECT {KEYS}, count(*) AS current_samples, count(*) FILTER (failed) AS current_errors, quantile_cont(lg, 0.5) AS current_log FROM cr GROUP BY ALL)"""


def z2(e0, n0, e1, n1):
    p = f"(({e0} + {e1}) / CAST({n0} + {n1} AS DOUBLE))"
    var = f"({p} * (1 - {p}) * (1.0::DOUBLE / {n0} + 1.0::DOUBLE / {n1}))"
    return f"(CASE WHEN {n0} > 0 AND {n1} > 0 AND {var} > 0 THEN greatest(0, ({e1} / CAST({n1} AS DOUBLE) - {e0} / CAST({n0} AS DOUBLE)) / sqrt({var})) ELSE 0 END)"


OPS = f"""st AS (SELECT *, CASE WHEN NOT coalesce(sufficient, false) THEN 'insufficient_baseline' WHEN coalesce(current_samples, 0) < 10 THEN 'insufficient_current_data' ELSE 'ready' END AS state FROM base FULL JOIN cur USING ({KEYS})),
zs AS (SELECT *, CASE WHEN state = 'ready' THEN greatest(0, (current_log - log_median) / scale) ELSE 0 END AS latency_z, CASE WHEN state = 'ready' THEN {z2('errors', 'samples', 'current_errors', 'current_samples')} ELSE 0 END AS error_z FROM st),
ops AS (SELECT *, latency_z >= 2.0 AS latency_anomalous, error_z >= 3.0 AS error_anomalous, greatest(latency_z / 2.0, error_z / 3.0) AS severity FROM zs)"""


def r(c, n=6):
    return F.round(c, n)


@query("ano01_latency_stats", f"{WITH}, {BASE} SELECT {KEYS}, samples, errors, round(median_ms, 6) AS median_ms, p95_ms, round(log_median, 6) AS log_median, round(log_mad, 6) AS log_mad, round(scale, 6) AS scale, round(error_rate, 6) AS error_rate, sufficient FROM base")
def ano01(spark, d):
    """Also the smoothed error rate and the sufficiency of a baseline."""
    b = A.baseline(B.obs(spark, d))
    return b.select("incident_id", "service", "operation", "samples", "errors", r("median_ms").alias("median_ms"), "p95_ms", *(r(c).alias(c) for c in ("log_median", "log_mad", "scale", "error_rate")), "sufficient")


@query("ano05_current_window", f"{WITH}, {CUR} SELECT {KEYS}, current_samples, current_errors, round(current_log, 6) AS current_log FROM cur")
def ano05(spark, d):
    return A.current(B.obs(spark, d)).withColumn("current_log", r("current_log"))


def operations(spark, d):
    return A.operation_anomalies(B.obs(spark, d), latency_z=2.0)


@query("ano06_operation_anomalies", f"{WITH}, {BASE}, {CUR}, {OPS} SELECT {KEYS}, state, samples, current_samples, round(latency_z, 6) AS latency_z, round(error_z, 6) AS error_z, latency_anomalous, error_anomalous, round(severity, 6) AS severity FROM ops")
def ano06(spark, d):
    return operations(spark, d).select("incident_id", "service", "operation", "state", "samples", "current_samples", *(r(c).alias(c) for c in ("latency_z", "error_z", "severity")), "latency_anomalous", "error_anomalous")


@query("ano07_service_rollup", f"{WITH}, {BASE}, {CUR}, {OPS} SELECT incident_id, service, round(max(severity), 6) AS severity, bool_or(latency_anomalous OR error_anomalous) AS anomalous, bool_or(state = 'ready') AS ready, count(*) AS operations FROM ops GROUP BY 1, 2")
def ano07(spark, d):
    return A.service_anomalies(operations(spark, d)).withColumn("severity", r("severity"))


@query("ano_service_rank", f"{WITH}, {BASE}, {CUR}, {OPS}, sv AS (SELECT incident_id, service, round(max(severity), 6) AS severity FROM ops GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY severity DESC, service) AS rank FROM sv")
def service_rank(spark, d):
    """The flagship: services of each incident ranked by the severity of their worst operation."""
    s = A.service_anomalies(operations(spark, d)).select("incident_id", "service", r("severity").alias("severity"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("severity"), "service")).cast("long"))


RES = f"""res AS (SELECT o.*, greatest(0, (ln(1 + latency_ms) - log_median) / scale) AS residual, samples AS bs, errors AS be, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts_us, sample_id) - 1 AS idx
  FROM (SELECT * FROM obs WHERE phase = 'current') o JOIN base USING ({KEYS}))"""
PART = f"PARTITION BY {KEYS} ORDER BY idx"


def _scales() -> str:
    out = []
    for n in A.SCALES:
        rows = f"({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        full = f"idx >= {n - 1}"
        e, k = f"sum(CAST(failed AS INT)) OVER {rows}", f"count(failed) OVER {rows}"
        out += [f"CASE WHEN {full} THEN quantile_cont(residual, 0.5) OVER {rows} END AS loc_{n}", f"CASE WHEN {full} THEN quantile_cont(residual, 0.9) OVER {rows} END AS tail_{n}", f"{e} AS e_{n}", f"CASE WHEN {full} THEN {k} END AS k_{n}"]
    return "wn AS (SELECT *, " + ", ".join(out) + " FROM res), wz AS (SELECT *, " + ", ".join(f"CASE WHEN k_{n} > 0 THEN {z2('be', 'bs', f'e_{n}', f'k_{n}')} END AS err_{n}" for n in A.SCALES) + " FROM wn), sc AS (SELECT " + KEYS + ", " + ", ".join(f"max({c}_{n}) AS {c}_{n}" for n in A.SCALES for c in ("loc", "tail", "err")) + " FROM wz GROUP BY ALL)"


CUSUM = f"""p AS (SELECT *, sum(greatest(0, residual) - 0.5) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS pre FROM res),
cs AS (SELECT {KEYS}, max(s) AS cusum FROM (SELECT *, pre - least(0, min(pre) OVER ({PART} ROWS UNBOUNDED PRECEDING)) AS s FROM p) GROUP BY ALL)"""


@query("ano08_residuals", f"{WITH}, {BASE}, {RES} SELECT {KEYS}, sample_id, idx, round(residual, 6) AS residual FROM res")
def ano08(spark, d):
    return A.residuals(B.obs(spark, d)).select("incident_id", "service", "operation", "sample_id", F.col("idx").cast("long").alias("idx"), r("residual").alias("residual"))


@query("ano09_scale_features", f"{WITH}, {BASE}, {RES}, {_scales()} SELECT {KEYS}, " + ", ".join(f"round({c}_{n}, 5) AS {c}_{n}" for n in A.SCALES for c in ("loc", "tail", "err")) + " FROM sc")
def ano09(spark, d):
    """Rolling location and tail, and the windowed error z (ANO-11)."""
    f = A.scale_features(A.residuals(B.obs(spark, d)))
    return f.withColumns({f"{c}_{n}": r(f"{c}_{n}", 5) for n in A.SCALES for c in ("loc", "tail", "err")})


@query("ano10_cusum", f"{WITH}, {BASE}, {RES}, {CUSUM} SELECT {KEYS}, round(cusum, 5) AS cusum FROM cs")
def ano10(spark, d):
    return A.cusum_peak(A.residuals(B.obs(spark, d))).withColumn("cusum", r("cusum", 5))


VERDICT = f"""ch AS (SELECT {KEYS}, CAST(v AS DOUBLE) / (CASE WHEN name LIKE 'loc%' THEN 2.0 WHEN name LIKE 'tail%' THEN 4.0 WHEN name LIKE 'err%' THEN 3.0 ELSE 8.0 END) AS v, name FROM (
  {' UNION ALL '.join(f"SELECT {KEYS}, coalesce({c}_{n}, 0) AS v, '{c}_{n}' AS name FROM sc" for n in A.SCALES for c in ('loc', 'tail', 'err'))} UNION ALL SELECT {KEYS}, cusum, 'cusum' FROM cs)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY v DESC, name DESC) AS k FROM ch) WHERE k = 1),
runs AS (SELECT {KEYS}, max(len) AS longest_run FROM (SELECT {KEYS}, idx - q AS g, count(*) AS len FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY idx) AS q FROM res WHERE residual >= 2.0) GROUP BY ALL) GROUP BY ALL),
ons AS (SELECT {KEYS}, min(idx) AS onset FROM (SELECT {KEYS}, idx FROM wz WHERE {' OR '.join(f"{c}_{n} >= {t}" for n in A.SCALES for c, t in (('loc', 2.0), ('tail', 4.0), ('err', 3.0)))}
  UNION ALL SELECT {KEYS}, idx FROM (SELECT *, pre - least(0, min(pre) OVER ({PART} ROWS UNBOUNDED PRECEDING)) AS s FROM p) WHERE s >= 8.0) GROUP BY ALL),
shape AS (SELECT {KEYS}, count(*) AS n, avg(CAST(residual >= 2.0 AS INT)) AS persistence, max(bs) AS bs FROM res GROUP BY ALL),
vd AS (SELECT {KEYS}, n, CASE WHEN bs >= 30 AND n >= 10 THEN v ELSE 0 END AS score, name AS channel, bs >= 30 AND n >= 10 AND v >= 1 AS anomalous, onset, onset / greatest(1, n - 1)::DOUBLE AS onset_fraction, persistence, coalesce(longest_run, 0) AS longest_run
  FROM best JOIN shape USING ({KEYS}) LEFT JOIN runs USING ({KEYS}) LEFT JOIN ons USING ({KEYS}))"""


@query("ano12_verdicts", f"{WITH}, {BASE}, {RES}, {_scales()}, {CUSUM}, {VERDICT} SELECT {KEYS}, n, round(score, 5) AS score, channel, anomalous, onset, round(onset_fraction, 6) AS onset_fraction, round(persistence, 6) AS persistence, longest_run FROM vd")
def ano12(spark, d):
    """With onset, persistence and the longest run above the threshold (ANO-16)."""
    v = A.verdicts(B.obs(spark, d))
    return v.withColumns({"score": r("score", 5), "onset_fraction": r("onset_fraction"), "persistence": r("persistence"), "onset": F.col("onset").cast("long")})


@query("ano13_service_winner", f"{WITH}, {BASE}, {RES}, {_scales()}, {CUSUM}, {VERDICT}, w AS (SELECT *, row_number() OVER (PARTITION BY incident_id, service ORDER BY score DESC, operation DESC) AS k, bool_or(anomalous) OVER (PARTITION BY incident_id, service) AS anya FROM vd) SELECT incident_id, service, anya AS anomalous, round(score, 5) AS score, operation FROM w WHERE k = 1")
def ano13(spark, d):
    return A.service_winner(A.verdicts(B.obs(spark, d))).withColumn("score", r("score", 5))


@query("ano14_config_grid", f"""{WITH}, {BASE}, {RES}, {_scales()}, {CUSUM}, cf AS (SELECT CAST(a * 9 + b * 3 + c AS BIGINT) AS config, 1.0 + a AS l, 3.0 + b AS t, 2.0 + c AS e, 6.0 + 2 * a AS m, CAST(a + b + c AS BIGINT) AS complexity FROM range(3) x(a), range(3) y(b), range(3) z(c)),
hit AS (SELECT config, complexity, service = 'svc-3' AS truth, greatest({', '.join(f"coalesce(loc_{n}, 0) / l, coalesce(tail_{n}, 0) / t, coalesce(err_{n}, 0) / e" for n in A.SCALES)}, cusum / m) >= 1 AS hit FROM sc JOIN cs USING ({KEYS}), cf)
SELECT config, complexity, round(count(*) FILTER (hit AND truth) / CAST(count(*) FILTER (truth) AS DOUBLE), 6) AS recall, round(count(*) FILTER (hit AND NOT truth) / CAST(count(*) FILTER (NOT truth) AS DOUBLE), 6) AS fpr FROM hit GROUP BY 1, 2""")
def ano14(spark, d):
    """Every setting of a grid against every record in one job."""
    res = A.residuals(B.obs(spark, d))
    f = A.scale_features(res).join(A.cusum_peak(res), A.OPERATION).withColumn("truth", F.col("service") == "svc-3")
    a, b, c = (F.floor(F.col("id") / k) % 3 for k in (9, 3, 1))
    configs = spark.range(27).select(F.col("id").alias("config"), (1.0 + a).alias("location"), (3.0 + b).alias("tail"), (2.0 + c).alias("error"), (6.0 + 2 * a).alias("limit"), (a + b + c).alias("complexity"))
    return A.grid(f, configs).withColumns({"recall": r("recall"), "fpr": r("fpr")})


@query("ano15_window_detection")
def ano15(spark, d):
    """A whole trace table through server spans, both phases and the second detector."""
    return A.window_detection(B.spans(spark, d)).withColumn("score", r("score", 5))
