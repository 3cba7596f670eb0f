"""Queries on metric points, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.operators import metrics as M
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

P = f"WITH {B.POINTS}"
DAY = 86_400
START = 852_076_800  # 1997-01-01, where the current phase begins


def r(c, n=6):
    return F.round(c, n)


WIDE = "wide AS (SELECT ts AS time, max(value) FILTER (service = 'svc-1' AND family = 'cpu') AS \"orders_cpu\", max(value) FILTER (service = 'svc-2' AND family = 'memory') AS \"pay_service_mem\", max(value) FILTER (service = 'svc-3' AND family = 'network') AS \"cart-db_net\", max(value) FILTER (service = 'svc-1' AND family = 'cpu') AS \"Istio_Proxy_cpu\", max(value) FILTER (service = 'svc-2' AND family = 'memory') AS \"mysql_mem\", max(value) FILTER (service = 'svc-5' AND family = 'network') AS \" Cart-Service-_socket\" FROM points GROUP BY 1)"


def wide(spark, d):
    p = B.points(spark, d)
    pick = lambda s, f: F.max(F.when((F.col("service") == s) & (F.col("family") == f), F.col("value")))
    return p.groupBy(F.col("ts").cast("string").alias("time")).agg(pick("svc-1", "cpu").alias("orders_cpu"), pick("svc-2", "memory").alias("pay_service_mem"), pick("svc-3", "network").alias("cart-db_net"), pick("svc-1", "cpu").alias("Istio_Proxy_cpu"), pick("svc-2", "memory").alias("mysql_mem"), pick("svc-5", "network").alias(" Cart-Service-_socket"))


@query("src09_wide_read", f"{P}, {WIDE} SELECT CAST(time AS DOUBLE) AS time, metric, value FROM (UNPIVOT wide ON \"orders_cpu\", \"pay_service_mem\", \"cart-db_net\", \"Istio_Proxy_cpu\", \"mysql_mem\", \" Cart-Service-_socket\" INTO NAME metric VALUE value)")
def src09(spark, d):
    return M.long_points(wide(spark, d))


@query("prj07_metric_parse", f"{P}, {WIDE} SELECT * FROM (VALUES ('orders_cpu', 'orders', 'cpu', 'orders', false), ('pay_service_mem', 'pay_service', 'memory', 'pay', false), (' Cart-Service-_socket', ' Cart-Service-', 'sockets', 'cart', false), ('cart-db_net', 'cart-db', 'network', 'cartdb', true), ('Istio_Proxy_cpu', 'Istio_Proxy', 'cpu', 'istioproxy', true), ('mysql_mem', 'mysql', 'memory', 'mysql', false)) v(metric, entity, family, service_key, infrastructure) JOIN (SELECT metric, count(*) AS n FROM (UNPIVOT wide ON \"orders_cpu\", \"pay_service_mem\", \"cart-db_net\", \"Istio_Proxy_cpu\", \"mysql_mem\", \" Cart-Service-_socket\" INTO NAME metric VALUE value) GROUP BY 1) USING (metric)")
def prj07(spark, d):
    """Entity, family, service key and the infrastructure predicate of metric columns (PRJ-08 to PRJ-10)."""
    long = M.long_points(wide(spark, d)).groupBy("metric").agg(F.count("*").alias("n"))
    entity, family = M.parsed_metric(F.col("metric"))
    return long.select("metric", entity.alias("entity"), family.alias("family"), M.service_key(entity).alias("service_key"), M.infrastructure(entity).alias("infrastructure"), "n")


@query("prj16_units", "SELECT unit, coalesce(u, 'none') AS canonical_unit, count(*) AS n, count(*) FILTER (reject) AS rejected, round(sum(v), 3) AS total FROM (SELECT unit, CASE unit WHEN 'MiB' THEN 'bytes' WHEN 'ms' THEN 'seconds' WHEN 'percent' THEN 'ratio' END AS u, unit = 'furlong' OR value < 100 AS reject, (value - 100) * CASE unit WHEN 'MiB' THEN 1048576 WHEN 'ms' THEN 0.001 WHEN 'percent' THEN 0.01 END AS v FROM (SELECT value, ['MiB', 'ms', 'percent', 'furlong'][CAST(event_id % 4 AS INT) + 1] AS unit FROM events)) GROUP BY 1, 2")
def prj16(spark, d):
    e = B.read(spark, d, "events")
    unit = F.element_at(F.array(*map(F.lit, ("MiB", "ms", "percent", "furlong"))), (F.col("event_id") % 4 + 1).cast("int"))
    c = M.converted(e.select(unit.alias("unit"), (F.col("value") - 100).alias("value")))
    return c.groupBy("unit", F.coalesce("canonical_unit", F.lit("none")).alias("canonical_unit")).agg(F.count("*").alias("n"), F.count("rejected").alias("rejected"), r(F.sum("canonical_value"), 3).alias("total"))


@query("met01_frame_audit", f"""{P}, t AS (SELECT service, family, ts - lag(ts) OVER (PARTITION BY service, family ORDER BY ts) AS d FROM (SELECT DISTINCT service, family, ts FROM points))
SELECT service, family, p.points, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infs, cadence, least_step, largest_step, times, p.points - times AS repeated FROM (SELECT service, family, count(*) AS points FROM points GROUP BY 1, 2) p
JOIN (SELECT service, family, quantile_cont(CAST(d AS DOUBLE), 0.5) AS cadence, min(d) AS least_step, max(d) AS largest_step, count(*) AS times FROM t GROUP BY 1, 2) USING (service, family)""")
def met01(spark, d):
    return M.frame_audit(B.points(spark, d))


SHIFT = """b1 AS (SELECT service, family, quantile_cont(value, 0.5) AS med, count(*) AS n0, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.9) AS q9 FROM points WHERE phase = 'baseline' GROUP BY 1, 2),
b2 AS (SELECT service, family, greatest(1.4826 * quantile_cont(abs(value - med), 0.5), 1e-6 * greatest(1, abs(min(med)))) AS scale FROM points JOIN b1 USING (service, family) WHERE phase = 'baseline' GROUP BY 1, 2),
cu AS (SELECT *, (value - med) / scale AS residual, row_number() OVER (PARTITION BY service, family ORDER BY ts) - 1 AS idx FROM points JOIN b1 USING (service, family) JOIN b2 USING (service, family) WHERE phase = 'current')"""


@query("met02_channel_shift", f"""{P}, {SHIFT}, rn AS (SELECT service, family, max(len) AS run FROM (SELECT service, family, idx - k AS g, count(*) AS len FROM (SELECT *, row_number() OVER (PARTITION BY service, family ORDER BY idx) AS k FROM cu WHERE abs(residual) >= 1.0) GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT service, family, min(n0) AS n0, count(*) AS n1, min(scale) AS scale, (quantile_cont(value, 0.5) - min(med)) / min(scale) AS location, (quantile_cont(value, 0.9) - min(q9)) / min(scale) AS p90_shift, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25) - min(q3) + min(q1)) / min(scale) AS iqr_shift,
avg(CAST(abs(residual) >= 1.0 AS INT)) AS persistence, max(abs(residual)) AS peak, arg_max(idx, (abs(residual), -idx)) AS peak_at, min(idx) FILTER (abs(residual) >= 1.0) AS first FROM cu GROUP BY 1, 2)
SELECT service, family, n0, n1, round(scale, 6) AS scale, round(location, 5) AS location, round(abs(location), 5) AS abs_location, round(peak_at / greatest(1, n1 - 1)::DOUBLE, 6) AS peak_fraction, round(p90_shift, 5) AS p90_shift, round(iqr_shift, 5) AS iqr_shift, round(persistence, 6) AS persistence, round(peak, 5) AS peak, round(coalesce(first / greatest(1, n1 - 1)::DOUBLE, 0), 6) AS first_fraction, round(coalesce(run, 0) / CAST(n1 AS DOUBLE), 6) AS run_fraction FROM g LEFT JOIN rn USING (service, family) WHERE n0 >= 30 AND n1 >= 10""")
def met02(spark, d):
    s = M.channel_shift(B.points(spark, d), threshold=1.0)
    five = ("location", "abs_location", "p90_shift", "iqr_shift", "peak")
    return s.withColumns({c: r(c, 5) for c in five} | {c: r(c) for c in ("scale", "persistence", "first_fraction", "peak_fraction", "run_fraction")})


@query("met03_rolling_shift", f"""{P}, {SHIFT}, ro AS (SELECT service, family, abs(quantile_cont(residual, 0.5) OVER (PARTITION BY service, family ORDER BY ts RANGE BETWEEN {60 * DAY - 1} PRECEDING AND CURRENT ROW)) AS rolled FROM cu)
SELECT service, family, round(max(rolled), 5) AS largest, round(quantile_cont(rolled, 0.5), 5) AS median_shift, round(avg(CAST(rolled >= 0.1 AS INT)), 6) AS above FROM ro GROUP BY 1, 2""")
def met03(spark, d):
    s = M.rolling_shift(B.points(spark, d), 60 * DAY, threshold=0.1)
    return s.withColumns({"largest": r("largest", 5), "median_shift": r("median_shift", 5), "above": r("above")})


@query("met04_family_aggregate", f"""{P}, {SHIFT}, g AS (SELECT service, family, round(max(abs(residual)), 4) AS score, round(avg(CAST(abs(residual) >= 1.0 AS INT)), 6) AS persistence FROM cu GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY score DESC, family) AS k FROM g)
SELECT service, max(CASE WHEN k = 1 THEN family END) AS winner, max(score) AS best, round(avg(CASE WHEN k <= 2 THEN score END), 5) AS top2, max(persistence) AS persistence, count(*) AS channels FROM k GROUP BY 1""")
def met04(spark, d):
    s = M.channel_shift(B.points(spark, d), threshold=1.0, least=(1, 1)).select("service", "family", r("peak", 4).alias("score"), r("persistence").alias("persistence"))
    return M.family_aggregate(s, ["service"], "family", "score", "persistence").withColumn("top2", r("top2", 5))


@query("met05_feature_vector", f"{P}, {SHIFT}, g AS (SELECT service, family, round(max(abs(residual)), 5) AS peak FROM cu GROUP BY 1, 2) SELECT service, " + ", ".join(f"max(CASE WHEN family = '{f}' THEN 1 ELSE 0 END) AS has_{f}, coalesce(max(peak) FILTER (family = '{f}'), 0) AS {f}_peak" for f in B.FAMILIES) + " FROM g GROUP BY 1")
def met05(spark, d):
    s = M.channel_shift(B.points(spark, d), threshold=1.0, least=(1, 1)).withColumn("peak", r("peak", 5))
    return M.feature_vector(s, B.FAMILIES, ["peak"])


@query("met06_tied_percentile", f"{P}, g AS (SELECT service, family, count(*) AS n FROM points GROUP BY 1, 2), w AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY n) - 1 + (count(*) OVER (PARTITION BY family, n) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY n, service) - 1 AS o FROM g) SELECT service, family, round(CASE WHEN m > 1 THEN k / (m - 1) ELSE 0 END, 6) AS tied, round(CASE WHEN m > 1 THEN o / CAST(m - 1 AS DOUBLE) ELSE 0 END, 6) AS ordinal FROM w")
def met06(spark, d):
    """Percentiles with ties averaged, and by position (MET-07)."""
    g = B.points(spark, d).groupBy("service", "family").agg(F.count("*").alias("n"))
    w = Window.partitionBy("family")
    m = F.count("*").over(w)
    ordinal = F.when(m > 1, (F.row_number().over(w.orderBy("n", "service")) - 1) / (m - 1)).otherwise(0.0)
    return g.select("service", "family", r(stats.tied_percentile(["family"], "n")).alias("tied"), r(ordinal).alias("ordinal"))


PAIRS = "pr AS (SELECT a.service, a.family, a.ts, a.phase, b.value AS x, a.value AS y FROM points a JOIN points b ON a.service = b.service AND a.ts = b.ts WHERE a.family <> 'traffic_rate' AND b.family = 'traffic_rate')"


@query("jon08_workload_pairs", f"{P}, {PAIRS} SELECT service, family, phase, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y FROM pr GROUP BY 1, 2, 3")
def jon08(spark, d):
    w = M.workload_pairs(B.points(spark, d))
    return w.groupBy("service", "family", "phase").agg(F.count("*").alias("n"), r(F.sum("x"), 3).alias("x"), r(F.sum("y"), 3).alias("y"))


def _fits(rounds: int = 8) -> str:
    """CTEs fit0 (least squares) to fit8 (Huber re-weighted) over pb (service, family, x, y)."""
    fit = """fit{i} AS MATERIALIZED (SELECT service, family, b, (y - b * x) / w AS a FROM (SELECT *, CASE WHEN w * xx - x * x > 1e-12::DOUBLE * w * xx THEN (w * xy - x * y) / (w * xx - x * x) ELSE (x / w) * (y / w) / (1 + (x / w) * (x / w)) END AS b
  FROM (SELECT service, family, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM {rows} GROUP BY 1, 2)))"""
    out = [fit.format(i=0, rows="(SELECT *, 1.0::DOUBLE AS w FROM pb)")]
    for i in range(1, rounds + 1):
        out.append(f"""r{i} AS MATERIALIZED (SELECT pb.*, y - a - b * x AS r FROM pb JOIN fit{i - 1} USING (service, family)), c{i} AS MATERIALIZED (SELECT service, family, quantile_cont(r, 0.5) AS c FROM r{i} GROUP BY 1, 2),
s{i} AS MATERIALIZED (SELECT service, family, greatest(1.4826::DOUBLE * quantile_cont(abs(r - c), 0.5), 1e-9::DOUBLE) AS s FROM r{i} JOIN c{i} USING (service, family) GROUP BY 1, 2)""")
        out.append(fit.format(i=i, rows=f"(SELECT x, y, service, family, pow(CASE WHEN abs(r) <= 1.345::DOUBLE * s THEN 1.0::DOUBLE ELSE 1.345::DOUBLE * s / abs(r) END, 2) AS w FROM r{i} JOIN s{i} USING (service, family))"))
    return ", ".join(out)


@query("met09_robust_line", f"{P}, {PAIRS}, pb AS MATERIALIZED (SELECT service, family, x, y FROM pr WHERE phase = 'baseline'), {_fits()} SELECT service, family, round(b, 4) AS slope, round(a, 4) AS intercept FROM fit8")
def met09(spark, d):
    p = M.workload_pairs(B.points(spark, d)).filter("phase = 'baseline'")
    return M.robust_line(p, ["service", "family"]).withColumns({"slope": r("slope", 4), "intercept": r("intercept", 4)})


@query("met10_conditioned_residuals", f"""{P}, {PAIRS}, k AS (SELECT service, family, min(x) FILTER (phase = 'baseline') >= 0 AND quantile_cont(x, 0.9) FILTER (phase = 'baseline') > 4 * greatest(quantile_cont(x, 0.5) FILTER (phase = 'baseline'), 1e-9) AS lx,
  min(y) FILTER (phase = 'baseline') >= 0 AND quantile_cont(y, 0.9) FILTER (phase = 'baseline') > 4 * greatest(quantile_cont(y, 0.5) FILTER (phase = 'baseline'), 1e-9) AS ly
  FROM pr GROUP BY 1, 2 HAVING count(*) >= 40 AND count(*) FILTER (phase = 'baseline') >= 30 AND count(*) FILTER (phase = 'current') >= 10),
t AS MATERIALIZED (SELECT service, family, phase, CASE WHEN lx THEN ln(1 + x) ELSE x END AS x, CASE WHEN ly THEN ln(1 + y) ELSE y END AS y FROM pr JOIN k USING (service, family)), pb AS MATERIALIZED (SELECT service, family, x, y FROM t WHERE phase = 'baseline'), {_fits()},
e AS MATERIALIZED (SELECT t.*, y - a - b * x AS r FROM t JOIN fit8 USING (service, family)), ce AS (SELECT service, family, quantile_cont(r, 0.5) AS c FROM e WHERE phase = 'baseline' GROUP BY 1, 2),
se AS (SELECT service, family, c, greatest(1.4826::DOUBLE * quantile_cont(abs(r - c), 0.5), greatest(1.0, abs(c)) * 1e-6) AS s FROM e JOIN ce USING (service, family) WHERE phase = 'baseline' GROUP BY 1, 2, 3)
SELECT service, family, count(*) AS n, round(abs(quantile_cont(r, 0.5) - min(c)) / min(s), 4) AS location, round(quantile_cont(abs(r - c) / s, 0.9), 4) AS p90, round(max(abs(r - c) / s), 4) AS peak, round(avg(CAST(abs(r - c) / s >= 3.5 AS INT)), 6) AS persistence
FROM e JOIN se USING (service, family) WHERE phase = 'current' GROUP BY 1, 2""")
def met10(spark, d):
    out = M.conditioned_residuals(M.workload_pairs(B.points(spark, d)), ["service", "family"])
    return out.withColumns({c: r(c, 4) for c in ("location", "p90", "peak")} | {"persistence": r("persistence")})


END = START + 730 * DAY
CALLS = "calls AS (SELECT 'svc-' || (l_suppkey % 10) AS service, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS ts, l_returnflag = 'R' AS error FROM lineitem)"


@query("met17_temporal_shape", f"""{P}, {SHIFT}, {CALLS}, f AS (SELECT service, family, abs(residual) AS a, (ts - {START}) / CAST({END - START} AS DOUBLE) AS f FROM (SELECT points.*, (value - med) / scale AS residual FROM points JOIN b1 USING (service, family) JOIN b2 USING (service, family)) WHERE ts BETWEEN {START} AND {END}),
g AS (SELECT service, family, quantile_cont(a, 0.9) FILTER (f <= 1/3.0::DOUBLE) AS e, quantile_cont(a, 0.9) FILTER (f >= 2/3.0::DOUBLE) AS l, min(f) FILTER (a >= 1.5) AS o FROM f GROUP BY 1, 2),
m AS (SELECT service, coalesce(max(e), 0) AS e, coalesce(max(l), 0) AS l, min(o) AS o FROM g GROUP BY 1),
k AS (SELECT service, error, (ts - {START}) / CAST({END - START} AS DOUBLE) AS f FROM calls WHERE ts BETWEEN {START} AND {END}),
x AS (SELECT service, coalesce(avg(CAST(error AS INT)) FILTER (f <= 1/3.0::DOUBLE), 0) AS x, coalesce(avg(CAST(error AS INT)) FILTER (f >= 2/3.0::DOUBLE), 0) AS y, min(f) FILTER (error) AS p FROM k GROUP BY 1),
sv AS (SELECT DISTINCT service FROM points UNION SELECT 'svc-silent')
SELECT service, round(coalesce(e, 0), 5) AS metric_early, round(coalesce(l, 0), 5) AS metric_late, round(coalesce(l, 0) - coalesce(e, 0), 5) + 0 AS metric_trend, round(coalesce(o, 1), 6) AS metric_first_fraction, CASE WHEN o IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS metric_observed,
round(coalesce(x, 0), 6) AS error_early, round(coalesce(y, 0), 6) AS error_late, round(coalesce(y, 0) - coalesce(x, 0), 6) + 0 AS error_trend, round(coalesce(p, 1), 6) AS error_first_fraction, CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS error_observed
FROM sv LEFT JOIN m USING (service) LEFT JOIN x USING (service)""")
def met17(spark, d):
    """Points and calls from before and after the window are in the rows and count nowhere; one service has neither."""
    p = B.points(spark, d)
    b = stats.robust_stats(p.filter("phase = 'baseline'"), M.SERIES, "value", M.scale_floor())
    res = p.join(b, M.SERIES).withColumn("residual", (F.col("value") - F.col("median")) / F.col("scale"))
    calls = B.read(spark, d, "lineitem").select(F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service"), (B.micros("l_shipdate") / 1_000_000).cast("long").alias("ts"), (F.col("l_returnflag") == "R").alias("error"))
    services = p.select("service").distinct().unionByName(spark.range(1).select(F.lit("svc-silent").alias("service")))
    t = M.temporal_shape(res, calls, services, START, END, 1.5)
    return t.withColumns({c: r(c, 5) + 0.0 for c in ("metric_early", "metric_late", "metric_trend")} | {c: r(c) + 0.0 for c in ("metric_first_fraction", "error_early", "error_late", "error_trend", "error_first_fraction")})


GRID = f"""sl AS (SELECT range AS slot FROM range({START}, {START + 360 * DAY}, {30 * DAY})), se AS (SELECT DISTINCT service, family FROM points), m AS (SELECT service, family, CAST(floor((ts - {START}) / {30 * DAY}.0) AS BIGINT) * {30 * DAY} + {START} AS slot, avg(value) AS value FROM points GROUP BY 1, 2, 3),
gr AS (SELECT service, family, slot, CASE WHEN m.value IS NULL THEN 'MISSING' ELSE 'OBSERVED' END AS state, m.value FROM se CROSS JOIN sl LEFT JOIN m USING (service, family, slot))"""


def grid(spark, d):
    return M.complete_grid(B.points(spark, d), START, START + 360 * DAY, 30 * DAY)


@query("jon10_complete_grid", f"{P}, {GRID} SELECT service, family, slot, state, round(value, 4) AS value FROM gr WHERE (service, family) IN (SELECT (service, family) FROM m)")
def jon10(spark, d):
    return grid(spark, d).withColumn("value", r("value", 4))


@query("met19_grid_reference", f"""{P}, {GRID}, g AS (SELECT service, family, count(*) FILTER (state = 'OBSERVED') AS n, avg(CAST(state = 'OBSERVED' AS INT)) AS support, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM gr GROUP BY 1, 2)
SELECT service, family, n, round(support, 6) AS support, round(b, 6) AS center, round(greatest(c - a, 0.05 * abs(b), 1e-9), 6) AS scale FROM g WHERE n >= 5 AND support >= 0.5""")
def met19(spark, d):
    g = M.grid_reference(grid(spark, d), least=5, support=0.5)
    return g.withColumns({c: r(c) for c in ("support", "center", "scale")})


BIN = "bn AS (SELECT service, family, CAST(floor((k - 1) / ceil(n / 16.0::DOUBLE)) AS BIGINT) AS bin, min(ts) AS start, max(ts) AS \"end\", min(value) AS least, max(value) AS largest, avg(value) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY service, family ORDER BY ts) AS k, count(*) OVER (PARTITION BY service, family) AS n FROM points) GROUP BY 1, 2, 3)"


@query("met21_binned", f"{P}, {BIN} SELECT service, family, bin, start, \"end\", least, largest, round(mean, 6) AS mean, n FROM bn")
def met21(spark, d):
    return M.binned(B.points(spark, d), 16).withColumn("mean", r("mean"))


@query("met22_coarsened", f"{P}, {BIN} SELECT service, family, CAST(floor(bin / 4.0) AS BIGINT) AS bin, min(start) AS start, max(\"end\") AS \"end\", min(least) AS least, max(largest) AS largest, round(sum(mean * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM bn GROUP BY 1, 2, 3")
def met22(spark, d):
    return M.coarsened(M.binned(B.points(spark, d), 16), 4).withColumn("mean", r("mean"))


@query("met23_interval_bins", f"{P}, {BIN} SELECT service, family, count(*) AS bins, CAST(sum(n) AS BIGINT) AS points FROM bn WHERE start >= {START - 700 * DAY} AND \"end\" <= {START + 300 * DAY} GROUP BY 1, 2")
def met23(spark, d):
    b = M.interval_bins(M.binned(B.points(spark, d), 16), START - 700 * DAY, START + 300 * DAY)
    return b.groupBy("service", "family").agg(F.count("*").alias("bins"), F.sum("n").alias("points"))


@query("met24_point_coverage", f"{P} SELECT service, family, count(DISTINCT ts) AS times, round(count(DISTINCT ts) / 365.0::DOUBLE, 6) AS coverage FROM points WHERE ts >= {START} AND ts < {START + 365 * DAY} GROUP BY 1, 2")
def met24(spark, d):
    return M.point_coverage(B.points(spark, d), START, START + 365 * DAY, DAY).withColumn("coverage", r("coverage"))


@query("met26_red_channels", """WITH rq AS (SELECT 'svc-' || (user_id % 8) AS service, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value FROM events),
g AS (SELECT service, count(*) AS requests, avg(CAST(status >= 500 AS INT)) AS er, count(*) FILTER (value <= 50) AS a, count(*) FILTER (value <= 100) AS b, count(*) FILTER (value <= 200) AS c, count(*) FILTER (value <= 500) AS d FROM rq GROUP BY 1)
SELECT service, requests, round(er, 6) AS error_ratio, round(CASE WHEN a >= 0.95 * requests AND a > 0 THEN 50 * 0.95 * requests / a WHEN b >= 0.95 * requests AND b > a THEN 50 + 50 * (0.95 * requests - a) / (b - a) WHEN c >= 0.95 * requests AND c > b THEN 100 + 100 * (0.95 * requests - b) / (c - b) WHEN d >= 0.95 * requests AND d > c THEN 200 + 300 * (0.95 * requests - c) / (d - c) ELSE 500 END, 6) AS latency_p95 FROM g""")
def met26(spark, d):
    e = B.read(spark, d, "events").select(F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency"))
    return M.red_channels(e, ["service"], [50.0, 100.0, 200.0, 500.0]).withColumns({"error_ratio": r("error_ratio"), "latency_p95": r("latency_p95")})


@query("met18_red_states", f"""{P}, s AS (SELECT service, CASE family WHEN 'cpu' THEN 'request_rate' ELSE family END AS channel, CASE WHEN family = 'cpu' AND service = 'svc-2' THEN 0 WHEN family = 'memory' AND service = 'svc-3' THEN NULL ELSE value END AS value FROM points)
SELECT service, channel, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, CASE WHEN count(value) = 0 THEN 'unavailable' WHEN channel = 'request_rate' AND max(abs(value)) = 0 THEN 'no_activity' WHEN count(value) < 900 THEN 'incomplete' ELSE 'available' END AS state FROM s GROUP BY 1, 2""")
def met18(spark, d):
    p = B.points(spark, d)
    value = F.when((F.col("family") == "cpu") & (F.col("service") == "svc-2"), 0.0).when((F.col("family") == "memory") & (F.col("service") == "svc-3"), None).otherwise(F.col("value"))
    s = p.select("service", F.when(F.col("family") == "cpu", "request_rate").otherwise(F.col("family")).alias("channel"), value.alias("value"))
    return M.red_states(s, 900).withColumn("median", r("median"))


@query("src20_counter_rates", """WITH k AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, CAST(floor(value * 100) AS BIGINT) AS c FROM events), g AS (SELECT user_id, sec, max(c) AS c FROM k GROUP BY 1, 2),
w AS (SELECT user_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY sec) AS d, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS t FROM g) SELECT user_id, count(*) AS readings, count(*) FILTER (d < 0) AS resets, round(sum(CASE WHEN d >= 0 AND t > 0 THEN d / CAST(t AS DOUBLE) END), 6) AS rates FROM w GROUP BY 1""")
def src20(spark, d):
    e = B.read(spark, d, "events").groupBy("user_id", F.floor(B.micros("ts") / 1_000_000).alias("at")).agg(F.max(F.floor(F.col("value") * 100)).alias("c"))
    c = M.counter_rates(e, "user_id", "at", "c")
    return c.groupBy("user_id").agg(F.count("*").alias("readings"), F.count_if("reset").alias("resets"), r(F.sum("rate")).alias("rates"))


SEG = "sg AS (SELECT * FROM (VALUES ('a', 820454400, 836179200), ('b', 830000000, 852076800), ('c', 860000000, 870000000)) s(segment, a, b))"


@query("jon07_segments", f"{P}, {SEG}, k AS (SELECT p.service, p.family, p.ts, segment, row_number() OVER (PARTITION BY p.service, p.family, p.ts, p.value ORDER BY a, segment) AS k FROM points p JOIN sg ON ts BETWEEN a AND b) SELECT family, segment, count(*) AS n FROM k WHERE k = 1 GROUP BY 1, 2")
def jon07(spark, d):
    s = spark.createDataFrame([("a", 820454400, 836179200), ("b", 830000000, 852076800), ("c", 860000000, 870000000)], "segment string, start long, end long")
    return M.in_segments(B.points(spark, d), s).groupBy("family", "segment").agg(F.count("*").alias("n"))


@query("met14_disappearance", "SELECT o_custkey AS key, round(CASE WHEN x >= 1 THEN 0.45 * greatest(0, 1 - s / greatest(x, 1e-9)) + 0.35 * m + CASE WHEN s = 0 THEN 0.2 ELSE 0 END ELSE 0 END, 6) AS score FROM (SELECT o_custkey, count(*) / 2.0::DOUBLE AS x, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS s, avg(CAST(o_orderpriority = '1-URGENT' AS INT)) AS m FROM orders GROUP BY 1)")
def met14(spark, d):
    g = B.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg((F.count("*") / 2).alias("x"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("s"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("m"))
    return g.select("key", r(M.disappearance(F.col("x"), F.col("s"), F.col("m"))).alias("score"))


@query("prj14_15_strengths", "SELECT event_type, round(sum(CASE WHEN x > 0 THEN x ELSE 0 END), 4) AS kept, round(avg(least(1, greatest(0, 1 - exp(-(CASE WHEN x > 0 THEN x ELSE 0 END) / 3.5)))), 6) AS strength FROM (SELECT event_type, value - 20 AS x FROM events) GROUP BY 1")
def prj14(spark, d):
    e = B.read(spark, d, "events").withColumn("x", F.col("value") - 20)
    return e.groupBy("event_type").agg(r(F.sum(stats.nonnegative("x")), 4).alias("kept"), r(F.avg(stats.bounded_strength("x", 3.5))).alias("strength"))
