"""Queries on rankings, their evaluation and splits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions.lineage import cut
from tracegrid.operators import anomaly as A
from tracegrid.operators import evaluation as E
from tracegrid.operators import ranking as R
from tracegrid.plans.anomaly_queries import BASE, CUR, OPS
from tracegrid.plans.registry import query
from tracegrid.plans.span_queries import TIMED
from tracegrid.sources import bindings as B

C = f"WITH {B.CAND}"
BOTH = """both2 AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score_a DESC, service) AS rank_a, row_number() OVER (PARTITION BY incident_id ORDER BY score_b DESC, service) AS rank_b, count(*) OVER (PARTITION BY incident_id) AS n FROM cand)"""
TRUTH = "tr AS (SELECT incident_id, dataset, system, fault, rank_a AS truth_rank, n AS candidates FROM both2 WHERE is_root)"


def r(c, n=6):
    return F.round(c, n)


def both(spark, d):
    c = R.ranked(B.cand(spark, d), "score_a", name="rank_a")
    return R.ranked(c, "score_b", name="rank_b")


def ranks(spark, d):
    """Truth ranks of the first score's ranking."""
    c = both(spark, d)
    truth = c.filter("is_root").select("incident_id", F.col("service").alias("root_service"), "dataset", "system", "fault")
    return E.truth_ranks(c.select("incident_id", "service", F.col("rank_a").alias("rank")), truth)


def frac(*parts: str) -> str:
    hexes = "substr(sha256(concat_ws(':', " + ", ".join(parts) + ")), 1, 13)"
    return f"(CAST(('0x' || {hexes}) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query("rnk01_ranked", f"{C}, {BOTH} SELECT incident_id, service, score_a, rank_a, rank_b FROM both2")
def rnk01(spark, d):
    return both(spark, d).select("incident_id", "service", "score_a", "rank_a", "rank_b")


PCT = "CASE WHEN n > 1 THEN 1 - ({} - 1) / CAST(n - 1 AS DOUBLE) ELSE 1 END"


@query("rnk06_07_percentiles", f"""{C}, {BOTH}, x AS (SELECT incident_id, service, {PCT.format('rank_a')} AS pa, {PCT.format('rank_b')} AS pb, min(score_a) OVER (PARTITION BY incident_id) AS lo, max(score_a) OVER (PARTITION BY incident_id) AS hi, score_a FROM both2)
SELECT incident_id, service, round((pa + pb) / 2, 6) AS fused, row_number() OVER (PARTITION BY incident_id ORDER BY (pa + pb) / 2 DESC, service) AS fused_rank, round(CASE WHEN hi > lo THEN (score_a - lo) / (hi - lo) ELSE 0.5 END, 6) AS relative FROM x""")
def rnk07(spark, d):
    c = R.rank_average(both(spark, d), ["rank_a", "rank_b"])
    return c.select("incident_id", "service", r("fused").alias("fused"), "fused_rank", r(R.relative_score("score_a")).alias("relative"))


@query("rnk08_reciprocal", f"{C}, {BOTH} SELECT incident_id, service, round(1.0::DOUBLE / (60 + rank_a) + 1.0::DOUBLE / (60 + rank_b), 9) AS rrf, row_number() OVER (PARTITION BY incident_id ORDER BY 1.0::DOUBLE / (60 + rank_a) + 1.0::DOUBLE / (60 + rank_b) DESC, service) AS rrf_rank FROM both2")
def rnk08(spark, d):
    c = both(spark, d)
    return R.reciprocal(c, ["rank_a", "rank_b"]).select("incident_id", "service", r("rrf", 9).alias("rrf"), "rrf_rank")


@query("rnk09_tied_rank", f"{C} SELECT incident_id, service, rank() OVER (PARTITION BY incident_id ORDER BY score_b DESC) + (count(*) OVER (PARTITION BY incident_id, score_b) - 1) / 2.0::DOUBLE AS tied_rank FROM cand")
def rnk09(spark, d):
    from tracegrid.functions.stats import tied_rank

    return B.cand(spark, d).select("incident_id", "service", tied_rank(["incident_id"], "score_b").alias("tied_rank"))


@query("rnk10_expert_features", f"""{C}, {BOTH}, m AS (SELECT incident_id, max(score_a) FILTER (rank_a = 1) AS a1, max(score_a) FILTER (rank_a = 2) AS a2, max(score_b) FILTER (rank_b = 1) AS b1, max(score_b) FILTER (rank_b = 2) AS b2, max(CAST(rank_a = 1 AND rank_b = 1 AS INT)) AS same_top FROM both2 GROUP BY 1),
x AS (SELECT *, {PCT.format('rank_a')} AS pa, {PCT.format('rank_b')} AS pb FROM both2)
SELECT incident_id, service, round(abs(pa - pb), 6) AS disagreement, round(greatest(pa, pb), 6) AS best_pct, round((pa + pb) / 2, 6) AS mean_pct, round((a1 - a2) / greatest(abs(a1), 1e-9), 6) AS margin_a, round((b1 - b2) / greatest(abs(b1), 1e-9), 6) AS margin_b, same_top, n AS candidates FROM x JOIN m USING (incident_id)""")
def rnk10(spark, d):
    f = R.expert_features(both(spark, d))
    return f.select("incident_id", "service", *(r(c).alias(c) for c in ("disagreement", "best_pct", "mean_pct", "margin_a", "margin_b")), "same_top", "candidates")


@query("rnk11_rerank_top", f"{C}, {BOTH} SELECT incident_id, service, rank_a, row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN rank_a <= 3 THEN 0 ELSE 1 END, CASE WHEN rank_a <= 3 THEN -score_b END, rank_a, service) AS new_rank FROM both2")
def rnk11(spark, d):
    return R.rerank_top(both(spark, d), 3, "score_b", rank="rank_a").select("incident_id", "service", "rank_a", "new_rank")


@query("rnk12_support_profile", f"""{C}, {BOTH}, m AS (SELECT incident_id, max(score_a) FILTER (rank_a = 1) AS a1, max(score_a) FILTER (rank_a = 2) AS a2, max(score_b) FILTER (rank_b = 1) AS b1, max(score_b) FILTER (rank_b = 2) AS b2 FROM both2 GROUP BY 1),
x AS (SELECT incident_id, service, score_a - CASE WHEN rank_a = 1 THEN coalesce(a2, 0) ELSE a1 END AS la, score_b - CASE WHEN rank_b = 1 THEN coalesce(b2, 0) ELSE b1 END AS lb FROM both2 JOIN m USING (incident_id))
SELECT incident_id, service, round(la, 4) AS score_a_lead, round(lb, 4) AS score_b_lead, round((la + lb) / 2, 4) AS support FROM x""")
def rnk12(spark, d):
    p = R.support_profile(B.cand(spark, d), ["score_a", "score_b"])
    return p.select("incident_id", "service", *(r(c, 4).alias(c) for c in ("score_a_lead", "score_b_lead", "support")))


@query("rnk15_pseudo_random", f"{C}, x AS (SELECT incident_id, service, {frac(chr(39) + '11' + chr(39), 'incident_id', 'service')} AS h FROM cand) SELECT incident_id, service, row_number() OVER (PARTITION BY incident_id ORDER BY h DESC, service) AS rank FROM x")
def rnk15(spark, d):
    return R.pseudo_random(B.cand(spark, d).select("incident_id", "service"), 11).select("incident_id", "service", "rank")


TP = "(CASE WHEN n > 1 THEN (rank() OVER (PARTITION BY incident_id ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY incident_id, {0}) - 1) / 2.0::DOUBLE) / (n - 1) ELSE 0 END)"


@query("rnk16_soft_heuristics", f"""{C}, {BOTH}, p AS (SELECT incident_id, service, {TP.format('score_a')} AS a, {TP.format('score_b')} AS b FROM both2),
l AS (SELECT incident_id, service, 'metric' AS ranker, round(a, 9) AS score FROM p UNION ALL SELECT incident_id, service, 'trace', round(b, 9) FROM p UNION ALL SELECT incident_id, service, 'hybrid', round((a + b) / 2, 9) FROM p)
SELECT incident_id, service, ranker, round(score, 6) AS score, row_number() OVER (PARTITION BY incident_id, ranker ORDER BY score DESC, service) AS rank FROM l""")
def rnk16(spark, d):
    s = R.soft_heuristics(B.cand(spark, d), {"metric": ["score_a"], "trace": ["score_b"], "hybrid": ["score_a", "score_b"]})
    return s.withColumn("score", r("score"))


@query("rnk17_keep_last", f"WITH {B.OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY service, operation ORDER BY ts_us DESC, sample_id DESC) AS k FROM obs) SELECT service, operation, sample_id FROM k WHERE k <= 5")
def rnk17(spark, d):
    return A.last_n(B.obs(spark, d), ["service", "operation"], 5).select("service", "operation", "sample_id")


@query("rnk18_top_examples", f"WITH {B.SPANS}, k AS (SELECT *, row_number() OVER (PARTITION BY incident_id, service ORDER BY error DESC, duration_us DESC, trace_id, span_id) AS example FROM spans) SELECT incident_id, service, trace_id, span_id, duration_us, error, example FROM k WHERE example <= 3")
def rnk18(spark, d):
    return R.top_examples(B.spans(spark, d), ["incident_id", "service"]).select("incident_id", "service", "trace_id", "span_id", "duration_us", "error", "example")


@query("rnk19_column_ranking", f"""{C}, {BOTH}, nat AS (SELECT incident_id, service || CASE WHEN rank_b % 2 = 0 THEN '-db_cpu' ELSE '_mem' END AS col, rank_a AS position FROM both2),
g AS (SELECT incident_id, regexp_replace(string_split(col, '_')[1], '-db$', '') AS service, min(position) AS position FROM nat GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY position, service) AS rank FROM g""")
def rnk19(spark, d):
    c = both(spark, d)
    native = c.select("incident_id", F.concat("service", F.when(F.col("rank_b") % 2 == 0, "-db_cpu").otherwise("_mem")).alias("column"), F.col("rank_a").alias("position"))
    return R.column_ranking(native)


DIAGNOSIS = f"""WITH RECURSIVE {B.SPANS}, {TIMED},
obs AS (SELECT incident_id, trace_id || '/' || span_id AS sample_id, service, operation, trace_id, span_id, start_us AS ts_us, duration_us / 1000.0::DOUBLE AS latency_ms, error AS failed, phase FROM spans WHERE kind = 'SERVER'), {BASE}, {CUR}, {OPS},
ev AS (SELECT c.incident_id, c.service, c.operation, count(t.trace_id) / CAST(count(*) AS DOUBLE) * coalesce(quantile_cont(t.exclusive_ratio, 0.5), 0) AS own FROM cr c LEFT JOIN timed t ON t.trace_id = c.trace_id AND t.span_id = c.span_id GROUP BY 1, 2, 3),
sv AS (SELECT incident_id, service, bool_or(state = 'ready') AS ready, max(severity) AS severity, max(latency_z) AS lz, max(error_z) AS ez, bool_or(latency_anomalous) AS la, bool_or(error_anomalous) AS ea, max((1 - exp(-latency_z / 2.0)) * coalesce(own, 0)) AS traced FROM ops LEFT JOIN ev USING (incident_id, service, operation) GROUP BY 1, 2),
sg AS (SELECT incident_id, CASE WHEN bool_or(ea) THEN 'error' WHEN bool_or(la) THEN 'latency' ELSE 'none' END AS signal FROM sv GROUP BY 1),
fe AS (SELECT *, CASE signal WHEN 'error' THEN ea WHEN 'latency' THEN la ELSE false END AS observed FROM sv JOIN sg USING (incident_id)),
calls2 AS (SELECT DISTINCT c.incident_id, p.service AS source, c.service AS target FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service <> c.service),
up AS (SELECT incident_id, target AS candidate, source AS service FROM calls2 UNION SELECT u.incident_id, u.candidate, g.source FROM up u JOIN calls2 g ON g.incident_id = u.incident_id AND g.target = u.service),
aff AS (SELECT incident_id, service AS candidate, service FROM sv UNION SELECT * FROM up),
ft AS (SELECT a.incident_id, a.candidate AS service, count(*) FILTER (ready) AS predicted, count(*) FILTER (observed) AS hit FROM aff a JOIN fe USING (incident_id, service) GROUP BY 1, 2),
ob AS (SELECT incident_id, count(*) FILTER (observed) AS n FROM fe GROUP BY 1),
f2 AS (SELECT *, CASE WHEN predicted > 0 AND n > 0 AND hit > 0 THEN 2 * (hit / CAST(predicted AS DOUBLE)) * (hit / CAST(n AS DOUBLE)) / (hit / CAST(predicted AS DOUBLE) + hit / CAST(n AS DOUBLE)) ELSE 0 END AS f1,
  CASE signal WHEN 'error' THEN 1 - exp(-ez / 3.0) WHEN 'latency' THEN 1 - exp(-lz / 2.0) ELSE 0 END AS strength, CASE signal WHEN 'error' THEN 1 - exp(-ez / 3.0) WHEN 'latency' THEN traced ELSE 0 END AS own FROM fe JOIN ft USING (incident_id, service) JOIN ob USING (incident_id) WHERE observed)"""
RANKERS = {"max_severity": ("severity", "0"), "topology_consistency": ("f1", "strength"), "local_evidence": ("own", "0"), "hybrid": ("f1 * own", "0")}


@query("rnk02_05_evidence_rankings", f"{DIAGNOSIS}, lg AS (" + " UNION ALL ".join(f"SELECT incident_id, service, '{k}' AS ranker, round({s}, 9) AS score, round({t}, 9) AS tie FROM f2" for k, (s, t) in RANKERS.items()) + ") SELECT incident_id, service, ranker, round(score, 6) AS score, row_number() OVER (PARTITION BY incident_id, ranker ORDER BY score DESC, tie DESC, service) AS rank FROM lg")
def rnk02(spark, d):
    """The whole diagnosis of derived traces: server spans, baseline, anomalies, topology fit, local evidence, four rankings."""
    from tracegrid.operators import graph as G
    from tracegrid.operators import spans as S

    s = cut(B.spans(spark, d))
    o = s.filter("kind = 'SERVER'").select("incident_id", F.concat_ws("/", "trace_id", "span_id").alias("sample_id"), "service", "operation", "trace_id", "span_id", F.col("start_us").alias("ts_us"), (F.col("duration_us") / 1000).alias("latency_ms"), F.col("error").alias("failed"), "phase")
    ops = A.operation_anomalies(o, latency_z=2.0)
    refs = A.last_n(o.filter("phase = 'current'"), A.OPERATION, A.KEEP_CURRENT).select(*A.OPERATION, "trace_id", "span_id")
    refs = cut(refs)  # some for each operation
    evidence = S.operation_evidence(S.exclusive_time(cut(s.join(refs.select("trace_id").distinct(), "trace_id", "left_semi"))), refs)
    edges = S.service_graph(s, ["incident_id"]).select("incident_id", "source", "target")
    fits = G.topology_fit(edges, R.observed_services(ops), ["incident_id"])
    return R.evidence_rankings(R.service_features(ops, fits, evidence, 2.0, A.ERROR_Z)).withColumn("score", r("score"))


@query("jon16_same_candidates", f"{C} SELECT incident_id, service, 'a' AS side FROM cand WHERE score_b < 5")
def jon16(spark, d):
    c = B.cand(spark, d)
    return R.same_candidates(c, c.filter("score_b >= 5"))


# ---- evaluation --------------------------------------------------------------------------------------------------------------

METRICS = "count(*) AS incidents, " + ", ".join(f"round(avg(CASE WHEN truth_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS ac{k}" for k in E.CUTS) + ", round(avg(coalesce(1.0::DOUBLE / truth_rank, 0)), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN truth_rank <= {k} THEN 1 / log2(truth_rank + 1) ELSE 0 END), 6) AS ndcg{k}" for k in (1, 3)) + ", round(count(truth_rank) / CAST(count(*) AS DOUBLE), 6) AS coverage"
NAMES = [*(f"ac{k}" for k in E.CUTS), "mrr", "ndcg1", "ndcg3", "coverage"]


@query("eva01_03_metrics", f"{C}, {BOTH}, {TRUTH} " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, {METRICS} FROM tr GROUP BY 1, 2" for k, v in (("dataset", "dataset"), ("system", "system"), ("fault", "fault"), ("overall", "NULL"))))
def eva03(spark, d):
    """Truth ranks, all metrics, by each dimension and overall."""
    return E.grouped_metrics(ranks(spark, d), ["dataset", "system", "fault"]).withColumns({c: r(c) for c in NAMES})


@query("eva04_macro", f"{C}, {BOTH}, {TRUTH}, g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, avg(coalesce(1.0::DOUBLE / truth_rank, 0)) AS mrr FROM tr GROUP BY 1, 2" for k in ("dataset", "system", "fault")) + ") SELECT dimension, round(avg(mrr), 6) AS macro, arg_min(value, mrr) AS worst, round(min(mrr), 6) AS worst_value FROM g GROUP BY 1")
def eva04(spark, d):
    return E.macro(E.grouped_metrics(ranks(spark, d), ["dataset", "system", "fault"]), "mrr").withColumns({c: r(c) for c in ("macro", "worst_value")})


@query("eva05_chance", f"{C}, {BOTH}, {TRUTH} SELECT " + ", ".join(f"round(avg(least(1.0::DOUBLE, {k}.0 / candidates)), 6) AS ac{k}" for k in E.CUTS) + ", round(avg(list_sum(list_transform(range(1, candidates + 1), lambda i: 1.0::DOUBLE / i)) / candidates), 6) AS mrr FROM tr")
def eva05(spark, d):
    c = E.chance(ranks(spark, d))
    return c.withColumns({x: r(x) for x in c.columns})


@query("eva06_wilson", f"""{C}, {BOTH}, {TRUTH}, g AS (SELECT system, count(*) FILTER (truth_rank = 1) AS hits, count(*) AS n FROM tr GROUP BY 1), z AS (SELECT *, hits / CAST(n AS DOUBLE) AS p, 1.959963984540054 AS z FROM g)
SELECT system, hits, n, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM z""")
def eva06(spark, d):
    return E.wilson_rows(ranks(spark, d), ["system"]).withColumns({c: r(c) for c in ("low", "high")})


REPLICATES = 200
BOOT = f"""u AS (SELECT dataset || system AS unit, sum(hit) AS s, count(*) AS n, row_number() OVER (ORDER BY dataset || system) - 1 AS k FROM (SELECT *, CASE WHEN truth_rank = 1 THEN 1 ELSE 0 END AS hit FROM tr) GROUP BY 1),
m AS (SELECT count(*) AS m FROM u), dr AS (SELECT b, CAST(floor({frac("'7'", 'CAST(b AS VARCHAR)', 'CAST(j AS VARCHAR)')} * m) AS BIGINT) AS k FROM m, range({REPLICATES}) x(b), range(100) y(j) WHERE j < m)"""


@query("eva08_cluster_bootstrap", f"{C}, {BOTH}, {TRUTH}, {BOOT} SELECT b AS replicate, round(sum(s) / CAST(sum(n) AS DOUBLE), 9) AS mean FROM dr JOIN u USING (k) GROUP BY 1")
def eva08(spark, d):
    """Clusters are summed up before they are drawn; with incidents as units this is the incident bootstrap (EVA-07)."""
    t = ranks(spark, d).withColumn("unit", F.concat("dataset", "system")).withColumn("hit", (F.col("truth_rank") == 1).cast("int"))
    return E.bootstrap(t, "unit", "hit", REPLICATES).withColumn("mean", r("mean", 9))


PAIRED = f"""p AS (SELECT rank_a, rank_b, row_number() OVER (ORDER BY rank_a, rank_b) - 1 AS k, CASE WHEN rank_a = 1 THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN rank_b = 1 THEN 1 ELSE 0 END AS ac1, 1.0::DOUBLE / rank_a - 1.0::DOUBLE / rank_b AS mrr FROM both2 WHERE is_root),
dr AS (SELECT b, CAST(floor({frac("'7'", 'CAST(b AS VARCHAR)', 'CAST(j AS VARCHAR)')} * m) AS BIGINT) AS k FROM (SELECT count(*) AS m FROM p), range({REPLICATES}) x(b), LATERAL (SELECT unnest(range(m)) AS j) y),
rp AS (SELECT b, avg(ac1) AS ac1, avg(mrr) AS mrr FROM dr JOIN p USING (k) GROUP BY 1), ls AS (SELECT list(ac1 ORDER BY ac1) AS a, list(mrr ORDER BY mrr) AS m FROM rp)"""
_LOW, _HIGH = round((REPLICATES - 1) * 0.025) + 1, round((REPLICATES - 1) * 0.975) + 1


@query("eva07_interval", f"""{C}, {BOTH}, {PAIRED} SELECT 'ac1' AS metric, (SELECT round(avg(ac1), 9) FROM p) AS difference, round(a[{_LOW}], 9) AS low, round(a[{_HIGH}], 9) AS high FROM ls
UNION ALL SELECT 'mrr', (SELECT round(avg(mrr), 9) FROM p), round(m[{_LOW}], 9), round(m[{_HIGH}], 9) FROM ls""")
def eva07(spark, d):
    """The first score's ranking less the second's, resampled by incident."""
    p = both(spark, d).filter("is_root").select("incident_id", "rank_a", "rank_b")
    return E.paired_bootstrap(p, REPLICATES).withColumns({c: r(c, 9) for c in ("difference", "low", "high")})


@query("eva09_seed_variance", f"{C}, {BOTH}, {TRUTH}, g AS (SELECT dataset, system, avg(CASE WHEN truth_rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM tr GROUP BY 1, 2) SELECT dataset, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS runs FROM g GROUP BY 1")
def eva09(spark, d):
    g = ranks(spark, d).groupBy("dataset", "system").agg(F.avg((F.col("truth_rank") == 1).cast("double")).alias("v"))
    return E.seed_variance(g, ["dataset"], "v").withColumns({c: r(c) for c in ("mean", "std", "min", "max")})


@query("eva10_mcnemar", f"{C}, {BOTH}, q AS (SELECT system, rank_a = 1 AS a, rank_b = 1 AS b FROM both2 WHERE is_root) SELECT system, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM q GROUP BY 1")
def eva10(spark, d):
    """The table; its exact probability is held against brute force in the tests."""
    q = both(spark, d).filter("is_root").select("system", (F.col("rank_a") == 1).alias("a"), (F.col("rank_b") == 1).alias("b"))
    return E.mcnemar(q, ["system"]).drop("p")


NR = "nr AS (SELECT incident_id, service, is_root, dataset, CASE WHEN n > 1 THEN (rank_a - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END AS rank_score FROM both2)"


def normalised(spark, d):
    return both(spark, d).withColumn("rank_score", 1 - R.rank_percentile("rank_a"))


@query("eva11_conformal", f"""{C}, {BOTH}, {NR}, ca AS (SELECT round(rank_score, 9) AS v, row_number() OVER (ORDER BY rank_score) - 1 AS k, count(*) OVER () AS n FROM nr WHERE is_root AND dataset IN ('1-URGENT', '2-HIGH')),
q AS (SELECT v FROM ca WHERE k = least(n - 1, CAST(ceil((n + 1) * 0.9) AS BIGINT) - 1)), g AS (SELECT incident_id, min(v) AS v, count(*) FILTER (round(rank_score, 9) <= v) AS size, bool_or(round(rank_score, 9) <= v AND is_root) AS covered FROM nr, q WHERE dataset NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1)
SELECT round(min(v), 6) AS quantile, round(avg(size), 6) AS mean_size, round(avg(CAST(covered AS INT)), 6) AS coverage, count(*) AS incidents FROM g""")
def eva11(spark, d):
    n = normalised(spark, d).withColumn("rank_score", r("rank_score", 9))
    early = F.col("dataset").isin("1-URGENT", "2-HIGH")
    c = E.conformal(n.filter(early & F.col("is_root")).select(F.col("rank_score").alias("truth_score")), n.filter(~early), 0.9)
    return c.withColumns({x: r(x) for x in ("quantile", "mean_size", "coverage")})


QUAL = "ql AS (SELECT incident_id, truth_rank, truth_rank = 1 AS correct, floor((a1 - a2) / greatest(abs(a1), 1e-9) * 50) / 50 AS quality FROM tr JOIN (SELECT incident_id, max(score_a) FILTER (rank_a = 1) AS a1, max(score_a) FILTER (rank_a = 2) AS a2 FROM both2 GROUP BY 1) USING (incident_id))"


def quality(spark, d):
    m = both(spark, d).withColumn("m", R.margin("score_a")).filter("is_root").select("incident_id", F.col("rank_a").alias("truth_rank"), (F.col("rank_a") == 1).alias("correct"), (F.floor(F.col("m") * 50) / 50).alias("quality"))
    return m


@query("eva13_abstention", f"""{C}, {BOTH}, {TRUTH}, {QUAL}, c AS (SELECT quality, count(*) AS n, sum(CAST(correct AS INT)) AS k FROM ql GROUP BY 1), w AS (SELECT quality, sum(n) OVER (ORDER BY quality DESC) AS accepted, sum(k) OVER (ORDER BY quality DESC) AS good, sum(n) OVER () AS total FROM c)
SELECT quality AS threshold, CAST(accepted AS BIGINT) AS accepted, round(accepted / CAST(total AS DOUBLE), 6) AS coverage, round(good / CAST(accepted AS DOUBLE), 6) AS accuracy FROM w WHERE good / CAST(accepted AS DOUBLE) >= 0.42 ORDER BY accepted DESC LIMIT 1""")
def eva13(spark, d):
    return E.abstention(quality(spark, d), 0.42).withColumns({c: r(c) for c in ("coverage", "accuracy")})


@query("eva14_selective", f"{C}, {BOTH}, {TRUTH}, {QUAL} SELECT round(avg(CASE WHEN quality >= 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN quality >= 0.3 THEN CAST(correct AS INT) END), 6) AS accuracy, round(avg(CASE WHEN quality >= 0.3 THEN 1.0::DOUBLE / truth_rank END), 6) AS mrr FROM ql")
def eva14(spark, d):
    return E.selective(quality(spark, d), 0.3).withColumns({c: r(c) for c in ("coverage", "accuracy", "mrr")})


@query("eva15_aurc", f"""{C}, {BOTH}, {TRUTH}, {QUAL}, k AS (SELECT row_number() OVER (ORDER BY quality DESC, incident_id) AS i, sum(CAST(NOT correct AS INT)) OVER (ORDER BY quality DESC, incident_id ROWS UNBOUNDED PRECEDING) AS bad FROM ql), c AS (SELECT i, bad / CAST(i AS DOUBLE) AS risk FROM k),
l AS (SELECT risk, lag(risk) OVER (ORDER BY i) AS b FROM c) SELECT round(sum((risk + b) / 2) / count(*), 6) AS aurc, count(*) AS n FROM l""")
def eva15(spark, d):
    return E.aurc(E.risk_curve(quality(spark, d))).withColumn("aurc", r("aurc"))


@query("eva16_ood", f"""{C}, b AS (SELECT quantile_cont(score_a, 0.01) AS la, quantile_cont(score_a, 0.99) AS ha, quantile_cont(score_b, 0.01) AS lb, quantile_cont(score_b, 0.99) AS hb FROM cand WHERE fault = 'F')
SELECT incident_id, service, (CAST(score_a < la OR score_a > ha AS INT) + CAST(score_b < lb OR score_b > hb AS INT)) / 2.0::DOUBLE AS ood FROM cand, b WHERE fault <> 'F'""")
def eva16(spark, d):
    c = B.cand(spark, d)
    features = ["score_a", "score_b"]
    return E.ood_scores(c.filter("fault <> 'F'").select("incident_id", "service", *features), E.ood_bounds(c.filter("fault = 'F'"), features), ["incident_id", "service"], features)


@query("eva17_distribution_shift", f"""{C}, lg AS (SELECT system, 'score_a' AS feature, score_a AS v FROM cand UNION ALL SELECT system, 'score_b', score_b FROM cand), p AS (SELECT feature, system, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM lg GROUP BY 1, 2),
j AS (SELECT x.feature, x.system AS "left", y.system AS "right", abs(x.m - y.m) / greatest(x.b - x.a, y.b - y.a, 1e-9) AS shift FROM p x JOIN p y ON x.feature = y.feature AND x.system < y.system)
SELECT feature, "left", "right", round(shift, 6) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY shift DESC, "left" DESC, "right" DESC) AS k FROM j) WHERE k = 1""")
def eva17(spark, d):
    return E.distribution_shift(B.cand(spark, d), "system", ["score_a", "score_b"]).withColumn("shift", r("shift"))


@query("eva18_repeatability", f"""{C}, {BOTH}, t AS (SELECT dataset, service, count(*) AS n FROM both2 WHERE rank_a = 1 GROUP BY 1, 2), a AS (SELECT dataset, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS consistency, CAST(sum(n) AS BIGINT) AS repeats FROM t GROUP BY 1),
v AS (SELECT dataset, service, var_pop(rank_a) AS v FROM both2 GROUP BY 1, 2) SELECT dataset, consistency, repeats, rank_variance FROM a JOIN (SELECT dataset, round(avg(v), 6) AS rank_variance FROM v GROUP BY 1) USING (dataset)""")
def eva18(spark, d):
    c = both(spark, d).withColumn("rank", F.col("rank_a"))
    return E.repeatability(c, "dataset").withColumns({x: r(x) for x in ("consistency", "rank_variance")})


@query("eva19_rank_histogram", f"""{C}, {BOTH}, {TRUTH}, b AS (SELECT CASE WHEN truth_rank <= 3 THEN CAST(truth_rank AS VARCHAR) WHEN truth_rank <= 5 THEN '4-5' WHEN truth_rank <= 10 THEN '6-10' ELSE '>10' END AS bucket FROM tr)
SELECT x.bucket, count(b.bucket) AS n FROM (VALUES ('1'), ('2'), ('3'), ('4-5'), ('6-10'), ('>10'), ('absent')) x(bucket) LEFT JOIN b ON b.bucket = x.bucket GROUP BY 1""")
def eva19(spark, d):
    return E.rank_histogram(ranks(spark, d))


@query("eva20_failure_taxonomy", f"""{C}, {BOTH}, {TRUTH}, f AS (SELECT incident_id, unnest(list_filter([CASE WHEN truth_rank <= 3 THEN 'near_miss' END, CASE WHEN truth_rank > 5 THEN 'far' END, CASE WHEN candidates > 6 THEN 'many_candidates' END], lambda x: x IS NOT NULL)) AS flag FROM tr WHERE truth_rank > 1)
SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def eva20(spark, d):
    flags = {"near_miss": F.col("truth_rank") <= 3, "far": F.col("truth_rank") > 5, "many_candidates": F.col("candidates") > 6}
    return E.failure_taxonomy(ranks(spark, d), flags).drop("examples")


@query("eva23_margins", f"{C}, {BOTH}, m AS (SELECT max(score_b) FILTER (rank_b = 1) - max(score_b) FILTER (rank_b = 2) AS m FROM both2 GROUP BY incident_id) SELECT round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.1), 6) AS p10, round(avg(CAST(m = 0 AS INT)), 6) AS ties, round(avg(CAST(m <= 5 AS INT)), 6) AS near_ties, count(*) AS n FROM m")
def eva23(spark, d):
    m = E.margins(B.cand(spark, d).withColumn("score", F.col("score_b")), ["incident_id"], 5.0)
    return m.withColumns({c: r(c) for c in ("median", "p10", "ties", "near_ties")})


@query("eva25_case_status", f"{C}, {BOTH}, {TRUTH} SELECT dataset, CASE WHEN candidates < 4 THEN 'insufficient_candidates' WHEN truth_rank > 5 THEN 'detection_miss' ELSE 'ready' END AS status, count(*) AS n FROM tr GROUP BY 1, 2")
def eva25(spark, d):
    t = ranks(spark, d)
    status = F.when(F.col("truth_rank").isNull(), "root_not_observable").when(F.col("candidates") < 4, "insufficient_candidates").when(F.col("truth_rank") > 5, "detection_miss").otherwise("ready")
    return t.groupBy("dataset", status.alias("status")).agg(F.count("*").alias("n"))


@query("eva27_gates", f"{C}, {BOTH}, {TRUTH}, m AS (SELECT {METRICS} FROM tr) SELECT ac1 >= 0.2 AS accuracy, mrr >= 0.4 AS reciprocal, coverage >= 0.95 AS coverage_ok, CASE WHEN ac1 >= 0.2 AND mrr >= 0.4 AND coverage >= 0.95 THEN 'promote' ELSE 'hold' END AS verdict FROM m")
def eva27(spark, d):
    m = ranks(spark, d).agg(*E.metric_columns())
    return E.gates(m, {"accuracy": F.col("ac1") >= 0.2, "reciprocal": F.col("mrr") >= 0.4, "coverage_ok": F.col("coverage") >= 0.95})


MASK = """cond AS (SELECT * FROM (VALUES ('none', 1.0, 1.0), ('a_missing', 0.0, 1.0), ('a_weak', 0.5, 1.0), ('b_missing', 1.0, 0.0)) c(condition, fa, fb)),
ms AS (SELECT condition, incident_id, service, is_root, score_a * fa / 1000 + score_b * fb AS s FROM cand, cond), rk AS (SELECT *, row_number() OVER (PARTITION BY condition, incident_id ORDER BY round(s, 6) DESC, service) AS rank FROM ms)"""


@query("eva28_stress_matrix", f"{C}, {MASK} SELECT condition, count(*) AS incidents, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ac1, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM rk WHERE is_root GROUP BY 1")
def eva28(spark, d):
    """A heuristic's metrics with a modality missing or weakened (PRJ-17)."""
    cond = spark.createDataFrame([("none", 1.0, 1.0), ("a_missing", 0.0, 1.0), ("a_weak", 0.5, 1.0), ("b_missing", 1.0, 0.0)], "condition string, fa double, fb double")
    s = B.cand(spark, d).crossJoin(F.broadcast(cond)).withColumn("s", r(F.col("score_a") * F.col("fa") / 1000 + F.col("score_b") * F.col("fb")))
    k = R.ranked(s, "s", ["condition", "incident_id"]).filter("is_root")
    return k.groupBy("condition").agg(F.count("*").alias("incidents"), r(F.avg((F.col("rank") == 1).cast("double"))).alias("ac1"), r(F.avg(1 / F.col("rank"))).alias("mrr"))


@query("eva29_group_permutation", f"""{C}, a AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY service) AS k, row_number() OVER (PARTITION BY incident_id ORDER BY {frac("'5'", 'incident_id', 'service')}, service) AS p FROM cand),
j AS (SELECT x.incident_id, x.service, x.is_root, y.score_a FROM a x JOIN a y ON x.incident_id = y.incident_id AND x.k = y.p), rk AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score_a DESC, service) AS rank FROM j)
SELECT round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ac1, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM rk WHERE is_root""")
def eva29(spark, d):
    p = E.permuted_within(B.cand(spark, d), ["score_a"], ["incident_id"], 5)
    k = R.ranked(p, "score_a").filter("is_root")
    return k.agg(r(F.avg((F.col("rank") == 1).cast("double"))).alias("ac1"), r(F.avg(1 / F.col("rank"))).alias("mrr"))


@query("eva31_contribution_shares", f"{C} SELECT incident_id, service, 'metric' AS \"group\", round(abs(score_a) / (abs(score_a) + abs(score_b)), 6) AS share FROM cand UNION ALL SELECT incident_id, service, 'trace', round(abs(score_b) / (abs(score_a) + abs(score_b)), 6) FROM cand")
def eva31(spark, d):
    c = B.cand(spark, d).select("incident_id", "service", "score_a", "score_b")
    return E.contribution_shares(c, ["incident_id", "service"], {"score_a": "metric", "score_b": "trace"}).withColumn("share", r("share"))


@query("eva32_permuted_labels", f"{C}, x AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY CAST(is_root AS INT), {frac("'3'", 'incident_id', 'service')}, service) AS k FROM cand) SELECT incident_id, service FROM x WHERE k = 1")
def eva32(spark, d):
    c = B.cand(spark, d).withColumn("label", F.col("is_root").cast("int"))
    return E.permuted_labels(c, ["incident_id"], 3).filter("permuted = 1").select("incident_id", "service")


# ---- splits --------------------------------------------------------------------------------------------------------------------


@query("spl01_stratified", f"""{C}, {BOTH}, {TRUTH}, x AS (SELECT *, row_number() OVER (PARTITION BY system, fault ORDER BY {frac("'1'", 'incident_id')}, incident_id) AS k, count(*) OVER (PARTITION BY system, fault) AS m FROM tr),
y AS (SELECT *, CASE WHEN m >= 3 THEN greatest(1, CAST(round(m * 0.15) AS BIGINT)) ELSE 0 END AS v FROM x) SELECT system, fault, CASE WHEN k <= v THEN 'validation' WHEN k <= 2 * v THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM y GROUP BY 1, 2, 3""")
def spl01(spark, d):
    return E.stratified(ranks(spark, d), ["system", "fault"], "incident_id", 1).groupBy("system", "fault", "split").agg(F.count("*").alias("n"))


DIGITS = "list_sum(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256('ns:' || incident_id), i, 1)) - 1)) % 5"


@query("spl02_hash_split", f"{C}, i AS (SELECT DISTINCT incident_id FROM cand) SELECT incident_id, CAST({DIGITS} AS BIGINT) AS fold FROM i")
def spl02(spark, d):
    return B.cand(spark, d).select("incident_id").distinct().select("incident_id", E.hash_split(F.col("incident_id"), "ns").alias("fold"))


@query("spl03_grouped_folds", f"""{C.replace("WITH ", "WITH RECURSIVE ", 1)}, c AS (SELECT cl, n, row_number() OVER (ORDER BY {frac("'2'", 'cl')}, cl) AS k FROM (SELECT dataset || system AS cl, count(*) AS n FROM cand GROUP BY 1)),
dealt AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS cl, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS fold, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads
  UNION ALL SELECT k, cl, n, f - 1, list_transform(loads, lambda x, i: CASE WHEN i = f THEN x + n ELSE x END) FROM (SELECT c.*, loads, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS f FROM dealt JOIN c ON c.k = dealt.k + 1))
SELECT cl AS cluster, fold, n FROM dealt WHERE k > 0""")
def spl03(spark, d):
    c = B.cand(spark, d).withColumn("cluster", F.concat("dataset", "system"))
    return E.grouped_folds(c, "cluster", 5, 2).groupBy("cluster", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query("spl04_leave_one_out", f"{C} SELECT g.system AS held_out, CASE WHEN c.system = g.system THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM cand c, (SELECT DISTINCT system FROM cand) g GROUP BY 1, 2")
def spl04(spark, d):
    return E.leave_one_out(B.cand(spark, d), "system").groupBy("held_out", "role").agg(F.count("*").alias("n"))


@query("spl05_cross_split", f"{C}, x AS (SELECT service || score_b AS fp, CASE WHEN fault = 'F' THEN 'train' ELSE 'test' END AS split FROM cand) SELECT fp AS fingerprint, count(DISTINCT split) AS splits, count(*) AS n FROM (SELECT replace(fp, '.0', '') AS fp, split FROM x) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def spl05(spark, d):
    c = B.cand(spark, d).select(F.concat("service", F.col("score_b").cast("long").cast("string")).alias("fingerprint"), F.when(F.col("fault") == "F", "train").otherwise("test").alias("split"))
    return E.cross_split(c, "fingerprint")


@query("spl06_ledger", """WITH l AS (SELECT o_custkey AS system, CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'selection' WHEN 2 THEN 'locked' ELSE 'report' END AS role FROM orders)
SELECT system, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(*) AS n FROM l GROUP BY 1 HAVING bool_or(role IN ('train', 'selection')) AND bool_or(role = 'locked')""")
def spl06(spark, d):
    role = F.element_at(F.array(*map(F.lit, ("train", "selection", "locked", "report"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    ledger = B.read(spark, d, "orders").select(F.col("o_custkey").alias("system"), role.alias("role"))
    return E.ledger_conflicts(ledger, ["system"]).withColumn("roles", F.array_join("roles", ","))


@query("spl09_hash_minimum", f"{C}, x AS (SELECT DISTINCT system, incident_id FROM cand) SELECT system, arg_min(incident_id, sha256(incident_id)) AS incident_id FROM x GROUP BY 1")
def spl09(spark, d):
    return E.hash_minimum(B.cand(spark, d), "system", "incident_id")


@query("spl10_invalid_groups", f"{C} SELECT incident_id, count(*) AS n, CAST(sum(CAST(is_root AND score_b > 20 AS INT)) AS BIGINT) AS positives FROM cand GROUP BY 1 HAVING count(*) < 2 OR sum(CAST(is_root AND score_b > 20 AS INT)) <> 1")
def spl10(spark, d):
    return E.invalid_groups(B.cand(spark, d).withColumn("label", (F.col("is_root") & (F.col("score_b") > 20)).cast("int")), "incident_id", "label")


@query("spl12_overlap", "SELECT count(*) AS common FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') WHERE k IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def spl12(spark, d):
    li = B.read(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return E.overlap(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"), "k")
