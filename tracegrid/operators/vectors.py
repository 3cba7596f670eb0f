"""The diagnostic vector of every candidate of an incident: its metrics, its traces, what goes on around it, what has disappeared."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.functions.lineage import cut
from tracegrid.operators import diagnosis as D
from tracegrid.operators import graph as G

# Metric families and trace signals of the vector.
FAMILIES = ("cpu", "memory", "network", "traffic_rate")
SIGNALS = ("span_rate", "request_rate", "error_rate", "latency_median_us", "latency_p90_us", "latency_p99_us", "exclusive_median_us", "downstream_wait_ratio")
# Names that would tell the truth or whose incident it is.
FORBIDDEN = ("root", "root_service", "fault", "fault_family", "label", "system", "dataset")
# The vector's columns, in order.
METRICS = (
    *(f"metric_{f}_{x}" for f in FAMILIES for x in ("shift", "persistence", "available")),
    "metric_max_shift", "metric_second_shift", "metric_coverage", "metric_heuristic_percentile",
)
TRACES = (*(f"trace_{s}_shift" for s in SIGNALS), "trace_local_support", "trace_coverage", "exclusive_duration_support", "downstream_wait_support")
PROPAGATION = (
    "upstream_affected_ratio", "downstream_affected_ratio", "affected_neighborhood_precision", "affected_neighborhood_recall",
    "affected_neighborhood_f1", "distance_weighted_affected_callers", "distance_weighted_affected_callees",
    "local_vs_neighbor_anomaly_contrast", "caller_error_propagation", "callee_latency_propagation",
    "expected_vs_observed_affected_region",
)
DISAPPEARANCE = (
    "expected_service_activity", "observed_service_activity", "activity_ratio", "span_count_drop", "request_count_drop",
    "last_seen_delta", "expected_edge_presence", "observed_edge_presence", "missing_expected_edge_ratio",
    "caller_requests_without_callee_response", "caller_errors_without_callee_spans", "expected_trace_presence",
    "observed_trace_presence", "telemetry_disappearance_score", "trace_collected_mask", "expected_but_disappeared_mask",
)
COVERAGE = ("topology_coverage", "candidate_count_log", "missing_metric_modality", "missing_trace_modality")
FEATURES = METRICS + TRACES + PROPAGATION + DISAPPEARANCE + COVERAGE

#: A shift from which on a service counts as affected, and one that counts as full support.
AFFECTED, FULL = 3.0, 6.0


class Healthy(NamedTuple):
    """What is normal: robust lines of metrics (by, service, family) and trace signals (by, service, signal) on the load, as
    workload_baseline() gives them, and the edges (by, source, target) that are expected."""

    metrics: DataFrame
    traces: DataFrame
    edges: DataFrame


def melted(summary: DataFrame, keep: list[str]) -> DataFrame:
    """keep, signal, value: the trace signals of window_summary() below one another."""
    one = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in SIGNALS))
    return summary.select(*keep, F.explode(one).alias("__m")).select(*keep, "__m.*")


def candidate_vectors(incidents: DataFrame, services: DataFrame, points: DataFrame, summary: DataFrame, observed: DataFrame, healthy: Healthy, by: list[str]) -> DataFrame:
    """incident_id, service and the 59 doubles of FEATURES, a row for each candidate of an incident.

    incidents: incident_id, the columns `by` that name its healthy period, start_us, end_us, load, traces_collected; columns of
    FORBIDDEN are refused. services: incident_id, service. points: incident_id, service, family, value. summary: incident_id,
    service and the columns of spans.window_summary(). observed: incident_id, source, target.

    Nothing is null: a service without points, spans or a healthy period has zeros there; one without a summary was last seen
    before the incident. A null load is 0; points that are null or not finite are left out. Repeated candidates and edges count once; candidates and edges without a name, and
    candidates of an unknown incident, have no row. More columns of the inputs are left out. Edges may lead to services that are
    no candidates: these count as expected or observed calls and as steps of a distance, not as neighbours.

    All incidents go through at once: joins on the incident and the service, closures of each incident's graph, and one window
    over the candidates of an incident.
    """
    leaked = sorted(set(FORBIDDEN) & set(incidents.columns))
    if leaked:
        raise ValueError(f"incidents tell the truth: {leaked}")
    seconds = F.coalesce(F.greatest((F.col("end_us") - F.col("start_us")) / 1_000_000, F.lit(1e-6)), F.lit(1e-6))
    about = incidents.select("incident_id", *by, F.coalesce(F.col("load").cast("double"), F.lit(0.0)).alias("x"), seconds.alias("seconds"), F.coalesce("traces_collected", F.lit(False)).cast("double").alias("collected"))
    at = ["incident_id", "service"]
    who = services.select(*at).filter("service is not null").distinct().join(about, "incident_id")
    edges = cut(_edges(about, observed, healthy.edges, by))
    # rows of candidates, cut step by step: each step reads the one before several times
    local = cut(_local(who, summary, healthy, by).join(_metrics(about, points, healthy, by), at, "left"))
    raw = cut(_scored(local, edges))
    around, far = (cut(x) for x in _around(raw, edges))
    totals = raw.groupBy("incident_id").agg(F.count("*").alias("candidates"), F.count_if("affected").alias("hot"))
    topology = edges.select("incident_id").distinct().withColumn("topology", F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy("max_metric", "service")) - 1
    j = raw.withColumn("place", rank).join(around, at, "left").join(far, at, "left").join(totals, "incident_id").join(topology, "incident_id", "left")
    return j.select(*at, *(c.cast("double").alias(name) for name, c in _columns().items()))


def _edges(about: DataFrame, observed: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """incident_id, source, target, expected, observed of every edge that is one of the two."""
    ends = ["incident_id", "source", "target"]
    e = about.select("incident_id", *by).join(expected.select(*by, "source", "target").distinct(), by).select(*ends, F.lit(True).alias("expected"))
    o = observed.select(*ends).distinct().join(about.select("incident_id"), "incident_id", "left_semi").withColumn("observed", F.lit(True))
    both = e.filter("source is not null and target is not null").join(o.filter("source is not null and target is not null"), ends, "full")
    return both.select(*ends, F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("observed", F.lit(False)).alias("observed"))


def _metrics(about: DataFrame, points: DataFrame, healthy: Healthy, by: list[str]) -> DataFrame:
    """incident_id, service, and shift and persistence of each family that has points and a line."""
    p = points.select("incident_id", "service", "family", F.col("value").cast("double").alias("value")).filter(F.col("family").isin(*FAMILIES) & stats.finite("value"))
    p = p.join(about.select("incident_id", *by, "x"), "incident_id")
    m = D.metric_residual_shift(p, healthy.metrics, [*by, "service", "family"], AFFECTED, ["incident_id", "service", "family"])
    of = lambda f, c: F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{f}_{c}")
    return m.groupBy("incident_id", "service").agg(*(of(f, c) for f in FAMILIES for c in ("shift", "persistence")))


def _local(who: DataFrame, summary: DataFrame, healthy: Healthy, by: list[str]) -> DataFrame:
    """who with its summary, the shift of each signal and the numbers of spans and requests that are expected."""
    at = ["incident_id", "service"]
    rest = ("last_seen_delta_s", "trace_coverage", "span_count", "request_count")
    s = who.join(summary.select(*at, *(F.col(c).cast("double").alias(c) for c in (*SIGNALS, *rest))), at, "left")
    s = s.withColumns({c: F.coalesce(c, F.col("seconds") if c == "last_seen_delta_s" else F.lit(0.0)) for c in (*SIGNALS, *rest)})
    long = D.trace_signal_shift(melted(s, [*at, *by, "x"]), healthy.traces, [*by, "service"])
    of = lambda name, c: F.max(F.when(F.col("signal") == name, F.col(c)))
    wide = long.groupBy(*at).agg(*(of(n, "shift").alias(f"shift_{n}") for n in SIGNALS), *(F.coalesce(of(f"{n}_rate", "predicted"), F.lit(0.0)).alias(f"expected_{n}_rate") for n in ("span", "request")))
    amount = lambda n: F.greatest(F.lit(0.0), F.col(f"expected_{n}_rate") * F.col("seconds")).alias(f"expected_{n}s")
    return s.join(wide, at).select(*who.columns, "error_rate", *rest, *(f"shift_{n}" for n in SIGNALS), amount("span"), amount("request"))


def _scored(j: DataFrame, edges: DataFrame) -> DataFrame:
    """j with its expected and observed calls, its largest shifts, how far it has disappeared, its score and whether it is affected."""
    at = ["incident_id", "service"]
    e, o = F.col("expected"), F.col("observed")
    out = edges.groupBy("incident_id", F.col("source").alias("service")).agg(F.count_if(e).alias("out_expected"), F.count_if(o).alias("out_observed"), F.count_if(e & ~o).alias("out_missing"))
    into = edges.groupBy("incident_id", F.col("target").alias("service")).agg(F.count_if(e).alias("in_expected"), F.count_if(e & o).alias("in_seen"))
    counts = ("out_expected", "out_observed", "out_missing", "in_expected", "in_seen")
    j = j.join(out, at, "left").join(into, at, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    shifts = F.sort_array(F.array(*(F.coalesce(f"{f}_shift", F.lit(0.0)) for f in FAMILIES)), asc=False)
    ratio, missing = F.col("span_count") / F.greatest("expected_spans", F.lit(1.0)), F.col("out_missing") / F.greatest(F.lit(1), F.col("out_expected"))
    j = j.withColumns({"max_metric": shifts[0], "second_metric": shifts[1], "max_trace": F.greatest(*(F.col(f"shift_{n}") for n in SIGNALS), F.lit(0.0)), "ratio": ratio, "missing": missing})
    due = F.col("expected_spans") >= 1
    j = j.withColumn("due", due.cast("double")).withColumn("gone", (due & (F.col("ratio") < 0.2)).cast("double"))
    lost = 0.45 * F.greatest(F.lit(0.0), 1 - F.col("ratio")) + 0.35 * F.col("missing") + 0.20 * F.col("gone")
    j = j.withColumn("disappearance", F.when(due, F.least(F.lit(1.0), F.greatest(F.lit(0.0), lost))).otherwise(0.0))
    j = j.withColumn("score", F.greatest("max_metric", "max_trace", F.col("disappearance") * FULL))
    return j.withColumn("affected", F.col("score") >= AFFECTED)


def _around(raw: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each candidate: counts and means over the candidates that call it or that it calls, however far; and sums of 1 / distance
    to the affected ones, over all edges."""
    at, i = ["incident_id", "service"], ["incident_id"]
    name = lambda c: raw.select("incident_id", F.col("service").alias(c))
    inner = edges.join(name("source"), [*i, "source"], "left_semi").join(name("target"), [*i, "target"], "left_semi")
    other = raw.select("incident_id", F.col("service").alias("other"), "affected", "score", "error_rate", "shift_latency_p90_us")
    ways = G.closures(inner, i, itself_on_cycle=True).groupBy(*at, "other").agg(F.bool_or(F.col("direction") == "ancestor").alias("up"), F.bool_or(F.col("direction") == "descendant").alias("down"))
    up, down, hot = F.col("up"), F.col("down"), F.col("affected")
    around = ways.join(other, [*i, "other"]).groupBy(*at).agg(
        F.count_if(up).alias("ups"), F.count_if(up & hot).alias("hot_ups"), F.count_if(down).alias("downs"), F.count_if(down & hot).alias("hot_downs"), F.count("*").alias("near"),
        F.count_if(hot).alias("hot_near"), F.avg("score").alias("near_score"), F.avg(F.when(up, F.col("error_rate"))).alias("up_error"), F.avg(F.when(down, F.col("shift_latency_p90_us"))).alias("down_latency"),
    )
    far = G.closures(edges, i).join(other.filter("affected").select(*i, "other"), [*i, "other"])
    weight = lambda way: F.sum(F.when(F.col("direction") == way, 1 / F.col("distance")))
    return around, far.groupBy(*at).agg(weight("ancestor").alias("callers"), weight("descendant").alias("callees"))


def _columns() -> dict:
    """The features over the joined row, in order."""
    c = F.col
    zero = lambda x: F.coalesce(c(x) if isinstance(x, str) else x, F.lit(0.0))
    share = lambda part, whole: zero(part) / F.greatest(zero(whole), F.lit(1.0))
    support = lambda s: F.least(F.lit(1.0), c(f"shift_{s}") / FULL)
    p, q = share("hot_near", "hot"), share("hot_near", "near")
    work = F.greatest(F.lit(1.0), c("seconds") * c("x"))
    drop = lambda n: F.greatest(F.lit(0.0), 1 - c(f"{n}_count") / F.greatest(c(f"expected_{n}s"), F.lit(1.0)))
    there = [c(f"{f}_shift").isNotNull().cast("double") for f in FAMILIES]
    known = there[0] + there[1] + there[2] + there[3]
    metric = {f"metric_{f}_{x}": y for f, t in zip(FAMILIES, there, strict=True) for x, y in (("shift", zero(f"{f}_shift")), ("persistence", zero(f"{f}_persistence")), ("available", t))}
    values = metric | {
        "metric_max_shift": c("max_metric"), "metric_second_shift": c("second_metric"), "metric_coverage": known / len(FAMILIES), "metric_heuristic_percentile": c("place") / F.greatest(c("candidates") - 1, F.lit(1)),
        **{f"trace_{s}_shift": c(f"shift_{s}") for s in SIGNALS},
        "trace_local_support": F.least(F.lit(1.0), c("max_trace") / FULL), "trace_coverage": c("trace_coverage"), "exclusive_duration_support": support("exclusive_median_us"), "downstream_wait_support": support("downstream_wait_ratio"),
        "upstream_affected_ratio": share("hot_ups", "ups"), "downstream_affected_ratio": share("hot_downs", "downs"), "affected_neighborhood_precision": p, "affected_neighborhood_recall": q,
        "affected_neighborhood_f1": 2 * p * q / F.greatest(p + q, F.lit(1e-9)), "distance_weighted_affected_callers": share("callers", "hot"), "distance_weighted_affected_callees": share("callees", "hot"),
        "local_vs_neighbor_anomaly_contrast": c("score") - zero("near_score"), "caller_error_propagation": zero("up_error"), "callee_latency_propagation": zero("down_latency"),
        "expected_vs_observed_affected_region": zero("hot_near") / F.greatest(F.lit(1.0), zero("hot") + zero("near") - zero("hot_near")),
        "expected_service_activity": F.least(F.lit(1.0), c("expected_spans") / work), "observed_service_activity": F.least(F.lit(1.0), c("span_count") / work), "activity_ratio": F.least(F.lit(2.0), c("ratio")),
        "span_count_drop": drop("span"), "request_count_drop": drop("request"), "last_seen_delta": F.least(F.lit(1.0), c("last_seen_delta_s") / F.greatest(c("seconds"), F.lit(1.0))),
        "expected_edge_presence": c("out_expected") + c("in_expected") > 0, "observed_edge_presence": c("out_observed") + c("in_seen") > 0, "missing_expected_edge_ratio": c("missing"),
        "caller_requests_without_callee_response": c("missing") * (zero("ups") > 0).cast("double"), "caller_errors_without_callee_spans": c("missing") * zero("up_error"),
        "expected_trace_presence": c("due"), "observed_trace_presence": c("span_count") > 0, "telemetry_disappearance_score": c("disappearance"), "trace_collected_mask": c("collected"), "expected_but_disappeared_mask": c("gone"),
        "topology_coverage": zero("topology"), "candidate_count_log": F.log1p("candidates"), "missing_metric_modality": known == 0, "missing_trace_modality": 1 - c("collected"),
    }
    return {name: values[name] for name in FEATURES}
