"""Facts about the services of incidents in one long table, and the checks that rules over it propose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.operators import spans as S

KEY = ["incident_id", "service"]
#: What is proposed, the kind of fact it is about, and when.
RULES = {
    "CHECK_METRIC_COVERAGE": ("metric", "samples = 0 OR coverage < 0.8"),
    "CHECK_METRIC_DEVIATION": ("metric", "residual_p90 >= 3"),
    "CHECK_TRACE_AVAILABILITY": ("traces", "state <> 'OBSERVED'"),
    "INSPECT_ERROR_TRACES": ("traces", "state = 'OBSERVED' AND errors > 0"),
    "CHECK_CANDIDATE_INVENTORY": ("dependencies", "external > 0"),
}
EXAMPLES = 3
_EXAMPLE = "array<struct<trace_id: string, span_id: string, start_us: bigint, duration_us: bigint, error: boolean>>"
_EDGE = "array<struct<source: string, target: string, calls: bigint>>"
#: A fact's own columns; those of other kinds are null.
VALUES = {"family": "string", "samples": "bigint", "least": "double", "median": "double", "largest": "double", "coverage": "double", "expected": "double", "residual_p90": "double", "spans": "bigint", "errors": "bigint", "examples": _EXAMPLE, "edges": _EDGE, "external": "bigint"}


def _fact(df: DataFrame, kind: str) -> DataFrame:
    own = {c: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in VALUES.items()}
    return df.select(*KEY, F.lit(kind).alias("kind"), "state", *own.values())


def metric_facts(points: DataFrame, baseline: DataFrame, services: DataFrame, windows: DataFrame, families: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """A fact for each service and family: samples in the window, their least, median and largest value, and the 90 % quantile of
    their distance from what the baseline (keys, family, slope, intercept, residual_median, residual_iqr, samples) foresees at the
    window's load, in its scale; MISSING without samples, no comparison without a baseline."""
    grid = services.select(*KEY).distinct().withColumn("family", F.explode(F.array(*map(F.lit, families)))).join(windows, "incident_id")
    at = [*KEY, "family"]
    p = points.select(*at, "ts", "value").join(windows, "incident_id").filter(F.col("ts").between(F.col("start"), F.col("end")))
    b = baseline.filter("samples > 0").select(*at, "slope", "intercept", "residual_median", "residual_iqr")
    foreseen = F.col("intercept") + F.col("slope") * F.col("load") + F.coalesce("residual_median", F.lit(0.0))
    away = F.abs(F.col("value") - foreseen) / F.col("residual_iqr")
    g = p.join(b, at, "left").groupBy(*at).agg(F.count("value").alias("samples"), F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("largest"), F.max(foreseen).alias("expected"), F.percentile(away, 0.9).alias("residual_p90"))
    j = grid.join(g, at, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    j = j.join(coverage.select(*at, "coverage"), at, "left") if coverage is not None else j
    return _fact(j.withColumn("state", F.when(F.col("samples") > 0, "OBSERVED").otherwise("MISSING")), "metric")


def _in_window(spans: DataFrame, windows: DataFrame) -> DataFrame:
    w = windows.select("incident_id", (F.col("start") * 1_000_000).alias("__a"), (F.col("end") * 1_000_000).alias("__b"))
    return spans.join(w, "incident_id").filter(F.col("start_us").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def trace_facts(spans: DataFrame, services: DataFrame, windows: DataFrame, identity: str = "^[0-9A-Za-z-]{1,64}$") -> DataFrame:
    """A fact for each service: spans and failed spans that start in the window, and three examples, failed ones first, then the
    longest. Only ids, times and the outcome are shown, of spans whose ids have the given form. UNAVAILABLE where the incident's
    window says that no traces were collected, else NOT_OBSERVED without spans.

    Examples are chosen in 64 parts of a service's spans first, so that no task sorts all of them."""
    local = _in_window(spans, windows).join(services.select(*KEY).distinct(), KEY, "left_semi")
    failed = F.coalesce("error", F.lit(False))
    counts = local.groupBy(*KEY).agg(F.count("*").alias("spans"), F.count_if(failed).alias("errors"))
    shown = local.filter(F.col("trace_id").rlike(identity) & F.col("span_id").rlike(identity)).withColumn("__part", F.pmod(F.xxhash64("trace_id", "span_id"), F.lit(64)))
    order = [failed.desc(), F.col("duration_us").desc(), F.col("span_id"), F.col("trace_id")]
    for keys in ([*KEY, "__part"], KEY):
        shown = shown.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__k") <= EXAMPLES)
    one = F.struct("trace_id", "span_id", "start_us", "duration_us", failed.alias("error"))
    best = shown.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", one.alias("x")))), lambda s: s["x"]).alias("examples"))
    j = services.select(*KEY).distinct().join(windows.select("incident_id", "traces_collected"), "incident_id").join(counts, KEY, "left").join(best, KEY, "left")
    state = F.when(~F.coalesce("traces_collected", F.lit(True)), "UNAVAILABLE").when(F.col("spans") > 0, "OBSERVED").otherwise("NOT_OBSERVED")
    return _fact(j.withColumns({"state": state, "spans": F.coalesce("spans", F.lit(0)), "errors": F.coalesce("errors", F.lit(0)), "examples": F.coalesce("examples", F.expr(f"CAST(array() AS {_EXAMPLE})"))}), "traces")


def dependency_facts(spans: DataFrame, services: DataFrame, windows: DataFrame) -> DataFrame:
    """A fact for each service: calls between it and other candidates whose callee starts in the window, and how many calls it has
    with services that are no candidates."""
    keys = S.trace_keys(spans)[::-1]
    up = spans.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("span_id").alias("__s"), F.col("service").alias("parent_service"))
    # callees of the window first, so only these are sorted
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k != "trace_id" else F.col(k) == F.col("__trace_id") for k in keys]
    linked = _in_window(spans, windows).join(up, [*same, F.col("parent_span_id") == F.col("__s")])
    e = linked.groupBy("incident_id", F.col("parent_service").alias("source"), F.col("service").alias("target")).agg(F.count("*").alias("calls")).filter("source <> target")
    known = lambda c: services.select("incident_id", F.col("service").alias(c)).distinct().withColumn(f"__{c}", F.lit(True))
    e = e.join(known("source"), ["incident_id", "source"], "left").join(known("target"), ["incident_id", "target"], "left")
    ends = F.explode(F.array(F.struct(F.col("source").alias("service"), F.col("__source").alias("own")), F.struct(F.col("target").alias("service"), F.col("__target").alias("own"))))
    both = F.col("__source").isNotNull() & F.col("__target").isNotNull()
    g = e.select("incident_id", "source", "target", "calls", both.alias("both"), ends.alias("x")).filter("x.own").groupBy("incident_id", F.col("x.service").alias("service")).agg(
        F.sort_array(F.collect_list(F.when(F.col("both"), F.struct("source", "target", "calls")))).alias("edges"), F.coalesce(F.sum(F.when(~F.col("both"), F.col("calls"))), F.lit(0)).alias("external"),
    )
    seen = _in_window(spans, windows).groupBy(*KEY).agg(F.lit(True).alias("__seen"))
    j = services.select(*KEY).distinct().join(windows.select("incident_id", "traces_collected"), "incident_id").join(g, KEY, "left").join(seen, KEY, "left")
    state = F.when(~F.coalesce("traces_collected", F.lit(True)), "UNAVAILABLE").when(F.col("__seen"), "OBSERVED").otherwise("NOT_OBSERVED")
    return _fact(j.withColumns({"state": state, "edges": F.coalesce("edges", F.expr(f"CAST(array() AS {_EDGE})")), "external": F.coalesce("external", F.lit(0))}), "dependencies")


def catalog(points: DataFrame, baseline: DataFrame, spans: DataFrame, services: DataFrame, windows: DataFrame, families: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """All facts, each with an id that its contents give: id, incident_id, service, kind, state and the columns of VALUES.

    services: incident_id, service (the candidates); windows: incident_id, start, end (seconds), load, traces_collected, one row
    an incident. Nothing outside the windows or the candidates counts, but calls with other services as `external`.
    """
    every = metric_facts(points, baseline, services, windows, families, coverage).unionByName(trace_facts(spans, services, windows)).unionByName(dependency_facts(spans, services, windows))
    content = F.to_json(F.struct(*every.columns), {"ignoreNullFields": "false"})
    return every.select(F.concat(F.lit("obs-"), F.substring(F.sha2(content, 256), 1, 32)).alias("id"), "*")


def checks(facts: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """(incident_id, service, code, evidence, status): what each rule proposes to look at, with the fact that made it do so. A rule
    is a kind of fact and a condition over its columns; a condition that is null proposes nothing."""
    fired = F.array_compact(F.array(*(F.when((F.col("kind") == kind) & F.expr(f"coalesce({condition}, false)"), F.lit(code)) for code, (kind, condition) in rules.items())))
    return facts.select(*KEY, F.explode(fired).alias("code"), F.col("id").alias("evidence"), F.lit("PROPOSED_NOT_EXECUTED").alias("status"))
