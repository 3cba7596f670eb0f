"""Around an incident: names and aliases, candidate universes, labels and detection, guards of splits, cyclic traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.functions.lineage import cut
from tracegrid.operators.metrics import infrastructure, normalized, service_key

INCIDENT = ["incident_id"]
# Roles of data that no model may be chosen by.
LOCKED = ("USED_TEST_READONLY", "USED_TEST", "LOCKED_NEW_TEST")
# Actions of a container and the events that they are.
ACTIONS = {"oom": "oom", "die": "exit", "start": "start", "restart": "restart"}
# Where a rate of requests comes from.
SOURCES = ("profile_constant", "measured_interval_mean")


# ---- names ---------------------------------------------------------------------------------------------------------------


def root_name(value: Column, dataset: Column) -> Column:
    """A labelled root in small letters with dashes; one family of datasets calls its front end otherwise."""
    name = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    return F.when(dataset.endswith("-OB") & (name == "frontend"), "frontendservice").otherwise(name)


def aliased(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """The column's labels as services. aliases: label (once each), service; rows of labels with a null service are dropped.
    Labels without an alias become null with `unmapped` true."""
    a = aliases.select(F.col("label").alias(column), F.col("service").alias("__service"), F.lit(True).alias("__known"))
    j = df.join(a, column, "left").filter("__known is null or __service is not null")
    return j.withColumn(column, F.col("__service")).withColumn("unmapped", F.col("__known").isNull()).drop("__service", "__known")


def entity_services(entities: DataFrame, observed: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """keys, entity and its service in both ways, strict and resolved: the only observed service with the entity's key.
    Infrastructure has none. Without exactly one, strict is null unless nothing at all is observed; resolved is the normalised
    entity. entities: keys, entity; observed: keys, service."""
    o = observed.select(*keys, "service").distinct()
    one = o.withColumn("__key", service_key(F.col("service"))).groupBy(*keys, "__key").agg(F.count("*").alias("__n"), F.min("service").alias("__only"))
    some = o.select(*keys).distinct().withColumn("__some", F.lit(True))
    e = entities.select(*keys, "entity").distinct().withColumn("__key", service_key(F.col("entity")))
    j = e.join(one, [*keys, "__key"], "left").join(some, keys, "left")
    service = lambda free: F.when(infrastructure(F.col("entity")), None).when(F.col("__n") == 1, F.col("__only")).when(free, normalized(F.col("entity")))
    return j.select(*keys, "entity", service(F.col("__some").isNull()).alias("strict"), service(F.lit(True)).alias("resolved"))


def matched_entities(entities: DataFrame, observed: DataFrame, resolve: bool = False, keys: list[str] = INCIDENT) -> DataFrame:
    """keys, entity, service: entity_services() in one of its ways."""
    return entity_services(entities, observed, keys).select(*keys, "entity", F.col("resolved" if resolve else "strict").alias("service"))


def candidate_universe(metrics: DataFrame, traces: DataFrame, topology: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """keys, service, has_metrics, has_traces, has_topology: services with metrics or traces; topology only marks them."""
    at = [*keys, "service"]
    side = lambda df, name: df.filter("service is not null").select(*at).distinct().withColumn(name, F.lit(True))
    j = side(metrics, "has_metrics").join(side(traces, "has_traces"), at, "full").join(side(topology, "has_topology"), at, "left")
    return j.select(*at, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_metrics", "has_traces", "has_topology")))


def subset(df: DataFrame, ids: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """Rows of the listed incidents."""
    return df.join(ids.select(*keys), keys, "left_semi")


def paired(challenger: DataFrame, baseline: DataFrame, truth: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """All incidents of the three with challenger_*, baseline_* and truth_* columns and `complete`, false where one lacks it: a
    comparison is fair only if every row is complete."""

    def side(df, name):
        return df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys), F.lit(True).alias(f"__{name}"))

    j = side(challenger, "challenger").join(side(baseline, "baseline"), keys, "full").join(side(truth, "truth"), keys, "full")
    marks = ["__challenger", "__baseline", "__truth"]
    return j.withColumn("complete", F.col(marks[0]).isNotNull() & F.col(marks[1]).isNotNull() & F.col(marks[2]).isNotNull()).drop(*marks)


def applicability(healthy: tuple[Column, Column], window: tuple[Column, Column], reference: tuple[Column, Column], current: tuple[Column, Column], sources: tuple[str, ...] = SOURCES) -> dict[str, Column]:
    """Columns that say whether a healthy period may serve as the reference of a window: temporal_relation (both ends
    included), rps_ratio, load_relation and reasons. reference and current are (requests per second, source); a reference
    without a rate or of an unknown source is none."""
    (a, b), (start, end) = healthy, window
    rate = lambda c: F.when(stats.finite(c) & (c > 0), c)
    known = lambda c: F.when(c.isin(*sources), c).otherwise("unknown")
    temporal = F.when(~F.coalesce(stats.finite(a) & stats.finite(b) & (a < b), F.lit(False)), "UNKNOWN").when(b < start, "PRECEDES").when(a > end, "AFTER").otherwise("OVERLAPS")
    r_source = F.when(rate(reference[0]).isNull(), "unknown").otherwise(known(reference[1]))
    r_rate, c_rate, c_source = F.when(r_source != "unknown", rate(reference[0])), rate(current[0]), known(current[1])
    same = F.abs(c_rate - r_rate) <= 1e-12 * F.greatest(c_rate, r_rate)
    load = F.when(c_rate.isNull() | r_rate.isNull(), "UNKNOWN").when(same, "SAME_REFERENCE_RPS").otherwise("DIFFERENT_REFERENCE_RPS")
    reasons = F.array_compact(F.array(
        F.when(temporal != "PRECEDES", F.concat(F.lit("HEALTHY_PERIOD_"), temporal)),
        F.when(r_source == "unknown", "REFERENCE_LOAD_UNKNOWN").when(r_source == "profile_constant", "REFERENCE_LOAD_CONFIGURED_NOT_MEASURED"),
        F.when(c_source == "unknown", "CURRENT_LOAD_SOURCE_UNKNOWN").when(c_source == "profile_constant", "CURRENT_LOAD_CONFIGURED_NOT_MEASURED"),
        F.when(load == "DIFFERENT_REFERENCE_RPS", "LOAD_DIFFERS_FROM_SINGLE_REFERENCE"), F.when(c_rate.isNull(), "CURRENT_LOAD_UNKNOWN"),
    ))
    return {"temporal_relation": temporal, "rps_ratio": c_rate / r_rate, "load_relation": load, "reasons": reasons}


def container_events(events: DataFrame, project: str, services: list[str]) -> DataFrame:
    """Life-cycle events of a project's services: id, event, service, instance, time_ns, exit_code; repeats are dropped.

    events: type, project, service, instance, action, time_ns, observed_ns, exit_code (text). Kept are containers with an id of
    64 hex digits, a time that is not after the observation, and a known action or a change of health. Exit codes other than 0
    to 255 are null.
    """
    event = F.when(F.col("action").startswith("health_status: "), "health_change")
    for action, name in ACTIONS.items():
        event = F.when(F.col("action") == action, name).otherwise(event)
    ok = (F.col("type") == "container") & (F.col("project") == project) & F.col("service").isin(*services) & F.col("instance").rlike("^[0-9a-f]{64}$") & (F.col("time_ns") > 0) & (F.col("time_ns") <= F.col("observed_ns"))
    identity = F.sha2(F.format_string('["%s", "%s", %d]', "instance", "action", "time_ns"), 256)
    code = F.when(F.col("exit_code").rlike("^[0-9]{1,9}$"), F.col("exit_code").try_cast("int"))
    kept = events.filter(ok).select(identity.alias("id"), event.alias("event"), "service", "instance", "time_ns", F.when(code <= 255, code).alias("exit_code"))
    return kept.filter("event is not null").groupBy("id", "event", "instance", "time_ns").agg(F.min("service").alias("service"), F.min("exit_code").alias("exit_code"))


# ---- labels and detection ------------------------------------------------------------------------------------------------------


def enriched_labels(labels: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Labels (incident_id, incident_type, root_service) with detected, detection_miss, root_ready, ready_group_size,
    localization_eligible, training_eligible and trivial_group. snapshots: incident_id, state, ready (array of services); a label
    without one keeps nulls."""
    fault = F.coalesce(F.col("incident_type") == "fault", F.lit(False))
    detected, size = F.col("state") == "ready", F.size(F.coalesce("ready", F.array().cast("array<string>")))
    j = labels.join(snapshots.select("incident_id", "state", "ready", F.lit(True).alias("__found")), "incident_id", "left")
    root = fault & F.coalesce(F.array_contains("ready", F.col("root_service")), F.lit(False))
    flags = {"detected": detected, "detection_miss": fault & ~detected, "root_ready": root, "ready_group_size": size, "localization_eligible": detected & root, "training_eligible": detected & root & (size >= 2), "trivial_group": detected & root & (size == 1)}
    return j.select(*labels.columns, *(F.when(F.col("__found"), v).alias(k) for k, v in flags.items()))


def detection_misses(labels: DataFrame, operations: DataFrame, least: int = 10, latency_z: float = 3.5, error_z: float = 3.0) -> DataFrame:
    """Undetected faults with the reason: too few samples of the root, its own operations above a threshold (so propagation was
    not detected), or all below. operations: incident_id, service, current_samples, latency_z, error_z."""
    o = operations.groupBy("incident_id", F.col("service").alias("root_service")).agg(F.max("current_samples").alias("__n"), F.bool_or((F.col("latency_z") >= latency_z) | (F.col("error_z") >= error_z)).alias("__hot"), F.count("*").alias("root_operations"))
    j = labels.filter("incident_type = 'fault' and not detected").join(o, ["incident_id", "root_service"], "left")
    reason = F.when(F.coalesce("__n", F.lit(0)) < least, "insufficient_data").when(F.col("__hot"), "propagation_not_detected").otherwise("below_threshold")
    return j.select("incident_id", "root_service", reason.alias("reason"), F.coalesce("root_operations", F.lit(0)).alias("root_operations"))


def false_positives(labels: DataFrame, operations: DataFrame) -> DataFrame:
    """Healthy incidents that were detected, with their operations."""
    healthy = labels.filter("incident_type <> 'fault' and detected").select("incident_id")
    return healthy.join(operations, "incident_id", "left")


def detection_summary(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, faults, healthy, recall, share of faults with a ready root, eligible and training shares, false positives among the
    healthy, and the share of faults that are detected, have a ready root and rank it first (truth_rank = 1)."""
    fault = F.col("incident_type") == "fault"
    n, m = F.count_if(fault), F.count_if(~fault)
    share = lambda c: F.count_if(fault & c) / F.greatest(F.lit(1), n)
    return cases.groupBy(*(keys or [])).agg(
        n.alias("faults"), m.alias("healthy"), share(F.col("detected")).alias("recall"), share(F.col("root_ready")).alias("root_ready_coverage"),
        share(F.col("localization_eligible")).alias("eligible_rate"), share(F.col("training_eligible")).alias("training_rate"),
        (F.count_if(~fault & F.col("detected")) / F.greatest(F.lit(1), m)).alias("healthy_fpr"), share(F.col("detected") & F.col("root_ready") & (F.col("truth_rank") == 1)).alias("end_to_end_ac1"),
    )


def coverage_summary(cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cases, observable, eligible, recall of candidates, mean candidates, share of entities that match. cases: keys,
    observable, eligible, candidates, entities, matched."""
    total = F.sum("entities")
    return cases.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if("observable").alias("observable"), F.count_if("eligible").alias("eligible"), (F.count_if("observable") / F.count("*")).alias("candidate_recall"), F.avg("candidates").alias("mean_candidates"), F.when(total > 0, F.sum("matched") / total).otherwise(0.0).alias("match_ratio"))


def feature_stability(observations: DataFrame, least: float = 0.6) -> DataFrame:
    """Per feature over folds and seeds: how often it is used, mean gain, share of positive drops under permutation, and whether
    it stays: if both shares reach `least`, or as a feature of structure. observations: feature, used, gain, drop."""
    g = observations.groupBy("feature").agg(F.avg(F.col("used").cast("double")).alias("use_frequency"), F.avg("gain").alias("mean_gain"), F.avg((F.col("drop") > 1e-12).cast("double")).alias("positive_fraction"))
    structural = F.col("feature").endswith("_has") | F.col("feature").startswith("coverage_") | F.col("feature").startswith("topology_")
    return g.withColumn("structural", structural).withColumn("eligible", F.col("structural") | ((F.col("use_frequency") >= least) & (F.col("positive_fraction") >= least)))


def reranker_records(candidates: DataFrame, components: list[str], keys: list[str] = INCIDENT) -> DataFrame:
    """Per candidate: components and support as they are, the percentile of its rank, its score between the least and the largest
    (0.5 if they are equal), and, at rank 1, the margin to the second. candidates: keys, service, rank, score, support_score."""
    w = Window.partitionBy(*keys)
    n, low, high = F.count("*").over(w), F.min("score").over(w), F.max("score").over(w)
    first, second = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w), F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w)
    margin = F.when(n == 1, 1.0).otherwise((first - second) / F.greatest(F.abs(first), F.abs(second), F.lit(1e-9)))
    return candidates.select(
        *keys, "service", *(F.col(c).cast("double").alias(f"component_{c}") for c in components), F.col("support_score").cast("double").alias("support_score"),
        F.when(n == 1, 1.0).otherwise(1 - (F.col("rank") - 1) / (n - 1)).alias("base_rank_percentile"), F.when(high - low <= 1e-12, 0.5).otherwise((F.col("score") - low) / (high - low)).alias("base_relative_score"),
        F.when(F.col("rank") == 1, margin).otherwise(0.0).alias("base_margin"),
    )


# ---- guards ----------------------------------------------------------------------------------------------------------------------


def selection_faults(ids: DataFrame, datasets: DataFrame, roles: DataFrame) -> DataFrame:
    """incident_id, reason of incidents that may not take part in the choice of a model: of no registered dataset, or of a used
    or locked one. Empty if all may. datasets: incident_id, dataset; roles: dataset, role."""
    j = ids.select("incident_id").distinct().join(datasets, "incident_id", "left").join(roles, "dataset", "left")
    return j.select("incident_id", F.when(F.col("role").isNull(), "unregistered").when(F.col("role").isin(*LOCKED), "locked").alias("reason")).filter("reason is not null")


def partition_faults(parts: DataFrame, names: list[str], keys: list[str] = INCIDENT) -> DataFrame:
    """keys, reason of incidents in more than one part; and a row without keys for each of the named parts that is empty."""
    shared = parts.groupBy(*keys).agg(F.count_distinct("part").alias("n")).filter("n > 1").select(*keys, F.lit("shared").alias("reason"))
    named = parts.sparkSession.createDataFrame([(n,) for n in names], "part string")
    empty = named.join(parts.select("part").distinct(), "part", "left_anti")
    return shared.unionByName(empty.select(*(F.lit(None).cast(parts.schema[k].dataType).alias(k) for k in keys), F.concat(F.lit("empty "), "part").alias("reason")))


def parent_cycles(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans whose chain of parents never ends.

    Pointers are doubled: after k rounds only spans with 2^k ancestors are left. Each round takes one away as long as a chain ends
    at all, so a round that takes none leaves those that lead to a cycle. Rounds grow with the logarithm of the depth.
    """
    at = cut(spans.filter("parent_span_id <> ''").groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("p")))
    n = at.count()
    while n:
        up = at.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("p").alias("next"))
        at = cut(at.join(up, (F.col("trace_id") == F.col("t")) & (F.col("p") == F.col("s"))).select("trace_id", "span_id", F.col("next").alias("p")))
        left, n = n, at.count()
        if n == left:
            break
    return at.select("trace_id", "span_id")
