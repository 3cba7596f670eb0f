"""Rankings of candidate services: deterministic ranks, the evidence rankers, fusions, re-ranking and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats

INCIDENT = ["incident_id"]
OPERATION = ["incident_id", "service", "operation"]


def ranked(df: DataFrame, score: str | Column, keys: list[str] = INCIDENT, name: str = "rank") -> DataFrame:
    """Adds the rank 1..n within the keys: by score downwards, then service upwards."""
    s = F.col(score) if isinstance(score, str) else score
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(s.desc(), F.col("service"))).cast("long"))


def evidence_rankings(features: DataFrame) -> DataFrame:
    """Long table (incident_id, ranker, service, score, rank) of the four rankers over candidates.

    features: incident_id, service, candidate, severity, local_strength, primary_strength, f1. max_severity ranks by
    severity, topology_consistency by F1 (then primary strength), local_evidence by local strength, hybrid by F1 * local; at nine
    decimals, so that sums in another order don't change ties.
    """
    c = features.filter("candidate")
    rankers = {"max_severity": ("severity", F.lit(0.0)), "topology_consistency": ("f1", F.col("primary_strength")), "local_evidence": ("local_strength", F.lit(0.0)), "hybrid": (F.col("f1") * F.col("local_strength"), F.lit(0.0))}
    rows = F.array(*(F.struct(F.lit(k).alias("ranker"), (F.col(s) if isinstance(s, str) else s).cast("double").alias("score"), t.cast("double").alias("tie")) for k, (s, t) in rankers.items()))
    long = c.select("incident_id", "service", F.explode(rows).alias("r")).select("incident_id", "service", "r.ranker", *(F.round(f"r.{c}", 9).alias(c) for c in ("score", "tie")))
    w = Window.partitionBy("incident_id", "ranker").orderBy(F.desc("score"), F.desc("tie"), "service")
    return long.withColumn("rank", F.row_number().over(w).cast("long")).drop("tie")


def source_operation(ops: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Each service's operation of the largest value, of equal ones the least name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "operation")
    return ops.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(*keys, "operation", value)


def primary_signal(ops: DataFrame) -> DataFrame:
    """Per incident: error if a ready operation's errors are anomalous, else latency likewise, else none; and the state."""
    ready = F.col("state") == "ready"
    g = ops.groupBy("incident_id").agg(F.bool_or(ready & F.col("error_anomalous")).alias("e"), F.bool_or(ready & F.col("latency_anomalous")).alias("l"), F.bool_or(ready).alias("r"))
    return g.select("incident_id", F.when(F.col("e"), "error").when(F.col("l"), "latency").otherwise("none").alias("signal"), F.when(~F.col("r"), "not_ready").when(F.col("e") | F.col("l"), "ready").otherwise("no_anomaly").alias("state"))


def observed_services(ops: DataFrame) -> DataFrame:
    """Per incident and service: ready (an operation is), and anomalous in the incident's primary signal."""
    ready = F.col("state") == "ready"
    g = ops.groupBy("incident_id", "service").agg(F.bool_or(ready).alias("ready"), F.bool_or(ready & F.col("error_anomalous")).alias("__e"), F.bool_or(ready & F.col("latency_anomalous")).alias("__l"))
    j = g.join(primary_signal(ops).select("incident_id", "signal"), "incident_id")
    on = F.when(F.col("signal") == "error", F.col("__e")).when(F.col("signal") == "latency", F.col("__l")).otherwise(False)
    return j.select("incident_id", "service", "signal", "ready", on.alias("anomalous"))


def service_features(ops: DataFrame, fits: DataFrame, evidence: DataFrame, latency_threshold: float, error_threshold: float) -> DataFrame:
    """Per incident and service: strengths of its worst ready operations, whether it is a candidate (anomalous in the primary
    signal), and how well the services that it affects match those observed.

    fits: incident_id, candidate, f1. evidence: incident_id, service, operation, coverage, median_exclusive_ratio
    (spans.operation_evidence). The local strength is that of the errors or, if latency is the signal, the largest product of an
    operation's latency strength, median exclusive ratio and trace coverage, which is 0 without traces.
    """
    seen = observed_services(ops).withColumnRenamed("anomalous", "candidate")
    e = evidence.select(*OPERATION, (F.col("coverage") * F.col("median_exclusive_ratio")).alias("__own"))
    z = lambda c: F.when(F.col("state") == "ready", F.col(c)).otherwise(0.0)
    traced = stats.bounded_strength(z("latency_z"), latency_threshold) * F.coalesce("__own", F.lit(0.0))
    g = ops.join(e, OPERATION, "left").groupBy("incident_id", "service").agg(F.max(z("severity")).alias("severity"), F.max(z("latency_z")).alias("__lz"), F.max(z("error_z")).alias("__ez"), F.max(traced).alias("__traced"))
    ls, es = stats.bounded_strength("__lz", latency_threshold), stats.bounded_strength("__ez", error_threshold)
    j = g.join(seen, ["incident_id", "service"]).join(fits.select("incident_id", F.col("candidate").alias("service"), "f1"), ["incident_id", "service"], "left")
    by = lambda error, latency: F.when(F.col("signal") == "error", error).when(F.col("signal") == "latency", latency).otherwise(0.0)
    return j.select("incident_id", "service", "severity", "candidate", by(es, ls).alias("primary_strength"), by(es, F.col("__traced")).alias("local_strength"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def rank_percentile(rank: str, keys: list[str] = INCIDENT) -> Column:
    """1 - (r - 1) / (n - 1); 1 for a single candidate."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(n > 1, 1 - (F.col(rank) - 1) / (n - 1)).otherwise(1.0)


def relative_score(score: str, keys: list[str] = INCIDENT) -> Column:
    """(x - min) / (max - min); 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.5)


def margin(score: str, keys: list[str] = INCIDENT) -> Column:
    """(best - second) / max(|best|, 1e-9); 1 for a single candidate."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "service").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, second = F.first(score).over(w), F.nth_value(score, 2).over(w)
    return F.when(second.isNull(), 1.0).otherwise((top - second) / F.greatest(F.abs(top), F.lit(1e-9)))


def rank_average(df: DataFrame, ranks: list[str], keys: list[str] = INCIDENT) -> DataFrame:
    """Mean of the rank percentiles of several rankings, and the rank by it."""
    mean = sum((rank_percentile(r, keys) for r in ranks[1:]), rank_percentile(ranks[0], keys)) / len(ranks)
    return ranked(df.withColumn("fused", mean), "fused", keys, "fused_rank")


def reciprocal(df: DataFrame, ranks: list[str], k: float = 60.0, keys: list[str] = INCIDENT) -> DataFrame:
    """Sum of 1 / (k + rank), and the rank by it."""
    total = sum((1 / (k + F.col(r)) for r in ranks[1:]), 1 / (k + F.col(ranks[0])))
    return ranked(df.withColumn("rrf", total), "rrf", keys, "rrf_rank")


def expert_features(df: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """Meta features of two experts (score_a, rank_a, score_b, rank_b): percentiles, relative scores, disagreement, margins,
    shared first place."""
    w = Window.partitionBy(*keys)
    out = df.withColumns({"pct_a": rank_percentile("rank_a", keys), "pct_b": rank_percentile("rank_b", keys), "rel_a": relative_score("score_a", keys), "rel_b": relative_score("score_b", keys), "margin_a": margin("score_a", keys), "margin_b": margin("score_b", keys)})
    same = F.max(((F.col("rank_a") == 1) & (F.col("rank_b") == 1)).cast("int")).over(w)
    return out.withColumns({"disagreement": F.abs(F.col("pct_a") - F.col("pct_b")), "best_pct": F.greatest("pct_a", "pct_b"), "mean_pct": (F.col("pct_a") + F.col("pct_b")) / 2, "same_top": same, "candidates": F.count("*").over(w)})


def rerank_top(df: DataFrame, k: int, second: str, rank: str = "rank", keys: list[str] = INCIDENT) -> DataFrame:
    """Re-order the first k by a second score (ties: rank, service); who is among them, and the rest, stay."""
    top = F.col(rank) <= k
    w = Window.partitionBy(*keys).orderBy(F.when(top, 0).otherwise(1), F.when(top, -F.col(second)), F.col(rank), F.col("service"))
    return df.withColumn("new_rank", F.row_number().over(w).cast("long"))


def support_profile(df: DataFrame, components: list[str], keys: list[str] = INCIDENT) -> DataFrame:
    """For each component the lead over the best other candidate, and the mean lead as support. The best other one is the
    second if the row itself is the best, else the best."""
    out = df
    for c in components:
        w = Window.partitionBy(*keys).orderBy(F.desc(c), "service").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, second = F.first(F.struct(F.col(c).alias("v"), F.col("service").alias("s"))).over(w), F.nth_value(c, 2).over(w)
        other = F.when(first["s"] == F.col("service"), F.coalesce(second, F.lit(0.0))).otherwise(first["v"])
        out = out.withColumn(f"{c}_lead", F.col(c) - other)
    return out.withColumn("support", sum((F.col(f"{c}_lead") for c in components[1:]), F.col(f"{components[0]}_lead")) / len(components))


def early_deviation(df: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """Observed ones first, then the earliest first deviation, the largest shift, the name."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("first_fraction").isNull(), 1).otherwise(0), "first_fraction", F.desc("shift"), "service")
    return df.withColumn("rank", F.row_number().over(w).cast("long"))


def pseudo_random(df: DataFrame, seed: int, keys: list[str] = INCIDENT) -> DataFrame:
    """A ranking by a hash of seed, incident and service: the same on every run."""
    return ranked(df.withColumn("random_score", stats.hash_fraction(F.lit(str(seed)), F.col("incident_id"), F.col("service"))), "random_score", keys)


def soft_heuristics(df: DataFrame, groups: dict[str, list[str]], keys: list[str] = INCIDENT) -> DataFrame:
    """Long rankings: for each name, the mean of some columns' tied percentiles within the incident."""
    rows = []
    out = df
    for name, columns in groups.items():
        out = out.withColumn(f"__{name}", sum((stats.tied_percentile(keys, c) for c in columns[1:]), stats.tied_percentile(keys, columns[0])) / len(columns))
        rows.append(F.struct(F.lit(name).alias("ranker"), F.round(f"__{name}", 9).alias("score")))
    long = out.select(*keys, "service", F.explode(F.array(*rows)).alias("r")).select(*keys, "service", "r.*")
    return ranked(long, "score", [*keys, "ranker"])


def column_ranking(native: DataFrame, keys: list[str] = INCIDENT) -> DataFrame:
    """From a ranking of metric columns to one of services: the part before the first '_', without '-db'; the first place of
    each service counts. native: keys, column, position."""
    service = F.regexp_replace(F.split("column", "_")[0], "-db$", "")
    g = native.groupBy(*keys, service.alias("service")).agg(F.min("position").alias("position"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("position", "service")).cast("long"))


def top_examples(df: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Errors first, then the longest, then the id; n of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("error"), F.desc("duration_us"), "trace_id", "span_id")
    return df.withColumn("example", F.row_number().over(w).cast("long")).filter(F.col("example") <= n)


def same_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(incident_id, service, side) of candidates that only one of two experts has; empty if they may be joined."""
    cols = ["incident_id", "service"]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("a")).union(y.exceptAll(x).withColumn("side", F.lit("b")))
