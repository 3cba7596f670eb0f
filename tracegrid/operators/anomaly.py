"""Healthy baselines and deviations of operations and services: both detectors, as windows and two-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.functions.lineage import cut

OPERATION = ["incident_id", "service", "operation"]
ORDER = ["ts_us", "sample_id"]
#: Fixed values of the first detector.
KEEP_BASELINE, KEEP_CURRENT, LEAST_BASELINE, LEAST_CURRENT = 1000, 20, 30, 10
LATENCY_Z, ERROR_Z, LEAST_SCALE = 3.5, 3.0, 0.1
#: Fixed values of the second detector: window lengths and the slack of its cumulative sum.
SCALES, SLACK = (5, 10, 20), 0.5


def last_n(df: DataFrame, keys: list[str], n: int, order: list[str] = ORDER) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def latency_stats(obs: DataFrame, keys: list[str] = OPERATION) -> DataFrame:
    """keys, samples, errors, median and nearest-rank 95 % of the latency, median, MAD and scale of log1p latency."""
    x = obs.withColumn("__log", F.log1p("latency_ms"))
    a = x.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if("failed").alias("errors"), F.percentile("latency_ms", 0.5).alias("median_ms"))
    p95 = stats.nearest_rank(x, keys, "latency_ms", 0.95, "p95_ms")
    log = stats.robust_stats(x, keys, "__log", LEAST_SCALE).withColumnsRenamed({"median": "log_median", "mad": "log_mad"})
    return a.join(p95, keys).join(log, keys).withColumn("error_rate", stats.smoothed_rate("errors", "samples"))


def baseline(obs: DataFrame, keys: list[str] = OPERATION) -> DataFrame:
    """latency_stats() of the last 1000 baseline samples, which are written once, and whether they are enough."""
    last = last_n(obs.filter("phase = 'baseline'"), keys, KEEP_BASELINE).select(*keys, "latency_ms", "failed")
    b = latency_stats(cut(last), keys)
    return b.withColumn("sufficient", F.col("samples") >= LEAST_BASELINE)


def current(obs: DataFrame, keys: list[str] = OPERATION) -> DataFrame:
    """Samples, errors and log1p median of the last 20 current samples."""
    c = last_n(obs.filter("phase = 'current'"), keys, KEEP_CURRENT).withColumn("__log", F.log1p("latency_ms"))
    return c.groupBy(*keys).agg(F.count("*").alias("current_samples"), F.count_if("failed").alias("current_errors"), F.percentile("__log", 0.5).alias("current_log"))


def operation_anomalies(obs: DataFrame, keys: list[str] = OPERATION, latency_z: float = LATENCY_Z, error_z: float = ERROR_Z) -> DataFrame:
    """Each operation's state, z scores, flags and severity; operations of either phase appear."""
    j = baseline(obs, keys).join(current(obs, keys), keys, "full")
    enough, fresh = F.coalesce("sufficient", F.lit(False)), F.coalesce("current_samples", F.lit(0)) >= LEAST_CURRENT
    state = F.when(~enough, "insufficient_baseline").when(~fresh, "insufficient_current_data").otherwise("ready")
    ready = F.col("state") == "ready"
    lz = F.greatest(F.lit(0.0), (F.col("current_log") - F.col("log_median")) / F.col("scale"))
    ez = stats.two_proportion_z("errors", "samples", "current_errors", "current_samples")
    out = j.withColumn("state", state).withColumn("latency_z", F.when(ready, lz).otherwise(0.0)).withColumn("error_z", F.when(ready, ez).otherwise(0.0))
    out = out.withColumn("latency_anomalous", F.col("latency_z") >= latency_z).withColumn("error_anomalous", F.col("error_z") >= error_z)
    return out.withColumn("severity", F.greatest(F.col("latency_z") / latency_z, F.col("error_z") / error_z))


def service_anomalies(operations: DataFrame) -> DataFrame:
    """The worst of each service's operations."""
    return operations.groupBy("incident_id", "service").agg(F.max("severity").alias("severity"), F.bool_or(F.col("latency_anomalous") | F.col("error_anomalous")).alias("anomalous"), F.bool_or(F.col("state") == "ready").alias("ready"), F.count("*").alias("operations"))


def residuals(obs: DataFrame, keys: list[str] = OPERATION) -> DataFrame:
    """Current samples in order: idx from 0, residual = max(0, (log1p latency - baseline median) / scale), failed."""
    b = baseline(obs, keys).select(*(F.col(k).alias(f"__{k}") for k in keys), "log_median", "scale", F.col("samples").alias("base_samples"), F.col("errors").alias("base_errors"))
    c = obs.filter("phase = 'current'").join(b, [F.col(k) == F.col(f"__{k}") for k in keys]).drop(*(f"__{k}" for k in keys))
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    r = F.greatest(F.lit(0.0), (F.log1p("latency_ms") - F.col("log_median")) / F.col("scale"))
    return c.withColumn("residual", r).withColumn("idx", F.row_number().over(w) - 1)


def sliding_quantile(df: DataFrame, keys: list[str], order: str | list[str], value: str, wide: int, q: float) -> Column:
    """Quantile over the last `wide` rows, null until there are so many."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.when(F.row_number().over(w) >= wide, F.percentile(value, q).over(w.rowsBetween(1 - wide, 0)))


def array_quantile(a: Column, q: float) -> Column:
    """percentile(q) of the elements of a sorted array without nulls: interpolated; null of nothing."""
    at = (F.size(a) - 1) * F.lit(q)
    low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


CHANNELS = [f"{k}_{n}" for n in SCALES for k in ("loc", "tail", "err")]


def rolling_features(res: DataFrame, keys: list[str] = OPERATION, order: str | list[str] = "idx") -> DataFrame:
    """Adds for each window length, where the window is full: the median and the 90 % quantile of the window's residuals (which
    residuals() never leaves null), and the z of its known failures against the baseline's. The residuals of the longest window
    are gathered in a row's array, and sorted once for each length."""
    w = Window.partitionBy(*keys).orderBy(order)
    known, bad = F.col("failed").isNotNull().cast("int"), F.coalesce(F.col("failed").cast("int"), F.lit(0))
    frames = {f"__{c}_{n}": F.sum(x).over(w.rowsBetween(1 - n, 0)) for n in SCALES for c, x in (("k", known), ("b", bad))}
    out = res.withColumns({"__last": F.collect_list("residual").over(w.rowsBetween(1 - max(SCALES), 0)), **frames})
    for n in SCALES:
        full = F.size("__last") >= n
        out = out.withColumn("__s", F.when(full, F.sort_array(F.slice("__last", -n, n))))
        z = stats.two_proportion_z("base_errors", "base_samples", f"__b_{n}", f"__k_{n}")
        out = out.withColumns({f"loc_{n}": array_quantile(F.col("__s"), 0.5), f"tail_{n}": array_quantile(F.col("__s"), 0.9), f"err_{n}": F.when(full & (F.col(f"__k_{n}") > 0), z)}).drop("__s")
    return out.drop("__last", *frames)


def scale_features(res: DataFrame, keys: list[str] = OPERATION) -> DataFrame:
    """For each window length the largest of each of rolling_features()."""
    return rolling_features(res, keys).groupBy(*keys).agg(*(F.max(c).alias(c) for c in CHANNELS))


def cusum_peak(res: DataFrame, keys: list[str] = OPERATION, slack: float = SLACK) -> DataFrame:
    return stats.cusum(res, keys, "idx", "residual", slack).groupBy(*keys).agg(F.max("cusum").alias("cusum"))


def verdicts(obs: DataFrame, keys: list[str] = OPERATION, location: float = 2.0, tail: float = 4.0, error: float = 3.0, cusum: float = 8.0) -> DataFrame:
    """The second detector for each operation: channels over their thresholds, the largest as score, its name (of equal
    ones the last by name), whether it fires, and persistence and longest run of residuals above `location`. The onset is the
    first place at which any channel reaches its threshold, also as a fraction of the last place. obs is read twice; the current
    samples are shuffled and sorted once."""
    res = residuals(obs, keys).select(*keys, *ORDER, "failed", "residual", "idx", "base_samples", "base_errors")
    limits = {"loc": location, "tail": tail, "err": error}
    channels = [F.struct((F.coalesce(F.col(f"{k}_{n}"), F.lit(0.0)) / limits[k]).alias("v"), F.lit(f"{k}_{n}").alias("name")) for k in limits for n in SCALES]
    channels.append(F.struct((F.col("cusum") / cusum).alias("v"), F.lit("cusum").alias("name")))
    best = F.array_max(F.array(*channels))
    rows = stats.cusum(rolling_features(res, keys, ORDER), keys, ORDER, "residual", SLACK).withColumn("__on", F.col("residual") >= location)
    # in a run: how far the last place that is not in it lies back
    off = F.max(F.when(F.col("__on"), None).otherwise(F.col("idx"))).over(Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__run", F.col("idx") - F.coalesce(off, F.lit(-1)))
    reached = F.greatest(*(F.coalesce(F.col(f"{k}_{n}") / limits[k], F.lit(0.0)) for k in limits for n in SCALES), F.col("cusum") / cusum) >= 1
    f = rows.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in [*CHANNELS, "cusum"]), F.count("*").alias("n"), F.min(F.when(reached, F.col("idx"))).alias("onset"), F.avg(F.col("__on").cast("int")).alias("persistence"), F.max("base_samples").alias("base_samples"),
        F.max("__run").cast("long").alias("longest_run"),
    )
    out = f.withColumn("__best", best)
    fit = (F.col("base_samples") >= LEAST_BASELINE) & (F.col("n") >= LEAST_CURRENT)
    return out.select(*keys, "n", F.when(fit, F.col("__best.v")).otherwise(0.0).alias("score"), F.col("__best.name").alias("channel"), (fit & (F.col("__best.v") >= 1)).alias("anomalous"), "onset", (F.col("onset") / F.greatest(F.lit(1), F.col("n") - 1)).alias("onset_fraction"), "persistence", "longest_run")


def service_winner(verdict: DataFrame) -> DataFrame:
    """Each service's operation of the highest score, of equal ones the last by name."""
    return verdict.groupBy("incident_id", "service").agg(F.max(F.struct("score", "operation")).alias("__m"), F.bool_or("anomalous").alias("anomalous")).select("incident_id", "service", "anomalous", F.col("__m.score").alias("score"), F.col("__m.operation").alias("operation"))


def grid(features: DataFrame, configs: DataFrame, truth: str = "truth") -> DataFrame:
    """Recall and false-positive rate of each config (config, location, tail, error, cusum, channels) over records that carry
    scale_features(), cusum and a truth column; configs are a bounded list, joined with every record at once."""
    c = F.broadcast(configs)  # a grid of settings, tens of rows
    j = features.crossJoin(c)
    parts = [F.coalesce(F.col(f"{k}_{n}"), F.lit(0.0)) / F.col(k2) for k, k2 in (("loc", "location"), ("tail", "tail"), ("err", "error")) for n in SCALES]
    hit = F.greatest(*parts, F.col("cusum") / F.col("limit")) >= 1
    return j.withColumn("__hit", hit).groupBy("config", "complexity").agg((F.count_if(F.col("__hit") & F.col(truth)) / F.nullif(F.count_if(truth), F.lit(0))).alias("recall"), (F.count_if(F.col("__hit") & ~F.col(truth)) / F.nullif(F.count_if(~F.col(truth)), F.lit(0))).alias("fpr"))


def window_detection(spans: DataFrame) -> DataFrame:
    """Both phases of a trace table through the second detector: server spans become observations, which are written once."""
    o = spans.filter("kind = 'SERVER'").select("incident_id", F.xxhash64("trace_id", "span_id").alias("sample_id"), "service", "operation", F.col("start_us").alias("ts_us"), (F.col("duration_us") / 1000).alias("latency_ms"), F.col("error").alias("failed"), "phase")
    return service_winner(verdicts(cut(o)))
