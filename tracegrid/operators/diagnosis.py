"""Deviations of metrics and trace signals from a healthy period, given the load; and observed requests, errors and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.operators.metrics import SERIES, huber_line

# Trace signals of which only a rise counts; of the others (rates of spans and requests) any change does.
RISING = ("error_rate", "latency_median_us", "latency_p90_us", "latency_p99_us", "exclusive_median_us", "downstream_wait_ratio")
# Channels of observed requests.
CHANNELS = ("request_rate", "error_ratio", "latency_p95")


def workload_baseline(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """keys, slope, intercept, residual_median, residual_iqr, samples of healthy points (keys, x the load, value).

    A robust line on x, estimated jointly with its scale, where x varies and there are four points or more, else the median. The scale of residuals is their IQR, at
    least 1 % of their median and of the median value, and 1e-9.
    """
    g = points.groupBy(*keys).agg(F.count("*").alias("samples"), (F.min("x") < F.max("x")).alias("__varies"), F.percentile("value", 0.5).alias("__median"))
    varied = points.join(g.filter("__varies and samples >= 4").select(*keys), keys, "left_semi")
    fit = huber_line(varied.withColumn("y", F.col("value")), keys).drop("sigma") if not varied.isEmpty() else points.select(*keys, F.lit(0.0).alias("slope"), F.lit(0.0).alias("intercept")).limit(0)
    f = g.join(fit, keys, "left").select(*keys, "samples", "__median", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "__median").alias("intercept"))
    res = points.join(f, keys).withColumn("__r", F.col("value") - F.col("intercept") - F.col("slope") * F.col("x"))
    q = res.groupBy(*keys).agg(F.percentile("__r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    scale = F.greatest(F.col("__q")[2] - F.col("__q")[0], 0.01 * F.abs(F.col("__q")[1]), 0.01 * F.abs("__median"), F.lit(1e-9))
    return f.join(q, keys).select(*keys, "slope", "intercept", F.col("__q")[1].alias("residual_median"), scale.alias("residual_iqr"), "samples")


def _residuals(points: DataFrame, baseline: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    predicted = F.col("intercept") + F.col("slope") * F.col("x") + F.col("residual_median")
    return points.join(baseline, keys, how).withColumn("predicted", predicted).withColumn("residual", (F.col("value") - F.col("predicted")) / F.col("residual_iqr"))


def metric_residual_shift(points: DataFrame, baseline: DataFrame, keys: list[str] = SERIES, threshold: float = 3.0, group: list[str] | None = None) -> DataFrame:
    """keys, shift (90 % quantile of the absolute residuals), persistence (share at or above the threshold) of current points (keys,
    x, value) that have a baseline; the others are not available and have no row. group: other columns of the points to have rows
    of, where many (as incidents) share a baseline."""
    a = F.abs("residual")
    return _residuals(points, baseline, keys).groupBy(*(group or keys)).agg(F.percentile(a, 0.9).alias("shift"), F.avg((a >= threshold).cast("double")).alias("persistence"))


def trace_signal_shift(signals: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """signals (keys, signal, x, value) with `shift`: the residual, one-sided for those that only count if they rise; 0 without a
    baseline; and `predicted`, the value at that load, null without one."""
    r = F.col("residual")
    shift = F.when(F.col("signal").isin(*RISING), F.greatest(F.lit(0.0), r)).otherwise(F.abs(r))
    return _residuals(signals, baseline, [*keys, "signal"], "left").select(*signals.columns, F.coalesce(shift, F.lit(0.0)).alias("shift"), "predicted")


def iqr_baseline(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """keys, median, iqr (at least 1 % of the median, and 1e-9), samples."""
    g = points.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("samples"))
    return g.select(*keys, F.col("q")[1].alias("median"), F.greatest(F.col("q")[2] - F.col("q")[0], 0.01 * F.abs(F.col("q")[1]), F.lit(1e-9)).alias("iqr"), "samples")


def iqr_shifts(points: DataFrame, baseline: DataFrame, services: DataFrame, families: list[str], keys: list[str], threshold: float = 3.0) -> DataFrame:
    """keys, service, family for each service (keys, service) and family: has, shift (90 % quantile of |z|), persistence, and the
    percentile of the shift among the services; zeros where there are no points or no baseline."""
    at = [*keys, "service", "family"]
    base = [c for c in at if c in baseline.columns]
    z = F.abs((F.col("value") - F.col("median")) / F.col("iqr"))
    g = points.join(baseline, base).groupBy(*at).agg(F.percentile(z, 0.9).alias("shift"), F.avg((z >= threshold).cast("double")).alias("persistence"))
    grid = services.select(*keys, "service").distinct().withColumn("family", F.explode(F.array(*map(F.lit, families))))
    j = grid.join(g, at, "left").select(*at, F.col("shift").isNotNull().alias("has"), F.coalesce("shift", F.lit(0.0)).alias("shift"), F.coalesce("persistence", F.lit(0.0)).alias("persistence"))
    return j.withColumn("percentile", stats.tied_percentile([*keys, "family"], "shift"))


def restricted_vector(vector: DataFrame, families: list[str], keep: list[str], shift: str) -> DataFrame:
    """A wide vector (has_<family>, <family>_<value>) with the other families' columns set to 0, and the number of families that
    are left, their share of all, the largest shift and the mean of the two largest (column <family>_<shift>)."""
    gone = [f for f in families if f not in keep]
    lost = [c for c in vector.columns if any(c == f"has_{f}" or c.startswith(f"{f}_") for f in gone)]
    v = vector.withColumns({c: F.lit(0).cast(vector.schema[c].dataType) for c in lost})
    there = F.array_compact(F.array(*(F.when(F.col(f"has_{f}") > 0, F.col(f"{f}_{shift}").cast("double")) for f in families)))
    top = F.slice(F.sort_array(there, asc=False), 1, 2)
    v = v.withColumn("family_count", F.size(there)).withColumn("__top", top)
    mean = F.when(F.size("__top") > 0, F.aggregate("__top", F.lit(0.0), lambda a, x: a + x) / F.size("__top")).otherwise(0.0)
    return v.withColumn("family_ratio", F.col("family_count") / len(families)).withColumn("max_shift", F.coalesce(F.get("__top", F.lit(0)), F.lit(0.0))).withColumn("top2", mean).drop("__top")


# ---- requests, errors, latency ----------------------------------------------------------------------------------------------------


def red_matrix(rows: DataFrame) -> DataFrame:
    """Rows (service, channel, ts, value) with NaN as null, and `rejected`: a presence that is neither 0 nor 1, a value that is
    negative or infinite, a ratio above 1."""
    v = F.when(~F.isnan("value"), F.col("value"))
    bad = F.when((F.col("channel") == "presence") & ~F.coalesce(v.isin(0.0, 1.0), F.lit(False)), "presence").when((v < 0) | (F.abs(v) == float("inf")), "range").when((F.col("channel") == "error_ratio") & (v > 1), "range")
    return rows.withColumn("rejected", bad).withColumn("value", v)


def red_summary(rows: DataFrame, services: DataFrame, expected: int) -> DataFrame:
    """Per service and channel of a window of `expected` slots: the service's state, the channel's, samples, least, median, largest
    value and coverage. rows: service, channel (presence too), ts, value; one row a slot.

    A service is UNAVAILABLE unless present in all slots, INCOMPLETE without any rate, NO_ACTIVITY if all rates are 0, OBSERVED if
    all rates are there and all slots with traffic have the other channels, else PARTIAL. Those count in slots with traffic only.
    """
    of = lambda c: F.max(F.when(F.col("channel") == c, F.col("value")))
    slot = rows.groupBy("service", "ts").agg(*(of(c).alias(c) for c in ("presence", *CHANNELS)), F.count_if(F.col("channel") == "request_rate").alias("__rate"))
    rate = F.col("request_rate")
    g = slot.groupBy("service").agg(
        F.count_if(F.col("presence") == 1).alias("__p"), F.count_if(F.col("presence") != 1).alias("__absent"), F.sum("__rate").alias("__rates"), F.count("request_rate").alias("__known"),
        F.count_if(rate == 0).alias("__zero"), F.count_if((rate > 0) & (F.col("error_ratio").isNull() | F.col("latency_p95").isNull())).alias("__open"),
    )
    every = lambda c: F.coalesce(c, F.lit(0)) == expected
    state = F.when(~every("__p") | (F.col("__absent") > 0), "UNAVAILABLE").when(F.col("__known") == 0, "INCOMPLETE").when(every("__rates") & every("__zero"), "NO_ACTIVITY").when(every("__rates") & every("__known") & (F.col("__open") == 0), "OBSERVED").otherwise("PARTIAL")
    states = services.select("service").distinct().join(g, "service", "left").select("service", state.alias("state"))
    used = [F.struct(F.lit(c).alias("channel"), (rate if c == "request_rate" else F.when(rate > 0, F.col(c))).cast("double").alias("value")) for c in CHANNELS]
    long = slot.select("service", F.explode(F.array(*used)).alias("c")).select("service", "c.*")
    shown = ~F.col("state").isin("UNAVAILABLE", "INCOMPLETE") & ((F.col("state") != "NO_ACTIVITY") | (F.col("channel") == "request_rate"))
    grid = states.withColumn("channel", F.explode(F.array(*map(F.lit, CHANNELS))))
    j = grid.join(long, ["service", "channel"], "left").withColumn("value", F.when(shown, F.col("value")))
    own = F.when((F.col("state") == "NO_ACTIVITY") & (F.col("channel") != "request_rate"), "NOT_DEFINED_WITHOUT_TRAFFIC").otherwise(F.col("state"))
    return j.groupBy("service", "state", "channel", own.alias("channel_state")).agg(F.count("value").alias("samples"), F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("largest"), (F.count("value") / expected).alias("coverage"))


def workload_intensity(points: DataFrame, start: int, end: int, keys: list[str]) -> DataFrame:
    """keys, intensity (mean of the values in [start, end]), and instead a fault: more than one series, bad values anywhere,
    repeated times, or nothing above 0. points: keys, series, ts, value."""
    inside = F.col("ts").between(start, end)
    t = points.groupBy(*keys, "ts").agg(F.count_if(inside).alias("__n"), F.sum(F.when(inside, F.col("value"))).alias("__sum"), F.min("series").alias("__a"), F.max("series").alias("__b"), F.count_if(~stats.finite("value") | (F.col("value") < 0)).alias("__bad"))
    g = t.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"), F.min("__a").alias("__a"), F.max("__b").alias("__b"), F.sum("__bad").alias("__bad"), F.max("__n").alias("__most"))
    fault = F.when(F.col("__a") != F.col("__b"), "series").when(F.col("__bad") > 0, "value").when(F.col("__most") > 1, "repeated").when(F.coalesce("__sum", F.lit(0.0)) <= 0, "none")
    return g.withColumn("fault", fault).select(*keys, "fault", F.when(F.col("fault").isNull(), F.col("__sum") / F.col("__n")).alias("intensity"))


def complete_matrix(points: DataFrame, services: list[str], families: list[str]) -> DataFrame:
    """One row a time with a column <service>/<family> for each pair; times with a missing, repeated, not finite or other series are
    left out: nothing is imputed. Compare the number of rows with that of the times to see whether the grid is whole."""
    names = [f"{s}/{f}" for s in services for f in families]
    p = points.withColumn("__name", F.concat_ws("/", "service", "family"))
    fine = F.col("__name").isin(*names) & stats.finite("value")
    g = p.groupBy("ts").agg(F.count("*").alias("__n"), F.count_if(~fine).alias("__bad"), *(F.max(F.when(F.col("__name") == n, F.col("value"))).alias(n) for n in names))
    whole = F.col("__n") == len(names)
    for n in names:
        whole = whole & F.col(f"`{n}`").isNotNull()
    return g.filter(whole & (F.col("__bad") == 0)).select("ts", *(f"`{n}`" for n in names))
