"""Metric channels: wide and long points, shifts against a baseline, complete grids, rates and workload-conditioned fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.functions.lineage import cut

# Metric suffix -> family, longest suffix first where one ends another.
SUFFIXES = {"latency-90": "latency_p90", "latency-50": "latency_p50", "diskio": "disk_io", "cpu": "cpu", "mem": "memory", "net": "network", "socket": "sockets", "workload": "traffic_rate", "error": "error_rate", "latency": None}
# Unit -> (canonical unit, factor).
UNITS = {"cores": ("cores", 1.0), "millicores": ("cores", 0.001), "bytes": ("bytes", 1.0), "KiB": ("bytes", 1024.0), "MiB": ("bytes", 1048576.0), "percent": ("ratio", 0.01), "ratio": ("ratio", 1.0), "s": ("seconds", 1.0), "ms": ("seconds", 0.001), "us": ("seconds", 0.000001)}
SERIES = ["service", "family"]


def long_points(wide: DataFrame, time: str = "time") -> DataFrame:
    """time, metric, value of a frame with a column a metric; not finite values and times are dropped, repeated times become
    their median."""
    metrics = [c for c in wide.columns if c != time]
    cast = wide.select(F.col(time).cast("double").alias(time), *(F.col(f"`{c}`").cast("double").alias(c) for c in metrics))
    long = cast.unpivot([time], metrics, "metric", "value").filter(stats.finite(time) & stats.finite("value"))
    return long.groupBy(time, "metric").agg(F.percentile("value", 0.5).alias("value"))


def parsed_metric(metric: Column) -> tuple[Column, Column]:
    """Entity and family of <entity>_<suffix>; null family for unknown suffixes."""
    entity, suffix = F.regexp_extract(metric, r"^(.+)_([^_]+)$", 1), F.regexp_extract(metric, r"^(.+)_([^_]+)$", 2)
    family = F.lit(None).cast("string")
    for k, v in SUFFIXES.items():
        family = F.when(suffix == k, v).otherwise(family)
    return F.when(entity != "", entity), family


def normalized(entity: Column) -> Column:
    """Small letters, runs of '_' and '-' as one '-', no blanks or dashes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(entity)), "[_-]+", "-"), "^-|-$", "")


def service_key(entity: Column) -> Column:
    """The normalized name without a last 'service' and without '-'."""
    return F.regexp_replace(F.regexp_replace(normalized(entity), "-?service$", ""), "-", "")


def infrastructure(entity: Column) -> Column:
    """Databases, caches and proxies, which are no candidates: by name once it is in small letters with single dashes."""
    name = normalized(entity)
    # fixed values: names that are infrastructure, and ends of such names
    return name.isin("redis", "rabbitmq", "queue", "session", "istio-proxy") | name.rlike("-(mongo|mysql|db)$")


def converted(points: DataFrame) -> DataFrame:
    """Values in canonical units; rows of unknown unit keep a reason instead."""
    unit, factor = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, (u, f) in UNITS.items():
        unit, factor = F.when(F.col("unit") == k, u).otherwise(unit), F.when(F.col("unit") == k, f).otherwise(factor)
    return points.withColumn("canonical_unit", unit).withColumn("canonical_value", F.col("value") * factor).withColumn("rejected", F.when(unit.isNull(), "unit").when(F.col("value") < 0, "negative"))


def frame_audit(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Per series: points, repeated times, bad values, and the median, least and largest positive step between times."""
    t = points.select(*keys, "ts").distinct()
    step = t.withColumn("__d", F.col("ts") - F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))).groupBy(*keys).agg(F.percentile("__d", 0.5).alias("cadence"), F.min("__d").alias("least_step"), F.max("__d").alias("largest_step"), F.count("*").alias("times"))
    n = points.groupBy(*keys).agg(F.count("*").alias("points"), F.count_if(F.isnan("value")).alias("nans"), F.count_if(F.abs("value") == float("inf")).alias("infs"))
    return n.join(step, keys).withColumn("repeated", F.col("points") - F.col("times"))


def scale_floor() -> Column:
    return 1e-6 * F.greatest(F.lit(1.0), F.abs("median"))


def channel_shift(points: DataFrame, keys: list[str] = SERIES, threshold: float = 3.5, least: tuple[int, int] = (30, 10)) -> DataFrame:
    """Per series with enough points: shift of the median, of the 90 % quantile and of the IQR in robust units of the baseline;
    share and longest run of the residuals above the threshold; the largest residual. Places (of the first above the threshold,
    0 without one, and of the largest) are fractions of the last place."""
    base = points.filter("phase = 'baseline'")
    b = stats.robust_stats(base, keys, "value", scale_floor())
    q = base.groupBy(*keys).agg(F.count("*").alias("n0"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias("q0"))
    b = b.join(q, keys)
    cur = points.filter("phase = 'current'").join(b, keys)
    cur = cur.withColumn("residual", (F.col("value") - F.col("median")) / F.col("scale")).withColumn("on", F.abs("residual") >= threshold)
    cur = cur.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    g = cur.groupBy(*keys).agg(
        F.first("n0").alias("n0"), F.count("*").alias("n1"), F.first("scale").alias("scale"), ((F.percentile("value", 0.5) - F.first("median")) / F.first("scale")).alias("location"),
        ((F.percentile("value", 0.9) - F.first("q0")[2]) / F.first("scale")).alias("p90_shift"), ((F.percentile("value", 0.75) - F.percentile("value", 0.25) - F.first("q0")[1] + F.first("q0")[0]) / F.first("scale")).alias("iqr_shift"),
        F.avg(F.col("on").cast("double")).alias("persistence"), F.min(F.when(F.col("on"), F.col("idx"))).alias("first"), F.max(F.abs("residual")).alias("peak"),
        F.max_by("idx", F.struct(F.abs("residual"), -F.col("idx"))).alias("peak_at"),
    )
    runs = stats.longest_run(cur, keys, "idx", "on")
    out = g.join(runs, keys).filter((F.col("n0") >= least[0]) & (F.col("n1") >= least[1]))
    last = F.greatest(F.lit(1), F.col("n1") - 1)
    out = out.withColumn("first_fraction", F.coalesce(F.col("first") / last, F.lit(0.0))).withColumn("peak_fraction", F.col("peak_at") / last).withColumn("abs_location", F.abs("location"))
    return out.withColumn("run_fraction", F.col("longest_run") / F.col("n1")).drop("first", "peak_at", "longest_run")


def rolling_shift(points: DataFrame, seconds: int, keys: list[str] = SERIES, threshold: float = 3.5) -> DataFrame:
    """Medians over the trailing window (t - seconds, t] of the current points, in robust units of the baseline: largest, median
    and share above the threshold."""
    b = stats.robust_stats(points.filter("phase = 'baseline'"), keys, "value", scale_floor())
    cur = points.filter("phase = 'current'").join(b, keys).withColumn("residual", (F.col("value") - F.col("median")) / F.col("scale"))
    w = Window.partitionBy(*keys).orderBy("ts").rangeBetween(1 - seconds, 0)
    m = cur.withColumn("rolled", F.abs(F.percentile("residual", 0.5).over(w)))
    return m.groupBy(*keys).agg(F.max("rolled").alias("largest"), F.percentile("rolled", 0.5).alias("median_shift"), F.avg((F.col("rolled") >= threshold).cast("double")).alias("above"))


def family_aggregate(shifts: DataFrame, keys: list[str], channel: str, score: str, persistence: str) -> DataFrame:
    """Per key: the channel of the largest score (of equal ones the least name), the mean of the two largest, the largest
    persistence."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), channel)
    r = shifts.withColumn("__k", F.row_number().over(w))
    return r.groupBy(*keys).agg(F.max(F.when(F.col("__k") == 1, F.col(channel))).alias("winner"), F.max(score).alias("best"), F.avg(F.when(F.col("__k") <= 2, F.col(score))).alias("top2"), F.max(persistence).alias("persistence"), F.count("*").alias("channels"))


def feature_vector(shifts: DataFrame, families: list[str], values: list[str]) -> DataFrame:
    """One row a service with has_<family> and <family>_<value>, 0 where there is no channel."""
    g = shifts.groupBy("service").agg(*(F.max(F.when(F.col("family") == f, 1).otherwise(0)).alias(f"has_{f}") for f in families), *(F.coalesce(F.max(F.when(F.col("family") == f, F.col(v))), F.lit(0.0)).alias(f"{f}_{v}") for f in families for v in values))
    return g


def complete_grid(points: DataFrame, start: int, end: int, step: int, keys: list[str] = SERIES) -> DataFrame:
    """Each series at every slot of [start, end): OBSERVED with its value, MISSING without one."""
    slots = points.sparkSession.range(start, end, step).withColumnRenamed("id", "slot")
    series = points.select(*keys).distinct()
    p = points.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.floor((F.col("ts") - start) / step) * step + start).alias("__slot"), "value").groupBy(*(f"__{k}" for k in keys), "__slot").agg(F.avg("value").alias("value"))
    j = series.crossJoin(F.broadcast(slots)).join(p, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("slot") == F.col("__slot")], "left")  # the slots of one window
    return j.select(*keys, "slot", F.when(F.col("__slot").isNotNull(), "OBSERVED").otherwise("MISSING").alias("state"), "value")


def grid_reference(grid: DataFrame, keys: list[str] = SERIES, least: int = 20, support: float = 0.8, floor: float = 1e-9) -> DataFrame:
    """Center and scale of series that are observed often enough; scale is the IQR, at least 5 % of the center."""
    g = grid.groupBy(*keys).agg(F.count_if(F.col("state") == "OBSERVED").alias("n"), F.avg((F.col("state") == "OBSERVED").cast("double")).alias("support"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    center = F.col("p")[1]
    out = g.select(*keys, "n", "support", center.alias("center"), F.greatest(F.col("p")[2] - F.col("p")[0], 0.05 * F.abs(center), F.lit(floor)).alias("scale"))
    return out.filter((F.col("n") >= least) & (F.col("support") >= support))


def point_coverage(points: DataFrame, start: int, end: int, step: int, keys: list[str] = SERIES) -> DataFrame:
    expected = (end - start) // step
    inside = points.filter((F.col("ts") >= start) & (F.col("ts") < end))
    return inside.groupBy(*keys).agg(F.count_distinct("ts").alias("times")).withColumn("coverage", F.col("times") / expected)


def binned(points: DataFrame, most: int, keys: list[str] = SERIES) -> DataFrame:
    """At most `most` bins of equally many points: start, end, least, largest, mean, number."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy("ts")) - 1, F.count("*").over(w)
    b = points.withColumn("__n", n).withColumn("bin", F.floor(i / F.ceil(n / most)))
    return b.groupBy(*keys, "bin").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("value").alias("least"), F.max("value").alias("largest"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def coarsened(bins: DataFrame, factor: int, keys: list[str] = SERIES) -> DataFrame:
    """Neighbouring bins merged, means weighted by their points."""
    return bins.groupBy(*keys, F.floor(F.col("bin") / factor).alias("bin")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("least").alias("least"), F.max("largest").alias("largest"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def interval_bins(bins: DataFrame, start: int, end: int) -> DataFrame:
    """Bins that lie in the interval as a whole."""
    return bins.filter((F.col("start") >= start) & (F.col("end") <= end))


def counter_rates(readings: DataFrame, instance: str, at: str, counter: str) -> DataFrame:
    """Increase per second of a counter; null (not 0) for the first reading and after a reset."""
    w = Window.partitionBy(instance).orderBy(at)
    d, t = F.col(counter) - F.lag(counter).over(w), F.col(at) - F.lag(at).over(w)
    return readings.withColumn("rate", F.when((d >= 0) & (t > 0), d / t)).withColumn("reset", F.coalesce(d < 0, F.lit(False)))


def red_channels(requests: DataFrame, keys: list[str], bounds: list[float]) -> DataFrame:
    """Requests, share of 5xx and the 95 % latency from cumulative histogram buckets, interpolated inside its bucket.

    Buckets are added up over all rows before the quantile is taken. requests: keys, status, latency.
    """
    edges = [0.0, *bounds]
    g = requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.avg((F.col("status") >= 500).cast("double")).alias("error_ratio"), *(F.count_if(F.col("latency") <= b).alias(f"__le{i}") for i, b in enumerate(bounds)))
    rank, p95 = 0.95 * F.col("requests"), F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        low = F.col(f"__le{i - 1}") if i else F.lit(0)
        inside = F.col(f"__le{i}") - low
        p95 = F.when((F.col(f"__le{i}") >= rank) & (inside > 0), edges[i] + (bounds[i] - edges[i]) * (rank - low) / inside).otherwise(p95)
    return g.withColumn("latency_p95", p95).drop(*(f"__le{i}" for i in range(len(bounds))))


def red_states(points: DataFrame, expected: int) -> DataFrame:
    """Per service and channel: unavailable (no value), no_activity (all rates 0), incomplete (fewer than expected), available."""
    g = points.groupBy("service", "channel").agg(F.count("value").alias("n"), F.max(F.abs("value")).alias("__top"), F.percentile("value", 0.5).alias("median"))
    state = F.when(F.col("n") == 0, "unavailable").when((F.col("channel") == "request_rate") & (F.col("__top") == 0), "no_activity").when(F.col("n") < expected, "incomplete").otherwise("available")
    return g.withColumn("state", state).drop("__top")


def workload_pairs(points: DataFrame, traffic: str = "traffic_rate") -> DataFrame:
    """Values of each other family next to the service's traffic at the same time: service, family, ts, phase, x, y."""
    x = points.filter(F.col("family") == traffic).select(F.col("service").alias("__s"), F.col("ts").alias("__t"), F.col("value").alias("x"))
    return points.filter(F.col("family") != traffic).join(x, (F.col("service") == F.col("__s")) & (F.col("ts") == F.col("__t"))).select("service", "family", "ts", "phase", "x", F.col("value").alias("y"))


def robust_line(pairs: DataFrame, keys: list[str], rounds: int = 8, limit: float = 1.345) -> DataFrame:
    """Slope and intercept of y on x for all groups at once: least squares, then `rounds` times re-weighted after Huber.

    Each round is one aggregation of weighted sums; a row weighs the square of its Huber weight, as design and response are
    both multiplied by it. Residuals are scaled by 1.4826 times their median distance from their median. Where x is constant,
    the line is the one of least coefficients through the mean.
    """
    fit = None
    for _ in range(rounds + 1):
        p = pairs.select(*keys, "x", "y")
        if fit is None:
            p = p.withColumn("w", F.lit(1.0))
        else:
            p = p.join(fit, keys).withColumn("r", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
            centred = p.join(p.groupBy(*keys).agg(F.percentile("r", 0.5).alias("c")), keys)
            s = centred.groupBy(*keys).agg(F.greatest(F.percentile(F.abs(F.col("r") - F.col("c")), 0.5) * stats.MAD, F.lit(1e-9)).alias("s"))
            p = p.drop("slope", "intercept").join(s, keys).withColumn("w", F.pow(F.least(F.lit(1.0), limit / F.greatest(F.abs("r") / F.col("s"), F.lit(1e-12))), 2))
        g = p.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"))
        det = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
        mean_x, mean_y = F.col("x") / F.col("w"), F.col("y") / F.col("w")
        slope = F.when(det > 1e-12 * F.col("w") * F.col("xx"), (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / det).otherwise(mean_x * mean_y / (1 + mean_x * mean_x))
        fit = cut(g.withColumn("slope", slope).select(*keys, "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("w")).alias("intercept")))
    return fit


def huber_line(points: DataFrame, keys: list[str], epsilon: float = 1.35, rounds: int = 60) -> DataFrame:
    """keys, slope, intercept, sigma that together minimise n sigma + sum of sigma h((y - intercept - slope x) / sigma), h being the
    square up to epsilon and a line of the same slope beyond: line and scale are estimated jointly, for all groups at once.

    Given which points lie within epsilon sigma, and on which side the others are, the minimum has a closed form in the sums of
    those points and in numbers and signs of the others. Each round is one aggregation of these sums; a group is done when a
    round gives what the round before gave, which then is the minimum, as the function is convex. Steps are halved where that
    takes long. Groups need at least two different x. points: keys, x, y.
    """
    means = points.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("__dx"), F.coalesce(F.nullif(F.stddev_pop("y"), F.lit(0.0)), F.lit(1.0)).alias("__dy"))
    unit = cut(points.select(*keys, "x", "y").join(means, keys).select(*keys, ((F.col("x") - F.col("__mx")) / F.col("__dx")).alias("x"), ((F.col("y") - F.col("__my")) / F.col("__dy")).alias("y")))
    fit = unit.select(*keys).distinct().select(*keys, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1e300).alias("s"), F.lit(False).alias("done"))
    for k in range(rounds):
        r = F.col("y") - F.col("a") * F.col("x") - F.col("b")
        p = unit.join(fit.filter("not done"), keys).withColumn("__in", F.abs(r) <= epsilon * F.col("s")).withColumn("__sign", F.when(F.col("__in"), 0.0).otherwise(F.signum(r)))
        inner = lambda c: F.coalesce(F.sum(F.when(F.col("__in"), c)), F.lit(0.0))
        x, y = F.col("x"), F.col("y")
        g = p.groupBy(*keys, "a", "b", "s").agg(F.count("*").alias("total"), inner(F.lit(1.0)).alias("n"), inner(x).alias("sx"), inner(y).alias("sy"), inner(x * x).alias("xx"), inner(x * y).alias("xy"), inner(y * y).alias("yy"), F.sum("__sign").alias("signs"), F.sum(F.col("__sign") * x).alias("signs_x"))
        det = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")
        solve = lambda u, v: ((F.col("n") * u - F.col("sx") * v) / F.col("det"), (F.col("xx") * v - F.col("sx") * u) / F.col("det"))
        g = g.withColumn("det", F.when(det > 1e-12, det))
        a0, b0 = solve(F.col("xy"), F.col("sy"))
        a1, b1 = solve(epsilon * F.col("signs_x"), epsilon * F.col("signs"))
        g = g.withColumns({"a0": a0, "b0": b0, "a1": a1, "b1": b1})
        rest = F.greatest(F.col("yy") - F.col("a0") * F.col("xy") - F.col("b0") * F.col("sy"), F.lit(1e-24))
        moved = F.col("a1") * F.col("a1") * F.col("xx") + 2 * F.col("a1") * F.col("b1") * F.col("sx") + F.col("b1") * F.col("b1") * F.col("n")
        room = F.col("total") - epsilon * epsilon * (F.col("total") - F.col("n")) - moved
        # too many points outside: a larger scale takes them in
        new = F.when(room > 1e-9, F.sqrt(rest / room)).otherwise(2 * F.col("s"))
        g = g.withColumn("t", F.coalesce(new, 2 * F.col("s")))
        share = 1.0 if k < 20 else 0.5
        mix = lambda old, c: F.col(old) + share * (c - F.col(old)) if k else c
        line = lambda c, d, old: F.when(room > 1e-9, F.coalesce(F.col(c) + F.col("t") * F.col(d), F.col(old))).otherwise(F.col(old))
        step = g.withColumns({"a2": mix("a", line("a0", "a1", "a")), "b2": mix("b", line("b0", "b1", "b")), "s2": mix("s", F.col("t"))})
        close = lambda u, v: F.abs(F.col(u) - F.col(v)) <= 1e-13 + 1e-12 * F.abs(F.col(v))
        step = step.select(*keys, F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("s2").alias("s"), (close("a", "a2") & close("b", "b2") & close("s", "s2")).alias("done"))
        fit = cut(step.unionByName(fit.filter("done")))
        if fit.filter("not done").isEmpty():
            break
    out = fit.join(means, keys)
    slope = F.col("a") * F.col("__dy") / F.col("__dx")
    return out.select(*keys, slope.alias("slope"), (F.col("__my") + F.col("b") * F.col("__dy") - slope * F.col("__mx")).alias("intercept"), (F.col("s") * F.col("__dy")).alias("sigma"))


def conditioned_residuals(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Deviation of the current y from the line that the baseline has on x: location (of the median), 90 % quantile, peak and
    persistence in robust units. Groups have `least` rows in all, in the baseline and in the current phase. An x or y that is
    never negative in the baseline, and whose 90 % quantile there is above four medians, is taken as log(1 + value)."""
    least, phase = (40, 30, 10), F.col("phase")
    of = lambda c, p, q: F.percentile(F.when(p, F.col(c)), q)
    skew = lambda c: (F.min(F.when(phase == "baseline", F.col(c))) >= 0) & (of(c, phase == "baseline", 0.9) > 4 * F.greatest(of(c, phase == "baseline", 0.5), F.lit(1e-9)))
    g = pairs.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(phase == "baseline").alias("__n0"), F.count_if(phase == "current").alias("__n1"), skew("x").alias("__x"), skew("y").alias("__y"))
    g = g.filter((F.col("__n") >= least[0]) & (F.col("__n0") >= least[1]) & (F.col("__n1") >= least[2]))
    pairs = pairs.join(g, keys).withColumns({c: F.when(F.col(f"__{c}"), F.log1p(c)).otherwise(F.col(c)) for c in "xy"}).select(*keys, "phase", "x", "y")
    base = pairs.filter(phase == "baseline")
    fit = robust_line(base, keys)
    res = lambda df: df.join(fit, keys).withColumn("r", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    b = stats.robust_stats(res(base), keys, "r", scale_floor())
    c = res(pairs.filter("phase = 'current'")).join(b, keys).withColumn("z", F.abs((F.col("r") - F.col("median")) / F.col("scale")))
    return c.groupBy(*keys).agg(F.count("*").alias("n"), (F.abs(F.percentile("r", 0.5) - F.first("median")) / F.first("scale")).alias("location"), F.percentile("z", 0.9).alias("p90"), F.max("z").alias("peak"), F.avg((F.col("z") >= 3.5).cast("double")).alias("persistence"))


def strongest_residual(conditioned: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the row with the largest peak; of equal ones the first by family."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("peak"), "family"))
    return conditioned.withColumn("__k", best).filter("__k = 1").drop("__k")


def in_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Each point with the first segment (start, end, both included) that holds it; segments are a bounded list."""
    s = F.broadcast(segments.withColumnsRenamed({"start": "__a", "end": "__b"}))  # a healthy period has a few segments
    j = points.join(s, (F.col("ts") >= F.col("__a")) & (F.col("ts") <= F.col("__b")))
    key = [c for c in points.columns]
    return j.groupBy(*key).agg(F.min_by("segment", F.struct("__a", "segment")).alias("segment"))


def disappearance(expected: Column, seen: Column, missing_edges: Column) -> Column:
    """0.45 times the drop, 0.35 times the missing edges, 0.2 if nothing is left; 0 where fewer than one span is expected."""
    drop = F.greatest(F.lit(0.0), 1 - seen / F.greatest(expected, F.lit(1e-9)))
    return F.when(expected >= 1, 0.45 * drop + 0.35 * missing_edges + F.when(seen == 0, 0.2).otherwise(0.0)).otherwise(0.0)


def temporal_shape(residuals: DataFrame, spans: DataFrame, services: DataFrame, start: int, end: int, threshold: float = 3.0) -> DataFrame:
    """Per service of `services`: where in the window deviations and errors stand.

    residuals: service, family, ts, residual; spans: service, ts, error; only those from start to end count. The first third of
    the window is early, the last is late. A service's early (late) value is the largest over its families of the 90 % quantile
    of the absolute residuals there, 0 without any; first_fraction is where the first residual of the threshold stands, 1
    without one. The same for errors: their share of the early and the late spans, and where the first one stands.
    """
    f = (F.col("ts") - start) / (end - start)
    inside = lambda df: df.filter(F.col("ts").between(start, end)).withColumn("__f", f)
    early, late = F.col("__f") <= 1 / 3, F.col("__f") >= 2 / 3
    a = F.abs("residual")
    g = inside(residuals).groupBy("service", "family").agg(F.percentile(F.when(early, a), 0.9).alias("e"), F.percentile(F.when(late, a), 0.9).alias("l"), F.min(F.when(a >= threshold, F.col("__f"))).alias("o"))
    m = g.groupBy("service").agg(F.max("e").alias("e"), F.max("l").alias("l"), F.min("o").alias("o"))
    bad = F.col("error").cast("double")
    s = inside(spans).groupBy("service").agg(F.avg(F.when(early, bad)).alias("x"), F.avg(F.when(late, bad)).alias("y"), F.min(F.when(F.col("error"), F.col("__f"))).alias("p"))
    j = services.select("service").distinct().join(m, "service", "left").join(s, "service", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shape = lambda k, one, two, first: [zero(one).alias(f"{k}_early"), zero(two).alias(f"{k}_late"), (zero(two) - zero(one)).alias(f"{k}_trend"), F.coalesce(first, F.lit(1.0)).alias(f"{k}_first_fraction"), F.col(first).isNotNull().cast("double").alias(f"{k}_observed")]
    return j.select("service", *shape("metric", "e", "l", "o"), *shape("error", "x", "y", "p"))
