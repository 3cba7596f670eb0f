"""The diagnostic vector over the test tables: an incident is a month of traces after the healthy ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.lineage import cut, cut_by, joins_in_place
from tracegrid.operators import diagnosis as D
from tracegrid.operators import spans as S
from tracegrid.operators import vectors as V
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

MONTH = 2_592_000
HEALTHY = "months before the split"


class Months(NamedTuple):
    """Windows of a month and what was seen in them; `late` tells those with traces after the split."""

    windows: DataFrame
    summary: DataFrame
    edges: DataFrame
    points: DataFrame


def month(micros) -> F.Column:
    return F.floor(micros / (MONTH * 1_000_000)) * (MONTH * 1_000_000)


def months(spark, d) -> Months:
    n = B.parts(B.read(spark, d, "lineitem"))
    s = B.spans(spark, d, n).select(S.PLACE, *B.SPAN_COLUMNS[:5], "kind", "start_us", "duration_us", "error", "phase")
    # in buckets by their trace: links, climbs and their sums need no other shuffle
    s = cut_by(s.withColumn("environment", F.lit(HEALTHY)).withColumn("window_us", month(F.col("start_us"))), S.PLACE, n)
    root = (F.col("span_id") == "r").cast("int")
    windows = cut(s.groupBy("environment", "window_us").agg((F.sum(root) / MONTH).alias("load"), (F.max("phase") == "current").alias("late")))
    line = B.read(spark, d, "lineitem").join(B.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    points = line.groupBy(F.concat(F.lit("n-"), F.col("s_nationkey") % 12).alias("service"), F.element_at(F.array(*map(F.lit, V.FAMILIES)), F.col("l_linenumber") % 4 + 1).alias("family"), B.micros("l_shipdate").alias("ts"))
    points = points.agg(F.avg(F.col("l_quantity").cast("double")).alias("value")).withColumn("window_us", month(F.col("ts")))
    with joins_in_place(spark):
        summary, edges = cut(S.window_summary(s, ["environment"], MONTH, n)), cut(S.window_edges(s, ["environment"], MONTH))
    return Months(windows, summary, edges, cut(points))


def healthy(m: Months) -> V.Healthy:
    before = m.windows.filter("not late").select("window_us", F.col("load").alias("x"))
    lines = lambda df, kind: D.workload_baseline(df.join(before, "window_us").select("service", kind, "x", "value"), ["service", kind]).withColumn("environment", F.lit(HEALTHY))
    # a parent starts no later than its child, so it is in a healthy month, too
    early = m.windows.filter("not late")
    edges = cut(S.expected_of_windows(m.edges.join(early, ["environment", "window_us"], "left_semi"), early, ["environment"]))
    return V.Healthy(cut(lines(m.points, "family")), cut(lines(V.melted(m.summary, ["window_us", "service"]), "signal")), edges)


def inputs(spark, d) -> tuple:
    """incidents, services, points, summary, observed edges and the healthy period, as candidate_vectors() takes them."""
    m = months(spark, d)
    name = lambda df: df.withColumn("incident_id", F.concat(F.lit("w-"), "window_us"))
    late = m.windows.filter("late").select("window_us")
    of = lambda df: name(df.join(late, "window_us"))
    about = name(m.windows.filter("late")).select("incident_id", "environment", F.col("window_us").alias("start_us"), (F.col("window_us") + MONTH * 1_000_000).alias("end_us"), "load", F.lit(True).alias("traces_collected"))
    return about, of(m.summary).select("incident_id", "service"), of(m.points), of(m.summary), of(m.edges), healthy(m)


@query("met15_candidate_vector")
def met15(spark, d):
    """All 59 columns; tests/test_vectors.py recomputes each of them service by service."""
    v = V.candidate_vectors(*inputs(spark, d), ["environment"])
    return v.select("incident_id", "service", *(F.round(c, 6).alias(c) for c in V.FEATURES))
