"""Service graphs as edge lists: closures, shortest distances, affected sets, propagation features, frontiers, validity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.functions.lineage import cut


#: Edges up to which a graph is walked by one task.
SMALL = 2_000


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def _walked(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """All targets of all sources of one graph, level by level from each source."""
    out: dict = {}
    for s, t in zip(frame["source"], frame["target"], strict=True):
        out.setdefault(s, []).append(t)
    rows = []
    for s in out:
        seen, level, d = set(), [s], 0
        while level:
            d += 1
            level = [t for t in dict.fromkeys(t for x in level for t in out.get(x, ())) if t not in seen]
            seen.update(level)
            rows += [(s, t, d) for t in level]
    got = pd.DataFrame(rows, columns=["source", "target", "distance"])
    for i, k in enumerate(keys):
        got.insert(i, k, [frame[k].iloc[0]] * len(got))
    return got


def reachable(edges: DataFrame, keys: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """keys, source, target, distance for every target that a source reaches, by the shortest way (at least one edge).

    Graphs of at most `small` edges, which are counted first, are walked by a task each; larger ones, and a graph without keys, by
    joins (_joined), whatever their size. A node on a cycle reaches itself.
    """
    keys = keys or []
    e = edges.select(*keys, "source", "target").distinct()
    if not keys:
        return _joined(e, keys)
    e = cut(e)
    null = F.col("source").isNull() | F.col("target").isNull()
    sizes = e.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(null).alias("__null"))
    fits = (F.col("__n") <= small) & (F.col("__null") == 0)
    for k in keys:
        fits = fits & F.col(k).isNotNull()
    sizes = cut(sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), fits.alias("__fits")))
    schema = T.StructType([*e.schema.fields, T.StructField("distance", T.IntegerType())])
    of = lambda fit: e.join(sizes.filter(fit), _same(keys), "left_semi")
    walked = of(F.col("__fits")).groupBy(*keys).applyInPandas(lambda f: _walked(f, keys), schema)
    return walked if sizes.filter("not __fits").isEmpty() else walked.unionByName(_joined(of(~F.col("__fits")), keys))


def _joined(e: DataFrame, keys: list[str]) -> DataFrame:
    """reachable() of distinct edges by joins.

    Semi-naive: each round extends only what the last one found, and stops when nothing new appears. Each round is cut, so that
    the plan does not grow; there are as many as the longest shortest way has edges.
    """
    step = e.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("source").alias("__s"), F.col("target").alias("__t"))
    seen = new = cut(e.withColumn("distance", F.lit(1)))
    d = 1
    while True:
        d += 1
        on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("target") == F.col("__s")]
        ahead = new.join(step, on).select(*keys, "source", F.col("__t").alias("target")).distinct()
        old = seen.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("source").alias("__a"), F.col("target").alias("__b"))
        fresh = ahead.join(old, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("source") == F.col("__a"), F.col("target") == F.col("__b")], "left_anti")
        new = cut(fresh.withColumn("distance", F.lit(d)))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        if d % 16 == 0:  # the rounds are cut already; this only keeps their union short
            seen = cut(seen)


def _beside(df: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of `one`, which has a row for each value of the keys: one row in all where there are none."""
    return df.join(one, keys, "left") if keys else df.crossJoin(F.broadcast(one))


def affected(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, candidate, service): the candidate itself and everyone who calls it, however far away. edges: source calls target.

    Here and below, keys (as incident_id) are columns of all inputs and name independent graphs.
    """
    keys = keys or []
    up = reachable(edges, keys).select(*keys, F.col("target").alias("candidate"), F.col("source").alias("service"))
    return nodes.select(*keys, F.col("service").alias("candidate"), "service").union(up).distinct()


def closures(edges: DataFrame, keys: list[str] | None = None, itself_on_cycle: bool = False) -> DataFrame:
    """(keys, service, other, direction, distance): ancestors call the service, descendants are called by it; itself only if
    asked for."""
    keys = keys or []
    r = reachable(edges, keys)
    way = lambda a, b, name: F.struct(F.col(a).alias("service"), F.col(b).alias("other"), F.lit(name).alias("direction"))
    ways = F.array(way("target", "source", "ancestor"), way("source", "target", "descendant"))
    both = r.select(*keys, "distance", F.explode(ways).alias("w")).select(*keys, "w.*", "distance")
    return both if itself_on_cycle else both.filter("service <> other")


def degrees(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """In and out degree and sizes of both closures, each over the other nodes."""
    keys = keys or []
    at = [*keys, "service"]
    n = nodes.groupBy(*keys).agg(F.greatest(F.lit(1), F.count("*") - 1).alias("__n"))
    ins = edges.groupBy(*keys, F.col("target").alias("service")).agg(F.count_distinct("source").alias("in_degree"))
    outs = edges.groupBy(*keys, F.col("source").alias("service")).agg(F.count_distinct("target").alias("out_degree"))
    c = closures(edges, keys).groupBy(*at).agg(F.count_if(F.col("direction") == "ancestor").alias("ancestors"), F.count_if(F.col("direction") == "descendant").alias("descendants"))
    j = _beside(nodes.select(*at).join(ins, at, "left").join(outs, at, "left").join(c, at, "left"), n, keys)
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("in_degree", "out_degree", "ancestors", "descendants")}
    return j.select(*at, *(v.alias(k) for k, v in zero.items()), *((v / F.col("__n")).alias(f"{k}_ratio") for k, v in zero.items()))


def topology_fit(edges: DataFrame, scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each candidate: precision, recall and F1 of its affected set among the ready services against those observed.

    scores: keys, service, ready, anomalous (ranking.observed_services() gives those of the primary signal).
    """
    keys = keys or []
    s = scores.select(*keys, "service", "ready", "anomalous")
    total = s.groupBy(*keys).agg(F.count_if(F.col("anomalous") & F.col("ready")).alias("__obs"))
    a = affected(edges, s, keys).join(s, [*keys, "service"])
    g = _beside(a.groupBy(*keys, "candidate").agg(F.count_if("ready").alias("predicted"), F.count_if(F.col("ready") & F.col("anomalous")).alias("hit")), total, keys)
    p = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("__obs") > 0, F.col("hit") / F.col("__obs")).otherwise(0.0)
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).select(*keys, "candidate", "predicted", "hit", "precision", "recall", "f1")


def distance_weight(edges: DataFrame, scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of 1 / shortest distance from each service to the anomalous ones, up and down, over their number."""
    keys = keys or []
    at = [*keys, "service"]
    n = scores.groupBy(*keys).agg(F.greatest(F.lit(1), F.count_if("anomalous")).alias("__n"))
    hot = scores.filter("anomalous").select(*keys, F.col("service").alias("other"))
    w = closures(edges, keys).join(hot, [*keys, "other"]).groupBy(*at).agg(F.sum(F.when(F.col("direction") == "ancestor", 1 / F.col("distance"))).alias("u"), F.sum(F.when(F.col("direction") == "descendant", 1 / F.col("distance"))).alias("d"))
    j = _beside(scores.select(*at).join(w, at, "left"), n, keys)
    return j.select(*at, (F.coalesce("u", F.lit(0.0)) / F.col("__n")).alias("up_weight"), (F.coalesce("d", F.lit(0.0)) / F.col("__n")).alias("down_weight"))


def neighbourhood(edges: DataFrame, scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each service, of those that call it and that it calls, however far: shares that are anomalous, mean severities, its
    own severity less theirs; and how well the anomalous services are its neighbours: precision, recall, F1, and the Jaccard
    index of the two sets. A service on both sides counts once around it. scores: keys, service, severity, anomalous."""
    keys = keys or []
    at = [*keys, "service"]
    n = scores.groupBy(*keys).agg(F.count_if("anomalous").alias("__hot"))
    ways = closures(edges, keys).groupBy(*at, "other").agg(F.bool_or(F.col("direction") == "ancestor").alias("up"), F.bool_or(F.col("direction") == "descendant").alias("down"))
    c = ways.join(scores.select(*keys, F.col("service").alias("other"), "severity", "anomalous"), [*keys, "other"])
    up, down, hot = F.col("up"), F.col("down"), F.col("anomalous")
    g = c.groupBy(*at).agg(
        F.avg(F.when(up, hot.cast("int"))).alias("up_ratio"), F.avg(F.when(down, hot.cast("int"))).alias("down_ratio"), F.avg(F.when(up, F.col("severity"))).alias("up_mean"),
        F.avg(F.when(down, F.col("severity"))).alias("down_mean"), F.avg("severity").alias("around"), F.count("*").alias("__all"), F.count_if(hot).alias("__hit"),
    )
    j = _beside(scores.select(*at, "severity").join(g, at, "left"), n, keys)
    hit, size, all_hot = F.coalesce("__hit", F.lit(0)), F.coalesce("__all", F.lit(0)), F.col("__hot")
    p, q = hit / F.greatest(F.lit(1), all_hot), hit / F.greatest(F.lit(1), size)
    zero = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("up_ratio", "down_ratio", "up_mean", "down_mean")]
    fit = [p.alias("precision"), q.alias("recall"), (2 * p * q / F.greatest(p + q, F.lit(1e-9))).alias("f1"), (hit / F.greatest(F.lit(1), all_hot + size - hit)).alias("overlap")]
    return j.select(*at, *zero, (F.col("severity") - F.coalesce("around", F.lit(0.0))).alias("contrast"), *fit)


def on_cycle(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Services that reach themselves."""
    keys = keys or []
    return reachable(edges, keys).filter("source = target").select(*keys, F.col("source").alias("service")).distinct()


def invalid_edges(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, source, target, reason for edges to itself, repeated edges and edges with an unknown end."""
    ends = [*(keys or []), "source", "target"]
    known = lambda end: nodes.select(*(keys or []), F.col("service").alias(end))
    one = edges.select(*ends)
    self_ = one.filter("source = target").withColumn("reason", F.lit("self"))
    twice = one.groupBy(*ends).agg(F.count("*").alias("n")).filter("n > 1").select(*ends, F.lit("duplicate").alias("reason"))
    lost = [one.join(known(end), [*(keys or []), end], "left_anti").select(*ends) for end in ("source", "target")]
    lost = lost[0].union(lost[1]).distinct().withColumn("reason", F.lit("unknown"))
    return self_.distinct().union(twice).union(lost)


def branch_isolation(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edges observed but not expected, and expected but not observed."""
    cols = [*keys, "source", "target"]
    e, o = expected.select(*cols).distinct().withColumn("__e", F.lit(1)), observed.select(*cols).distinct().withColumn("__o", F.lit(1))
    j = e.join(o, cols, "full")
    return j.groupBy(*keys).agg(F.count_if(F.col("__e").isNull()).alias("unexpected"), F.count_if(F.col("__o").isNull()).alias("missing"), F.count("*").alias("edges"))


def red_frontier(edges: DataFrame, shifts: DataFrame, threshold: float = 3.0, share: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Anomalous services without a callee that is anomalous in the same channel at least `share` as much.

    shifts: keys, service, channel, delta. Returns keys, service, channel, delta, frontier.
    """
    keys = keys or []
    hot = shifts.filter(F.col("delta") >= threshold)
    child = hot.select(*keys, F.col("service").alias("target"), "channel", F.col("delta").alias("__d"))
    calls = edges.filter("source <> target").select(*keys, F.col("source").alias("service"), "target").distinct()
    held = hot.join(calls, [*keys, "service"]).join(child, [*keys, "target", "channel"]).filter(F.col("__d") >= share * F.col("delta"))
    held = held.select(*keys, "service", "channel", F.lit(True).alias("__held")).distinct()
    j = hot.join(held, [*keys, "service", "channel"], "left")
    return j.select(*keys, "service", "channel", "delta", F.col("__held").isNull().alias("frontier"))


def tiered_order(ranking: DataFrame, frontier: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Re-order a ranking (incident_id, service, rank): frontier services first, then other anomalous ones, then the rest, each
    by the original rank. Abstains (original order) where there is nothing to go by: no edges, a cycle, no frontier.

    frontier and edges are of one graph for all incidents, or of one for each value of the keys (["incident_id"]).
    """
    keys = keys or []
    f = frontier.groupBy(*keys, "service").agg(F.bool_or("frontier").alias("front"))
    some = edges.groupBy(*keys).agg((F.count("*") > 0).alias("__some"))
    cyclic = on_cycle(edges, keys).groupBy(*keys).agg((F.count("*") > 0).alias("__cyclic"))
    j = _beside(_beside(ranking.join(f, [*keys, "service"], "left"), some, keys), cyclic, keys)
    w = Window.partitionBy("incident_id")
    no = F.lit(False)
    any_front = F.max(F.coalesce("front", no).cast("int")).over(w) == 1
    why = F.when(~F.coalesce("__some", no), "no_edges").when(F.coalesce("__cyclic", no), "cyclic").when(~any_front, "no_frontier")
    out = j.withColumn("abstained", why)
    tier = F.when(F.col("abstained").isNotNull() | F.col("front"), 0).when(F.col("front").isNotNull(), 1).otherwise(2)
    out = out.withColumn("__tier", tier)
    return out.withColumn("new_rank", F.row_number().over(w.orderBy("__tier", "rank", "service"))).select("incident_id", "service", "rank", "new_rank", "abstained")


def edge_set(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct edges without blanks and loops."""
    return edges.filter("trim(source) <> '' and trim(target) <> '' and source <> target").select(*(keys or []), "source", "target").distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)
