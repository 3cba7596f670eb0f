"""Queries on service graphs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegrid.operators import graph as G
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B

WITH = f"WITH RECURSIVE {B.PAIRS}"
# 25 services: no shortest way, and no way back to a service, has more than 25 edges
REACH = """walk AS (SELECT incident_id, source, target, 1 AS d FROM edges UNION SELECT w.incident_id, w.source, e.target, d + 1 FROM walk w JOIN edges e ON e.incident_id = w.incident_id AND e.source = w.target WHERE d < 25),
reach AS (SELECT incident_id, source, target, min(d) AS distance FROM walk GROUP BY 1, 2, 3)"""
NODES = "nodes AS (SELECT incident_id, source AS service FROM edges UNION SELECT incident_id, target FROM edges)"
# severities and flags derived from the node's traffic
SCORES = "scores AS (SELECT incident_id, service, CAST(sum(load) % 10 AS DOUBLE) AS severity, sum(load) % 3 = 0 AS anomalous, sum(load) % 7 <> 0 AS ready FROM (SELECT incident_id, source AS service, load FROM edges UNION ALL SELECT incident_id, target, load FROM edges) GROUP BY 1, 2)"
BOTH = "both2 AS (SELECT incident_id, source AS service, target AS other, distance, false AS up FROM reach WHERE source <> target UNION ALL SELECT incident_id, target, source, distance, true FROM reach WHERE source <> target)"
KEY = ["incident_id"]


def nodes(e):
    return e.select(*KEY, F.col("source").alias("service")).union(e.select(*KEY, "target")).distinct()


def scores(e):
    both = e.select(*KEY, F.col("source").alias("service"), "load").union(e.select(*KEY, "target", "load"))
    n = F.sum("load")
    return both.groupBy(*KEY, "service").agg((n % 10).cast("double").alias("severity"), (n % 3 == 0).alias("anomalous"), (n % 7 != 0).alias("ready"))


def r(c, n=6):
    return F.round(c, n)


@query("rec01_reachable", f"{WITH}, {REACH} SELECT incident_id, source, target, CAST(distance AS BIGINT) AS distance FROM reach")
def rec01(spark, d):
    """Closure with shortest distances (REC-04)."""
    return G.reachable(B.edges(spark, d), KEY).withColumn("distance", F.col("distance").cast("long"))


AFF = "aff AS (SELECT incident_id, service AS candidate, service FROM nodes UNION SELECT incident_id, target, source FROM reach)"


@query("gra01_affected", f"{WITH}, {REACH}, {NODES}, {AFF} SELECT * FROM aff")
def gra01(spark, d):
    e = B.edges(spark, d)
    return G.affected(e, nodes(e), KEY)


@query("gra02_closures", f"{WITH}, {REACH}, {BOTH} SELECT incident_id, service, other, CASE WHEN up THEN 'ancestor' ELSE 'descendant' END AS direction FROM both2")
def gra02(spark, d):
    return G.closures(B.edges(spark, d), KEY).drop("distance")


@query("gra03_degrees", f"""{WITH}, {REACH}, {NODES}, {BOTH}, m AS (SELECT incident_id, greatest(1, count(*) - 1) AS m FROM nodes GROUP BY 1), i AS (SELECT incident_id, target AS service, count(DISTINCT source) AS n FROM edges GROUP BY 1, 2), o AS (SELECT incident_id, source AS service, count(DISTINCT target) AS n FROM edges GROUP BY 1, 2),
c AS (SELECT incident_id, service, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b FROM both2 GROUP BY 1, 2),
x AS (SELECT incident_id, service, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(a, 0) AS ancestors, coalesce(b, 0) AS descendants FROM nodes LEFT JOIN i USING (incident_id, service) LEFT JOIN o USING (incident_id, service) LEFT JOIN c USING (incident_id, service))
SELECT incident_id, service, in_degree, out_degree, ancestors, descendants, round(in_degree / CAST(m AS DOUBLE), 6) AS in_degree_ratio, round(out_degree / CAST(m AS DOUBLE), 6) AS out_degree_ratio, round(ancestors / CAST(m AS DOUBLE), 6) AS ancestors_ratio, round(descendants / CAST(m AS DOUBLE), 6) AS descendants_ratio FROM x JOIN m USING (incident_id)""")
def gra03(spark, d):
    e = B.edges(spark, d)
    g = G.degrees(e, nodes(e), KEY)
    return g.withColumns({c: r(c) for c in g.columns if c.endswith("ratio")})


@query("gra04_topology_fit", f"""{WITH}, {REACH}, {NODES}, {SCORES}, {AFF}, o AS (SELECT incident_id, count(*) FILTER (anomalous AND ready) AS obs FROM scores GROUP BY 1),
g AS (SELECT incident_id, candidate, count(*) FILTER (ready) AS predicted, count(*) FILTER (ready AND anomalous) AS hit FROM aff JOIN scores USING (incident_id, service) GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hit / CAST(predicted AS DOUBLE) ELSE 0 END AS p, CASE WHEN obs > 0 THEN hit / CAST(obs AS DOUBLE) ELSE 0 END AS q FROM g JOIN o USING (incident_id))
SELECT incident_id, candidate, predicted, hit, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM pr""")
def gra04(spark, d):
    e = B.edges(spark, d)
    return G.topology_fit(e, scores(e), KEY).withColumns({c: r(c) for c in ("precision", "recall", "f1")})


@query("gra05_distance_weight", f"""{WITH}, {REACH}, {NODES}, {SCORES}, {BOTH}, n AS (SELECT incident_id, greatest(1, count(*) FILTER (anomalous)) AS n FROM scores GROUP BY 1),
w AS (SELECT b.incident_id, b.service, sum(CASE WHEN up THEN 1.0::DOUBLE / distance END) AS u, sum(CASE WHEN NOT up THEN 1.0::DOUBLE / distance END) AS d FROM both2 b JOIN scores s ON s.incident_id = b.incident_id AND s.service = b.other WHERE anomalous GROUP BY 1, 2)
SELECT incident_id, service, round(coalesce(u, 0) / n, 6) AS up_weight, round(coalesce(d, 0) / n, 6) AS down_weight FROM scores LEFT JOIN w USING (incident_id, service) JOIN n USING (incident_id)""")
def gra05(spark, d):
    e = B.edges(spark, d)
    return G.distance_weight(e, scores(e), KEY).withColumns({c: r(c) for c in ("up_weight", "down_weight")})


AROUND = """ways AS (SELECT incident_id, service, other, bool_or(up) AS up, bool_or(NOT up) AS down FROM both2 GROUP BY 1, 2, 3),
g AS (SELECT w.incident_id, w.service, avg(CASE WHEN up THEN CAST(anomalous AS INT) END) AS ur, avg(CASE WHEN down THEN CAST(anomalous AS INT) END) AS dr, avg(CASE WHEN up THEN severity END) AS um, avg(CASE WHEN down THEN severity END) AS dm, avg(severity) AS around, count(*) AS size, count(*) FILTER (anomalous) AS hit
  FROM ways w JOIN scores s ON s.incident_id = w.incident_id AND s.service = w.other GROUP BY 1, 2),
n AS (SELECT incident_id, count(*) FILTER (anomalous) AS hot FROM scores GROUP BY 1),
ng AS (SELECT s.*, ur, dr, um, dm, around, coalesce(size, 0) AS size, coalesce(hit, 0) AS hit, hot, coalesce(hit, 0) / CAST(greatest(1, hot) AS DOUBLE) AS p, coalesce(hit, 0) / CAST(greatest(1, coalesce(size, 0)) AS DOUBLE) AS q FROM scores s LEFT JOIN g USING (incident_id, service) JOIN n USING (incident_id))"""


@query("gra06_neighbourhood", f"""{WITH}, {REACH}, {SCORES}, {BOTH}, {AROUND}
SELECT incident_id, service, round(coalesce(ur, 0), 6) AS up_ratio, round(coalesce(dr, 0), 6) AS down_ratio, round(coalesce(um, 0), 6) AS up_mean, round(coalesce(dm, 0), 6) AS down_mean, round(severity - coalesce(around, 0), 6) AS contrast,
round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / greatest(p + q, 1e-9), 6) AS f1, round(hit / CAST(greatest(1, hot + size - hit) AS DOUBLE), 6) AS overlap FROM ng""")
def gra06(spark, d):
    e = B.edges(spark, d)
    n = G.neighbourhood(e, scores(e), KEY)
    return n.withColumns({c: r(c) for c in n.columns if c not in ("incident_id", "service")})


@query("gra07_cycles", f"{WITH}, {REACH} SELECT incident_id, source AS service FROM reach WHERE source = target")
def gra07(spark, d):
    return G.on_cycle(B.edges(spark, d), KEY)


SHIFTS = "shifts AS (SELECT incident_id, source AS service, CASE WHEN load % 2 = 0 THEN 'errors' ELSE 'latency' END AS channel, CAST(max(load % 11) AS DOUBLE) AS delta FROM pairs GROUP BY 1, 2, 3)"


def shifts(spark, d):
    return B.pairs(spark, d).groupBy(*KEY, F.col("source").alias("service"), F.when(F.col("load") % 2 == 0, "errors").otherwise("latency").alias("channel")).agg(F.max(F.col("load") % 11).cast("double").alias("delta"))


FRONT = """hot AS (SELECT * FROM shifts WHERE delta >= 5), held AS (SELECT DISTINCT h.incident_id, h.service, h.channel FROM hot h JOIN edges e ON e.incident_id = h.incident_id AND e.source = h.service JOIN hot c ON c.incident_id = e.incident_id AND c.service = e.target AND c.channel = h.channel AND c.delta >= 0.5 * h.delta),
fr AS (SELECT h.*, k.service IS NULL AS frontier FROM hot h LEFT JOIN held k USING (incident_id, service, channel))"""


@query("gra08_red_frontier", f"{WITH}, {SHIFTS}, {FRONT} SELECT * FROM fr")
def gra08(spark, d):
    """Anomalous services that no anomalous callee explains (JON-19)."""
    return G.red_frontier(B.edges(spark, d), shifts(spark, d), 5.0, keys=KEY)


@query("gra08_tiered_order", f"""{WITH}, {REACH}, {SHIFTS}, {FRONT}, rk AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY service DESC) AS rank FROM (SELECT DISTINCT incident_id, source AS service FROM pairs)),
f AS (SELECT incident_id, service, bool_or(frontier) AS front FROM fr GROUP BY 1, 2), sm AS (SELECT DISTINCT incident_id, true AS filled FROM edges), cy AS (SELECT DISTINCT incident_id, true AS cyclic FROM reach WHERE source = target),
j AS (SELECT incident_id, service, rank, front, CASE WHEN filled IS NULL THEN 'no_edges' WHEN cyclic THEN 'cyclic' WHEN NOT bool_or(coalesce(front, false)) OVER (PARTITION BY incident_id) THEN 'no_frontier' END AS abstained FROM rk LEFT JOIN f USING (incident_id, service) LEFT JOIN sm USING (incident_id) LEFT JOIN cy USING (incident_id))
SELECT incident_id, service, rank, row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN abstained IS NOT NULL OR front THEN 0 WHEN front IS NOT NULL THEN 1 ELSE 2 END, rank, service) AS new_rank, abstained FROM j""")
def gra08b(spark, d):
    ranking = B.pairs(spark, d).select(*KEY, F.col("source").alias("service")).distinct()
    ranking = ranking.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("service"))).cast("long"))
    e = B.edges(spark, d)
    return G.tiered_order(ranking, G.red_frontier(e, shifts(spark, d), 5.0, keys=KEY), e, KEY).withColumn("new_rank", F.col("new_rank").cast("long"))


@query("gra09_invalid_edges", f"""{WITH}, w AS (SELECT incident_id, CASE WHEN load % 5 = 0 THEN target ELSE source END AS source, CASE WHEN load % 7 = 0 THEN 'x' ELSE target END AS target FROM pairs), k AS (SELECT DISTINCT incident_id, source AS service FROM pairs)
SELECT DISTINCT incident_id, source, target, 'self' AS reason FROM w WHERE source = target UNION ALL SELECT incident_id, source, target, 'duplicate' FROM w GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT incident_id, source, target, 'unknown' FROM w WHERE (incident_id, source) NOT IN (SELECT (incident_id, service) FROM k) OR (incident_id, target) NOT IN (SELECT (incident_id, service) FROM k)""")
def gra09(spark, d):
    p = B.pairs(spark, d)
    worn = p.select(*KEY, F.when(F.col("load") % 5 == 0, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("load") % 7 == 0, "x").otherwise(F.col("target")).alias("target"))
    return G.invalid_edges(worn, p.select(*KEY, F.col("source").alias("service")).distinct(), KEY)


@query("gra10_branch_isolation", f"""WITH {B.SPANS}, g AS (SELECT DISTINCT c.incident_id, c.phase, p.service AS source, c.service AS target FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service <> c.service),
j AS (SELECT incident_id, e.source AS es, o.source AS os FROM (SELECT * FROM g WHERE phase = 'baseline') e FULL JOIN (SELECT * FROM g WHERE phase = 'current') o USING (incident_id, source, target))
SELECT incident_id, count(*) FILTER (es IS NULL) AS unexpected, count(*) FILTER (os IS NULL) AS missing, count(*) AS edges FROM j GROUP BY 1""")
def gra10(spark, d):
    from tracegrid.operators import spans as S

    linked = S.with_parent(B.spans(spark, d), ("service",)).filter("parent_service <> service")
    g = linked.select("incident_id", "phase", F.col("parent_service").alias("source"), F.col("service").alias("target"))
    return G.branch_isolation(g.filter("phase = 'baseline'"), g.filter("phase = 'current'"), ["incident_id"])


@query("set06_edge_set", f"{WITH} SELECT DISTINCT incident_id, source, target FROM pairs WHERE source <> target")
def set06(spark, d):
    return G.edge_set(B.pairs(spark, d), KEY)
