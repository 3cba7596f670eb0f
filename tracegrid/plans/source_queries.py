"""Queries on sources, sinks, set operations and learned ranking, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.operators import boosting as G
from tracegrid.operators import learn as L
from tracegrid.operators import spans as S
from tracegrid.plans.registry import query
from tracegrid.sources import bindings as B
from tracegrid.sources import readers as D

LOGS = """lg AS (SELECT 'svc-' || (user_id % 8) AS service, epoch_us(ts) * 1000 AS source_timestamp_ns, '{"event.name":"' || event_type || '","http.response.status_code":"' || CASE event_type WHEN 'error' THEN 500 + event_id % 5 WHEN 'click' THEN 401 + event_id % 4 ELSE 200 END || '","user":"' || user_id || '"}' AS line FROM events)"""


def log_lines(spark, d):
    e = B.read(spark, d, "events")
    code = F.when(F.col("event_type") == "error", 500 + F.col("event_id") % 5).when(F.col("event_type") == "click", 401 + F.col("event_id") % 4).otherwise(200)
    line = F.concat(F.lit('{"event.name":"'), "event_type", F.lit('","http.response.status_code":"'), code.cast("string"), F.lit('","user":"'), F.col("user_id").cast("string"), F.lit('"}'))
    return e.select(F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service"), (B.micros("ts") * 1000).alias("source_timestamp_ns"), line.alias("line"))


SPLIT_NS = 1_705_363_200_000_000_000  # 2024-01-16


@query("src13_log_records", f"""WITH {LOGS}, x AS (SELECT DISTINCT service, source_timestamp_ns, line FROM lg WHERE source_timestamp_ns < {SPLIT_NS + 10**15})
SELECT service, CASE WHEN source_timestamp_ns < {SPLIT_NS} THEN 'BEFORE_INCIDENT' ELSE 'INCIDENT' END AS period, CAST(regexp_extract(line, 'status_code":"([0-9]+)', 1) AS INT) AS status, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def src13(spark, d):
    logs = D.log_records(log_lines(spark, d), SPLIT_NS, SPLIT_NS + 10**15)
    return logs.groupBy("service", "period", "status").agg(F.count("*").alias("n"))


@query("prj19_event_category", f"WITH {LOGS}, x AS (SELECT service, CAST(regexp_extract(line, 'status_code\":\"([0-9]+)', 1) AS INT) AS st FROM lg) SELECT CASE WHEN st IN (401, 403) THEN 'access_denied' WHEN st = 404 THEN 'not_found' WHEN st = 504 THEN 'timeout' WHEN st >= 500 THEN 'server_error' END AS category, count(*) AS n FROM x GROUP BY 1")
def prj19(spark, d):
    fields = F.from_json("line", "map<string,string>")
    return log_lines(spark, d).groupBy(D.event_category(fields).alias("category")).agg(F.count("*").alias("n"))


@query("src01_otlp_spans", f"WITH {B.SPANS} SELECT service, kind, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS us FROM spans WHERE kind = 'SERVER' AND span_id <> 'r' GROUP BY 1, 2")
def src01(spark, d):
    """Server spans written as OTLP/JSON envelopes and read back."""
    s = B.spans(spark, d).filter("kind = 'SERVER' and span_id <> 'r'")
    attr = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value")))
    span = F.struct(
        F.substring(F.sha2("trace_id", 256), 1, 32).alias("traceId"), F.substring(F.sha2(F.concat("trace_id", "span_id"), 256), 1, 16).alias("spanId"), F.col("operation").alias("name"), F.lit(2).alias("kind"),
        (F.col("start_us") * 1000).cast("string").alias("startTimeUnixNano"), ((F.col("start_us") + F.col("duration_us")) * 1000).cast("string").alias("endTimeUnixNano"),
    )
    env = F.struct(F.array(F.struct(F.struct(attr.alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    good, _ = D.otlp_spans(s.select(F.to_json(env).alias("value")))
    return good.groupBy("service", "kind").agg(F.count("*").alias("n"), F.sum("duration_us").alias("us"))


@query("src11_matrix_points", "SELECT 'svc-' || (user_id % 8) AS service, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY 1")
def src11(spark, d):
    """Samples of each service and event type as a range-query matrix, read back; one type has bad values."""
    e = B.read(spark, d, "events").withColumn("day", F.to_date("ts"))
    value = F.when(F.col("event_type") == "view", "NaN").otherwise(F.col("value").cast("string"))
    g = e.groupBy((F.col("user_id") % 8).alias("s"), "event_type", "day").agg(F.collect_list(F.array(F.col("event_id").cast("string"), value)).alias("values"))  # a day of one series
    doc = F.struct(F.struct(F.array(F.struct(F.create_map(F.lit("service"), F.concat(F.lit("svc-"), "s")).alias("metric"), "values")).alias("result")).alias("data"))
    points, _ = D.matrix_points(g.select(F.to_json(doc).alias("value")))
    return points.groupBy("service").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("src19_seal", """WITH h AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
s AS (SELECT count(*) AS rows, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS s0, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS s1, sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)) AS s2, sum(CAST('0x' || substr(h, 37, 12) AS BIGINT)) AS s3 FROM h)
SELECT rows, sha256(concat_ws('-', rows, s0, s1, s2, s3)) AS digest FROM s""")
def src19(spark, d):
    """Content digest of a table's keys and status; equal for any order and partitioning (tested)."""
    return D.seal(B.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query("src07_valid_spans", f"WITH {B.SPANS} SELECT phase, count(*) AS n FROM spans WHERE duration_us >= 0 AND start_us > 0 GROUP BY 1")
def src07(spark, d):
    return S.valid(B.spans(spark, d)).groupBy("phase").agg(F.count("*").alias("n"))


@query("prj02_business_server", "SELECT r = 'SERVER' AND e NOT IN ('/health') AND NOT starts_with(e, '/debug/') AS business, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'SERVER' ELSE 'CLIENT' END AS r, ['/health', '/debug/x', '/orders'][CAST(event_id % 3 AS INT) + 1] AS e FROM events) GROUP BY 1")
def prj02(spark, d):
    path = F.element_at(F.array(*map(F.lit, ("GET /health", "GET /debug/x", "GET  /orders"))), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 2 == 0, "SERVER").otherwise("CLIENT")
    return B.read(spark, d, "events").groupBy(S.business_server(kind, path).alias("business")).agg(F.count("*").alias("n"))


@query("prj21_pseudonyms", "SELECT 'svc-' || lpad(CAST(k AS VARCHAR), 3, '0') AS alias, n, total FROM (SELECT dense_rank() OVER (ORDER BY s_name) AS k, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_name)")
def prj21(spark, d):
    from pyspark.sql import Window

    g = B.read(spark, d, "supplier").groupBy("s_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    k = F.dense_rank().over(Window.orderBy("s_name"))  # services of one projection
    return g.select(F.concat(F.lit("svc-"), F.lpad(k.cast("string"), 3, "0")).alias("alias"), "n", "total")


@query("set01_04_universes", """WITH a AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08), b AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A' AND l_tax > 0.07)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set01(spark, d):
    li = B.read(spark, d, "lineitem")
    a, b = li.filter("l_returnflag = 'R' and l_discount > 0.08").select("l_suppkey").distinct(), li.filter("l_returnflag = 'A' and l_tax > 0.07").select("l_suppkey").distinct()
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.exceptAll(b), "except"))


def labelled(spark, d):
    c = B.cand(spark, d)
    return L.folds(c.withColumn("label", F.col("is_root").cast("int")), "incident_id", 3, 5)


@query("lrn01_pairwise_ranker")
def lrn01(spark, d):
    """Fit on two folds, score and rank the third (LRN-02)."""
    c = labelled(spark, d)
    from tracegrid.operators.ranking import ranked

    model = L.fit(c.filter("fold <> 0"), ["score_a", "score_b"])
    return ranked(model.score(c.filter("fold = 0")), "model_score").select("incident_id", "service", "model_score", "rank")


@query("lrn04_out_of_fold")
def lrn04(spark, d):
    return L.out_of_fold(labelled(spark, d), ["score_a", "score_b"], 3).select("incident_id", "service", "fold", "model_score")


@query("lrn08_masked_copies", f"WITH {B.CAND} SELECT count(*) * 2 AS n, count(DISTINCT incident_id) * 2 AS incidents, round(sum(score_a), 2) AS total FROM cand")
def lrn08(spark, d):
    m = L.masked_copies(B.cand(spark, d), ["score_a"])
    return m.agg(F.count("*").alias("n"), F.count_distinct("incident_id").alias("incidents"), F.round(F.sum("score_a"), 2).alias("total"))


SCORES = ["score_a", "score_b"]


@query("lrn01_listwise_ranker")
def lrn01_listwise(spark, d):
    """Boosted trees on two folds, the third scored and ranked; the tests hold gradients, histograms and splits against loops."""
    from tracegrid.operators.ranking import ranked

    c = labelled(spark, d)
    forest = G.fit(c.filter("fold <> 0"), SCORES, G.Setting(depth=2, eta=0.3, rounds=4))
    return ranked(G.score(c.filter("fold = 0"), SCORES, forest), "model_score").select("incident_id", "service", "model_score", "rank")


@query("lrn07_nested")
def lrn07(spark, d):
    """Out-of-fold scores of all incidents, each by a forest whose setting was chosen without its fold."""
    settings = {"shallow": G.Setting(depth=1, eta=0.3, rounds=2), "deep": G.Setting(depth=2, eta=0.3, rounds=2)}
    n = G.nested(labelled(spark, d).drop("fold"), SCORES, "incident_id", settings, outer=3, inner=2)
    return n.predictions.select("incident_id", "service", "fold", "model_score")


@query("fun_exact_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def exact_quantiles(spark, d):
    """Three groups of a third of the rows each."""
    q = stats.exact_quantiles(B.read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.9, 0.99])
    return q.select("l_returnflag", *(F.round(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("median", "p90", "p99"))))
