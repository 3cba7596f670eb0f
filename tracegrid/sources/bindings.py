"""Telemetry tables derived from the TPC-H-like test tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_EVENTS = "2024-01-16"
SPLIT_ORDERS = "1999-01-01"
SPLIT_POINTS = "1997-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a part of the candidates: an incident's rows are sorted several times in one task.
LINES_A_PART = 250_000


def parts(lines: DataFrame) -> int:
    """Partitions for a table: one for each LINES_A_PART rows (counted from the files' footers), and not fewer than a shuffle has."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_PART))


def micros(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- operation observations ------------------------------------------------------------------------------------------

OBS = f"""obs AS (
  SELECT 'inc-' || (event_id % 2) AS incident_id, event_id AS sample_id, 'svc-' || (user_id % 8) AS service,
         'op-' || (user_id % 3) AS operation, epoch_us(ts) AS ts_us,
         value * (CASE WHEN user_id % 8 = 3 AND ts >= TIMESTAMP '{SPLIT_EVENTS}' THEN 12 ELSE 1 END) AS latency_ms,
         event_type = 'error' AS failed, CASE WHEN ts < TIMESTAMP '{SPLIT_EVENTS}' THEN 'baseline' ELSE 'current' END AS phase
  FROM events)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incident_id, sample_id, service, operation, ts_us, latency_ms, failed, phase; svc-3 is slow in the current phase."""
    late = F.col("ts") >= F.lit(SPLIT_EVENTS).cast("timestamp_ntz")
    slow = F.when((F.col("user_id") % 8 == 3) & late, 12).otherwise(1)
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("inc-"), F.col("event_id") % 2).alias("incident_id"),
        F.col("event_id").alias("sample_id"),
        F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service"),
        F.concat(F.lit("op-"), F.col("user_id") % 3).alias("operation"),
        micros("ts").alias("ts_us"),
        (F.col("value") * slow).alias("latency_ms"),
        (F.col("event_type") == "error").alias("failed"),
        F.when(late, "current").otherwise("baseline").alias("phase"),
    )


# ---- spans -----------------------------------------------------------------------------------------------------------

SPANS = f"""l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                               l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem),
calls AS (
  SELECT 'inc-' || (l_orderkey % 4) AS incident_id, CAST(l_orderkey AS VARCHAR) AS trace_id, rn, c_mktsegment AS root,
         'n-' || (s_nationkey % 12) AS leaf, l_returnflag = 'R' AS error, epoch_us(o_orderdate) AS t0,
         CASE WHEN o_orderdate < TIMESTAMP '{SPLIT_ORDERS}' THEN 'baseline' ELSE 'current' END AS phase,
         (CAST(floor(l_extendedprice) AS BIGINT) % 50000) * (CASE WHEN s_nationkey % 12 = 6 AND o_orderdate >= TIMESTAMP '{SPLIT_ORDERS}' THEN 64 ELSE 1 END) AS d
  FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
spans AS (
  SELECT incident_id, trace_id, 's' || rn AS span_id, 'c' || rn AS parent_span_id, leaf AS service, 'GET /items/' || (rn % 3) AS operation,
         'SERVER' AS kind, t0 + rn * 1000 + 1000 AS start_us, d AS duration_us, error, phase FROM calls
  UNION ALL
  SELECT incident_id, trace_id, 'c' || rn, 'r', root, 'call', 'CLIENT', t0 + rn * 1000, d + 2000, error, phase FROM calls
  UNION ALL
  SELECT incident_id, trace_id, 'r', NULL, root, 'POST /orders', 'SERVER', min(t0), 5000 + max(rn * 1000 + d + 2000), bool_or(error), min(phase)
  FROM calls GROUP BY incident_id, trace_id, root)"""

SPAN_COLUMNS = ["incident_id", "trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "start_us", "duration_us", "error", "phase"]


def spans(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Three-level traces: an order is a root SERVER span, each line a CLIENT span below it and a SERVER span below that. With
    a number of partitions they are in so many by `trace_place`, one more column, the keys of the trace in one text."""
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    trace = ["trace_id", "incident_id"]
    at = lambda c: {"incident_id": F.concat(F.lit("inc-"), F.col(c) % 4), "trace_id": F.col(c).cast("string")}
    # lines are shuffled once, by their trace: numbering, the order's join, its root span and whatever groups by trace stay there
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *line).withColumns(at("l_orderkey"))
    own, placed = [], lambda df: df
    if partitions:
        own, text = ["trace_place"], F.concat_ws("@", "trace_id", "incident_id")  # never null here: the keys are numbers of orders
        placed = lambda df: df.withColumn("trace_place", text).repartition(partitions, "trace_place")
        trace = [*own, *trace]
        lines = placed(lines)
    lines = lines.withColumn("rn", F.row_number().over(Window.partitionBy(*trace).orderBy(*line)).cast("long")).select(*trace, "rn", "l_suppkey", "l_returnflag", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumns(at("o_orderkey"))
    orders = placed(orders).select(*(own or trace), "o_orderdate", "c_mktsegment")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    late = F.col("o_orderdate") >= F.lit(SPLIT_ORDERS).cast("timestamp_ntz")
    calls = lines.join(orders, own or trace).join(F.broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey")).select(
        *trace, "rn", F.col("c_mktsegment").alias("root"), F.concat(F.lit("n-"), F.col("s_nationkey") % 12).alias("leaf"), (F.col("l_returnflag") == "R").alias("error"), micros("o_orderdate").alias("t0"),
        F.when(late, "current").otherwise("baseline").alias("phase"),
        (F.floor("l_extendedprice").cast("long") % 50000 * F.when((F.col("s_nationkey") % 12 == 6) & late, 64).otherwise(1)).alias("d"),
    )
    order = Window.partitionBy(*trace, "root")
    calls = calls.withColumns({
        "first": F.row_number().over(order.orderBy("rn")) == 1, "begin": F.min("t0").over(order), "longest": (F.max(F.col("rn") * 1000 + F.col("d") + 2000).over(order) + 5000),
        "failed": F.bool_or("error").over(order), "least_phase": F.min("phase").over(order),
    })
    rn, text, rest = F.col("rn").cast("string"), F.lit, [F.col("error").alias("error"), F.col("phase").alias("phase")]
    leaf = F.struct(F.concat(text("s"), rn).alias("span_id"), F.concat(text("c"), rn).alias("parent_span_id"), F.col("leaf").alias("service"), F.concat(text("GET /items/"), (F.col("rn") % 3).cast("string")).alias("operation"), text("SERVER").alias("kind"), (F.col("t0") + F.col("rn") * 1000 + 1000).alias("start_us"), F.col("d").alias("duration_us"), *rest)
    client = F.struct(F.concat(text("c"), rn).alias("span_id"), text("r").alias("parent_span_id"), F.col("root").alias("service"), text("call").alias("operation"), text("CLIENT").alias("kind"), (F.col("t0") + F.col("rn") * 1000).alias("start_us"), (F.col("d") + 2000).alias("duration_us"), *rest)
    root = F.struct(text("r").alias("span_id"), text(None).cast("string").alias("parent_span_id"), F.col("root").alias("service"), text("POST /orders").alias("operation"), text("SERVER").alias("kind"), F.col("begin").alias("start_us"), F.col("longest").alias("duration_us"), F.col("failed").alias("error"), F.col("least_phase").alias("phase"))
    every = calls.select(*trace, F.explode(F.when(F.col("first"), F.array(leaf, client, root)).otherwise(F.array(leaf, client))).alias("s"))
    return every.select(*own, *SPAN_COLUMNS[:2], "s.*")


# ---- service graphs ----------------------------------------------------------------------------------------------------

PAIRS = """pairs AS (
  SELECT 'day-' || CAST(epoch_us(o_orderdate) // 86400000000 AS VARCHAR) AS incident_id, 'v-' || c_nationkey AS source, 'v-' || s_nationkey AS target,
         count(*) AS observations, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS load
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3),
edges AS (SELECT * FROM pairs WHERE source <> target)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incident_id, source, target, observations, load: an incident is a day of orders, whose graph has all calls of the day."""
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("string")
    return (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.concat(F.lit("day-"), day).alias("incident_id"), F.concat(F.lit("v-"), "c_nationkey").alias("source"), F.concat(F.lit("v-"), "s_nationkey").alias("target"))
        .agg(F.count("*").alias("observations"), F.sum(F.col("l_quantity").cast("long")).alias("load"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different services: graphs with cycles."""
    return pairs(spark, sf_dir).filter("source <> target")


# ---- metric points ------------------------------------------------------------------------------------------------------

FAMILIES = ["cpu", "memory", "network", "traffic_rate"]
POINTS = f"""points AS (
  SELECT 'svc-' || (l_suppkey % 10) AS service,
         CASE l_linenumber % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' WHEN 2 THEN 'network' ELSE 'traffic_rate' END AS family,
         CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS ts,
         CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_POINTS}' THEN 'baseline' ELSE 'current' END AS phase,
         round(sum(CAST(l_quantity AS BIGINT)) / CAST(count(*) AS DOUBLE), 6) * (CASE WHEN min(l_suppkey % 10) = 4 AND min(l_shipdate) >= TIMESTAMP '{SPLIT_POINTS}' THEN 3 ELSE 1 END) AS value
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service, family, ts (seconds), phase, value: one point a day and series; svc-4 is high in the current phase."""
    late = F.col("l_shipdate") >= F.lit(SPLIT_POINTS).cast("timestamp_ntz")
    li = read(spark, sf_dir, "lineitem")
    key = li.select(
        F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service"),
        F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("l_linenumber") % 4 + 1).alias("family"),
        (micros("l_shipdate") / 1_000_000).cast("long").alias("ts"),
        F.when(late, "current").otherwise("baseline").alias("phase"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    high = F.when((F.col("service") == "svc-4") & (F.col("phase") == "current"), 3).otherwise(1)
    means = key.groupBy("service", "family", "ts", "phase").agg(F.round(F.sum("q") / F.count("*"), 6).alias("value"))
    return means.withColumn("value", F.col("value") * high)


# ---- candidates and labels ------------------------------------------------------------------------------------------------

CAND = """cand0 AS (
  SELECT 'o-' || l_orderkey AS incident_id, 'svc-' || (l_suppkey % 10) AS service, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS score_a,
         sum(CAST(l_quantity AS BIGINT)) AS score_b, max(l_discount) AS disc, min(o_orderpriority) AS dataset, min(c_mktsegment) AS system, min(o_orderstatus) AS fault
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
cand AS (
  SELECT incident_id, service, score_a / 100.0::DOUBLE AS score_a, CAST(score_b AS DOUBLE) AS score_b, dataset, system, fault,
         row_number() OVER (PARTITION BY incident_id ORDER BY disc DESC, service) = 1 AS is_root
  FROM cand0 WHERE incident_id IN (SELECT incident_id FROM cand0 GROUP BY 1 HAVING count(*) >= 3))"""


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate services of incidents (orders of three services or more), two scores, and which one is the root cause."""
    # lines are shuffled once, by their incident, into parts that don't grow with the table; what follows by incident stays there
    lines = read(spark, sf_dir, "lineitem")
    n = parts(lines)
    slim = lines.select(F.concat(F.lit("o-"), "l_orderkey").alias("incident_id"), F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service"), "l_extendedprice", "l_quantity", "l_discount")
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(F.concat(F.lit("o-"), "o_orderkey").alias("incident_id"), "o_orderpriority", "c_mktsegment", "o_orderstatus")
    base = (
        slim.repartition(n, "incident_id")
        .join(orders.repartition(n, "incident_id"), "incident_id")
        .groupBy("incident_id", "service")
        .agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("score_a"),
            F.sum(F.col("l_quantity").cast("long")).alias("score_b"),
            F.max("l_discount").alias("disc"),
            F.min("o_orderpriority").alias("dataset"),
            F.min("c_mktsegment").alias("system"),
            F.min("o_orderstatus").alias("fault"),
        )
    )
    by = Window.partitionBy("incident_id")
    kept = base.withColumn("n", F.count("*").over(by)).filter("n >= 3")
    root = F.row_number().over(by.orderBy(F.desc("disc"), "service")) == 1
    return kept.select("incident_id", "service", (F.col("score_a") / 100.0).alias("score_a"), F.col("score_b").cast("double").alias("score_b"), "dataset", "system", "fault", root.alias("is_root"))
