"""Readers and sinks: OTLP and Jaeger JSON, range-query matrices, log lines, wide frames, CSV census, resumable and sealed output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.operators.spans import canonical_operation

_ATTR = "array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>"
OTLP = f"""resourceSpans array<struct<resource: struct<attributes: {_ATTR}>, scopeSpans: array<struct<spans: array<struct<
  traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string,
  attributes: {_ATTR}, status: struct<code: int>>>>>>>"""
JAEGER = """data array<struct<traceID: string, processes: map<string, struct<serviceName: string>>, spans: array<struct<
  traceID: string, spanID: string, processID: string, operationName: string, startTime: bigint, duration: bigint,
  references: array<struct<refType: string, spanID: string>>, tags: array<struct<key: string, value: string>>>>>>"""
MATRIX = "data struct<result: array<struct<metric: map<string, string>, values: array<array<string>>>>>"
# Span kinds by number, and the keys of HTTP attributes, new and old.
KINDS = ["UNKNOWN", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]
HTTP = {"method": ("http.request.method", "http.method"), "route": ("http.route", "http.target"), "status": ("http.response.status_code", "http.status_code")}


def _value(attributes: Column, *keys: str) -> Column:
    """The last attribute in the list that has one of the keys, as text."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    hits = F.filter(attributes, lambda a: a["key"].isin(*keys))
    return F.try_element_at(F.transform(hits, lambda a: text(a["value"])), F.lit(-1))


def http_attributes(attributes: Column) -> dict[str, Column]:
    """method, route and status of an attribute list under new and old keys; the last one counts."""
    return {k: _value(attributes, *names) for k, names in HTTP.items()}


def otlp_spans(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(spans, rejects) of newline-delimited OTLP/JSON envelopes.

    The service is the resource's; ids of other than 16 and 8 bytes, or zero, and negative durations go to rejects with a
    reason, as do lines that do not parse.

    Rows are laid out by outer generators, below which Spark pushes no filter: it would parse each line once more for each use.
    """
    rows_of = lambda df, c, name, *keep: df.select(*keep, F.posexplode_outer(c).alias("__i", name)).filter("__i is not null").drop("__i")
    parsed = lines.withColumn("__e", F.from_json(F.col(column), f"{OTLP}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = parsed.filter("__e is null or __e._corrupt is not null or __e.resourceSpans is null").select(F.lit("json").alias("reason"), F.col(column).alias("detail"))
    r = rows_of(parsed, "__e.resourceSpans", "r").withColumn("service", _value(F.col("r.resource.attributes"), "service.name"))
    s = rows_of(rows_of(r, "r.scopeSpans", "c", "service"), "c.spans", "s", "service")
    http = http_attributes(F.col("s.attributes"))
    status = http["status"].try_cast("int")
    rows = s.select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.lower(F.nullif("s.parentSpanId", F.lit(""))).alias("parent_span_id"), "service", F.col("s.name").alias("operation"),
        F.element_at(F.array(*map(F.lit, KINDS)), F.least(F.greatest(F.coalesce("s.kind", F.lit(0)), F.lit(0)), F.lit(5)) + 1).alias("kind"),
        F.floor(F.col("s.startTimeUnixNano").try_cast("decimal(20,0)") / 1000).cast("long").alias("start_us"), F.floor(F.col("s.endTimeUnixNano").try_cast("decimal(20,0)") / 1000).cast("long").alias("end_us"),
        http["method"].alias("http_method"), http["route"].alias("http_route"), status.alias("http_status"), F.coalesce((F.col("s.status.code") == 2) | (status >= 500), F.lit(False)).alias("error"),
    ).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    hexed = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$") & ~F.col(c).rlike("^0+$"), F.lit(False))
    reason = F.when(~hexed("trace_id", 32), "trace_id").when(~hexed("span_id", 16), "span_id").when(F.coalesce("service", F.lit("")) == "", "service").when(F.col("start_us").isNull() | F.col("end_us").isNull(), "time").when(F.col("duration_us") < 0, "duration")
    rows = rows.withColumn("reason", reason)
    tagged = rows.select(F.inline_outer(F.array(F.struct(*rows.columns))))
    rejects = tagged.filter("reason is not null").select("reason", F.col("span_id").alias("detail")).unionByName(bad)
    return tagged.filter("reason is null").drop("reason", "end_us"), rejects


def jaeger_spans(lines: DataFrame, column: str = "value") -> DataFrame:
    """Canonical spans of Jaeger JSON: service by process, CHILD_OF parent, kind and error by tags, and the observed edge
    where the parent is of another service."""
    d = lines.select(F.explode(F.from_json(F.col(column), JAEGER)["data"]).alias("d")).select(F.col("d.processes").alias("p"), F.explode("d.spans").alias("s"))
    tag = lambda *k: F.try_element_at(F.filter("s.tags", lambda t: t["key"].isin(*k)), F.lit(-1))["value"]
    parent = F.try_element_at(F.filter("s.references", lambda x: x["refType"] == "CHILD_OF"), F.lit(1))["spanID"]
    status = tag(*HTTP["status"]).try_cast("int")
    spans = d.select(
        F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), parent.alias("parent_span_id"), F.try_element_at("p", F.col("s.processID"))["serviceName"].alias("service"), F.col("s.operationName").alias("operation"),
        F.upper(F.coalesce(tag("span.kind"), F.lit("unknown"))).alias("kind"), F.col("s.startTime").alias("start_us"), F.col("s.duration").alias("duration_us"), F.coalesce((tag("error") == "true") | (tag("otel.status_code") == "ERROR") | (status >= 500), F.lit(False)).alias("error"),
    )
    up = spans.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__s"), F.col("service").alias("__v"))
    j = spans.join(up, (F.col("trace_id") == F.col("__t")) & (F.col("parent_span_id") == F.col("__s")), "left")
    return j.withColumn("observed_edge", F.when(F.col("__v") != F.col("service"), F.struct(F.col("__v").alias("source"), F.col("service").alias("target")))).drop("__t", "__s", "__v")


def trace_parquet(spark: SparkSession, path: str, start_us: int, end_us: int) -> DataFrame:
    """Spans of a Parquet trace table, the time filter pushed to the scan, operations made canonical; a missing column fails."""
    need = ["traceID", "spanID", "parentSpanID", "serviceName", "methodName", "operationName", "startTime", "duration", "statusCode"]
    t = spark.read.parquet(path).select(*need).filter((F.col("startTime") >= start_us) & (F.col("startTime") < end_us))
    return t.select(F.col("traceID").alias("trace_id"), F.col("spanID").alias("span_id"), F.col("parentSpanID").alias("parent_span_id"), F.col("serviceName").alias("service"), canonical_operation(F.col("methodName"), F.col("operationName")).alias("operation"), F.col("startTime").alias("start_us"), F.col("duration").alias("duration_us"), F.col("statusCode").cast("long").alias("status_code"))


def ndjson_spans(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One span a line; header lines, which have no span id, are left out."""
    return spark.read.schema(schema).json(path).filter("span_id is not null")


def matrix_points(lines: DataFrame, column: str = "value", label: str = "service", ignored: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, counts) of range-query matrices: ts, service, value of finite, not negative samples; how many were not."""
    r = lines.select(F.explode(F.from_json(F.col(column), MATRIX)["data"]["result"]).alias("r"))
    v = r.select(F.try_element_at("r.metric", F.lit(label)).alias("service"), F.explode("r.values").alias("v")).filter(F.col("service").isNotNull() & ~F.col("service").isin(*ignored, ""))
    v = v.select("service", F.get("v", F.lit(0)).try_cast("double").alias("ts"), F.get("v", F.lit(1)).try_cast("double").alias("value"))
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & F.col("ts").isNotNull()
    v = v.withColumn("state", F.when(~ok | ~F.coalesce(ok, F.lit(False)), "not_finite").when(F.col("value") < 0, "negative").otherwise("kept"))
    return v.filter("state = 'kept'").drop("state"), v.groupBy("state").agg(F.count("*").alias("n"))


# Keys of a log record that are kept.
LOG_KEYS = ("event.name", "error.type", "http.response.status_code", "service.version", "message")


def log_records(lines: DataFrame, incident_start_ns: int, incident_end_ns: int) -> DataFrame:
    """service, source_timestamp_ns, fields (kept keys only), status, digest, period of structured lines (service,
    source_timestamp_ns, line); lines that are no JSON object go, repeats of time and digest collapse, time is half-open."""
    f = F.from_json("line", "map<string,string>")
    kept = F.map_filter(f, lambda k, v: k.isin(*LOG_KEYS) & v.isNotNull())
    status = F.try_element_at(kept, F.lit("http.response.status_code")).try_cast("int")
    rows = lines.withColumn("fields", kept).filter("size(fields) > 0").withColumn("status", F.when(status.between(100, 599), status)).withColumn("digest", F.sha2("line", 256))
    rows = rows.filter(F.col("source_timestamp_ns") < incident_end_ns).withColumn("period", F.when(F.col("source_timestamp_ns") < incident_start_ns, "BEFORE_INCIDENT").otherwise("INCIDENT"))
    return rows.dropDuplicates(["service", "source_timestamp_ns", "digest"]).drop("line")


def event_category(fields: Column) -> Column:
    """The first that holds: refused access, missing, server failure, timeout, exhausted, connection, restart, deployment,
    other error; null for successes and bare versions."""
    get = lambda k: F.try_element_at(fields, F.lit(k))
    status, error, name = get("http.response.status_code").try_cast("int"), F.lower(F.coalesce(get("error.type"), F.lit(""))), F.lower(F.coalesce(get("event.name"), F.lit("")))
    return (
        F.when(status.isin(401, 403), "access_denied").when(status == 404, "not_found").when(status == 429, "rate_limited").when(error.contains("timeout") | (status == 504), "timeout").when(error.contains("memory") | error.contains("exhaust"), "resource_exhausted")
        .when(error.contains("connect"), "connection_failure").when(status >= 500, "server_error").when(name.contains("restart"), "restart").when(name.contains("deploy"), "deployment").when(name.contains("config"), "configuration_change").when(error != "", "application_error")
    )


def lifecycle_changes(events: DataFrame) -> DataFrame:
    """Starts of container instances compared with the service's last stopped one: deployment if the image differs, configuration_change
    if the memory limit does. events: service, instance, action, at, image, memory_limit."""
    w = Window.partitionBy("service").orderBy("at", "instance").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.when(F.col("action") == "stop", F.struct("image", "memory_limit"))
    e = events.withColumn("__p", F.last(stop, ignorenulls=True).over(w)).filter("action = 'start' and __p is not null")
    change = F.when(F.col("image") != F.col("__p.image"), "deployment").when(F.col("memory_limit") != F.col("__p.memory_limit"), "configuration_change")
    return e.withColumn("change", change).filter("change is not null").drop("__p")


def datapack(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("metrics", "metrics_sum", "metrics_histogram")) -> DataFrame:
    """All tables {normal,abnormal}_<kind> of a case in one, with period and kind read from the file's name."""
    out = None
    for period in ("normal", "abnormal"):
        for kind in kinds:
            t = spark.read.parquet(f"{folder}/{period}_{kind}.parquet").withColumns({"period": F.lit(period), "kind": F.lit(kind)})
            out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def header_census(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """header, files: the distinct first lines of text tables and in how many files each stands."""
    t = spark.read.option("wholetext", "false").text(paths).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = t.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.groupBy("header").agg(F.count("*").alias("files"))


def append_new(df: DataFrame, path: str, ids: list[str]) -> DataFrame:
    """Append the rows whose ids are not in the output yet; returns what was appended. Safe to run again."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*ids).distinct()
        df = df.join(done, ids, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)
    return df


def seal(df: DataFrame) -> DataFrame:
    """rows and digest of a table's content, whatever the order and partitioning of its rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)))
    return sums.select("rows", F.sha2(F.concat_ws("-", "rows", *(F.col(f"s{i}").cast("string") for i in range(4))), 256).alias("digest"))


def joined_after_seal(features: DataFrame, labels: DataFrame, digest: str, key: str = "incident_id") -> DataFrame:
    """Labels joined to features whose content still has the sealed digest, and whose keys are the labels'."""
    if seal(features).first()["digest"] != digest:
        raise ValueError("the features are not those that were sealed")
    a, b = features.select(key).distinct(), labels.select(key).distinct()
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("features and labels have different keys")
    return features.join(labels, key)


def assert_truth_free(df: DataFrame, forbidden: tuple[str, ...] = ("root_service", "label", "fault_type", "fault_family", "is_root", "truth_rank")) -> DataFrame:
    """df, unless it has a column that gives the answer away."""
    found = [c for c in df.columns if c.lower() in forbidden]
    if found:
        raise ValueError(f"columns that name the truth: {found}")
    return df
