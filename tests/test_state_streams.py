"""Streams with state of their own: the same as batch operators on the same rows, in any order of arrival, also after a restart."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracegrid.operators import anomaly as A
from tracegrid.operators import spans as S
from tracegrid.streaming import outbox as O
from tracegrid.streaming import spans as T
from tracegrid.streaming import state as Y

SAMPLE = "ts timestamp, id long, service string, operation string, latency_ms double, failed boolean"
CONTROL = "ts timestamp, kind string"


@pytest.fixture(autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, Y.STORE)
    yield
    spark.conf.set(name, before)


def at(second: float) -> str:
    return f"timestamp_micros({int((1_700_000_000 + second) * 1e6)})"


def write(spark, rows, schema, path):
    names = [c.split()[0] for c in schema.split(", ")]
    plain = schema.replace("ts timestamp", "ts double")
    spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_micros(((F.col("ts") + 1_700_000_000) * 1_000_000).cast("long"))).select(*names).coalesce(1).write.mode("append").parquet(path)


def collect(query):
    seen = []
    q = query.writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend(df.collect()))
    return seen, q


def samples(seed=1):
    rng, rows, i = random.Random(seed), [], 0
    for service, operation in (("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")):
        for t in range(0, 1200, 4 if service != "c" else 90):
            slow = 9 if service == "b" and t > 700 else 1
            rows.append((t + rng.random(), i, service, operation, 5 * slow * (1 + rng.random()), rng.random() < (0.6 if (operation, t > 700) == ("y", True) else 0.1)))
            i += 1
    return rows


@pytest.mark.parametrize("order", ["time", "mixed"])
def test_life_cycle_equals_the_batch_detector(spark, tmp_path, order):
    rows = samples()
    controls = [(0.0, "start"), (50.0, "freeze"), (60.0, "reset"), (100.0, "start"), (120.0, "reset"), (700.0, "freeze"), (800.0, "freeze"), (1100.0, "reset")]
    source, orders = f"{tmp_path}/samples", f"{tmp_path}/controls"
    # parts of 300 s; within each, rows come in any order
    for k in range(4):
        part = [r for r in rows if k * 300 <= r[0] < (k + 1) * 300]
        if order == "mixed":
            random.Random(k).shuffle(part)
        write(spark, part, SAMPLE, source)
        write(spark, [c for c in controls if k * 300 <= c[0] < (k + 1) * 300][:: -1 if order == "mixed" else 1], CONTROL, orders)
        s, c = spark.readStream.schema(SAMPLE).parquet(source), spark.readStream.schema(CONTROL).parquet(orders)
        seen, q = collect(Y.life_cycle(s, c, "400 seconds", shards=3))
        q = q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    write(spark, [(9000.0, -1, "end", "end", 1.0, False)], SAMPLE, source)
    write(spark, [(9000.0, "none")], CONTROL, orders)
    s, c = spark.readStream.schema(SAMPLE).parquet(source), spark.readStream.schema(CONTROL).parquet(orders)
    last, q = collect(Y.life_cycle(s, c, "400 seconds", shards=3))
    assert q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(240)
    got: dict = {}
    for r in sorted([*seen, *last], key=lambda r: r.seq):
        got[r.service, r.operation] = r
    all_rows, all_controls = spark.read.parquet(source).filter("id >= 0"), spark.read.parquet(orders)
    j = all_rows.join(Y.phases(all_controls), F.lit(True)).withColumn("phase", Y.phase(F.col("ts"))).withColumns({"incident_id": F.lit("i"), "sample_id": F.col("id"), "ts_us": F.unix_micros("ts")})
    want = {(r.service, r.operation): r for r in A.operation_anomalies(j).collect()}
    assert set(got) == set(want) and len(want) == 4
    for k, w in want.items():
        g = got[k]
        assert (g.state, g.cycle, g.baseline_samples, g.current_samples) == (w.state, 2, w.samples or 0, w.current_samples or 0)
        assert g.latency_z == pytest.approx(w.latency_z, abs=1e-9) and g.error_z == pytest.approx(w.error_z, abs=1e-9)
        assert g.severity == pytest.approx(w.severity, abs=1e-9) and g.error_anomalous == w.error_anomalous
    assert {w.state for w in want.values()} == {"ready", "insufficient_baseline"} and want["b", "x"].latency_anomalous


SPAN = "trace_id string, span_id string, parent_span_id string, service string, ts timestamp"


def feed(spark, batches, build, tmp_path, schema=SPAN):
    """One micro-batch after the other; the rows given out, and the progress of each query's batches."""
    source, seen, told = f"{tmp_path}/in", [], []
    for rows in batches:
        write(spark, rows, schema, source)
        q = build(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("append").foreachBatch(lambda df, k: seen.extend(df.collect()))
        q = q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        told.append([p for p in q.recentProgress if p["numInputRows"]])
    return seen, told


def test_late_children_equal_the_batch_graph(spark, tmp_path):
    rng, rows = random.Random(3), []
    for t in range(12):
        for i in range(8):
            rows.append((float(t), f"t{t}", f"s{i}", f"s{rng.randrange(i)}" if i else None, f"v{rng.randrange(3)}"))
    rows = [(t, s, p, v, ts) for ts, t, s, p, v in rows]
    rng.shuffle(rows)
    twice = rows + rows[:20]
    seen, _ = feed(spark, [twice[0::3], twice[1::3], twice[2::3]], Y.kept_links, tmp_path)
    got: dict = {}
    for r in seen:
        got[r.source, r.target] = got.get((r.source, r.target), 0) + 1
    batch = spark.createDataFrame([(*r[:4], int(r[4])) for r in rows], "trace_id string, span_id string, parent_span_id string, service string, start_us long")
    assert got == {(r.source, r.target): r.observations for r in S.service_graph(batch, []).collect()} and got


def test_a_trace_goes_after_its_last_update(spark, tmp_path):
    """Updates at 0, 50 and 100 s keep a trace of 80 s; a child at 300 s comes too late."""
    batches = [[("t", "r", None, "a", 0.0)], [("t", "k1", "r", "b", 50.0)], [("t", "k2", "r", "c", 100.0)], [("u", "x", None, "z", 290.0)], [("u", "y", None, "z", 291.0)], [("t", "k3", "r", "d", 300.0)]]
    seen, _ = feed(spark, batches, lambda s: Y.kept_links(s, "0 seconds", 80_000), tmp_path)
    assert sorted(r.target for r in seen) == ["b", "c"]


def test_batches_of_one_long_trace_write_what_is_new(spark, tmp_path):
    """Entries written do not grow with the trace."""
    batches = [[("t", f"s{4 * k + i}", f"s{4 * k + i - 1}", f"v{i}", float(k)) for i in range(4)] for k in range(12)]
    seen, told = feed(spark, batches, Y.kept_links, tmp_path)
    assert len(seen) == 47
    updated = [sum(o["numRowsUpdated"] for o in p[0]["stateOperators"]) for p in told]
    assert max(updated[2:]) <= min(updated[2:]) + 1 and max(updated) < 20


def test_rolling_keeps_the_latest_over_frames(spark, tmp_path):
    """A key with more rows in a batch than a frame holds, in no order."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        base = spark.createDataFrame([("a", "o", 0.0, 0.1, 40, 2)], "service string, operation string, log_median double, scale double, samples long, errors long")
        rows = [(float(i), i, "a", "o", float(i), i % 2 == 0) for i in range(100)]
        random.Random(2).shuffle(rows)
        schema = "ts timestamp, sample_id long, service string, operation string, latency_ms double, failed boolean"
        seen = []
        for part in (rows[:60], rows[60:]):
            write(spark, part, schema, f"{tmp_path}/in")
            q = T.rolling_current(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), base).writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend(df.collect()))
            assert q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    import numpy as np

    p = (10 + 2) / 60
    r = seen[-1]
    assert r.n == 20 and r.latency_z == pytest.approx(float(np.median(np.log1p(np.arange(80, 100)))) / 0.1)
    assert r.error_z == pytest.approx((10 / 20 - 2 / 40) / (p * (1 - p) * (1 / 20 + 1 / 40)) ** 0.5) and r.anomalous


def test_sliding_quantiles_within_the_stated_rank_error(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.random() * 200, "a", "cpu", rng.lognormvariate(0, 1)) for _ in range(6000)]
    schema = "ts timestamp, service string, family string, value double"
    late = rows[:200]
    for part in (sorted(rows[200:3000]), sorted(rows[3000:]) + late, [(5000.0, "a", "cpu", 1.0)]):
        write(spark, part, schema, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for width in ("30 seconds", "60 seconds"):
        out = f"{tmp_path}/out{width[:2]}"
        q = T.sliding_shift(T.pane_sketches(stream, "10 seconds", "300 seconds", k=200), width, k=200).writeStream.outputMode("append").format("parquet")
        assert q.option("checkpointLocation", f"{tmp_path}/cp{width[:2]}").trigger(availableNow=True).start(out).awaitTermination(240)
        got = spark.read.parquet(out).collect()
        assert len(got) >= 18
        for r in got:
            end = r.end.timestamp() - 1_700_000_000
            inside = sorted(v for t, _, _, v in rows if end - int(width[:2]) <= t < end)
            assert r.n == len(inside) and r.largest == max(inside)
            for q, v in ((0.5, r.median), (0.9, r.p90)):
                low, high = sum(x < v for x in inside) / len(inside), sum(x <= v for x in inside) / len(inside)
                assert low - 0.03 <= q <= high + 0.03


def test_outbox_after_a_query_that_ended_between_write_and_commit(spark, tmp_path):
    schema = "ts timestamp, id string"
    polls = [[(float(i), f"e{i}") for i in range(0, 6)], [(float(i), f"e{i}") for i in range(4, 10)], [(float(i), f"e{i}") for i in range(9, 12)]]
    for p in polls:
        write(spark, p, schema, f"{tmp_path}/in")
    put, path, broken = O.outbox(f"{tmp_path}/box"), f"{tmp_path}/box", [True]

    def once_broken(df, k):
        put(df, k)
        if k == 1 and broken:
            broken.clear()
            raise RuntimeError("ended here")

    def start():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return O.polled(s, ["id"]).writeStream.foreachBatch(once_broken).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    assert start().awaitTermination(120)
    assert sorted(r.id for r in O.rows(spark, path).collect()) == sorted(f"e{i}" for i in range(12))
    sent: list = []
    assert O.deliver(spark, path, lambda df, n: sent.extend((n, r.id) for r in df.collect())) == O.rows(spark, path).select("batch").distinct().count()
    assert sorted(i for _, i in sent) == sorted(f"e{i}" for i in range(12))
    assert O.deliver(spark, path, lambda df, n: sent.append(n)) == 0 and O.pending(spark, path).count() == 0
