"""Streams with state of their own: the detector's life cycle under a stream of controls, and links of spans kept for a while."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracegrid.operators import anomaly as A

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a control can ask for.
CONTROLS = ("start", "freeze", "reset")
RESULT = "service string, operation string, seq long, at long, cycle int, state string, baseline_samples long, current_samples long, latency_z double, error_z double, latency_anomalous boolean, error_anomalous boolean, severity double"
_ARROW = pa.schema([("ts", pa.int64()), ("kind", pa.string()), ("id", pa.string()), ("service", pa.string()), ("operation", pa.string()), ("latency_ms", pa.float64()), ("failed", pa.bool_())])
_NAMES = _ARROW.names
_LINK = pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("parent_span_id", pa.string()), ("service", pa.string()), ("ts", pa.int64()), ("is_span", pa.bool_()), ("until", pa.int64())])
_LINK_NAMES = _LINK.names
#: Rows of a piece that waits on, and rows that are sorted at once before they are cut into pieces.
_PIECE, _SORTED = 50_000, 1_000_000
#: Controls of one time go in this order, then other kinds, then samples.
_SAMPLE = len(CONTROLS) + 1
_OPERATION = "latency array<double>, failed array<boolean>, samples long, errors long, log_median double, scale double"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(pieces: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(bytes(p)).read_all() for p in pieces])


def _numbered(texts: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """The distinct texts, and each row's place among them; null is as empty."""
    coded = pc.fill_null(texts, "").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _effective(state: str, controls: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], int]:
    """Of controls (place, kind) in order, those that make what a state becomes, and the number of starts: the last start, the freeze
    after it and the last reset after that."""
    out: list[tuple[int, str]] = []
    starts = 0
    for c in controls:
        if c[1] == "start":
            out, state, starts = [c], "collecting", starts + 1
        elif c[1] == "freeze" and state == "collecting":
            out, state = [*out, c], "frozen"
        elif c[1] == "reset" and state == "frozen":
            out = [*(x for x in out if x[1] != "reset"), c]
    return out, starts


def _median(x: list[float] | np.ndarray) -> float:
    return float(np.median(x))


class LifeCycle(StatefulProcessor):
    """Per shard: the state of the detector, and samples and baselines of the shard's operations.

    Rows wait in pieces until the watermark has passed them and are then taken in order of time (controls before samples of the
    same time, then by id), so the order of arrival makes no difference. A piece is an entry of its own and covers a short time:
    writing one reads no other, and only those that are due are read. Of the controls that are due only those of the last cycle
    have an effect; between two of them an operation's samples are taken in one go: only its last ones stay, and a sample costs the
    same however many are kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "least long, piece long", "rows binary")
        self.phase = handle.getValueState("phase", "state string, cycle int, seq long")
        self.operations = handle.getMapState("operations", "service string, operation string", _OPERATION)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, first, tables, keys = timerValues.getCurrentWatermarkInMs() * 1000, None, [], self._keys()
        for f in rows:
            f = f[_NAMES].assign(ts=(f["ts"].astype("datetime64[us]").astype("int64")))
            f = f[f["ts"] > now]  # later than the watermark allows
            if len(f):
                first = min(first or int(f["ts"].min()), int(f["ts"].min()))
                tables.append(pa.Table.from_pandas(f, _ARROW, preserve_index=False))
                if sum(map(len, tables)) >= _SORTED:
                    keys, tables = self._wait(pa.concat_tables(tables), keys), []
        if tables:
            keys = self._wait(pa.concat_tables(tables), keys)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from self._take(now, keys)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._take(timerValues.getCurrentWatermarkInMs() * 1000, self._keys())

    def close(self) -> None:
        pass

    def _keys(self) -> list[tuple]:
        return [tuple(k) for k in self.waiting.keys()]

    def _wait(self, table: pa.Table, keys: list[tuple]) -> list[tuple]:
        """Writes the rows in pieces by time; the keys of all pieces."""
        table, n, out = table.sort_by("ts"), 1 + max((k[1] for k in keys), default=0), list(keys)
        for i in range(0, len(table), _PIECE):
            piece = table.slice(i, _PIECE)
            out.append((piece["ts"][0].as_py(), n + i // _PIECE))
            self.waiting.updateValue(out[-1], (_packed(piece),))
        return out

    def _take(self, now: int, keys: list[tuple]) -> Iterator[pd.DataFrame]:
        read, left = [k for k in keys if k[0] <= now], [k for k in keys if k[0] > now]
        if not read:
            return
        rows = _unpacked([self.waiting.getValue(k)[0] for k in read])
        if left:
            for k in read:
                self.waiting.removeKey(k)
        else:
            self.waiting.clear()
        rest, due = rows.filter(pc.greater(rows["ts"], now)), rows.filter(pc.less_equal(rows["ts"], now))
        if len(rest):
            left = self._wait(rest, left)
        if left:
            self.handle.registerTimer(min(k[0] for k in left) // 1000 + 1)
        # text columns as numbers into their distinct values
        kind, kind_of = _numbered(due["kind"])
        rank = np.array([CONTROLS.index(k) if k in CONTROLS else _SAMPLE if k == "sample" else _SAMPLE - 1 for k in kind], dtype="int8")[kind_of]
        order = pc.sort_indices(pa.table({"ts": due["ts"], "rank": rank, "id": pc.fill_null(due["id"], "")}), sort_keys=[(c, "ascending") for c in ("ts", "rank", "id")])
        due, rank = due.select(["ts", "service", "operation", "latency_ms", "failed"]).take(order), rank[order.to_numpy()]
        state, cycle, seq = self.phase.get() if self.phase.exists() else ("empty", 0, 0)
        held: dict[tuple, list] = {}
        touched: dict[tuple, tuple[int, int]] = {}

        def every() -> list[tuple]:
            return list({*(tuple(k) for k in self.operations.keys()), *held})

        def get(k: tuple) -> list:
            if k not in held:
                v = self.operations.getValue(k) if self.operations.containsKey(k) else None
                held[k] = [list(v[0]), list(v[1]), *v[2:]] if v is not None else [[], [], None, None, None, None]
            return held[k]

        ts, latency = due["ts"].to_numpy(), due["latency_ms"].to_numpy().astype(float)
        failed = pc.fill_null(due["failed"], False).to_numpy().astype(bool)  # null is not failed
        services, codes = _numbered(due["service"])
        names, more = _numbered(due["operation"])
        used, codes = np.unique(codes.astype("int64") * len(names) + more, return_inverse=True)
        numbers: dict[tuple[str, str], int] = {}
        codes = np.array([numbers.setdefault((services[u // len(names)].strip(), names[u % len(names)].strip()), len(numbers)) for u in used.tolist()], dtype=int)[codes]
        operations = list(numbers)
        named = np.array([bool(k[0]) and bool(k[1]) for k in operations], dtype=bool)
        counts = (rank == _SAMPLE) & named[codes] & (latency >= 0)
        at, starts = _effective(state, [(i, CONTROLS[rank[i]]) for i in np.flatnonzero(rank < len(CONTROLS)).tolist()])
        start = at[0][0] if starts else 0  # a start clears all that was before it
        for stop, kind in [*at, (len(due), None)]:
            take = start + np.flatnonzero(counts[start:stop]) if state != "empty" else np.empty(0, dtype=int)
            if len(take):
                most = A.KEEP_CURRENT if state == "frozen" else A.KEEP_BASELINE
                take = take[np.argsort(codes[take], kind="stable")]
                cuts = np.flatnonzero(np.diff(codes[take])) + 1
                for group in np.split(take, cuts):
                    k, last = operations[codes[group[0]]], group[-most:]
                    v = get(k)
                    v[0], v[1] = [*v[0], *latency[last].tolist()][-most:], [*v[1], *failed[last].tolist()][-most:]
                    if state == "frozen":
                        touched[k] = (seq + int(group[-1]) + 1, int(ts[group[-1]]))
            if kind is None:
                break
            mark = (seq + stop + 1, int(ts[stop]))
            if kind == "start":
                state, cycle = "collecting", cycle + starts
                self.operations.clear()
                held.clear()
                touched.clear()
            elif kind == "freeze":
                state = "frozen"
                for k in every():
                    v = get(k)
                    log = np.log1p(v[0])
                    held[k] = [[], [], len(v[0]), sum(v[1]), _median(log), max(A.LEAST_SCALE, 1.4826 * _median(np.abs(log - _median(log))))]
                    touched[k] = mark
            elif kind == "reset":
                for k in every():
                    v = get(k)
                    v[0], v[1] = [], []
                    touched[k] = mark
            start = stop + 1
        self.phase.update((state, cycle, seq + len(due)))
        for k, v in held.items():
            self.operations.updateValue(k, tuple(v))
        out = [(*k, *touched[k], cycle, *self._result(get(k))) for k in touched] if state == "frozen" else []
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    @staticmethod
    def _result(v: list) -> tuple:
        latency, failed, n, errors, middle, scale = v
        m, state, lz, ez = len(latency), "ready", 0.0, 0.0
        if (n or 0) < A.LEAST_BASELINE:
            state = "insufficient_baseline"
        elif m < A.LEAST_CURRENT:
            state = "insufficient_current_data"
        else:
            lz = max(0.0, (_median(np.log1p(latency)) - middle) / scale)
            p = (errors + sum(failed)) / (n + m)
            var = p * (1 - p) * (1 / n + 1 / m)
            ez = max(0.0, (sum(failed) / m - errors / n) / var**0.5) if var > 0 else 0.0
        return (state, n or 0, m, lz, ez, lz >= A.LATENCY_Z, ez >= A.ERROR_Z, max(lz / A.LATENCY_Z, ez / A.ERROR_Z))


def life_cycle(samples: DataFrame, controls: DataFrame, delay: str = "1 minute", shards: int = 64) -> DataFrame:
    """Results of the first detector while controls (ts, kind) start the baseline, freeze it and reset the current samples.

    samples: ts, id, service, operation, latency_ms, failed. Operations are dealt out to shards, of which each gets every control:
    the state of a shard holds the life cycle and its operations' samples, at most the last 1000 while collecting, then a
    baseline that no sample moves and the last 20. Samples before the first start, without names or of negative latency count
    nowhere; a freeze while nothing is collected does nothing, and so do other kinds than CONTROLS, which only let time go on. Emits (RESULT) the operations that a batch has touched once
    the baseline is frozen; of an operation the row of largest seq holds.

    The session needs the RocksDB state store (STORE). Output mode update.
    """
    shard = F.pmod(F.xxhash64(F.trim("service"), F.trim("operation")), F.lit(shards)).cast("int")
    # numbers in texts of the same order
    number = samples.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    i = F.lpad(F.hex(F.col("id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0") if number else F.col("id").cast("string")
    s = samples.select(shard.alias("shard"), "ts", F.lit("sample").alias("kind"), i.alias("id"), "service", "operation", F.col("latency_ms").cast("double").alias("latency_ms"), "failed")
    c = controls.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ts", "kind", F.lit("").alias("id"), F.lit("").alias("service"), F.lit("").alias("operation"), F.lit(0.0).alias("latency_ms"), F.lit(False).alias("failed"),
    )
    both = s.unionByName(c).withWatermark("ts", delay)
    return both.groupBy("shard").transformWithStateInPandas(LifeCycle(), RESULT, "Update", "EventTime")


def phases(controls: DataFrame) -> DataFrame:
    """The life cycle that a whole list of controls (ts, kind) leaves, as one row: start (of the last baseline), freeze (its end,
    null if it is still open), current_from (the freeze or a later reset)."""
    start = controls.agg(F.max(F.when(F.col("kind") == "start", F.col("ts"))).alias("start"))
    j = controls.join(start, F.lit(True))
    g = j.groupBy("start").agg(F.min(F.when((F.col("kind") == "freeze") & (F.col("ts") >= F.col("start")), F.col("ts"))).alias("freeze"), F.max(F.when(F.col("kind") == "reset", F.col("ts"))).alias("reset"))
    return g.select("start", "freeze", F.when(F.col("freeze").isNotNull(), F.greatest("freeze", F.coalesce("reset", "freeze"))).alias("current_from"))


def phase(ts: Column) -> Column:
    """A sample's phase next to a row of phases(): null before the start and between freeze and reset."""
    collecting = (ts >= F.col("start")) & (F.col("freeze").isNull() | (ts < F.col("freeze")))
    return F.when(collecting, "baseline").when(ts >= F.col("current_from"), "current")


# ---- links -----------------------------------------------------------------------------------------------------------------------


class Links(StatefulProcessor):
    """Per bucket of traces: pieces of rows, each what a batch has brought that was not known. A batch reads the buckets of its traces,
    takes all their rows in one go and writes what is new in it, not the whole trace. A trace goes once nothing has come for
    `keep_ms`: it counts no longer, and its rows are dropped with others when they are half of the bucket."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "rows binary")
        self.past = handle.getValueState("past", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, new = timerValues.getCurrentWatermarkInMs(), pd.concat(list(rows), ignore_index=True)
        if new.empty:
            return
        new = new.assign(ts=new["ts"].astype("datetime64[us]").astype("int64"), is_span=True)[_LINK_NAMES[:-1]]
        new["until"] = np.maximum(new["ts"] // 1000, now) + self.keep_ms
        old, gone = self._read()
        if gone.any():
            if old["trace_id"][gone].isin(new["trace_id"]).any():  # a trace that starts anew
                self.pieces.clear()
                self._write(old[~gone])
            old = old[~gone]
        every = pd.concat([old, new], ignore_index=True) if len(old) else new
        fresh = np.arange(len(every)) >= len(old)
        trace = pd.factorize(every["trace_id"], use_na_sentinel=False)[0].astype("int64")
        ids = pd.factorize(pd.concat([every["span_id"], every["parent_span_id"]], ignore_index=True), use_na_sentinel=False)[0].astype("int64")
        span, parent = trace * len(ids) + ids[: len(every)], trace * len(ids) + ids[len(every) :]
        named = (every["parent_span_id"].notna() & (every["parent_span_id"] != "")).to_numpy(dtype=bool)
        # a span counts as it came first
        first = np.flatnonzero(every["is_span"].to_numpy(dtype=bool))
        first = first[~pd.Series(span[first]).duplicated().to_numpy()]
        children = first[named[first]]
        at = pd.Index(span[first]).get_indexer(parent[children])
        children, parents = children[at >= 0], first[at[at >= 0]]
        service = every["service"].astype(object).where(every["service"].notna(), None).to_numpy()
        out = (fresh[children] | fresh[parents]) & (service[children] != service[parents]).astype(bool)
        children, parents = children[out], parents[out]
        # what stays: new spans, and for a trace without one a row that tells until when it is kept
        until = pd.Series(every["until"].to_numpy()).groupby(trace).transform("max").to_numpy()
        had = pd.Series(np.where(fresh, -1, every["until"])).groupby(trace).transform("max").to_numpy()
        keep = np.zeros(len(every), dtype=bool)
        keep[first] = fresh[first]
        longer = np.flatnonzero(fresh & (until > had) & ~np.isin(trace, trace[keep]))
        longer = longer[~pd.Series(trace[longer]).duplicated().to_numpy()]
        is_span = keep.copy()
        keep[longer] = True
        self._write(every.assign(until=until, is_span=is_span)[keep])
        self._wake(int(until.min()))
        if len(children):
            yield pd.DataFrame({"trace_id": every["trace_id"].to_numpy()[children], "source": service[parents], "target": service[children], "ts": pd.to_datetime(every["ts"].to_numpy()[children], unit="us")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.past.update((timerValues.getCurrentWatermarkInMs(),))
        self.timer.clear()
        rows, gone = self._read()
        if 2 * gone.sum() >= len(rows):
            self.pieces.clear()
            self._write(rows[~gone])
        if gone.all():
            self.past.clear()
        else:
            self._wake(int(rows[~gone].groupby("trace_id", dropna=False)["until"].max().min()))
        return iter(())

    def close(self) -> None:
        pass

    def _read(self) -> tuple[pd.DataFrame, np.ndarray]:
        """All rows, and which of them are of traces that are gone."""
        pieces = [p[0] for p in self.pieces.get()] if self.pieces.exists() else []
        rows = (_unpacked(pieces) if pieces else _LINK.empty_table()).to_pandas()
        past = self.past.get()[0] if len(rows) and self.past.exists() else None
        gone = rows.groupby("trace_id", dropna=False)["until"].transform("max") < past if past is not None else np.zeros(len(rows), dtype=bool)
        return rows, np.asarray(gone, dtype=bool)

    def _write(self, rows: pd.DataFrame) -> None:
        for i in range(0, len(rows), _PIECE):
            self.pieces.appendValue((_packed(pa.Table.from_pandas(rows.iloc[i : i + _PIECE], _LINK, preserve_index=False)),))

    def _wake(self, due: int) -> None:
        """Timers fire no later than the first trace goes; one that fires too early is set again."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or due < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.timer.update((due,))


def kept_links(spans: DataFrame, delay: str = "10 minutes", keep_ms: int = 600_000, buckets: int = 1024) -> DataFrame:
    """(trace_id, source, target, ts) of calls between services, each child once, whichever of child and parent comes first.

    A trace is kept until the watermark is `keep_ms` past its last update (the latest time that has come for it): a span that
    comes later starts the trace anew. Traces are dealt out to buckets, each of which is read as a whole by a batch that brings
    something for it. spans: trace_id, span_id, parent_span_id, service, ts. Needs the RocksDB state store.
    """
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int").alias("bucket")
    s = spans.select(bucket, "trace_id", "span_id", "parent_span_id", "service", "ts").withWatermark("ts", delay)
    return s.groupBy("bucket").transformWithStateInPandas(Links(keep_ms), "trace_id string, source string, target string, ts timestamp", "Append", "EventTime")
