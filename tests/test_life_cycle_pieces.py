"""The life cycle's waiting rows lie in pieces of their own; what comes out is that of a walk row by row, with ties as in SQL."""

import random

import pandas as pd
import pytest

from tests.test_life_cycle_cost import _Map, _Timer
from tests.test_links_cost import _Handle as _Plain
from tracegrid.streaming import state as Y
from tracegrid.streaming.drain import drained

COLUMNS = ["ts", "kind", "id", "service", "operation", "latency_ms", "failed"]


class _Pieces(_Map):
    removeKey = dict.__delitem__  # noqa: N815


class _Handle(_Plain):
    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, _Pieces())


def frame(rows):
    f = pd.DataFrame(rows, columns=COLUMNS)
    return f.assign(ts=pd.to_datetime(f["ts"], unit="s"))


def machine():
    m, handle = Y.LifeCycle(), _Handle()
    m.init(handle)
    return m, handle


def test_a_piece_is_an_entry_of_a_short_time(monkeypatch):
    monkeypatch.setattr(Y, "_PIECE", 100)
    m, handle = machine()
    rows = [(t, "sample", str(t), "s", "o", 1.0, False) for t in range(1, 2001)]
    random.Random(1).shuffle(rows)
    assert not list(m.handleInputRows((0,), iter([frame(rows[:700]), frame(rows[700:])]), _Timer(0)))
    waiting = handle.states["waiting"]
    assert len(waiting) == 20 and max(len(Y._unpacked([v[0]])) for v in waiting.values()) == 100
    before = dict(waiting)
    assert not list(m.handleExpiredTimer((0,), _Timer(950_000), None))  # 950 rows are due
    assert len(waiting) == 11 and sum(before.get(k) is v for k, v in waiting.items()) == 10  # only the piece in between is written again
    assert sum(len(Y._unpacked([v[0]])) for v in waiting.values()) == 1050 and 951_000 <= min(t for t in handle.timers if t > 950_000) <= 951_001


def test_same_as_row_by_row(monkeypatch):
    monkeypatch.setattr(Y, "_PIECE", 7)
    monkeypatch.setattr(Y.A, "KEEP_BASELINE", 12)
    monkeypatch.setattr(Y.A, "KEEP_CURRENT", 5)
    monkeypatch.setattr(Y.A, "LEAST_BASELINE", 3)
    monkeypatch.setattr(Y.A, "LEAST_CURRENT", 2)
    rank = {"start": 0, "freeze": 1, "reset": 2, "tick": 3, "sample": 4}
    some = 0
    for seed in range(30):
        rng = random.Random(seed)
        m, _ = machine()
        waits, now, n = [], 0, 0
        state, cycle, seq, base, cur, frozen = "empty", 0, 0, {}, {}, {}
        for _ in range(12):
            rows = []
            for _ in range(rng.randrange(1, 60)):
                n, ts = n + 1, now + 1 + rng.randrange(20)
                if rng.random() < 0.15:
                    rows.append((ts, rng.choice(["start", "freeze", "reset", "tick"]), "", "", "", 0.0, False))
                else:
                    rows.append((ts, "sample", f"{n:04d}", rng.choice(["a", " a", "b", None]), rng.choice(["x", "y"]), rng.choice([1.0, 5.0, 9.0, -1.0, None]), rng.choice([True, False, None])))
            waits += rows
            got = [r for f in m.handleInputRows((0,), iter([frame(rows)]), _Timer(now * 1000)) for r in f.values.tolist()]
            assert not got
            now += rng.choice([3, 10, 30])
            got = sorted(tuple(r) for f in m.handleExpiredTimer((0,), _Timer(now * 1000), None) for r in f.values.tolist())
            due, waits = sorted((r for r in waits if r[0] <= now), key=lambda r: (r[0], rank[r[1]], r[2])), [r for r in waits if r[0] > now]
            touched = {}
            for ts, kind, _, service, operation, latency, failed in due:
                seq += 1
                k, mark = ((service or "").strip(), operation), (seq, ts * 1_000_000)
                if kind == "start":
                    state, cycle, base, cur, frozen, touched = "collecting", cycle + 1, {}, {}, {}, {}
                elif kind == "freeze" and state == "collecting":
                    state, frozen, cur = "frozen", base, {q: [] for q in base}
                    touched = dict.fromkeys(frozen, mark)
                elif kind == "reset" and state == "frozen":
                    touched, cur = dict.fromkeys(cur, mark), {q: [] for q in cur}
                elif kind == "sample" and all(k) and latency is not None and latency >= 0 and state != "empty":
                    kept, most = (base, 12) if state == "collecting" else (cur, 5)
                    kept[k] = [*kept.get(k, []), (latency, bool(failed))][-most:]
                    if state == "frozen":
                        touched[k] = mark
            want = []
            for k, mark in touched.items() if state == "frozen" else []:
                b = frozen.get(k)
                log = Y.np.log1p([x[0] for x in b]) if b else None
                middle = Y._median(log) if b else None
                v = [[x[0] for x in cur[k]], [x[1] for x in cur[k]], len(b) if b else None, sum(x[1] for x in b) if b else None, middle, max(Y.A.LEAST_SCALE, 1.4826 * Y._median(abs(log - middle))) if b else None]
                want.append((*k, *mark, cycle, *Y.LifeCycle._result(v)))
            assert got == sorted(want)
            some += len(want)
    assert some > 100


@pytest.mark.parametrize("order", [1, -1])
def test_controls_of_one_time(order):
    """A freeze at the time of a start ends that start's baseline, whichever came first."""
    m, _ = machine()
    rows = [(1, "start", "", "", "", 0.0, False), (5, "sample", "1", "s", "o", 1.0, False), *[(9, k, "", "", "", 0.0, False) for k in ("start", "freeze")[::order]], (10, "sample", "2", "s", "o", 1.0, False)]
    assert not list(m.handleInputRows((0,), iter([frame(rows)]), _Timer(0)))
    (out,) = m.handleExpiredTimer((0,), _Timer(20_000), None)
    assert out[["cycle", "baseline_samples", "current_samples"]].values.tolist() == [[2, 0, 1]]


def test_samples_of_one_time_go_by_number(spark, tmp_path):
    """The last 20 of those numbered 1 to 30 are 11 to 30, most of them slow, not those whose texts are the last."""
    rows = [(20, i, "s", "o", 1000.0 if 11 <= i <= 21 else 1.0, False) for i in range(1, 31)] + [(5, 100 + i, "s", "o", 1.0 + i % 3, False) for i in range(40)] + [(9000, -1, "end", "end", 1.0, False)]
    schema = "ts long, id long, service string, operation string, latency_ms double, failed boolean"
    spark.createDataFrame(rows, schema).selectExpr("timestamp_seconds(ts) AS ts", "id", "service", "operation", "latency_ms", "failed").coalesce(1).write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, "start"), (10, "freeze"), (9000, "none")], "ts long, kind string").selectExpr("timestamp_seconds(ts) AS ts", "kind").coalesce(1).write.parquet(f"{tmp_path}/c")
    stream = lambda x: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}")
    got = drained(Y.life_cycle(stream("s"), stream("c"), "1 minute", shards=2), "update").filter("service = 's'").orderBy("seq").collect()[-1]
    low, high = Y.np.log1p([2.0, 3.0])
    assert got.current_samples == 20 and got.latency_z == pytest.approx((Y.np.log1p(1000.0) - low) / (1.4826 * (high - low)))
