"""What the life cycle's samples cost."""

import time
from datetime import timedelta

import pandas as pd

from tracegrid.streaming import state as Y


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class _List(_Value):
    def appendValue(self, x):  # noqa: N802
        self.v = [*(self.v or []), x]

    def appendList(self, xs):  # noqa: N802
        self.v = [*(self.v or []), *xs]

    put = _Value.update


class _Map(dict):
    updateValue, getValue, containsKey = dict.__setitem__, dict.__getitem__, dict.__contains__  # noqa: N815


class _Handle:
    def __init__(self):
        self.lists, self.values, self.maps = _List(), _Value(), _Map()

    getListState = lambda self, *_: self.lists  # noqa: E731, N815
    getValueState = lambda self, *_: self.values  # noqa: E731, N815
    getMapState = lambda self, *_: self.maps  # noqa: E731, N815
    registerTimer = lambda self, *_: None  # noqa: E731, N815


class _Timer:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_busy_operation_is_taken_in_one_go():
    n, zero = 300_000, pd.Timestamp("2024-01-01")
    f = pd.DataFrame({"ts": [zero + timedelta(milliseconds=10 * i) for i in range(n)], "kind": "sample", "id": [str(i) for i in range(n)], "service": "s", "operation": "o", "latency_ms": [float(i % 50) for i in range(n)], "failed": [i % 10 == 0 for i in range(n)]})
    control = lambda i, kind: pd.DataFrame({"ts": [zero + timedelta(milliseconds=10 * i)], "kind": [kind], "id": "", "service": "", "operation": "", "latency_ms": 0.0, "failed": False})
    machine, handle = Y.LifeCycle(), _Handle()
    machine.init(handle)
    began = time.process_time()
    assert list(machine.handleInputRows((0,), iter([f, control(0, "start"), control(n - 100, "freeze")]), _Timer(0))) == []
    (out,) = machine.handleExpiredTimer((0,), _Timer(zero.value // 1_000_000 + 10 * n), None)
    assert time.process_time() - began < 4  # a copy of all kept samples for each new one: several times that
    assert out[["baseline_samples", "current_samples", "state", "seq"]].values.tolist() == [[1000, 20, "ready", n + 2]]
