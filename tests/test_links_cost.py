"""Links of kept traces: what they cost, and the same as a walk span by span, in any batches, with copies and traces that go."""

import random

import pandas as pd

from tests.test_life_cycle_cost import _List, _Timer, _Value
from tracegrid.streaming import state as Y


class _Handle:
    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def _state(self, name, kind):
        handle = self

        class Counted(kind):
            def __getattribute__(self, x):
                if x in ("get", "exists", "update", "clear", "appendValue", "getValue", "containsKey", "updateValue"):
                    handle.calls += 1
                return super().__getattribute__(x)

        return self.states.setdefault(name, Counted())

    getListState = lambda self, name, *_: self._state(name, _List)  # noqa: E731, N815
    getValueState = lambda self, name, *_: self._state(name, _Value)  # noqa: E731, N815

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


def frame(rows):
    f = pd.DataFrame(rows, columns=["trace_id", "span_id", "parent_span_id", "service", "ts"])
    return f.assign(bucket=0, ts=pd.to_datetime(f["ts"], unit="s"))


def links(out):
    return [tuple(r) for f in out for r in f[["trace_id", "source", "target"]].values.tolist()]


def machine(keep_ms):
    m, handle = Y.Links(keep_ms), _Handle()
    m.init(handle)
    return m, handle


def test_calls_to_the_state_do_not_grow_with_traces():
    m, handle = machine(1000)
    rows = [(f"t{t}", f"s{i}", f"s{i - 1}" if i else None, f"v{i}", t) for t in range(3000) for i in range(4)]
    random.Random(1).shuffle(rows)
    assert len(links(m.handleInputRows((0,), iter([frame(rows[:5000]), frame(rows[5000:])]), _Timer(0)))) == 9000
    assert handle.calls < 20 and len(handle.timers) == 1


def test_same_as_span_by_span():
    keep = 30
    for seed in range(25):
        rng = random.Random(seed)
        m, handle = machine(keep * 1000)
        known, waiting, until, now, got, want = {}, {}, {}, 0, [], []
        for _ in range(40):
            rows = []
            for _ in range(rng.randrange(1, 12)):
                t = rng.choice(["a", "b", "c", "d", None])
                rows.append((t, f"s{rng.randrange(7)}", rng.choice([None, "", *(f"s{k}" for k in range(7))]), rng.choice(["x", "y", None]), now + rng.randrange(25)))
            cut = rng.randrange(len(rows))
            got += links(m.handleInputRows((0,), iter([frame(part) for part in (rows[:cut], rows[cut:]) if part]), _Timer(now * 1000)))
            for t, s, p, v, ts in rows:
                until[t] = max(until.get(t, 0), max(ts, now) + keep)
                if s in known.setdefault(t, {}):
                    continue
                known[t][s] = v
                want += [(t, v, c) for c in waiting.setdefault(t, {}).pop(s, []) if c != v]
                if p in known[t]:
                    want += [(t, known[t][p], v)] if known[t][p] != v else []
                elif p:
                    waiting[t].setdefault(p, []).append(v)
            now += rng.choice([0, 1, 5, 20, 60])
            while handle.timers and min(handle.timers) < now * 1000:
                handle.timers.discard(min(handle.timers))
                got += links(m.handleExpiredTimer((0,), _Timer(now * 1000), None))
            for t in [t for t in until if until[t] < now]:
                del until[t]
                known.pop(t, None)
                waiting.pop(t, None)
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and want
