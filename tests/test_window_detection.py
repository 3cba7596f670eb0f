"""The second detector looks at observations that are derived once, and sorts the current ones once."""

import random

import numpy as np
import pytest

from tracegrid.operators import anomaly as A
from tracegrid.plans import registry

DIR = "/root/testdata/sf0.001"


def test_observations_once(spark):
    df = registry.QUERIES["ano15_window_detection"](spark, DIR)
    files = df.inputFiles()
    assert files and not [f for f in files if f.startswith(f"file://{DIR}")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in "".join(line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_windows_against_loops(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for key, n in (("a", 4), ("b", 9), ("c", 57)):
        x = [rng.choice([0.0, 0.5, rng.uniform(0, 9)]) for _ in range(n)]
        bad = [rng.choice([True, False, None]) for _ in range(n)]
        rows += [(key, i, x[i], bad[i], 3, 40) for i in range(n)]
        for i in range(n):
            for w in A.SCALES:
                full = i + 1 >= w
                want[key, i, w] = (float(np.quantile(x[i + 1 - w : i + 1], 0.5)), float(np.quantile(x[i + 1 - w : i + 1], 0.9)), [b for b in bad[i + 1 - w : i + 1] if b is not None]) if full else (None, None, [])
    df = spark.createDataFrame(rows, "key string, idx int, residual double, failed boolean, base_errors long, base_samples long")
    got = A.rolling_features(df, ["key"]).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*df.columns, *A.CHANNELS}
    for r in got:
        for w in A.SCALES:
            loc, tail, known = want[r.key, r.idx, w]
            assert r[f"loc_{w}"] == (loc if loc is None else pytest.approx(loc)) and r[f"tail_{w}"] == (tail if tail is None else pytest.approx(tail))
            assert (r[f"err_{w}"] is None) == (not known)
            if known:
                p = (3 + sum(known)) / (40 + len(known))
                assert r[f"err_{w}"] == pytest.approx(max(0.0, (sum(known) / len(known) - 3 / 40) / (p * (1 - p) * (1 / 40 + 1 / len(known))) ** 0.5))
