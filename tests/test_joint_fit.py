"""The joint Huber fit against a minimiser that shares nothing with it."""

from __future__ import annotations

import numpy as np
import pytest

from tracegrid.operators import diagnosis as D
from tracegrid.operators import metrics as M


def objective(p, x, y, eps=1.35):
    a, b, s = p
    r = np.abs(y - a * x - b)
    inside = r <= eps * s
    return len(x) * s + (r[inside] ** 2).sum() / s + (2 * eps * r[~inside] - eps * eps * s).sum()


def minimise(x, y):
    """Pattern search: steps in many directions that shrink when none helps; slow, but it only looks at values."""
    rng = np.random.default_rng(0)
    a, b = np.polyfit(x, y, 1)
    p = np.array([a, b, np.std(y - a * x - b) + 1e-9])
    best, step = objective(p, x, y), np.array([abs(a) + 0.1, abs(b) + 0.1, p[2]])
    while step.max() > 1e-13 * (1 + np.abs(p).max()):
        q = p + step * np.vstack([np.eye(3), -np.eye(3), rng.normal(size=(60, 3))])
        q = q[q[:, 2] > 0]
        v = [objective(z, x, y) for z in q]
        k = int(np.argmin(v))
        if v[k] < best:
            p, best = q[k], v[k]
        else:
            step = step * 0.7
    return p


@pytest.mark.parametrize("seed", [1, 2])
def test_line_and_scale_are_the_joint_minimum(spark, seed):
    rng, rows, want = np.random.default_rng(seed), [], {}
    for g, (slope, noise, share) in enumerate([(2.0, 0.1, 0.0), (-0.5, 1.0, 0.1), (0.0, 2.0, 0.3), (100.0, 5.0, 0.2), (3.0, 0.01, 0.4)]):
        n = int(rng.integers(5, 60))
        x = rng.choice([6.0, 18.0, 40.0], n) + rng.normal(0, 1, n)
        y = slope * x + 1000 * (g == 3) + rng.normal(0, noise, n) + (rng.random(n) < share) * rng.normal(0, 40, n)
        rows += [(f"g{g}", float(a), float(b)) for a, b in zip(x, y, strict=True)]
        want[f"g{g}"] = (x, y)
    got = {r.k: r for r in M.huber_line(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).collect()}
    assert len(got) == 5
    for k, (x, y) in want.items():
        r = got[k]
        least = objective(minimise(x, y), x, y)
        mine = objective((r.slope, r.intercept, r.sigma), x, y)
        assert mine <= least * (1 + 1e-7)
        # a minimum: no small step in any direction is lower
        for d in np.vstack([np.eye(3), -np.eye(3)]) * 1e-5:
            q = np.array([r.slope, r.intercept, r.sigma]) * (1 + d) + d * 1e-3
            assert objective(q, x, y) >= mine * (1 - 1e-12)
        p = minimise(x, y)
        at = x.mean()
        assert abs((r.slope * at + r.intercept) - (p[0] * at + p[1])) <= 1e-4 * (1 + r.sigma) and r.slope == pytest.approx(p[0], abs=1e-4 * (1 + r.sigma))


def test_load_is_taken_off(spark):
    """value = 2 load, at loads of 6 and 18, with a few bad points: the baseline has a slope above 1.5 and foresees a third load."""
    rng = np.random.default_rng(4)
    x = np.repeat([6.0, 18.0], 40)
    y = 2 * x + rng.normal(0, 0.2, 80) + 500 * (np.arange(80) % 16 == 0)
    points = spark.createDataFrame([("s", "cpu", float(a), float(b)) for a, b in zip(x, y, strict=True)], "service string, family string, x double, value double")
    base = D.workload_baseline(points)
    r = base.first()
    assert r.slope == pytest.approx(2, abs=0.1) and r.samples == 80
    current = spark.createDataFrame([("s", "cpu", 30.0, 60.0 + d) for d in (0.0, 0.05, -0.05)], "service string, family string, x double, value double")
    assert D.metric_residual_shift(current, base).first().shift < 6
    assert D.metric_residual_shift(current.withColumn("value", current["value"] + 30), base).first().shift > 20


def test_exact_lines_and_two_points(spark):
    rows = [("e", float(i), 3.0 * i + 1) for i in range(10)] + [("t", 1.0, 5.0), ("t", 2.0, 7.0)]
    got = {r.k: (r.slope, r.intercept) for r in M.huber_line(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).collect()}
    assert got["e"] == pytest.approx((3, 1), abs=1e-6) and got["t"] == pytest.approx((2, 3), abs=1e-6)
