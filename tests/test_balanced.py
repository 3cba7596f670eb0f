"""Balanced folds, the paired bootstrap and overlaps with dependencies against plain recomputations."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tracegrid.operators import evaluation as E
from tracegrid.operators import spans as S


def fraction(*parts) -> float:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


@pytest.mark.parametrize("block", [1_000_000, 7, 1])
def test_folds_balance_unequal_clusters(spark, block):
    rng = random.Random(3)
    sizes = {f"c{i}": rng.choice([1, 2, 3, 50, 200]) for i in range(40)} | {None: 5}
    df = spark.createDataFrame([(c, i) for c, n in sizes.items() for i in range(n)], "cluster string, id int")
    got = {(r.cluster, r.fold): r["count"] for r in E.grouped_folds(df, "cluster", 4, 9, block).groupBy("cluster", "fold").count().collect()}
    want, loads = {}, [0] * 4
    for c in sorted(sizes, key=lambda c: (fraction(9, c or ""), c or "")):
        fold = min(range(4), key=lambda f: (loads[f], f))
        want[c, fold] = sizes[c]
        loads[fold] += sizes[c]
    assert got == want


def test_folds_of_nothing(spark):
    assert E.grouped_folds(spark.createDataFrame([], "cluster string, id int"), "cluster", 4, 9).count() == 0


@pytest.mark.parametrize("n", [1, 3, 400])
def test_paired_bootstrap_is_the_loop(spark, n):
    rng = random.Random(n)
    rank = lambda: rng.choice([None, 0, 1, 1, 2, 3, 7])
    rows = [(f"i{k}", rank(), rank()) for k in range(n)]
    got = {r.metric: (r.difference, r.low, r.high) for r in E.paired_bootstrap(spark.createDataFrame(rows, "incident_id string, rank_a int, rank_b int"), 60, 5).collect()}
    order = sorted(((a, b) for _, a, b in rows), key=lambda p: tuple((x is None, x or 0) for x in p))
    score = {"ac1": lambda x: float(x == 1), "mrr": lambda x: 1 / x if x and x > 0 else 0.0}
    for metric, f in score.items():
        samples = []
        for b in range(60):
            at = [math.floor(fraction(5, b, j) * n) for j in range(n)]
            samples.append(sum(f(order[k][0]) - f(order[k][1]) for k in at) / n)
        samples.sort()
        want = (sum(f(a) - f(b) for a, b in order) / n, samples[round(59 * 0.025)], samples[round(59 * 0.975)])
        assert got[metric] == pytest.approx(want, abs=1e-12), metric


def test_paired_bootstrap_of_nothing(spark):
    assert E.paired_bootstrap(spark.createDataFrame([], "incident_id string, rank_a int, rank_b int"), 60).collect() == []


def overlap(spans: list[tuple], service: str) -> dict:
    """Summary of one service's entries, walked span by span."""
    by = {(i, t, s): row for row in spans for i, t, s in [row[:3]]}
    below = {}
    for row in spans:
        below.setdefault((row[0], row[1], row[3]), []).append(row)
    ratios, residuals, n = [], [], {"entries": 0, "boundaries": 0, "missing_parents": 0, "clipped": 0}
    for i, t, s, p, own, a, d in spans:
        parent = by.get((i, t, p))
        if own != service or parent and parent[4] == own:
            continue
        pending, cover, met = list(below.get((i, t, s), [])), set(), 0
        while pending:
            c = pending.pop()
            if c[4] == own:
                pending += below.get((i, t, c[2]), [])
                continue
            met += 1
            n["clipped"] += c[5] < a or c[5] + c[6] > a + d
            cover |= set(range(max(a, c[5]), min(a + d, c[5] + c[6])))
        n["entries"] += 1
        n["boundaries"] += met > 0
        n["missing_parents"] += bool(p) and parent is None
        ratios.append(len(cover) / max(d, 1))
        residuals.append(d - len(cover))
    q = lambda v, at: float(np.quantile(v, at)) if v else 0.0
    return n | {"overlap_median": q(ratios, 0.5), "overlap_p90": q(ratios, 0.9), "overlap_iqr": q(ratios, 0.75) - q(ratios, 0.25), "residual_median": q(residuals, 0.5), "residual_p90": q(residuals, 0.9)}


SPANS = "incident_id string, trace_id string, span_id string, parent_span_id string, service string, start_us long, duration_us long"


def traces(seed: int) -> list[tuple]:
    """Random trees, some parents lost, under trace ids that two incidents share."""
    rng, rows = random.Random(seed), []
    for incident in "xy":
        for t in range(12):
            for s in range(rng.randrange(1, 14)):
                p = rng.choice([None, "", "gone"]) if s == 0 or rng.random() < 0.1 else f"s{rng.randrange(s)}"
                rows.append((incident, f"t{t}", f"s{s}", p, rng.choice("abc"), rng.randrange(60), rng.randrange(40)))
    return rows


def test_overlap_is_the_walk(spark):
    now, before = traces(1), [r for r in traces(2) if not (r[0] == "y" and r[4] == "b")]
    services = spark.createDataFrame([(i, s) for i in "xy" for s in "abcd"], "incident_id string, service string")
    of = lambda rows: S.dependency_overlap(spark.createDataFrame(rows, SPANS), ["incident_id"], services)
    current, healthy = of(now), of(before)
    want = lambda rows, i, s: overlap([r for r in rows if r[0] == i], s)
    for df, rows in ((current, now), (healthy, before)):
        for r in df.collect():
            w = want(rows, r.incident_id, r.service)
            assert {k: r[k] for k in w} == pytest.approx(w), (r.incident_id, r.service)
    got = S.overlap_deviation(current, healthy, ["incident_id"]).collect()
    assert len(got) == 8
    for r in got:
        c, h = want(now, r.incident_id, r.service), want(before, r.incident_id, r.service)
        both, scale = c["entries"] > 0 and h["entries"] > 0, max(0.01, h["overlap_iqr"])
        shift = lambda k: (c[k] - h[k]) / scale if both else 0.0
        ratio = lambda k: math.log1p(c[k]) - math.log1p(h[k]) if both else 0.0
        assert (r.comparable, r.entry_observed, r.healthy_observed) == (both, c["entries"] > 0, h["entries"] > 0)
        assert (r.overlap_shift, r.overlap_p90_shift, r.residual_log_ratio, r.residual_p90_log_ratio) == pytest.approx((shift("overlap_median"), shift("overlap_p90"), ratio("residual_median"), ratio("residual_p90")))
        assert (r.overlap_median, r.boundary_support, r.missing_parent_ratio) == pytest.approx((c["overlap_median"], c["boundaries"] / max(1, c["entries"]), c["missing_parents"] / max(1, c["entries"])))
    assert {(r.incident_id, r.service) for r in got if not r.comparable} >= {("y", "b"), ("x", "d"), ("y", "d")}
