"""The listwise ranker against plain loops, on data that a linear ranker cannot rank, and nested validation without leaks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import boosting as G
from tracegrid.operators import learn as L

FEATURES = ["a", "b"]


def planted(spark, incidents: int, seed: int):
    """The root cause is where a is small in size; noise elsewhere: no monotone function of a or b finds it."""
    rng, rows = random.Random(seed), []
    for i in range(incidents):
        n = rng.randint(3, 7)
        root = rng.randrange(n)
        for k in range(n):
            a = rng.uniform(-0.3, 0.3) if k == root else rng.choice([-1, 1]) * rng.uniform(0.35, 2)
            rows.append((f"i{i}", "d", f"s{k}", int(k == root), a, rng.random(), f"c{i % 17}"))
    return spark.createDataFrame(rows, "incident_id string, dataset string, service string, label int, a double, b double, cluster string").repartition(4)


def plain_gradients(rows, top):
    """One list: (service, label, score) -> service: (g, h), pair by pair."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(order)}
    out = {r[0]: [0.0, 0.0] for r in rows}
    for s, label, x in rows:
        for t, other, y in rows:
            if label == 1 and other == 0 and (not top or min(rank[s], rank[t]) <= top):
                w = abs(1 / math.log2(1 + rank[s]) - 1 / math.log2(1 + rank[t]))
                rho = 1 / (1 + math.exp(x - y))
                for k, sign in ((s, -1), (t, 1)):
                    out[k][0] += sign * rho * w
                    out[k][1] += rho * (1 - rho) * w
    return out


@pytest.mark.parametrize("top", [0, 2])
def test_gradients_equal_a_loop_over_pairs(spark, top):
    rng = random.Random(7)
    rows = [(m, f"l{i}", f"s{k}", int(k == i % 5), rng.choice([0.0, 1.0, rng.random()])) for m in "xy" for i in range(9) for k in range(5)]
    got = G.gradients(spark.createDataFrame(rows, "model string, list string, service string, label int, score double"), top).collect()
    for m in "xy":
        for i in range(9):
            want = plain_gradients([r[2:] for r in rows if r[:2] == (m, f"l{i}")], top)
            for r in got:
                if (r.model, r.list) == (m, f"l{i}"):
                    assert (r.g, r.h) == pytest.approx(tuple(want[r.service]), abs=1e-12)
    assert abs(sum(r.g for r in got)) < 1e-9


def test_histograms_and_splits_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [("m", rng.randrange(2), rng.uniform(-1, 1), rng.random(), [rng.randrange(4), rng.randrange(4)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "model string, node int, g double, h double, bins array<int>")
    got = {(r.node, r.feature, r.bin): (r.g, r.h) for r in G.histograms(df).collect()}
    for node in (0, 1):
        gh = np.zeros((2, 2, 4))
        for f in range(2):
            for b in range(4):
                own = [r for r in rows if r[1] == node and r[4][f] == b]
                gh[:, f, b] = sum(r[2] for r in own), sum(r[3] for r in own)
                assert got[node, f, b] == pytest.approx(tuple(gh[:, f, b]))
        s, best = G.Setting(child=20.0), None
        for f in range(2):
            for b in range(3):
                lg, lh, rg, rh = gh[0, f, : b + 1].sum(), gh[1, f, : b + 1].sum(), gh[0, f, b + 1 :].sum(), gh[1, f, b + 1 :].sum()
                gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (lg + rg) ** 2 / (lh + rh + 1)
                if min(lh, rh) >= 20 and gain > 1e-12 and (best is None or gain > best[2] + 1e-12):
                    best = (f, b, gain)
        assert best and G.best_split(gh[0], gh[1], s) == (best[0], best[1], pytest.approx(best[2]))


def test_better_than_the_pairwise_model_where_it_is_not_linear(spark):
    train, test = planted(spark, 120, 1), planted(spark, 60, 2)
    forest = G.fit(train, FEATURES, G.Setting(depth=2, eta=0.5, rounds=6))
    scored = G.score(test, FEATURES, forest)
    listwise, pairwise = L.accuracy(scored), L.accuracy(L.fit(train, FEATURES).score(test))
    assert listwise["mrr"] > 0.95 > 0.8 > pairwise["mrr"]
    # the scores are those of a walk through the trees
    for r in scored.limit(20).collect():
        want = 0.0
        for feature, threshold, value in forest:
            i = 0
            while feature[i] >= 0:
                i = 2 * i + 1 + int((r.a, r.b)[feature[i]] > threshold[i])
            want += value[i]
        assert r.model_score == pytest.approx(want, abs=1e-12)


def test_several_root_causes_make_a_list_each(spark):
    df = spark.createDataFrame([("i", "d", "x", 1), ("i", "d", "y", 1), ("i", "d", "z", 0), ("j", "d", "x", 0)], "incident_id string, dataset string, service string, label int")
    got = sorted((r.list[-1], r.service) for r in G.lists(df, ["incident_id", "dataset"]).collect())
    assert got == [("x", "x"), ("x", "z"), ("y", "y"), ("y", "z")]


def test_models_trained_together_equal_those_trained_alone(spark):
    df = planted(spark, 30, 5)
    s = {"p": G.Setting(depth=1, rounds=2, eta=0.3), "q": G.Setting(depth=2, rounds=1, top=0)}
    both = G.fit_many(df.withColumn("model", F.explode(F.array(F.lit("p"), F.lit("q")))), FEATURES, s)
    for m in s:
        alone = G.fit(df, FEATURES, s[m])
        for t, u in zip(both[m], alone, strict=True):
            assert t[0] == u[0] and t[1] == u[1] and t[2] == pytest.approx(u[2], abs=1e-9)


def test_nested_choices_never_saw_their_fold(spark):
    df = planted(spark, 60, 9)
    settings = {"flat": G.Setting(depth=1, rounds=1, eta=0.01), "deep": G.Setting(depth=2, rounds=3, eta=0.5)}
    n = G.nested(df, FEATURES, "cluster", settings, outer=3, inner=2)
    out = n.predictions.cache()
    assert out.count() == df.count() and {c["setting"] for c in n.chosen} == {"deep"} and len(n.chosen) == 3
    # no prediction of a model that was trained on its incident, inner or outer (SPL-08)
    assert L.oof_provenance(out.select("model", "incident_id"), n.provenance).count() == 0
    fold = {r.cluster: r.fold for r in out.select("cluster", "fold").distinct().collect()}
    cluster = {r.incident_id: r.cluster for r in df.select("incident_id", "cluster").distinct().collect()}
    for r in n.provenance.collect():
        o = int(r.model.removeprefix("outer-").split("/")[0])
        assert fold[cluster[r.incident_id]] != o
    # the outer models by hand: trained on the other folds with the chosen setting
    o = n.chosen[0]["outer"]
    hand = G.score(out.filter(F.col("fold") == o).drop("model", "model_score"), FEATURES, G.fit(out.filter(F.col("fold") != o).drop("model", "model_score"), FEATURES, settings["deep"]))
    got = {(r.incident_id, r.service): r.model_score for r in out.filter(F.col("fold") == o).collect()}
    assert all(got[r.incident_id, r.service] == pytest.approx(r.model_score, abs=1e-9) for r in hand.collect())
    assert L.accuracy(out)["mrr"] > 0.85
