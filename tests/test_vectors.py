"""The vector of candidates against a plain recomputation, one incident and one service at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tracegrid.operators import vectors as V

RISING = {"error_rate", "latency_median_us", "latency_p90_us", "latency_p99_us", "exclusive_median_us", "downstream_wait_ratio"}
REST = ("last_seen_delta_s", "trace_coverage", "span_count", "request_count")
LINE = "slope double, intercept double, residual_median double, residual_iqr double, samples long"


def reached(start, edges):
    """Nodes that edges lead to from start, with the number of steps; start itself only by a cycle."""
    out, level, d = {}, {start}, 0
    while level:
        d += 1
        level = {t for s, t in edges if s in level} - set(out)
        out |= dict.fromkeys(level, d)
    return out


def plain(incident, services, points, summary, observed, metric_lines, trace_lines, expected):
    """service -> features of one incident; lines: key -> (slope, intercept, residual_median, residual_iqr)."""
    load, seconds = incident["load"] or 0.0, max((incident["end_us"] - incident["start_us"]) / 1e6, 1e-6)
    at = lambda line: line[1] + line[0] * load + line[2]
    collected = float(bool(incident["traces_collected"]))
    raw = {}
    for s in services:
        now = summary.get(s) or dict.fromkeys((*V.SIGNALS, *REST), 0.0) | {"last_seen_delta_s": seconds}
        families = {}
        for f in V.FAMILIES:
            values, line = [v for t, g, v in points if (t, g) == (s, f) and v is not None and math.isfinite(v)], metric_lines.get((s, f))
            if values and line:
                z = [abs((v - at(line)) / line[3]) for v in values]
                families[f] = (float(np.quantile(z, 0.9)), sum(x >= 3 for x in z) / len(z), 1.0)
            else:
                families[f] = (0.0, 0.0, 0.0)
        shifts = {}
        for n in V.SIGNALS:
            line = trace_lines.get((s, n))
            z = (now[n] - at(line)) / line[3] if line else 0.0
            shifts[n] = max(0.0, z) if n in RISING else abs(z)
        due = lambda n: max(0.0, at(trace_lines[s, n]) * seconds) if (s, n) in trace_lines else 0.0
        spans, requests = due("span_rate"), due("request_rate")
        outgoing, incoming, seen = {e for e in expected if e[0] == s}, {e for e in expected if e[1] == s}, {e for e in observed if e[0] == s}
        missing, ratio = len(outgoing - seen) / max(1, len(outgoing)), now["span_count"] / max(spans, 1.0)
        gone = float(spans >= 1 and ratio < 0.2)
        lost = min(1.0, 0.45 * max(0.0, 1 - ratio) + 0.35 * missing + 0.2 * gone) if spans >= 1 else 0.0
        most = max(x[0] for x in families.values())
        raw[s] = {
            "now": now, "families": families, "shifts": shifts, "spans": spans, "requests": requests, "missing": missing, "ratio": ratio, "gone": gone, "lost": lost, "most": most,
            "trace": max(shifts.values()), "score": max(most, max(shifts.values()), 6 * lost), "expects": bool(outgoing or incoming), "sees": bool(seen or incoming & observed),
        }
    hot = {s for s in services if raw[s]["score"] >= 3}
    every = expected | observed
    inner = {e for e in every if e[0] in raw and e[1] in raw}
    back = lambda edges: {(t, s) for s, t in edges}
    order = sorted(services, key=lambda s: (raw[s]["most"], s))
    mean = lambda v: sum(v) / len(v) if v else 0.0
    got = {}
    for s in services:
        r, now = raw[s], raw[s]["now"]
        up, down = set(reached(s, back(inner))), set(reached(s, inner))
        near = up | down
        p, q = len(near & hot) / max(1, len(hot)), len(near & hot) / max(1, len(near))
        far = lambda edges: sum(1 / d for t, d in reached(s, edges).items() if t in hot and t != s) / max(1, len(hot))
        top = sorted((x[0] for x in r["families"].values()), reverse=True)
        error = mean([raw[t]["now"]["error_rate"] for t in up])
        work = max(1.0, seconds * load)
        row = [x for f in V.FAMILIES for x in r["families"][f]]
        row += [top[0], top[1], sum(x[2] for x in r["families"].values()) / 4, order.index(s) / max(1, len(order) - 1)]
        row += [r["shifts"][n] for n in V.SIGNALS]
        row += [min(1.0, r["trace"] / 6), now["trace_coverage"], min(1.0, r["shifts"]["exclusive_median_us"] / 6), min(1.0, r["shifts"]["downstream_wait_ratio"] / 6)]
        row += [len(up & hot) / max(1, len(up)), len(down & hot) / max(1, len(down)), p, q, 2 * p * q / max(p + q, 1e-9), far(back(every)), far(every)]
        row += [r["score"] - mean([raw[t]["score"] for t in near]), error, mean([raw[t]["shifts"]["latency_p90_us"] for t in down]), len(near & hot) / max(1, len(hot | near))]
        row += [min(1.0, r["spans"] / work), min(1.0, now["span_count"] / work), min(2.0, r["ratio"]), max(0.0, 1 - now["span_count"] / max(r["spans"], 1.0)), max(0.0, 1 - now["request_count"] / max(r["requests"], 1.0))]
        row += [min(1.0, now["last_seen_delta_s"] / max(seconds, 1.0)), float(r["expects"]), float(r["sees"]), r["missing"], r["missing"] * bool(up), r["missing"] * error]
        row += [float(r["spans"] >= 1), float(now["span_count"] > 0), r["lost"], collected, r["gone"], float(bool(every)), math.log1p(len(services)), float(not any(x[2] for x in r["families"].values())), 1 - collected]
        got[s] = dict(zip(V.FEATURES, row, strict=True))
    return got


def made(seed: int):
    """Incidents in two environments: cycles, calls to services that are no candidates, silent services, missing lines."""
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(7)]
    line = lambda: (rng.choice([0.0, rng.uniform(-1, 1)]), rng.uniform(0, 6), rng.uniform(-0.2, 0.2), rng.uniform(0.2, 2))
    edge = lambda n: {(a, b) for a, b in ((rng.choice([*names, "outside"]), rng.choice([*names, "outside"])) for _ in range(n)) if a != b}
    world = {e: ({(s, f): line() for s in names for f in V.FAMILIES if rng.random() < 0.8}, {(s, n): line() for s in names for n in V.SIGNALS if rng.random() < 0.8}, edge(7)) for e in "ab"}
    incidents = {}
    for k in range(8):
        who = rng.sample(names, rng.randrange(1, 8))
        about = {"environment": "ab"[k % 2], "start_us": 1_000_000 * k, "end_us": 1_000_000 * k + rng.choice([0, 400_000, 60_000_000]), "load": rng.choice([None, 1.0, 4.0]), "traces_collected": (True, False, None)[k % 3]}
        points = [(rng.choice(who), rng.choice([*V.FAMILIES, "other"]), rng.choice([None, float("nan"), rng.uniform(0, 12), rng.uniform(0, 12), rng.uniform(0, 12)])) for _ in range(20)]
        summary = {s: {n: rng.uniform(0, 8) for n in V.SIGNALS} | {"last_seen_delta_s": rng.uniform(0, 90), "trace_coverage": 1.0, "span_count": float(rng.choice([0, 1, 30])), "request_count": float(rng.choice([0, 9]))} for s in who if rng.random() < 0.7}
        incidents[f"i{k}"] = (about, who, points, summary, edge(rng.choice([0, 3, 9])))
    return world, incidents


def frames(spark, world, incidents):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    healthy = V.Healthy(
        table([(e, s, f, *x, 9) for e, (m, _, _) in world.items() for (s, f), x in m.items()], f"environment string, service string, family string, {LINE}"),
        table([(e, s, n, *x, 9) for e, (_, t, _) in world.items() for (s, n), x in t.items()], f"environment string, service string, signal string, {LINE}"),
        table([(e, *x, 0.9) for e, (_, _, x_) in world.items() for x in x_ for _ in range(2)], "environment string, source string, target string, presence double"),
    )
    about = table([(i, a["environment"], a["start_us"], a["end_us"], a["load"], a["traces_collected"], "more") for i, (a, *_) in incidents.items()], "incident_id string, environment string, start_us long, end_us long, load double, traces_collected boolean, score string")
    services = table([(i, s, 1) for i, x in incidents.items() for s in [*x[1], None, x[1][0]]] + [("unknown", "s1", 1)], "incident_id string, service string, seconds int")
    points = table([(i, *p, 0.0) for i, x in incidents.items() for p in x[2]], "incident_id string, service string, family string, value double, x double")
    summary = table([(i, s, *(v[c] for c in (*V.SIGNALS, *REST))) for i, x in incidents.items() for s, v in x[3].items()], "incident_id string, service string, " + ", ".join(f"{c} double" for c in (*V.SIGNALS, *REST)))
    observed = table([(i, *e, 5) for i, x in incidents.items() for e in [*x[4], *list(x[4])[:1]]], "incident_id string, source string, target string, calls int")
    return about, services, points, summary, observed, healthy


@pytest.mark.parametrize("seed", [1, 2])
def test_every_feature_of_every_candidate(spark, seed):
    world, incidents = made(seed)
    df = V.candidate_vectors(*frames(spark, world, incidents), ["environment"])
    assert df.columns == ["incident_id", "service", *V.FEATURES] and len(V.FEATURES) == 59
    assert {f.dataType.typeName() for f in df.schema.fields[2:]} == {"double"}
    rows = df.collect()
    assert sorted((r.incident_id, r.service) for r in rows) == sorted((i, s) for i, x in incidents.items() for s in x[1])
    for i, (about, who, points, summary, observed) in incidents.items():
        want = plain(about, who, points, summary, observed, *world[about["environment"]])
        for r in rows:
            if r.incident_id == i:
                assert {c: r[c] for c in V.FEATURES} == pytest.approx(want[r.service], abs=1e-9), (i, r.service)
    for c in V.FEATURES:  # a column that never differs would prove nothing
        assert len({round(r[c], 9) for r in rows}) > 1 or c == "topology_coverage", c


def test_nothing_and_truth(spark):
    about, services, points, summary, observed, healthy = frames(spark, *made(3))
    none = lambda df: df.limit(0)
    assert V.candidate_vectors(none(about), services, points, summary, observed, healthy, ["environment"]).count() == 0
    bare = V.candidate_vectors(about, services, none(points), none(summary), none(observed), V.Healthy(*map(none, healthy)), ["environment"]).collect()
    assert bare and all(r.metric_max_shift == r.topology_coverage == r.trace_local_support == 0 and r.last_seen_delta <= 1 and r.missing_metric_modality == 1 for r in bare)
    with pytest.raises(ValueError, match="root_service"):
        V.candidate_vectors(about.withColumnRenamed("score", "root_service"), services, points, summary, observed, healthy, ["environment"])


def test_query_is_the_recomputation(spark):
    from tracegrid.plans import vector_queries as Q

    about, services, points, summary, observed, healthy = Q.inputs(spark, "/root/testdata/sf0.001")
    by = lambda rows: {i: [r for r in rows if r.incident_id == i] for i in {r.incident_id for r in rows}}
    who, p, now, seen = (by(df.collect()) for df in (services, points, summary, observed))
    lines = lambda df, k: {(r.service, r[k]): (r.slope, r.intercept, r.residual_median, r.residual_iqr) for r in df.collect()}
    metric, trace, expected = lines(healthy.metrics, "family"), lines(healthy.traces, "signal"), {(r.source, r.target) for r in healthy.edges.collect()}
    got = by(Q.met15(spark, "/root/testdata/sf0.001").collect())
    want_of = {r.incident_id: r.asDict() for r in about.collect()}
    assert metric and trace and expected and set(got) == set(want_of)
    for i, incident in want_of.items():
        names = sorted({r.service for r in who[i]})
        want = plain(incident, names, [(r.service, r.family, r.value) for r in p.get(i, [])], {r.service: {c: float(r[c]) for c in (*V.SIGNALS, *REST)} for r in now[i]}, {(r.source, r.target) for r in seen.get(i, [])}, metric, trace, expected)
        assert sorted(r.service for r in got[i]) == names
        for r in got[i]:
            assert {c: r[c] for c in V.FEATURES} == pytest.approx(want[r.service], abs=2e-6, rel=1e-6), (i, r.service)
