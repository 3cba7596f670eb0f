"""Listwise ranking by boosted trees, many models at once: gradients per list, histograms per node, splits chosen from their sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.functions.lineage import cut
from tracegrid.operators import ranking as R


@dataclass(frozen=True)
class Setting:
    """depth of the trees, eta (what a leaf's value is multiplied by), child (least sum of second derivatives in a leaf), rounds,
    reg (added to that sum), top: pairs count in which one of the two stands among so many (0: all pairs)."""

    depth: int = 2
    eta: float = 0.1
    child: float = 1e-3
    rounds: int = 20
    reg: float = 1.0
    top: int = 3


#: Nodes of a tree in the order of a heap: the children of i are 2 i + 1 and 2 i + 2. A leaf has feature -1.
TREE = "struct<feature: array<int>, threshold: array<double>, value: array<double>>"


def _named(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def _each_root(whole: DataFrame) -> DataFrame:
    """A row for each root cause in c, an incident's candidates: root, and c without the other root causes."""
    w = whole.withColumn("root", F.explode(F.filter("c", lambda e: e["label"] == 1)["service"]))
    return w.withColumn("c", F.filter("c", lambda e: (e["label"] == 0) | (e["service"] == F.col("root"))))


def lists(df: DataFrame, keys: list[str]) -> DataFrame:
    """One list for each root cause: keys, list, label. An incident with several root causes gives a list for each, without the
    others; one without any has none."""
    rest = [c for c in df.columns if c not in keys]
    whole = df.filter(_named(keys)).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("c"))
    return _each_root(whole).select(*keys, F.concat_ws("\x1f", *keys, "root").alias("list"), F.inline("c"))


def derivatives(many: np.ndarray, root: np.ndarray, score: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gradients() of lists that lie one after the other: many says how long each is; root, score and top are the candidates', in
    the order of their services."""
    if not len(score):
        return score, score
    starts, of = np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)
    order = np.lexsort((-score, of))  # stable: equal scores stay by service
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score)) - starts[of] + 1
    s = np.maximum.reduceat(np.where(root, score, -np.inf), starts)[of]
    k = np.maximum.reduceat(np.where(root, rank, -1.0), starts)[of]
    counts = ~root & (k > 0) & ((top == 0) | (np.minimum(rank, k) <= top))
    change = np.abs(1 / np.log2(1 + np.abs(k)) - 1 / np.log2(1 + rank), where=counts, out=np.zeros(len(score)))
    rho = 1 / (1 + np.exp(np.where(counts, s - score, 0.0)))
    g, h = np.where(counts, rho * change, 0.0), np.where(counts, rho * (1 - rho) * change, 0.0)
    return np.where(root, -np.add.reduceat(g, starts)[of], g), np.where(root, np.add.reduceat(h, starts)[of], h)


def gradients(df: DataFrame, top: Column | int = 0) -> DataFrame:
    """Adds g and h, the first and second derivative of the pairwise logistic loss by the score, where each pair of the root cause
    and another candidate weighs what NDCG changes if the two swap places. df: model, list, service, label (1 once a list),
    score. Equal scores are placed by service."""

    @F.pandas_udf("array<struct<g: double, h: double>>")
    def of(label: pd.Series, score: pd.Series, top: pd.Series) -> pd.Series:
        many = label.str.len().to_numpy()
        g, h = derivatives(many, np.concatenate(label.to_list()) == 1, np.concatenate(score.to_list()), np.repeat(top.to_numpy(), many))
        both = [{"g": x, "h": y} for x, y in zip(g, h, strict=True)]
        return pd.Series([both[e - n : e] for n, e in zip(many, np.cumsum(many), strict=True)])

    rest = [c for c in df.columns if c not in ("model", "list", "service")]
    packed = df.groupBy("model", "list").agg(F.sort_array(F.collect_list(F.struct("service", *rest))).alias("c"))
    top = (top if isinstance(top, Column) else F.lit(top)).cast("double")
    gh = packed.withColumn("gh", of(F.col("c.label"), F.col("c.score").cast("array<double>"), top))
    return gh.select("model", "list", F.explode(F.arrays_zip("c", "gh")).alias("e")).select("model", "list", *(f"e.c.{c}" for c in ("service", *rest)), "e.gh.*")


def cuts(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[list[float]]]:
    """For each model and feature at most bins - 1 places between the values of the rows that the model is trained on."""
    q = [i / bins for i in range(1, bins)]
    got = df.groupBy("model").agg(*(F.percentile_approx(F.col(f).cast("double"), q, 10_000).alias(f"c{i}") for i, f in enumerate(features))).collect()
    return {r["model"]: [sorted(set(r[f"c{i}"] or [])) for i in range(len(features))] for r in got}


def binned(packed: DataFrame, features: Sequence[str], at: dict[str, list[list[float]]]) -> DataFrame:
    """The candidates in c (service, label, x) as flat arrays in the order of their services: label, and bins, one a feature: how
    many of the model's cuts lie below the value."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, x = batch["model"].dictionary_encode(), batch["x"]
            flat = x.flatten()
            value = flat.to_numpy(zero_copy_only=False).astype(float)
            bins, none = np.zeros(len(value), np.int32), flat.is_null().to_numpy(zero_copy_only=False)
            own, feature = np.repeat(model.indices.to_numpy(), x.value_lengths().to_numpy()), np.arange(len(value)) % len(features)
            for i, m in enumerate(model.dictionary.to_pylist()):
                for f, limits in enumerate(at.get(m, [])):
                    here = (own == i) & (feature == f)
                    bins[here] = np.searchsorted(limits, value[here])
            bins[none] = 0
            many = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["model"], batch["label"], pa.ListArray.from_arrays(many, pa.array(bins))], ["model", "label", "bins"])

    c = F.sort_array("c")
    flat = packed.select("model", c.alias("c")).select("model", F.transform("c", lambda e: e["label"].cast("int")).alias("label"), F.flatten("c.x").alias("x"))
    return flat.mapInArrow(of, "model string, label array<int>, bins array<int>")


def _walk(feature: np.ndarray, limit: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of a tree at which each row of bins ends."""
    at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (bins[row, np.maximum(f, 0)] > limit[at]), at)
    return at


def _level_sums(data: DataFrame, trees: dict[str, list], tree: dict[str, tuple], level: int, top: dict[str, int], shape: tuple[int, int]) -> DataFrame:
    """model, node, feature, bin, g, h: the sums of one level of all models' trees, added up in every task before they are shuffled.

    data: binned(). trees: the models' trees so far, as (features, bins, values of the nodes); tree: (features, bins) of the one
    that grows."""
    nodes, (width, bins) = 2 ** (level + 1) - 1, shape
    arrays = lambda t: tuple(np.array(x) for x in t)
    trees, tree = {m: [arrays(t) for t in ts] for m, ts in trees.items()}, {m: arrays(t) for m, t in tree.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            model, many = batch["model"].dictionary_encode(), batch["label"].value_lengths().to_numpy().astype(np.int64)
            own, root = np.repeat(model.indices.to_numpy(), many), batch["label"].flatten().to_numpy() == 1
            b = batch["bins"].flatten().to_numpy().reshape(-1, width)
            score, limit, node = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), np.int64)
            names = model.dictionary.to_pylist()
            for i, m in enumerate(names):
                here = own == i
                mine, limit[here] = b[here], top[m]
                for feature, at, value in trees[m]:
                    score[here] += value[_walk(feature, at, mine, len(value).bit_length() - 1)]
                node[here] = _walk(*tree[m], mine, level)
            g, h = derivatives(many, root, score, limit)
            for i, m in enumerate(names):
                here = own == i
                sums = total.setdefault(m, np.zeros((3, nodes, width, bins)))
                for f in range(width):
                    at = node[here] * bins + b[here, f]
                    for k, w in enumerate((g[here], h[here], None)):
                        sums[k, :, f] += np.bincount(at, w, nodes * bins).reshape(nodes, bins)
        for m, sums in total.items():
            node, f, b = np.nonzero(sums[2])
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(node), pa.string()), *(pa.array(x.astype(np.int32)) for x in (node, f, b)), *(pa.array(sums[k, node, f, b]) for k in (0, 1))], ["model", "node", "feature", "bin", "g", "h"])

    parts = data.filter(F.col("model").isin(*tree)).mapInArrow(of, "model string, node int, feature int, bin int, g double, h double")
    return parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _node(tree: Column, x: Column, limit: str, depth: int) -> Column:
    """The node of a tree at which a row ends."""
    at = F.lit(0)
    for _ in range(depth):
        f = F.get(tree["feature"], at)
        right = (F.get(x, f) > F.get(tree[limit], at)).cast("int")
        at = F.when(F.coalesce(f, F.lit(-1)) >= 0, 2 * at + 1 + F.coalesce(right, F.lit(0))).otherwise(at)
    return at


def _sum(trees: Column, x: Column, limit: str, depth: int) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda a, t: a + F.get(t["value"], _node(t, x, limit, depth)))


def histograms(rows: DataFrame) -> DataFrame:
    """Sums of g and h for each model, node, feature and bin; added up in every task before anything is shuffled. The plain form
    of what _level_sums() does with packed lists."""
    each = rows.select("model", "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_split(g: np.ndarray, h: np.ndarray, s: Setting) -> tuple[int, int, float] | None:
    """(feature, last bin to the left, gain) of the largest gain above 0, from sums by feature and bin; the first of equal ones."""
    left_g, left_h = g.cumsum(axis=1), h.cumsum(axis=1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + s.reg) + right_g**2 / (right_h + s.reg) - all_g**2 / (all_h + s.reg)
    gain[(left_h < s.child) | (right_h < s.child)] = -1
    gain[:, -1] = -1
    f, b = np.unravel_index(np.round(gain, 12).argmax(), gain.shape)
    return (int(f), int(b), float(gain[f, b])) if gain[f, b] > 1e-12 else None


def fit_many(rows: DataFrame, features: Sequence[str], settings: dict[str, Setting], keys: list[str] = R.INCIDENT, bins: int = 32) -> dict[str, list]:
    """A forest for each model in settings, all trained together on rows (model, keys, service, label, features)."""
    x = F.array(*(F.col(f).cast("double") for f in features)).alias("x")
    whole = rows.filter(_named(keys)).groupBy("model", *keys).agg(F.collect_list(F.struct("service", "label", x)).alias("c"))
    return _train(whole, cuts(rows, features, bins), features, settings, bins)


def _train(whole: DataFrame, at: dict[str, list[list[float]]], features: Sequence[str], settings: dict[str, Setting], bins: int) -> dict[str, list]:
    """fit_many() of rows (model, c), c being the candidates (service, label, x) of one incident.

    Lists are written once, as rows of small numbers. A round takes for each level of the trees one pass over them: the scores of
    the trees so far, the gradients within each row, and one aggregation by model, node, feature and bin, which is all that
    is shuffled; what the driver gets are these sums (models * nodes * features * bins numbers), from which it chooses the splits.
    """
    spark = whole.sparkSession
    if not at:
        return {m: [] for m in settings}
    data = cut(binned(_each_root(whole), features, at))
    forests: dict[str, list] = {m: [] for m in settings}
    grown: dict[str, list] = {m: [] for m in settings}  # the same trees, with bins for thresholds
    for k in range(max((s.rounds for s in settings.values()), default=0)):
        live = {m: s for m, s in settings.items() if k < s.rounds}
        trees = {m: {0: None} for m in live}  # node -> split or None
        values: dict[tuple[str, int], float] = {}
        flat = lambda m, i: [(trees[m].get(n) or (-1, 0.0, 0))[i] for n in range(2 ** (live[m].depth + 1) - 1)]  # noqa: E731, B023
        for level in range(max(s.depth for s in live.values())):
            growing = {m: s for m, s in live.items() if level < s.depth}
            now = _level_sums(data, {m: grown[m] for m in growing}, {m: (flat(m, 0), flat(m, 2)) for m in growing}, level, {m: s.top for m, s in growing.items()}, (len(features), bins))
            sums: dict[tuple[str, int], np.ndarray] = {}
            for r in now.collect():
                sums.setdefault((r["model"], r["node"]), np.zeros((2, len(features), bins)))[:, r["feature"], r["bin"]] = r["g"], r["h"]
            found = False
            for (m, node), gh in sorted(sums.items()):
                s = live[m]
                split = best_split(gh[0], gh[1], s)
                if level == 0:
                    values[m, 0] = float(-s.eta * gh[0, 0].sum() / (gh[1, 0].sum() + s.reg))
                if split is None:
                    continue
                f, b, _ = split
                trees[m][node] = (f, at[m][f][b], b)
                for child, part in ((2 * node + 1, gh[:, f, : b + 1]), (2 * node + 2, gh[:, f, b + 1 :])):
                    trees[m][child] = None
                    values[m, child] = float(-s.eta * part[0].sum() / (part[1].sum() + s.reg))
                found = True
            if not found:
                break
        for m in live:
            value = [values.get((m, i), 0.0) for i in range(2 ** (live[m].depth + 1) - 1)]
            forests[m].append((flat(m, 0), flat(m, 1), value))
            grown[m].append((flat(m, 0), flat(m, 2), value))
    return forests


def predict(df: DataFrame, features: Sequence[str], forests: dict[str, list], name: str = "model_score") -> DataFrame:
    """Adds the score that each row's `model` gives it: one expression over the model's trees, whatever their number."""
    table = df.sparkSession.createDataFrame([(m, [t for t in f]) for m, f in forests.items()], f"__m string, __trees array<{TREE}>")
    x = F.array(*(F.col(f).cast("double") for f in features))
    j = df.join(F.broadcast(table), F.col("model") == F.col("__m"), "left").withColumn("__x", x)  # rows of a forest are few and small
    return j.withColumn(name, _sum(F.col("__trees"), F.col("__x"), "threshold", _depth(forests))).drop("__m", "__trees", "__x")


def _depth(forests: dict[str, list]) -> int:
    return max((len(t[0]).bit_length() - 1 for f in forests.values() for t in f), default=0)


def fit(df: DataFrame, features: Sequence[str], s: Setting = Setting(), keys: list[str] = R.INCIDENT, bins: int = 32) -> list:
    """One forest over all rows of df."""
    return fit_many(df.withColumn("model", F.lit("one")), features, {"one": s}, keys, bins)["one"]


def score(df: DataFrame, features: Sequence[str], forest: list, name: str = "model_score") -> DataFrame:
    return predict(df.withColumn("model", F.lit("one")), features, {"one": forest}, name).drop("model")


# ---- validation ----------------------------------------------------------------------------------------------------------------------


def fold(cluster: Column, n: int, seed: Column) -> Column:
    """Whole clusters to n folds by hash."""
    return F.floor(stats.hash_fraction(seed.cast("string"), cluster.cast("string")) * n).cast("int")


@dataclass
class Nested:
    """predictions: df with `fold` and model_score, by the forest of its outer fold. chosen: outer fold, setting and how all settings
    did. provenance: model and the incidents it was trained on."""

    predictions: DataFrame
    chosen: list[dict]
    provenance: DataFrame


def nested(df: DataFrame, features: Sequence[str], cluster: str, settings: dict[str, Setting], outer: int = 5, inner: int = 4, seed: int = 1, keys: list[str] = R.INCIDENT, bins: int = 32) -> Nested:
    """Out-of-fold scores whose setting was chosen without the fold.

    For each outer fold, the other clusters are dealt into inner folds; every setting is trained on all but each of these and
    judged on what it left out; the best (MRR, AC@1, then the shallower, the fewer rounds, the smaller eta) is trained on all
    clusters outside the outer fold. The inner models of all outer folds and settings are one job, as are the outer ones. df is
    computed once and written with a row an incident; models then take the candidates that are theirs out of that row, so
    nothing is shuffled for them but sums.
    """
    base = df.withColumn("fold", fold(F.col(cluster), outer, F.lit(seed)))
    inside = F.array(*(fold(F.col(cluster), inner, F.lit((seed + 1) * 1000 + o)) for o in range(outer))).alias("inside")
    x = F.array(*(F.col(f).cast("double") for f in features)).alias("x")
    row = F.struct(*(c for c in base.columns if c not in keys)).alias("row")
    alone = F.when(~_named(keys), F.xxhash64(*features, "service")).alias("__alone")  # rows of no incident are not gathered
    packed = base.select(*keys, alone, F.struct("service", "label", x, "fold", inside, row).alias("e")).groupBy(*keys, "__alone").agg(F.collect_list("e").alias("c"))
    incidents = cut(packed)
    known = incidents.filter(_named(keys))
    names = sorted(settings)

    def theirs(models: list[tuple], keep) -> DataFrame:
        m = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.lit(o).alias("o"), F.lit(i).alias("i")) for n, o, i in models))).alias("m")
        own = F.filter("c", lambda e: keep(e, F.col("m.o"), F.col("m.i")))
        return known.select(*keys, m, "c").select("m.model", *keys, F.transform(own, lambda e: F.struct(e["service"].alias("service"), e["label"].alias("label"), e["x"].alias("x"))).alias("c")).filter(F.size("c") > 0)

    def trained(models: list[tuple], keep, chosen: dict[str, Setting]) -> dict[str, list]:
        whole = theirs(models, keep)
        flat = whole.select("model", F.explode("c.x").alias("x")).select("model", *(F.get("x", F.lit(i)).alias(f) for i, f in enumerate(features)))
        return _train(whole.select("model", "c"), cuts(flat, features, bins), features, chosen, bins)

    models = [(f"{o}/{i}/{c}", o, i) for o in range(outer) for i in range(inner) for c in names]
    within = lambda e, o, i: (e["fold"] != o) & (F.get(e["inside"], o) != i)
    forests = trained(models, within, {m: settings[m.split("/", 2)[2]] for m, _, _ in models})
    got = _judged(known, forests, names, outer).collect()  # outer folds * settings
    chosen = []
    for o in range(outer):
        tried = [{"outer": o, "setting": r["__c"], "mrr": r["mrr"], "ac1": r["ac1"]} for r in got if r["__o"] == o]
        order = lambda t: (-round(t["mrr"], 9), -round(t["ac1"], 9), settings[t["setting"]].depth, settings[t["setting"]].rounds, settings[t["setting"]].eta, t["setting"])
        if tried:
            chosen.append(min(tried, key=order) | {"tried": sorted(tried, key=order)})
    last = [(f"outer-{c['outer']}", c["outer"], -1) for c in chosen]
    outside = lambda e, o, _: e["fold"] != o
    final = trained(last, outside, {f"outer-{c['outer']}": settings[c["setting"]] for c in chosen}) if last else {}
    rows = incidents.select(*keys, F.explode("c.row").alias("row")).select(*keys, "row.*").select(*base.columns)
    out = predict(rows.withColumn("model", F.concat(F.lit("outer-"), F.col("fold").cast("string"))), features, final)
    seen = theirs(models, within).select("model", *keys)
    seen = seen.unionByName(theirs(last, outside).select("model", *keys)) if last else seen
    return Nested(out, chosen, seen.distinct())


def _judged(known: DataFrame, forests: dict[str, list], names: list[str], outer: int) -> DataFrame:
    """__o, __c, mrr, ac1: how each setting ranks the root causes outside an outer fold, by the models that did not see them."""
    table = known.sparkSession.createDataFrame([(dict(forests.items()),)], f"trees map<string, array<{TREE}>>")
    each = known.crossJoin(F.broadcast(table)).select("c", "trees", F.explode(F.array(*(F.lit(o) for o in range(outer)))).alias("__o")).select("*", F.explode(F.array(*map(F.lit, names))).alias("__c"))  # one row of all forests
    of = lambda e: F.try_element_at("trees", F.concat_ws("/", F.col("__o").cast("string"), F.get(e["inside"], F.col("__o")).cast("string"), "__c"))
    scored = F.transform(F.filter("c", lambda e: e["fold"] != F.col("__o")), lambda e: F.struct((-_sum(of(e), e["x"], "threshold", _depth(forests))).alias("o"), e["service"].alias("s"), e["label"].alias("label")))
    placed = F.transform(F.array_sort(scored), lambda e, i: F.when(e["label"] == 1, i + 1))
    ranks = each.select("__o", "__c", F.explode(F.array_compact(placed)).alias("r"))
    return ranks.groupBy("__o", "__c").agg(F.avg(1 / F.col("r")).alias("mrr"), F.avg((F.col("r") == 1).cast("double")).alias("ac1"))
