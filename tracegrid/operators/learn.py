"""Learned ranking: a pairwise linear ranker on pyspark.ml, search, out-of-fold scores, ensembles and stacking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats
from tracegrid.functions.lineage import cut
from tracegrid.operators import ranking as R


@dataclass
class Ranker:
    """A linear score: sum of weight * (x - mean) / std."""

    features: list[str]
    weights: list[float]
    means: list[float]
    stds: list[float]

    def score(self, df: DataFrame, name: str = "model_score") -> DataFrame:
        terms = [F.lit(w) * (F.col(f) - m) / s for f, w, m, s in zip(self.features, self.weights, self.means, self.stds, strict=True)]
        return df.withColumn(name, F.round(sum(terms[1:], terms[0]), 9))


def with_roots(df: DataFrame, features: list[str], keys: list[str] = R.INCIDENT) -> DataFrame:
    """Adds __roots, the features of the root causes of the row's incident: one window, which stays where the incident is."""
    own = F.when(F.col("label") == 1, F.struct(*features))
    return df.withColumn("__roots", F.collect_list(own).over(Window.partitionBy(*keys)))


def _differences(df: DataFrame, features: list[str], keys: list[str], scale: Callable[[Column, str], Column]) -> DataFrame:
    """pairs() of rows that carry __roots, of scaled features."""
    named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    other = df.filter(named & (F.col("label") == 0)).select("*", F.explode("__roots").alias("__root"))
    up = other.select(*keys, *((scale(F.col(f"__root.{f}"), f) - scale(F.col(f), f)).alias(f) for f in features), F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("__s"))
    return up.select(*keys, *((F.col(f) * F.col("__s")).alias(f) for f in features), ((F.col("__s") + 1) / 2).alias("label"))


def pairs(df: DataFrame, features: list[str], keys: list[str] = R.INCIDENT) -> DataFrame:
    """Differences root - other and other - root of each incident's candidates, labelled 1 and 0: as many rows as there are other
    candidates, twice, for each root cause. Rows meet their root in one window over the incident."""
    return _differences(with_roots(df, features, keys), features, keys, lambda c, _: c)


def _moments(features: list[str], of: Column) -> list[Column]:
    """Mean and deviation of each feature over the rows of which `of` holds."""
    at = lambda f: F.when(of, F.col(f))
    return [c for f in features for c in (F.avg(at(f)), F.coalesce(F.stddev_pop(at(f)), F.lit(1.0)))]


def _fit(rooted: DataFrame, features: list[str], reg: float, keys: list[str], moments: list[float | None]) -> Ranker:
    """fit() of rows that carry __roots, once the moments are known."""
    means, stds = [m or 0.0 for m in moments[::2]], [s or 1.0 for s in moments[1::2]]
    by = dict(zip(features, zip(means, stds, strict=True), strict=True))
    scaled = _differences(rooted, features, keys, lambda c, f: (c - by[f][0]) / by[f][1])
    data = VectorAssembler(inputCols=features, outputCol="x").transform(scaled)
    model = LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False, standardization=False, regParam=reg, maxIter=50).fit(data)
    return Ranker(features, [float(w) for w in model.coefficients], means, stds)


def fit(df: DataFrame, features: list[str], reg: float = 0.01, keys: list[str] = R.INCIDENT) -> Ranker:
    """Pairwise logistic regression without intercept over standardised features; df has label 1 for the root cause. df is computed
    once: what the passes of the training need is written first."""
    rooted = cut(with_roots(df.select(*dict.fromkeys([*keys, "label", *features])), features, keys))
    return _fit(rooted, features, reg, keys, list(rooted.agg(*_moments(features, F.lit(True))).first()))


def vector(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("x", array_to_vector(F.array(*(F.col(f).cast("double") for f in features))))


def accuracy(scored: DataFrame, keys: list[str] = R.INCIDENT, score: str = "model_score") -> dict[str, float]:
    """MRR and AC@1 of the scores' ranking."""
    r = R.ranked(scored, score, keys, "__r").filter("label = 1")
    got = r.agg(F.avg(1 / F.col("__r")).alias("mrr"), F.avg((F.col("__r") == 1).cast("double")).alias("ac1")).first()
    return {"mrr": got["mrr"] or 0.0, "ac1": got["ac1"] or 0.0}


def search(train: DataFrame, validation: DataFrame, grids: list[list[str]], regs: list[float]) -> tuple[Ranker, list[dict]]:
    """Feature sets and penalties by validation MRR, then AC@1, then the simpler one. The grid is a few settings."""
    tried = []
    for features in grids:
        for reg in regs:
            model = fit(train, features, reg)
            tried.append({"model": model, "features": features, "reg": reg} | accuracy(model.score(validation)))
    best = max(tried, key=lambda t: (round(t["mrr"], 6), round(t["ac1"], 6), -len(t["features"]), t["reg"]))
    return best["model"], [{k: v for k, v in t.items() if k != "model"} for t in tried]


def folds(df: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """Whole clusters to n folds by hash."""
    return df.withColumn("fold", F.floor(stats.hash_fraction(F.lit(str(seed)), F.col(cluster).cast("string")) * n).cast("int"))


def out_of_fold(df: DataFrame, features: list[str], n: int, reg: float = 0.01, name: str = "model_score") -> DataFrame:
    """Scores of each fold by a model of the others; df has `fold`. df is computed and written once, with the root causes beside
    each row, so the folds' jobs shuffle nothing; the moments of all folds are one aggregation."""
    rooted = cut(with_roots(df, [*features, "fold"]))
    moments, each = list(rooted.agg(*(m for k in range(n) for m in _moments(features, F.col("fold") != k))).first()), 2 * len(features)
    out = None
    for k in range(n):
        trained = rooted.filter(F.col("fold") != k).withColumn("__roots", F.filter("__roots", lambda x: x["fold"] != k))  # noqa: B023
        model = _fit(trained, features, reg, R.INCIDENT, moments[each * k : each * (k + 1)])
        scored = model.score(rooted.filter(F.col("fold") == k).drop("__roots"), name)
        out = scored if out is None else out.unionByName(scored)
    return out


def ensemble(scored: list[DataFrame], keys: list[str] = R.INCIDENT, score: str = "model_score") -> DataFrame:
    """Mean score over models."""
    every = scored[0].select(*keys, "service", score)
    for s in scored[1:]:
        every = every.unionByName(s.select(*keys, "service", score))
    return R.ranked(every.groupBy(*keys, "service").agg(F.avg(score).alias(score)), score, keys)


def stacked(df: DataFrame, first: list[str], second: list[str], n: int) -> DataFrame:
    """Two experts' out-of-fold scores, their percentiles as features of a ranker above them, itself out of fold."""
    a = out_of_fold(df, first, n, name="score_1")
    b = out_of_fold(a, second, n, name="score_2")
    r = R.ranked(R.ranked(b, "score_1", name="rank_1"), "score_2", name="rank_2")
    meta = r.withColumns({"pct_1": R.rank_percentile("rank_1"), "pct_2": R.rank_percentile("rank_2"), "rel_1": R.relative_score("score_1"), "rel_2": R.relative_score("score_2")})
    return out_of_fold(meta, ["pct_1", "pct_2", "rel_1", "rel_2"], n, name="stacked_score")


def masked_copies(train: DataFrame, columns: list[str], suffix: str = ":masked") -> DataFrame:
    """Training incidents and copies of them, under ids of their own, with some columns 0."""
    copy = train.withColumns({"incident_id": F.concat("incident_id", F.lit(suffix)), **{c: F.lit(0.0) for c in columns}})
    return train.unionByName(copy)


def ablations(df: DataFrame, sets: dict[str, list[str]], n: int) -> list[dict]:
    """Out-of-fold metrics of each feature set."""
    return [{"set": k, **accuracy(out_of_fold(df, f, n))} for k, f in sets.items()]


def oof_provenance(predictions: DataFrame, training: DataFrame) -> DataFrame:
    """Predicted incidents that their model was trained on; must be empty. Both: model, incident_id."""
    return predictions.select("model", "incident_id").distinct().join(training.select("model", "incident_id").distinct(), ["model", "incident_id"], "left_semi")


def group_weights(df: DataFrame, keys: list[str] = R.INCIDENT) -> DataFrame:
    """One over the candidates of an incident, so that each incident weighs the same."""
    return df.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*keys)))
