"""Statistics of rankings: accuracy, intervals, bootstrap, conformal sets, abstention, shift, failure analysis, splits."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.functions import hashing, stats
from tracegrid.functions.lineage import cut

CUTS = (1, 2, 3, 5, 10)
#: Draws of the paired bootstrap in one row of sums, and in one task.
BLOCK_DRAWS, TASK_DRAWS = 100_000, 4_000_000


def truth_ranks(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each incident of truth (incident_id, root_service, ...): the root's rank, null if it is no candidate."""
    r = ranking.select(F.col("incident_id").alias("__i"), F.col("service").alias("__s"), F.col("rank").alias("truth_rank"))
    n = ranking.groupBy(F.col("incident_id").alias("__n")).agg(F.count("*").alias("candidates"))
    j = truth.join(r, (F.col("incident_id") == F.col("__i")) & (F.col("root_service") == F.col("__s")), "left").join(n, F.col("incident_id") == F.col("__n"), "left")
    return j.drop("__i", "__s", "__n").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def metric_columns(rank: str = "truth_rank") -> list[Column]:
    """Aggregates over all incidents, a missing root being a miss."""
    r = F.col(rank)
    ac = [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"ac{k}") for k in CUTS]
    ndcg = [F.avg(F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg{k}") for k in (1, 3)]
    return [F.count("*").alias("incidents"), *ac, F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), *ndcg, (F.count(r) / F.count("*")).alias("coverage")]


def grouped_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Metrics by each of the columns and overall, in one pass over grouping sets: dimension, value, metrics."""
    cube = ranks.select(*by, "truth_rank").groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(F.grouping_id().alias("__g"), *metric_columns())
    which, value = F.lit("overall"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        one = F.col("__g") == ((1 << len(by)) - 1) ^ (1 << (len(by) - 1 - i))
        which, value = F.when(one, c).otherwise(which), F.when(one, F.col(c)).otherwise(value)
    return cube.withColumn("dimension", which).withColumn("value", value).drop("__g", *by)


def macro(metrics: DataFrame, name: str) -> DataFrame:
    """Per dimension: the mean over its groups, and the worst group."""
    g = metrics.filter("dimension <> 'overall'")
    return g.groupBy("dimension").agg(F.avg(name).alias("macro"), F.min_by("value", F.struct(name, "value")).alias("worst"), F.min(name).alias("worst_value"))


def chance(ranks: DataFrame) -> DataFrame:
    """Expected metrics of a random order, from the number of candidates of each incident."""
    n = F.col("candidates").cast("int")
    inverse = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, x: a + 1.0 / x)
    ok = F.col("truth_rank").isNotNull()
    return ranks.agg(*(F.avg(F.when(ok, F.least(F.lit(1.0), F.lit(float(k)) / n)).otherwise(0.0)).alias(f"ac{k}") for k in CUTS), F.avg(F.when(ok, inverse / n).otherwise(0.0)).alias("mrr"))


def wilson_rows(ranks: DataFrame, by: list[str]) -> DataFrame:
    g = ranks.groupBy(*by).agg(F.count_if(F.col("truth_rank") == 1).alias("hits"), F.count("*").alias("n"))
    low, high = stats.wilson("hits", "n")
    return g.withColumn("low", low).withColumn("high", high)


def bootstrap(pairs: DataFrame, unit: str, value: str, replicates: int, seed: int = 7) -> DataFrame:
    """Replicates of the mean of `value`, resampling units (incidents or clusters) with replacement.

    Units are summed up first and numbered; draw j of replicate b is the unit at a hash of (seed, b, j), so the result is the
    same on every run and cluster. The cost is replicates * units rows, however many rows a unit has.
    """
    u = pairs.groupBy(unit).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    u = u.withColumn("__k", F.row_number().over(Window.orderBy(unit)) - 1)
    n = u.count()
    draws = pairs.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), F.floor(stats.hash_fraction(F.lit(str(seed)), F.floor(F.col("id") / n).cast("string"), (F.col("id") % n).cast("string")) * n).alias("__k"))
    j = draws.join(u.select(F.col("__k"), "__s", "__n"), "__k")
    return j.groupBy("replicate").agg((F.sum("__s") / F.sum("__n")).alias("mean"))


def interval(replicates: DataFrame, value: str = "mean", level: float = 0.95) -> DataFrame:
    """Ends of the central interval by the elements at (n - 1) q, rounded half to even."""
    n = replicates.count()
    at = [round((n - 1) * q) for q in ((1 - level) / 2, (1 + level) / 2)]
    r = replicates.withColumn("__k", F.row_number().over(Window.orderBy(value)) - 1)
    return r.agg(F.avg(value).alias("mean"), F.max(F.when(F.col("__k") == at[0], F.col(value))).alias("low"), F.max(F.when(F.col("__k") == at[1], F.col(value))).alias("high"))


def paired_bootstrap(pairs: DataFrame, replicates: int, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Two rankings of the same incidents, resampled by incident: a row a metric (ac1, mrr) with difference (first less second),
    low and high, the ends of the central interval of the replicates' differences.

    pairs: incident_id, rank_a, rank_b (null or below 1: a miss), a row an incident. Draw j of replicate b is the incident at a
    hash of (seed, b, j), incidents being in the order of their ranks. Only the distinct pairs of ranks (at most the square of an
    incident's candidates) are put in order and known to all tasks, not the incidents: a pair owns as many places as it has
    incidents. Replicates times incidents draws are hashed, in numpy, in tasks of about TASK_DRAWS draws; a task returns a row for
    each BLOCK_DRAWS of them. Without incidents there are no rows.
    """
    hit = lambda c: F.when(F.col(c) == 1, 1.0).otherwise(0.0)
    inverse = lambda c: F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(0.0)
    spark = pairs.sparkSession
    own = pairs.groupBy("rank_a", "rank_b").agg(F.count("*").alias("c")).orderBy(F.col("rank_a").asc_nulls_last(), F.col("rank_b").asc_nulls_last())
    own = own.select("c", (hit("rank_a") - hit("rank_b")).alias("ac1"), (inverse("rank_a") - inverse("rank_b")).alias("mrr")).toPandas()
    upto, values = own["c"].to_numpy().cumsum(), own[["ac1", "mrr"]].to_numpy()
    if not len(own):
        return spark.createDataFrame([], "metric string, difference double, low double, high double")
    n = int(upto[-1])

    def sums(blocks):
        for block in blocks:
            for b, start, end in block.itertuples(index=False):
                times = np.zeros(len(upto), dtype=np.int64)
                for x in hashing.fractions(f"{seed}:{b}:", start, end):
                    times += np.bincount(np.searchsorted(upto, np.floor(x * n), side="right"), minlength=len(upto))
                yield pd.DataFrame([[b, *(times @ values)]], columns=["replicate", "ac1", "mrr"])

    many = -(-n // BLOCK_DRAWS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-replicates * n // TASK_DRAWS))
    at = F.col("id") % many * BLOCK_DRAWS
    blocks = spark.range(0, replicates * many, 1, min(tasks, replicates * many)).select(F.floor(F.col("id") / many).alias("replicate"), at.alias("start"), F.least(at + BLOCK_DRAWS, F.lit(n)).alias("end"))
    drawn = blocks.mapInPandas(sums, "replicate long, ac1 double, mrr double")
    means = cut(drawn.groupBy("replicate").agg((F.sum("ac1") / n).alias("ac1"), (F.sum("mrr") / n).alias("mrr")))
    out = None
    for k, metric in enumerate(("ac1", "mrr")):
        whole = float((own["c"].to_numpy() @ values)[k]) / n
        one = interval(means.select(metric), metric, level).select(F.lit(metric).alias("metric"), F.lit(whole).alias("difference"), "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


def seed_variance(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("runs"))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """2 x 2 table of two paired outcomes a and b, and the exact two-sided binomial probability of the off-diagonal."""
    g = pairs.groupBy(*by).agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log C(n, i) - n log 2, built up from i - 1; summed for i = 0..k
    start = F.struct((-n * math.log(2)).alias("t"), F.exp(-n * math.log(2)).alias("s"))
    step = lambda a, i: F.struct((a.t + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("t"), (a.s + F.exp(a.t + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("s"))
    tail = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda a: a.s))
    return g.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def conformal(calibration: DataFrame, test: DataFrame, coverage: float) -> DataFrame:
    """Sets of candidates by split conformal prediction over normalised ranks.

    calibration: truth_score (normalised rank of the root); test: incident_id, service, rank_score, is_root. Quantile: the
    value at ceil((n + 1) c) - 1, at most the last.
    """
    n = calibration.count()
    at = min(n - 1, math.ceil((n + 1) * coverage) - 1)
    q = calibration.withColumn("__k", F.row_number().over(Window.orderBy("truth_score")) - 1).filter(F.col("__k") == at).select(F.col("truth_score").alias("quantile"))
    j = test.crossJoin(F.broadcast(q))  # one row
    inside = F.col("rank_score") <= F.col("quantile")
    g = j.groupBy("incident_id").agg(F.first("quantile").alias("quantile"), F.count_if(inside).alias("size"), F.bool_or(inside & F.col("is_root")).alias("covered"))
    return g.agg(F.first("quantile").alias("quantile"), F.avg("size").alias("mean_size"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.count("*").alias("incidents"))


def reliability(margin: Column, disagreement: Column, coverage: Column, ood: Column) -> Column:
    return margin - 0.25 * disagreement + 0.1 * coverage - 0.05 * ood


def abstention(records: DataFrame, target: float) -> DataFrame:
    """The quality threshold that accepts most records with at least the target accuracy. records: quality, correct."""
    w = Window.orderBy(F.desc("quality")).rangeBetween(Window.unboundedPreceding, 0)
    c = records.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("k"))
    c = c.withColumn("accepted", F.sum("n").over(w)).withColumn("accuracy", F.sum("k").over(w) / F.sum("n").over(w))
    total = records.count()
    return c.filter(F.col("accuracy") >= target).agg(F.max(F.struct("accepted", "quality", "accuracy")).alias("m")).select(F.col("m.quality").alias("threshold"), F.col("m.accepted").alias("accepted"), (F.col("m.accepted") / total).alias("coverage"), F.col("m.accuracy").alias("accuracy")).filter("threshold is not null")


def selective(records: DataFrame, threshold: float) -> DataFrame:
    """Coverage of the accepted, and their accuracy and mean reciprocal rank."""
    ok = F.col("quality") >= threshold
    return records.agg(F.avg(ok.cast("double")).alias("coverage"), F.avg(F.when(ok, F.col("correct").cast("double"))).alias("accuracy"), F.avg(F.when(ok, F.coalesce(1 / F.col("truth_rank"), F.lit(0.0)))).alias("mrr"))


def risk_curve(records: DataFrame, id_: str = "incident_id") -> DataFrame:
    """Risk among the first i by quality, i = 1..n."""
    w = Window.orderBy(F.desc("quality"), id_)
    mistakes = F.sum((~F.col("correct")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return records.select(F.row_number().over(w).cast("long").alias("i"), (mistakes / F.row_number().over(w)).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve: trapezoids of width 1 / n between its n points."""
    c = curve.withColumn("__b", F.lag("risk").over(Window.orderBy("i")))
    return c.agg((F.sum((F.col("risk") + F.col("__b")) / 2) / F.count("*")).alias("aurc"), F.count("*").alias("n"))


def unpivoted(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(ids, features, "feature", "value")


def ood_bounds(train: DataFrame, features: list[str]) -> DataFrame:
    """feature, median, iqr and the 1 % and 99 % quantiles."""
    p = unpivoted(train.select(*features), [], features).groupBy("feature").agg(F.percentile("value", F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99)))).alias("p"))
    return p.select("feature", F.col("p")[0].alias("low"), F.col("p")[2].alias("median"), (F.col("p")[3] - F.col("p")[1]).alias("iqr"), F.col("p")[4].alias("high"))


def ood_scores(test: DataFrame, bounds: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """ids and the share of features outside their bounds."""
    long = unpivoted(test, ids, features).join(F.broadcast(bounds.select("feature", "low", "high")), "feature")  # one row a feature
    return long.groupBy(*ids).agg(F.avg(((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).cast("double")).alias("ood"))


def distribution_shift(df: DataFrame, system: str, features: list[str]) -> DataFrame:
    """For each feature: the pair of systems whose medians differ most, in units of the larger interquartile range."""
    p = unpivoted(df, [system], features).groupBy("feature", system).agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("p"))
    a = p.select("feature", F.col(system).alias("left"), F.col("p").alias("lp"))
    b = p.select(F.col("feature").alias("__f"), F.col(system).alias("right"), F.col("p").alias("rp"))
    j = a.join(b, (F.col("feature") == F.col("__f")) & (F.col("left") < F.col("right")))
    iqr = F.greatest(F.col("lp")[2] - F.col("lp")[0], F.col("rp")[2] - F.col("rp")[0], F.lit(1e-9))
    j = j.withColumn("shift", F.abs(F.col("lp")[1] - F.col("rp")[1]) / iqr)
    return j.groupBy("feature").agg(F.max(F.struct("shift", "left", "right")).alias("m")).select("feature", "m.left", "m.right", "m.shift")


def repeatability(rankings: DataFrame, scenario: str) -> DataFrame:
    """Over repeats of a scenario: how often the most frequent first place comes, and the variance of ranks."""
    top = rankings.filter("rank = 1").groupBy(scenario, "service").agg(F.count("*").alias("n"))
    t = top.groupBy(scenario).agg((F.max("n") / F.sum("n")).alias("consistency"), F.sum("n").alias("repeats"))
    v = rankings.groupBy(scenario, "service").agg(F.var_pop("rank").alias("v")).groupBy(scenario).agg(F.avg("v").alias("rank_variance"))
    return t.join(v, scenario)


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """Incidents by bucket of the root's rank, empty buckets included."""
    names = ["1", "2", "3", "4-5", "6-10", ">10", "absent"]
    r = F.col("truth_rank")
    bucket = F.when(r.isNull(), "absent").when(r <= 3, r.cast("string")).when(r <= 5, "4-5").when(r <= 10, "6-10").otherwise(">10")
    g = ranks.groupBy(bucket.alias("__b")).agg(F.count("*").alias("n"))
    every = ranks.sparkSession.createDataFrame([(x,) for x in names], "bucket string")
    return every.join(g, F.col("bucket") == F.col("__b"), "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def failure_taxonomy(ranks: DataFrame, flags: dict[str, Column], examples: int = 10) -> DataFrame:
    """Diagnostic flags among the failed incidents: how many have each, and some examples."""
    failed = ranks.filter("truth_rank is null or truth_rank > 1")
    long = failed.select("incident_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))).alias("flag"))
    w = Window.partitionBy("flag").orderBy("incident_id")
    top = long.withColumn("__k", F.row_number().over(w))
    return top.groupBy("flag").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__k") <= examples, F.col("incident_id")))).alias("examples"))


def margins(ranking: DataFrame, keys: list[str], near: float = 0.01) -> DataFrame:
    """Lead of the first over the second: median, 10 % quantile, share of exact and of near ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "service")
    m = ranking.withColumn("__m", F.col("score") - F.lead("score").over(w)).withColumn("__k", F.row_number().over(w)).filter("__k = 1 and __m is not null")
    return m.agg(F.percentile("__m", 0.5).alias("median"), F.percentile("__m", 0.1).alias("p10"), F.avg((F.col("__m") == 0).cast("double")).alias("ties"), F.avg((F.col("__m") <= near).cast("double")).alias("near_ties"), F.count("*").alias("n"))


def gates(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each rule's outcome on a one-row frame, and the verdict: all hold."""
    every = F.lit(True)
    for c in rules.values():
        every = every & c
    return metrics.select(*(c.alias(k) for k, c in rules.items()), F.when(every, "promote").otherwise("hold").alias("verdict"))


def permuted_within(df: DataFrame, columns: list[str], keys: list[str], seed: int) -> DataFrame:
    """df with some columns dealt anew among the rows of each key, by a hash order."""
    w = Window.partitionBy(*keys)
    a = df.withColumn("__k", F.row_number().over(w.orderBy("service")))
    h = stats.hash_fraction(F.lit(str(seed)), *(F.col(k) for k in keys), F.col("service"))
    b = df.select(*(F.col(k).alias(f"__{k}") for k in keys), F.row_number().over(w.orderBy(h, "service")).alias("__p"), *(F.col(c).alias(f"__v_{c}") for c in columns))
    j = a.join(b, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__k") == F.col("__p")])
    return j.select(*(F.col(f"__v_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def contribution_shares(contributions: DataFrame, ids: list[str], groups: dict[str, str]) -> DataFrame:
    """ids, group and its share of the absolute contributions; groups: feature -> group."""
    long = unpivoted(contributions, ids, list(groups))
    name = F.element_at(F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)), F.col("feature"))
    g = long.groupBy(*ids, name.alias("group")).agg(F.sum(F.abs("value")).alias("__a"))
    total = F.sum("__a").over(Window.partitionBy(*ids))
    return g.select(*ids, "group", F.when(total > 0, F.col("__a") / total).otherwise(0.0).alias("share"))


def permuted_labels(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A control: in each group the positive moves to the other candidate of the least hash."""
    w = Window.partitionBy(*keys)
    h = stats.hash_fraction(F.lit(str(seed)), *(F.col(k) for k in keys), F.col("service"))
    pick = F.row_number().over(w.orderBy(F.col("label"), h, "service"))
    return df.withColumn("permuted", (pick == 1).cast("int"))


# ---- splits and leakage ----------------------------------------------------------------------------------------------------


def stratified(df: DataFrame, strata: list[str], id_: str, seed: int, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """train, validation or test by a hash order within each stratum; validation and test get one at least where 3 are there."""
    w = Window.partitionBy(*strata)
    h = stats.hash_fraction(F.lit(str(seed)), F.col(id_))
    k, n = F.row_number().over(w.orderBy(h, id_)), F.count("*").over(w)
    val = F.when(n >= 3, F.greatest(F.lit(1), F.round(n * shares[1]).cast("long"))).otherwise(0)
    return df.withColumn("split", F.when(k <= val, "validation").when(k <= 2 * val, "test").otherwise("train"))


def hash_split(id_: Column, namespace: str) -> Column:
    """SHA-256 of namespace:id mod 5, as 0..4."""
    return stats.digest_mod(F.concat(F.lit(namespace + ":"), id_), 5)


def _dealer(cluster: str, loads: list[int]):
    """A task's part of grouped_folds: the clusters of one block in order, the folds having these loads before it."""

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__h", cluster], na_position="first")
        heap = [(x, f) for f, x in enumerate(loads)]
        heapq.heapify(heap)
        folds = []
        for n in frame["__n"]:
            x, f = heap[0]
            folds.append(f)
            heapq.heapreplace(heap, (x + int(n), f))
        return frame.assign(fold=folds)

    return deal


def grouped_folds(df: DataFrame, cluster: str, folds: int, seed: int, block: int = 1_000_000) -> DataFrame:
    """df with `fold`: whole clusters in a hash order, each to the fold that has least rows so far, the first of equal ones.

    As each choice depends on those before it, clusters go through in order, in blocks of about `block`: ranges of the hash,
    each one task. From block to block only the folds' loads are carried, so memory is bounded, and a lost block is dealt again
    from them. The result doesn't depend on the block. Rows whose cluster is null form one cluster.
    """
    h = stats.hash_fraction(F.lit(str(seed)), F.coalesce(F.col(cluster).cast("string"), F.lit("")))
    c = cut(df.groupBy(cluster).agg(F.count("*").alias("__n")).withColumn("__h", h))
    blocks = max(1, -(-c.count() // block))
    schema = T.StructType([*c.schema.fields, T.StructField("__b", T.LongType()), T.StructField("fold", T.IntegerType())])
    c = c.withColumn("__b", F.floor(F.col("__h") * blocks))
    loads, dealt = [0] * folds, None
    for b in range(blocks):
        one = c.filter(F.col("__b") == b).groupBy("__b").applyInPandas(_dealer(cluster, list(loads)), schema).select(F.col(cluster).alias("__c"), "fold", "__n")
        if blocks > 1:
            one = cut(one)
            for fold, n in one.groupBy("fold").agg(F.sum("__n")).collect():  # a row a fold
                loads[fold] += n
        dealt = one if dealt is None else dealt.unionByName(one)
        if b % 16 == 15:
            dealt = cut(dealt)
    return df.join(dealt.drop("__n"), F.col(cluster).eqNullSafe(F.col("__c"))).drop("__c")


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """Each row once for each group: held_out names the group, role tells train from test."""
    g = df.select(F.col(group).alias("held_out")).distinct()
    return df.crossJoin(F.broadcast(g)).withColumn("role", F.when(F.col(group) == F.col("held_out"), "test").otherwise("train"))  # a row a group


def cross_split(df: DataFrame, fingerprint: str) -> DataFrame:
    return df.groupBy(fingerprint).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).filter("splits > 1")


def ledger_conflicts(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with roles that exclude one another: anything used for fitting or selection must not be locked or final."""
    g = ledger.groupBy(*keys).agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("n"))
    used = F.arrays_overlap("roles", F.array(F.lit("train"), F.lit("selection")))
    return g.filter(used & F.arrays_overlap("roles", F.array(F.lit("locked"), F.lit("final"))))


def hash_minimum(df: DataFrame, group: str, id_: str) -> DataFrame:
    """One id of each group: that of the least SHA-256."""
    return df.groupBy(group).agg(F.min_by(id_, F.sha2(F.col(id_), 256)).alias(id_))


def invalid_groups(df: DataFrame, key: str, label: str) -> DataFrame:
    """Groups of fewer than two candidates or with other than one positive."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    return g.filter("n < 2 or positives <> 1")


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.intersect(y).agg(F.count("*").alias("common"))
