"""The pairwise ranker: its input is computed once for all folds, and no fold's model sees the fold."""

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import learn as L


def candidates(spark):
    rows = [(f"i{i}", f"s{k}", int(k == i % 3 or (i == 4 and k == 0)), float((i * 7 + k * 5) % 11), float((i + 3 * k) % 5), (i + (k > 2)) % 3) for i in range(18) for k in range(4)]
    return spark.createDataFrame(rows, "incident_id string, service string, label int, a double, b double, fold int").repartition(3)


def test_folds_share_one_table_and_shuffle_nothing(spark):
    df = candidates(spark)
    out = L.out_of_fold(df, ["a", "b"], 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["incident_id"], r["service"]): r["model_score"] for r in out.collect()}
    assert len(got) == 72
    for k in range(3):  # some incidents lie in two folds
        alone = L.fit(df.filter(F.col("fold") != k), ["a", "b"]).score(df.filter(F.col("fold") == k)).collect()
        assert alone and all(got[r["incident_id"], r["service"]] == pytest.approx(r["model_score"], abs=1e-6) for r in alone)


def test_pairs_are_those_of_every_root_cause(spark):
    df = spark.createDataFrame([("i", 1, 5.0), ("i", 1, 7.0), ("i", 0, 1.0), ("j", 0, 2.0), (None, 1, 1.0), (None, 0, 0.0)], "incident_id string, label int, a double")
    assert sorted((r["incident_id"], r["a"], r["label"]) for r in L.pairs(df, ["a"]).collect()) == [("i", -6.0, 0.0), ("i", -4.0, 0.0), ("i", 4.0, 1.0), ("i", 6.0, 1.0)]
