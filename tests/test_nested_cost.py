"""Nested validation computes its input once; what models share is read, not shuffled again."""

from tests.test_boosting import FEATURES, planted
from tracegrid.operators import boosting as G


def test_predictions_read_the_one_table_of_incidents(spark):
    df = planted(spark, 12, 3).repartition(3)
    n = G.nested(df, FEATURES, "cluster", {"one": G.Setting(depth=1, rounds=1)}, outer=2, inner=2)
    assert "Exchange hashpartitioning" not in n.predictions._jdf.queryExecution().executedPlan().toString() and "RoundRobin" not in n.predictions._jdf.queryExecution().executedPlan().toString()
    assert n.predictions.count() == df.count()
