"""Parts of the candidates' table: as many as its rows ask for; entities matched in one pass."""

from tracegrid.operators import incidents as I
from tracegrid.plans import registry
from tracegrid.sources import bindings as B

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_lie_in_parts_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "LINES_A_PART", 500)
    n = B.parts(B.read(spark, SF, "lineitem"))
    assert n > 4 and f", {n})" in _plan(registry.QUERIES["rnk16_soft_heuristics"](spark, SF))


def test_both_ways_of_matching_read_the_entities_once(spark):
    e = spark.createDataFrame([("i", "A_Service"), ("i", "x"), ("j", "b"), ("i", "redis")], "incident_id string, entity string")
    seen = spark.createDataFrame([("i", "a"), ("i", "c")], "incident_id string, service string")
    got = {(r["incident_id"], r["entity"]): (r["strict"], r["resolved"]) for r in I.entity_services(e, seen).collect()}
    assert got == {("i", "A_Service"): ("a", "a"), ("i", "x"): (None, "x"), ("j", "b"): ("b", "b"), ("i", "redis"): (None, None)}
