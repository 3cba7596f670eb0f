"""Tables between the steps of a job: small on disk, and read as they were written."""

from pathlib import Path

from pyspark.sql import functions as F

from tracegrid.functions import lineage
from tracegrid.operators import spans as S


def _bytes(folder: str) -> int:
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())


def test_a_cut_is_written_in_columns(spark):
    df = spark.range(0, 200_000, 1, 2).select(F.concat(F.lit("inc-"), F.col("id") % 4).alias("incident_id"), (F.col("id") % 7).cast("string").alias("service"), F.lit(None).cast("string").alias("mark"))
    folder = lineage.folder(spark)
    before = _bytes(folder)
    kept = lineage.cut(df)
    assert _bytes(folder) - before < 2_000_000  # whole rows: more than 40 bytes each
    assert kept.count() == 200_000 and kept.filter("mark is null").count() == 200_000 and kept.columns == df.columns


def test_overlap_of_deep_and_cyclic_traces(spark):
    rows = [("i", "t", "e", None, "a", 0, 100)] + [("i", "t", f"n{k}", "e" if k == 0 else f"n{k - 1}", "a", 0, 100) for k in range(5)]
    rows += [("i", "t", "x", "n4", "b", 10, 20), ("i", "t", "y", "n4", "b", 20, 30), ("i", "t", "z", "e", "b", 90, 30)]  # 50 of 100 covered, z reaches out
    rows += [("i", "t", "p", "q", "c", 0, 10), ("i", "t", "q", "p", "c", 0, 10), ("i", "t", "w", "p", "d", 0, 10)]  # p and q are each other's parents
    spans = spark.createDataFrame(rows, "incident_id string, trace_id string, span_id string, parent_span_id string, service string, start_us long, duration_us long")
    got = {r["service"]: r for r in S.dependency_overlap(spans, ["incident_id"]).collect()}
    assert set(got) == {"a", "b", "d"}
    a = got["a"]
    assert (a["entries"], a["boundaries"], a["missing_parents"], a["clipped"], a["overlap_median"], a["residual_median"]) == (1, 1, 0, 1, 0.5, 50.0)
    assert all(got[s]["overlap_median"] == 0 and got[s]["boundaries"] == 0 for s in "bd")
