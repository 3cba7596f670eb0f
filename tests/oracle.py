"""Runs registered queries against their DuckDB SQL: python -m tests.oracle SF_DIR [NAME...] prints what differs."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "4") -> SparkSession:
    s = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int | float) or type(x).__name__ == "Decimal":
            return f"{float(x):.9g}"
        return str(x)

    return sorted((tuple(one(x) for x in row) for row in df.itertuples(index=False)), key=lambda t: tuple("" if x is None else x for x in t))


def difference(spark: SparkSession, con, sf_dir: str, run, sql: str) -> str:
    """What differs, '' if nothing does."""
    got, want = run(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    pairs = [(a, b) for a, b in zip(canonical(got), canonical(want), strict=True) if a != b]
    return f"{len(pairs)} of {len(got)} rows, as {pairs[0]}" if pairs else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    where, names = sys.argv[1], sys.argv[2:]
    spark, con, queries, oracles = session(), duck(where), entry.queries(), entry.oracle_sql()
    for name in names or [q for q in queries if not q.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            if name in oracles:
                said = difference(spark, con, where, queries[name], oracles[name]) or f"same, {queries[name](spark, where).count() if len(sys.argv) > 3 else ''}"
            else:
                said = f"no SQL, {queries[name](spark, where).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__} {str(e)[:700]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
