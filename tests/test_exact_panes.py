"""Quantiles of sliding windows over many values are values at their ranks, not a sketch's."""

import duckdb

from tests.oracle import difference
from tracegrid.plans.registry import ORACLES, QUERIES


def test_windows_of_many_values(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 8000000) AS ts, i % 3 AS user_id, 'view' AS event_type, hash(i) % 1000003 / 7.0 AS value, '' AS props
    FROM range(25000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert difference(spark, con, str(tmp_path), QUERIES["str09_sliding_shift"], ORACLES["str09_sliding_shift"]) == ""
