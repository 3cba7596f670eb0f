"""Every registered query of the telemetry library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tests import oracle
from tracegrid.plans import registry

SF = "/root/testdata/sf0.001"
#: Not run here: it takes minutes.
SLOW = {"lrn04_out_of_fold"}


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, con, name):
    assert oracle.difference(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
