"""Every registered query with SQL against DuckDB at the smallest size, and the others for their rows."""

from __future__ import annotations

import pytest
from oracle import differences, duck

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
#: The table has no questions that are too close; test_literals has.
NONE_FOUND = {"question_diversity_d10"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert not differences(df, con, sql)
    else:
        assert df.columns and df.isEmpty() == (name in NONE_FOUND)
