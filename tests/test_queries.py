"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import compare
import pytest

from gridwise import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert compare.differences(spark, con, SF, plans.QUERIES[name], plans.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    """These have no SQL; what they compute is tested against plain versions elsewhere."""
    rows = plans.QUERIES[name](spark, SF).collect()
    assert rows and any(value is not None for value in rows[0])
