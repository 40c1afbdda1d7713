"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

from lattis import plans
from tests.compare import differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.ORACLE_SQL))
def test_query(spark, name):
    assert differ(spark, SF, plans.QUERIES[name], plans.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
