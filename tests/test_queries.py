"""Every query against its DuckDB SQL on the small tables."""

import pytest

from tests.oracle import same
from trackframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if sql := registry.oracle_sql().get(name):
        assert same(df, sql, SF) > 0
    else:
        assert df.count() > 0
