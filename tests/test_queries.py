"""Every registered query runs at the small scale, and those with SQL agree with it."""

import pytest

from candela.plans import registry
from tests.conftest import SMALL, normal


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert df.columns
        return
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(result.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
