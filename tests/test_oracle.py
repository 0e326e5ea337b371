import pytest

from ctxlake.plans import core
from tests.oracle import compare

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", [n for n in core.queries() if n in SQL])
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, core.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["q", "doc", "score", "rank"] and df.count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
