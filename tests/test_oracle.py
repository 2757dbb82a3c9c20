"""Every registered query of the library against its SQL twin on the smallest tables; the others must run."""

import pytest
from compare import difference

from spanframe.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" in plan, "no table is read"
    if name in oracle_sql():
        assert difference(spark, lambda *_: df, oracle_sql()[name], SF) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
