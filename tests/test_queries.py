"""Every registered query of the reference's operators runs, and equals its SQL where it has one."""

import pytest
from compare import difference

from corvane.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert difference(df, con, ORACLE_SQL[name]) is None
    else:
        assert df.columns
        df.write.format("noop").mode("overwrite").save()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
