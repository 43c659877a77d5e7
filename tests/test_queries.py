"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from sparklog import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, same_rows):
    df = registry.queries()[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(df, ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())
