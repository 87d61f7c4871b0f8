import pytest

from corpusmill.plans import catalogue
from tests.oracle import same

ORACLE = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, catalogue.queries()[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
