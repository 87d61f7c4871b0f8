import pytest

from corpusmill.llm import queries
from tests.edges import dirty_tables, empty_tables

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def empty(sf_dir, tmp_path_factory):
    return empty_tables(sf_dir, str(tmp_path_factory.mktemp("empty")))


@pytest.fixture(scope="module")
def dirty(sf_dir, tmp_path_factory):
    return dirty_tables(sf_dir, str(tmp_path_factory.mktemp("dirty")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert not rows or name == "p7_fill"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_clashing_columns(spark, dirty, name):
    QUERIES[name](spark, dirty).collect()
