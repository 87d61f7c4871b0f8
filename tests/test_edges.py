import pytest

from corpusmill.plans import catalogue
from tests.edges import dirty_tables, empty_tables
from tests.oracle import same

QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def empty(sf_dir, tmp_path_factory):
    return empty_tables(sf_dir, str(tmp_path_factory.mktemp("empty")))


@pytest.fixture(scope="module")
def dirty(sf_dir, tmp_path_factory):
    return dirty_tables(sf_dir, str(tmp_path_factory.mktemp("dirty")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    QUERIES[name](spark, empty).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_clashing_columns(spark, dirty, name):
    QUERIES[name](spark, dirty).collect()


@pytest.mark.parametrize("name", ["p1_found", "p1_report", "bm25_topk", "language_stats", "live_chunks", "embed_dedup_stats", "incremental_reuse", "latency_percentiles"])
def test_dirty_tables_equal_sql(spark, dirty, name):
    same(spark, dirty, QUERIES[name], catalogue.oracle_sql()[name])
