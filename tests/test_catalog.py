"""Every registered query against its SQL check, or at least against its own rows."""

import oracle
import pytest

from themescope.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, db, name):
    assert oracle.difference(QUERIES[name](spark, small), db, ORACLES[name]) is None


def test_unchecked_queries_are_few():
    assert sorted(set(QUERIES) - set(ORACLES)) == ["full_run", "hashed_vectors", "k_sweep", "kmeans_clusters"]
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["product", "n", "share"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
