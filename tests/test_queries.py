"""Every query of the library proper against its SQL, or for rows alone where it has none."""

import pytest

from tessera.plans import codec_queries as plans
from tessera.plans import ingest_queries, library_queries  # noqa: F401  (they register their queries with the others)
from tests.oracle import database, same


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    if name in plans.ORACLES:
        same(df, con, plans.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())
