"""The operators that SQL can express, against it."""

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import database, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    same(QUERIES[name](spark, sf), database(sf), ORACLE_SQL[name])
