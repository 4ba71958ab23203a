"""Every registered query against its SQL over the small tables; those without SQL run and have rows."""

import pytest

from paperlens.plans.catalogue import ORACLE_SQL, QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(name, spark):
    assert QUERIES[name](spark, TINY).count() > 0
