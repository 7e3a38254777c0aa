import pytest
from compare import difference, oracle_connection
from conftest import SF

import __spark_entry__ as contract
from tidegate.plans.catalog import QUERIES
from tidegate.plans.oracles import ORACLES

TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    problem, count, _ = difference(spark, duck, SF, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None and count > 0
    described = {r[0]: r[1] for r in duck.execute("DESCRIBE " + contract.oracle_sql()[name]).fetchall()}
    if not name.startswith("stream"):
        dtypes = contract.queries()[name](spark, SF).dtypes
        assert {c: TYPES[t] for c, t in dtypes} == described
