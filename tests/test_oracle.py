"""Every query against its SQL on the smallest data set."""

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.registry import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, small, name):
    verdict, _ = compare(spark, con, small, name)
    assert verdict.startswith(("equal", "rows")), verdict
