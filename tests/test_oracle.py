"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    verdict, rows = compare(spark, duck, entry.queries()[name], entry.oracle_sql().get(name), DATA)
    assert verdict in ("equal", "near", "rows-only"), verdict
    assert rows > 0


def test_entry_has_the_known_values(spark):
    found = {r.client_id: r.value for r in entry.entry(spark).collect()}
    assert found == {0: 0.019073, 1: 0.010600, 2: -0.004735, 3: -0.038096}
