"""Every query against its SQL on the smallest tables, and the shape of the rest."""

from __future__ import annotations

import pytest

import __spark_entry__ as catalog
from tests.conftest import DATA
from tests.oracle import connect, duckdb_result, spark_result

SMALL = str(DATA / "sf0.001")
CORPUS = set(catalog._corpus("QUERIES"))  # tested in their own folder
ORACLES = {name: sql for name, sql in catalog.oracle_sql().items() if name not in CORPUS}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    connection = connect(SMALL)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    columns, rows = spark_result(catalog.queries()[name](spark, SMALL))
    expected_columns, expected = duckdb_result(duck, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(catalog.queries()) - CORPUS


def test_flagship_query(spark):
    assert catalog.entry(spark).count() == 10
