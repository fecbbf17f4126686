"""Every registered query against its SQL twin on the smallest data set."""

import pytest
from compare_twins import compare, connect

from legajo.plans import catalog

catalog.load()
#: queries that have no SQL twin; every other one must equal its own
WITHOUT_TWIN = {"full_case_run"}


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_twin(spark, connection, small, name):
    verdict = compare(spark, connection, name, small)
    assert verdict.startswith("rows only" if name in WITHOUT_TWIN else "equal"), verdict


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
