"""Every registered query against its SQL twin, on the smallest test data."""

import os

import pytest

from tests.compare import check, connect
from tickerloom.plans import all_queries
from tickerloom.plans.registry import CASES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
all_queries.load()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip(f"no test data at {SF}")
    return connect(SF)


@pytest.mark.parametrize("name", list(CASES))
def test_query_matches_sql(name, spark, con):
    ok, _, _, _, notes = check(name, spark, con, SF)
    assert ok, notes
