"""Every query with oracle SQL matches DuckDB on the same tables."""

import pytest

from tests.conftest import SF_SMALL
from hearth.plans.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con():
    from tools.oracle_check import duck
    return duck(SF_SMALL)



@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    from tools.oracle_check import compare
    ok, msg = compare(name, spark, con, SF_SMALL, QUERIES, ORACLES)
    assert ok, msg


def test_every_query_has_a_builder():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 90
