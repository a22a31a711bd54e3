"""Every registered query against its oracle SQL on the smallest data set."""

import pytest

from check_oracle import compare, duck
from conftest import SF_DIR
from strokelake.plans import all_queries  # noqa: F401
from strokelake.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    status = compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name])
    assert status.startswith("ok"), status


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_yields_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
