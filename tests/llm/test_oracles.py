from __future__ import annotations

import pytest

from siltstone.llm import oracles, queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], oracles.ORACLES[name])
