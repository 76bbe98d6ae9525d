from __future__ import annotations

import pytest

from siltstone.plans import fixtures
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_against_sql(spark, name):
    assert_same(spark, fixtures.QUERIES[name], fixtures.ORACLES[name])
