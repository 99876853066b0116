"""Every query of the catalog against its DuckDB oracle on the smallest tables."""

import pytest

from quillstone.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, detail, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SF, name)
    assert ok, detail
