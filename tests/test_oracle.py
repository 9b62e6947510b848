"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import os

import pytest

from tests.harness import compare, duck
from tillsight.plans.catalog import REGISTRY

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, SF)
    if sql is None:
        assert df.count() >= 0
        return
    problems, n = compare(df, con, sql)
    assert not problems, f"{name}: {problems}"
