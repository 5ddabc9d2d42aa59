"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest
from conftest import DATA, rows

from strayfield.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF", "sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, f"{DATA}/{SF}")
    values = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert got.columns
        return
    want = oracle(ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, values) == rows(want.columns, want.fetchall())
