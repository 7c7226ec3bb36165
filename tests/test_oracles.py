"""Every registered query with SQL gives DuckDB's rows; the others are in test_restatements."""

from __future__ import annotations

import pytest

from tests.oracle import connect, difference
from tidemark import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_oracle(spark, duck, name):
    assert difference(spark, duck, plans.QUERIES[name], plans.ORACLE[name], DATA) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
