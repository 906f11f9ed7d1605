"""Every core query over the smallest tables; those with SQL against DuckDB."""

from __future__ import annotations

import os

import pytest

from corpusloom.plans import catalogue
from tests.compare import compare, duck
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    run, sql = catalogue.queries()[name], catalogue.oracle_sql().get(name)
    if sql:
        assert not compare(spark, duck(SMALL), run, sql, SMALL)
    else:
        run(spark, SMALL).collect()
