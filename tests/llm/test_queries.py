"""The pN_ queries over the small test tables against SQL, and their stated columns."""

from __future__ import annotations

import os

import pytest

from corpusloom.llm import queries as Q
from tests.compare import compare, duck
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    assert not compare(spark, duck(SMALL), Q.queries()[name], Q.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs_with_distinct_rows(spark, name):
    found = Q.queries()[name](spark, SMALL)
    assert found.columns
    if name.endswith("_found"):
        assert found.count() == found.distinct().count() > 0
    else:
        found.collect()
