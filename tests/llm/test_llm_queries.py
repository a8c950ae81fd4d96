"""Every query of the subpackage with SQL against it; the others run."""

import pytest

from oracle import FOLDER, same
from strandline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
