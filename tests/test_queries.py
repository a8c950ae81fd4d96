"""Every query of the core against its SQL twin, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from oracle import FOLDER, same
from strandline.plans import core_problems, search_engine

CORE = core_problems.QUERIES | search_engine.QUERIES
SQL = core_problems.ORACLES | search_engine.ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, CORE[name], SQL[name])


def test_contract(spark):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
    assert CORE["crawl_delay"](spark, FOLDER).columns == ["host", "ts", "n", "accepted"]
