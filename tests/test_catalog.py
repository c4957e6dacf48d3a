"""Every query against its SQL, on the smallest tables."""

import pytest
from conftest import rows
from pyspark.sql import DataFrame

import __spark_entry__ as entry
import tools_check
from visitloom.plans import catalog

SF = "/root/testdata/sf0.001"
# Narrow queries that the smallest tables leave without rows.
MAY_BE_EMPTY: set[str] = set()
PLANS, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tools_check.connect(SF)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_equals_its_sql(spark, con, name):
    message = tools_check.check(spark, con, SF, name, PLANS[name], ORACLES.get(name))
    assert message == "" or (message == "EMPTY" and name in MAY_BE_EMPTY), message


def test_every_query_has_sql():
    assert set(ORACLES) == set(PLANS)


def test_entry_lists_all_of_them():
    assert set(PLANS) <= set(entry.queries()) and ORACLES.items() <= entry.oracle_sql().items()


def test_entry(spark):
    result = entry.entry(spark)
    assert isinstance(result, DataFrame)
    statuses = {r[0] for r in rows(result, "login_status")}
    assert "All" in statuses and len(statuses) > 1


def test_the_check_sees_a_difference(spark, con):
    wrong = ORACLES["login_status_users"].replace("count(DISTINCT user_pseudo_id)", "1 + count(DISTINCT user_pseudo_id)")
    assert tools_check.check(spark, con, SF, "x", PLANS["login_status_users"], wrong).startswith("ROWS")


