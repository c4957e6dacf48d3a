"""Name to query, and name to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitloom.plans.oracle import full_sql
from visitloom.plans.views import Views

Plan = Callable[[Views], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = full_sql(sql)
        return plan

    return register


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Views(spark, sf_dir))
