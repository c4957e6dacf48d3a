"""All queries. Importing the modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitloom.plans import bots, freshness, journeys, orders, tagging, traffic  # noqa: F401
from visitloom.plans.registry import ORACLES, PLANS, runnable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
