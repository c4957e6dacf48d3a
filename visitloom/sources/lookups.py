"""Small literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNEL_MAP_COLUMNS = (
    "channel_category", "campaign_category", "funnel_category", "marketing_category",
    "marketing_group_id", "campaign_group_type",
)
# Sample rows; a deployment passes its own map.
CHANNEL_MAP = (
    ("Paid Search", "Branded Search", "Lower", "Search", "G1", "Always on"),
    ("Paid Search", "Generic Search", "Lower", "Search", "G2", "Always on"),
    ("Paid Social", "Standard", "Upper", "Social", "G3", "Flight"),
    ("Paid Social", "Club", "Upper", "Social", "G4", "Flight"),
    ("Direct", "General", "Lower", "Owned", "G5", None),
)


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """Rows written in the program, as a plan node whose size the planner knows
    (rows passed in from Python have no statistics and would not be broadcast)."""
    structs = [F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def channel_map(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CHANNEL_MAP_COLUMNS, CHANNEL_MAP)
