"""Spark session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE does three jobs here: it coalesces the shuffles of small inputs, splits
# hot join keys, and turns a shuffled join into a broadcast one once the size
# of a side is known. No operator in this package hints a broadcast on data
# whose size is not bounded by construction.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python line of every expression costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "visitloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; ``conf`` entries (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
