"""Tables that come as one folder per day, the day in the name: ``events_20240131``, ``events_intraday_20240131``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions.dates import Day, day
from visitloom.sources.staging import folder_names, remove_folder, rename_folder

# --- fixed values ------------------------------------------------------------
FINAL = "events_"
INTRADAY = "events_intraday_"
# --- end of fixed values -----------------------------------------------------


def shard_name(prefix: str, of: Day) -> str:
    return f"{prefix}{day(of):%Y%m%d}"


def last_days(as_of: Day, days: int = 2) -> list[dt.date]:
    return [day(as_of) - dt.timedelta(days=i) for i in range(days)]


def shard_days(spark: SparkSession, folder: str, prefix: str, wanted: Sequence[Day]) -> list[dt.date]:
    """Those of the wanted days that have a shard, by the names in the folder: no shard is opened."""
    names = set(folder_names(spark, folder))
    return [day(d) for d in wanted if shard_name(prefix, d) in names]


def read_shards(
    spark: SparkSession, folder: str, prefix: str, days: Sequence[Day], schema: T.StructType, suffix: str = "shard_day"
) -> DataFrame:
    """Rows of the shards of these days with the day from the shard's name.

    Shards are picked by name before anything is listed or planned, so others
    cost nothing however many there are. A day without a shard has no rows.
    """
    found = shard_days(spark, folder, prefix, days)
    if not found:
        return spark.createDataFrame([], schema).withColumn(suffix, F.lit(None).cast("date"))
    rows = spark.read.schema(schema).parquet(*(f"{folder}/{shard_name(prefix, d)}" for d in found))
    stamp = F.regexp_extract(F.col("_metadata.file_path"), rf"/{prefix}(\d{{8}})/[^/]*$", 1)
    return rows.select("*", F.to_date(stamp, "yyyyMMdd").alias(suffix))


def intraday_shards(spark: SparkSession, folder: str, as_of: Day, schema: T.StructType, days: int = 2) -> DataFrame:
    """Intraday rows of the last days whose final shard is not there yet; which are, the names tell."""
    wanted = last_days(as_of, days)
    landed = set(shard_days(spark, folder, FINAL, wanted))
    return read_shards(spark, folder, INTRADAY, [d for d in wanted if d not in landed], schema)


def write_shards(rows: DataFrame, folder: str, prefix: str, date_col: str) -> None:
    """One folder per day, replaced whole; rows without a day raise."""
    spark = rows.sparkSession
    undated = F.raise_error(F.lit(f"{folder}: a row has no {date_col}")).cast("string")
    name = F.coalesce(F.concat(F.lit(prefix), F.date_format(date_col, "yyyyMMdd")), undated)
    fresh = f"{folder}/_fresh_{prefix}"
    remove_folder(spark, fresh)
    named = rows.withColumn("_shard", name)
    named.hint("rebalance", "_shard").write.partitionBy("_shard").parquet(fresh)
    for found in folder_names(spark, fresh):
        if found.startswith("_shard="):
            shard = found.split("=", 1)[1]
            remove_folder(spark, f"{folder}/{shard}")
            rename_folder(spark, f"{fresh}/{found}", f"{folder}/{shard}")
    remove_folder(spark, fresh)
