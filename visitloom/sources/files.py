"""Folders of files: everything at once, with its origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamped_name(file_name: Column, modified: Column) -> Column:
    """``name__yyyyMMdd_HHmmss.ext``; without an extension the stamp ends it."""
    stamp = F.date_format(modified, "yyyyMMdd_HHmmss")
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    extension = F.regexp_extract(file_name, r"(\.[^.]*)$", 1)
    return F.concat(stem, F.lit("__"), stamp, extension)


def backfill_all(
    spark: SparkSession,
    folder: str,
    file_format: str = "csv",
    schema: T.StructType | str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Every file of the folder, each row tagged with the name and modification
    time of its file and with the stamped name."""
    reader = spark.read.format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.load(folder)
    name, modified = F.col("_metadata.file_name"), F.col("_metadata.file_modification_time")
    return rows.select(
        "*",
        name.alias("file_name"),
        modified.alias("file_modified"),
        stamped_name(name, modified).alias("stamped_name"),
    )
