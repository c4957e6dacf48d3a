"""Daily CSV reports: read as text, keep a raw copy, clean by report id."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.functions.dates import parse_day
from visitloom.functions.numbers import whole_number

# --- fixed values ------------------------------------------------------------
# Cells that count as missing in an all-text CSV.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
REPORT_NAMES = {
    "REC008": "REC008 Website Order Type And Customer Type Report-{day}.csv",
    "REC013": "REC013-Campaign IDs Report-{day}.csv",
}
OTHER_REPORT = "{report}-{day}.csv"
RAW_PATH = "{report}/raw/{report}_{day}.csv"
CLEAN_PATH = "{report}/clean/{report}_{day}.csv"
# Forms in which the order report has its dates; month first where both could be meant.
ORDER_DATES = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy",
    "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "M-d-yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy",
    "MMMM d, yyyy",
)
# --- end of fixed values -----------------------------------------------------

Cleaner = Callable[[DataFrame], DataFrame]


def report_paths(report: str, day: dt.date) -> tuple[str, str, str]:
    """Names of the landed file, the raw copy and the cleaned table."""
    values = {"report": report, "day": day.isoformat()}
    landed = REPORT_NAMES.get(report, OTHER_REPORT).format(**values)
    return landed, RAW_PATH.format(**values), CLEAN_PATH.format(**values)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header; a quoted cell may hold line breaks.

    Without ``inferSchema`` only the header is looked at, not the data. Such a
    file cannot be cut, so each is read by one task.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"')
    return reader.option("multiLine", True).csv(path)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """``read_csv`` with the missing marks as NULL."""
    return blank_missing(read_csv(spark, path))


def write_csv(df: DataFrame, path: str) -> None:
    """Every part has the header, so any set of parts reads back complete."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def blank_missing(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def underscore_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def clean_orders(df: DataFrame, date_formats: Sequence[str] = ORDER_DATES) -> DataFrame:
    """Order report: dates in none of the formats become NULL, quantities that do not read 0."""
    df = underscore_headers(df)
    if "OrderDate" in df.columns:
        df = df.withColumn("OrderDate", parse_day(F.col("OrderDate"), date_formats).cast("string"))
    if "Bottle_Quantity" in df.columns:
        df = df.withColumn("Bottle_Quantity", whole_number(F.col("Bottle_Quantity")))
    return df


CLEANERS: Mapping[str, Cleaner] = {"REC008": clean_orders, "REC013": underscore_headers}


def clean_report(report: str, df: DataFrame, cleaners: Mapping[str, Cleaner] = CLEANERS) -> DataFrame:
    if report not in cleaners:
        raise ValueError(f"report {report!r} has no cleaner; known: {sorted(cleaners)}")
    return cleaners[report](df)


def run_report(
    spark: SparkSession,
    landing: str,
    out: str,
    day: dt.date,
    report: str = "REC008",
    cleaners: Mapping[str, Cleaner] = CLEANERS,
) -> DataFrame:
    """Raw copy first, all text and with its marks, then the cleaned table, so
    that a failing cleaner leaves the raw data behind. Eager; returns the
    cleaned rows. A cleaner with formats of its own is one entry in
    ``cleaners``: ``partial(clean_orders, date_formats=...)``."""
    landed, raw, clean = report_paths(report, day)
    rows = read_csv(spark, f"{landing}/{landed}")
    write_csv(rows, f"{out}/{raw}")
    cleaned = clean_report(report, blank_missing(rows), cleaners)
    write_csv(cleaned, f"{out}/{clean}")
    return cleaned
