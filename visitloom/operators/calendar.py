"""Fiscal calendar: weeks in, days out, look-ups by date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions.dates import quarter_of

WEEK_SCHEMA = T.StructType(
    [
        T.StructField("week_start", T.DateType()),
        T.StructField("week_end", T.DateType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("month", T.StringType()),
        T.StructField("fiscal_year", T.StringType()),
    ]
)

# Month names of a year that starts in July, 4-4-5 week months.
MONTHS = (
    "July", "August", "September", "October", "November", "December",
    "January", "February", "March", "April", "May", "June",
)


def weeks_445(spark: SparkSession, first_day: dt.date, years: int, label_year: int) -> DataFrame:
    """``years`` fiscal years of 52 weeks in 4-4-5 months, from ``first_day``.

    ``label_year`` is the calendar year in which the first fiscal year starts.
    """
    names = ", ".join(f"'{m}'" for m in MONTHS)
    return (
        spark.range(52 * years)
        .selectExpr("cast(id as int) as n", f"{label_year} + cast(id div 52 as int) as y")
        .selectExpr("*", "n % 52 + 1 as week", "n % 13 as q")
        .selectExpr(
            f"date_add(date'{first_day.isoformat()}', n * 7) as week_start",
            f"date_add(date'{first_day.isoformat()}', n * 7 + 6) as week_end",
            "week",
            f"""element_at(array({names}),
                cast((week - 1) div 13 * 3 + case when q < 4 then 1 when q < 8 then 2 else 3 end as int)) as month""",
            "concat(lpad(y % 100, 2, '0'), '-', lpad((y + 1) % 100, 2, '0')) as fiscal_year",
        )
    )


def weeks_near_july(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Fiscal years that start on the Saturday nearest 1 July, in 4-4-5 months.

    A year has 52 weeks, or 53 where the next start asks for it; week 53 belongs
    to the last month. Years are named by the calendar year of their start.
    """
    names = ", ".join(f"'{m}'" for m in MONTHS)
    start = "make_date({y}, 7, 1)"
    nearest = f"date_add({start}, case when {{d}} <= 3 then -{{d}} else 7 - {{d}} end)"
    # days since the last Saturday
    begin = lambda y: nearest.format(y=y, d=f"(dayofweek({start.format(y=y)}) % 7)")
    years = spark.range(first_year, last_year + 1).selectExpr(
        "cast(id as int) as y", f"{begin('cast(id as int)')} as year_start", f"{begin('cast(id + 1 as int)')} as next_start"
    )
    weeks = years.selectExpr("*", "explode(sequence(0, datediff(next_start, year_start) div 7 - 1)) as n")
    return weeks.selectExpr(
        "date_add(year_start, cast(n * 7 as int)) as week_start",
        "date_add(year_start, cast(n * 7 + 6 as int)) as week_end",
        "cast(n + 1 as int) as week",
        f"""element_at(array({names}), cast(least(12,
            n div 13 * 3 + case when n % 13 < 4 then 1 when n % 13 < 8 then 2 else 3 end) as int)) as month""",
        "concat(lpad(y % 100, 2, '0'), '-', lpad((y + 1) % 100, 2, '0')) as fiscal_year",
    )


def _month_number(month: Column) -> Column:
    return F.array_position(F.split(F.lit(",".join(MONTHS)), ","), month).cast("int")


def expand_weeks(weeks: DataFrame) -> DataFrame:
    """One row per fiscal day, with the numbers reports group by.

    Day numbers are date differences to the first day of the month and year,
    found by two small aggregates, so no calendar is sorted as a whole.
    """
    starts = weeks.groupBy("fiscal_year").agg(F.min("week_start").alias("year_start"))
    months = weeks.groupBy("fiscal_year", "month").agg(F.min("week_start").alias("month_start"))
    number = _month_number(F.col("month"))
    date = F.col("date")
    return (
        weeks.join(starts, "fiscal_year")
        .join(months, ["fiscal_year", "month"])
        .withColumn("date", F.explode(F.sequence("week_start", "week_end", F.expr("interval 1 day"))))
        .select(
            "date",
            "fiscal_year",
            quarter_of(number).alias("fiscal_quarter_number"),
            number.alias("fiscal_month_number"),
            F.col("month").alias("fiscal_month_name"),
            F.col("week").alias("fiscal_week_number"),
            F.col("week_start").alias("fiscal_week_start_date"),
            F.col("week_end").alias("fiscal_week_end_date"),
            (F.date_diff(date, F.col("week_start")) + 1).alias("fiscal_day_of_week"),
            (F.date_diff(date, F.col("month_start")) + 1).alias("fiscal_day_of_month"),
            (F.date_diff(date, F.col("year_start")) + 1).alias("fiscal_day_of_year"),
        )
    )


def with_fiscal(
    df: DataFrame, date_col: str, calendar: DataFrame, columns: list[str], how: str = "left"
) -> DataFrame:
    """Adds fiscal columns by date; ``inner`` drops days outside the calendar.

    A calendar has one row per day, so Catalyst sees it below the broadcast
    threshold; a date-keyed shuffle of the facts would be skewed by busy days.
    """
    look_up = calendar.select(F.col("date").alias(date_col), *columns)
    return df.join(look_up, date_col, how)
