"""Web properties: one table per site brought together under a brand."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.dates import Day, day, last_n_days


def brand_union(
    tables: Mapping[str, DataFrame], columns: list[str], property_ids: Mapping[str, str] | None = None
) -> DataFrame:
    """Same-shaped property tables under one another, tagged with their brand."""
    ids = property_ids or {}
    parts = [
        df.select(
            *columns,
            F.lit(brand).alias("brand"),
            *([F.lit(ids[brand]).alias("property_id")] if ids else []),
        )
        for brand, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def brand_of_host(host: Column, hosts: Mapping[str, str]) -> Column:
    """Brand of a host name; use it to read several properties in one scan."""
    chain = F
    for name, brand in hosts.items():
        chain = chain.when(host == name, brand)
    return chain


def session_key(user: Column, visit: Column) -> Column:
    """64-bit session id that is unique across properties and users."""
    return F.xxhash64(F.concat(user.cast("string"), F.lit("|"), visit.cast("string")))


def intraday_events(
    tables: Mapping[str, DataFrame],
    as_of: Day,
    columns: list[str],
    property_ids: Mapping[str, str],
    *,
    user: str = "user_pseudo_id",
    visit: str = "visit_id",
    date_col: str = "event_date",
    days: int = 2,
) -> DataFrame:
    """Yesterday and today of every property, with global session ids."""
    recent = {b: df.where(last_n_days(F.col(date_col), as_of, days)) for b, df in tables.items()}
    return brand_union(recent, columns, property_ids).withColumn(
        "session_id", session_key(F.col(user), F.col(visit))
    )


def recent_events(
    events: DataFrame,
    as_of: Day,
    *,
    user: str = "user_pseudo_id",
    visit: str = "visit_id",
    date_col: str = "event_date",
    days: int = 2,
) -> DataFrame:
    """``intraday_events`` where one table holds all properties: one scan."""
    recent = events.where(last_n_days(F.col(date_col), as_of, days))
    return recent.withColumn("session_id", session_key(F.col(user), F.col(visit)))


def prefer_final(
    final: DataFrame,
    intraday: DataFrame,
    keys: list[str],
    as_of: Day,
    date_col: str,
    days: int = 2,
    *,
    whole_days: bool = False,
) -> DataFrame:
    """All final rows, plus the intraday rows of the last days not yet final.

    Decided per key and not per day, so a partly landed day is neither lost
    nor counted twice. The keys of the final side are made distinct first: the
    anti join then meets each key once, however often a key repeats.

    ``whole_days`` decides by day instead: a day with any final row takes none
    from intraday. It needs no keys, but the final load must land in one piece.
    """
    if whole_days:
        keys = [date_col]
    landed = final
    if date_col in keys:
        landed = final.where(last_n_days(F.col(date_col), as_of, days))
    fresh = intraday.where(last_n_days(F.col(date_col), as_of, days))
    missing = fresh.join(landed.select(*keys).distinct(), keys, "left_anti")
    return final.unionByName(missing)


def prefer_landed(
    final: DataFrame, intraday: DataFrame, landed: Sequence[dt.date], as_of: Day, date_col: str, days: int = 2
) -> DataFrame:
    """``prefer_final`` by whole days, where the days that have landed are known
    (``tables.landed_days``): all final rows, plus the intraday rows of the last
    days not among them. Nothing is read to decide."""
    missing = last_n_days(F.col(date_col), as_of, days)
    there = [d for d in landed if d >= day(as_of) - dt.timedelta(days=days - 1)]
    if there:
        missing = missing & ~F.col(date_col).isin(*there)
    return final.unionByName(intraday.where(missing))


def validate_brand(report: DataFrame, expected: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per brand: sessions found and expected, and rows without a fiscal date.

    ``expected`` has brand and expected_sessions; a brand that is missing on
    either side shows with a NULL count there.
    """
    dated = report.join(
        calendar.select("date", F.lit(True).alias("has_fiscal")), "date", "left"
    )
    found = dated.groupBy("brand").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("has_fiscal").isNull()).alias("rows_without_fiscal_date"),
    )
    return found.join(expected, "brand", "full").select(
        "brand",
        "sessions",
        "expected_sessions",
        (F.col("sessions") - F.col("expected_sessions")).alias("difference"),
        "rows_without_fiscal_date",
    )


def with_channel_map(df: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Funnel and marketing columns of a (channel, campaign) pair.

    Pairs missing from the map are 'Unmapped'; the map's ids stay NULL there.
    """
    joined = df.join(channel_map, ["channel_category", "campaign_category"], "left")
    return joined.withColumns(
        {
            "funnel_category": F.coalesce("funnel_category", F.lit("Unmapped")),
            "marketing_category": F.coalesce("marketing_category", F.lit("Unmapped")),
        }
    )
