"""From events to sessions: cohorts, flags and per-session measures.

Everything here filters first and then aggregates with map-side partials, so a
session or user that owns a large part of the events reaches a reducer as at
most one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions import rules
from visitloom.functions.dates import Day, in_days

SESSION_COLUMNS = ("brand", "user_pseudo_id", "session_id", "event_date")


def page_sessions(
    events: DataFrame,
    *,
    names: Sequence[str] | None = None,
    host: str | None = None,
    country: str | None = None,
    not_country: str | None = None,
    url_regex: str | None = None,
    not_url_regex: str | None = None,
    lower_url: bool = False,
    paths: Sequence[str] | None = None,
    first_day: Day | None = None,
    last_day: Day | None = None,
    where: Column | None = None,
    columns: Sequence[str] = SESSION_COLUMNS,
) -> DataFrame:
    """Distinct sessions (per date, by default) with a matching event.

    ``not_country`` drops rows without a country as well: NULL is not unequal.
    """
    url = F.lower("page_location") if lower_url else F.col("page_location")
    condition = in_days(F.col("event_date"), first_day, last_day)
    if names:
        condition = condition & F.col("event_name").isin(*names)
    if host is not None:
        condition = condition & (F.col("host") == host)
    if country is not None:
        condition = condition & (F.col("country") == country)
    if not_country is not None:
        condition = condition & (F.col("country") != not_country)
    if paths:
        condition = condition & F.col("page_path").isin(*paths)
    if url_regex is not None:
        condition = condition & url.rlike(url_regex)
    if not_url_regex is not None:
        condition = condition & ~url.rlike(not_url_regex)
    if where is not None:
        condition = condition & where
    return events.where(condition).select(*columns).distinct()


def login_status_sessions(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its login group; identified statuses are matched in
    exact case, the unidentified one in any case."""
    status = F.col("login_status")
    flags = events.groupBy(*keys).agg(
        F.max(F.coalesce(status.isin(*rules.IDENTIFIED_STATUS), F.lit(False))).alias("has_identified"),
        F.max(F.coalesce(F.lower(status) == rules.UNIDENTIFIED_STATUS, F.lit(False))).alias(
            "has_unidentified"
        ),
    )
    group = rules.login_group(F.col("has_identified"), F.col("has_unidentified"))
    return flags.select(*keys, group.alias("login_status"))


def sessions_any(events: DataFrame, condition: Column, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Sessions in which any event meets the condition.

    The same rows as a filter on a per-session window maximum, without moving
    an event that does not match.
    """
    return events.where(condition).select(*keys).distinct()


def sessions_not_only(
    events: DataFrame,
    url_regex: str,
    keys: Sequence[str] = ("user_pseudo_id", "session_id"),
    hosts: Sequence[str] = (),
) -> DataFrame:
    """Sessions with at least one page outside the URL family and the given hosts."""
    outside = ~F.col("page_location").rlike(url_regex)
    for host in hosts:
        outside = outside & ~F.col("page_location").contains(host)
    return sessions_any(events, outside, keys)


def session_features(events: DataFrame, traffic_type: Column) -> DataFrame:
    """Per day, session, device, place and traffic type: volumes for scoring.

    Engagement is summed in whole milliseconds, so the total does not depend on
    the order in which partitions are merged. Names are lower-cased before the
    grouping, which merges rows that differ in case only.
    """
    name = F.col("event_name")
    lowered = [
        F.lower(c).alias(a)
        for c, a in (
            ("device_category", "device_category"),
            ("device_operating_system", "operating_system"),
            ("country", "country"),
            ("region", "region"),
            ("city", "city"),
        )
    ]
    tagged = events.select(
        F.col("event_date").alias("session_date"),
        "brand",
        "user_pseudo_id",
        F.concat(F.col("user_pseudo_id").cast("string"), F.lit("-"), F.col("session_id").cast("string")).alias(
            "session_key"
        ),
        traffic_type.alias("traffic_type"),
        *lowered,
        "event_name",
        "engagement_time_msec",
    )
    keys = [c for c in tagged.columns if c not in ("event_name", "engagement_time_msec")]
    return tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(name == "page_view").alias("pageviews"),
        F.count_if(name.isin(*rules.INTERACTION_EVENTS)).alias("interaction_events"),
        (F.coalesce(F.sum("engagement_time_msec"), F.lit(0)) / 1000).alias("engagement_seconds"),
        F.max(F.when(name == "purchase", 1).otherwise(0)).alias("has_conversion"),
    )


def session_profile(events: DataFrame, keys: Sequence[str] = ("session_date", "session_id")) -> DataFrame:
    """Events, page views, engagement, span and purchase flag per session.

    Aggregated before it meets the session table: the join then moves one row
    per session instead of every event.
    """
    name, ts = F.col("event_name"), F.col("event_timestamp_utc")
    bought = (name == "purchase") | F.col("transaction_id").isNotNull()
    return (
        events.withColumnRenamed("event_date", "session_date")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(name == "page_view").alias("pageviews"),
            F.count_if(name == "user_engagement").alias("user_engagement_events"),
            F.timestamp_diff("SECOND", F.min(ts), F.max(ts)).alias("event_span_s"),
            F.max(F.coalesce(bought, F.lit(False))).alias("did_purchase"),
        )
    )


def with_suspected_bot(profile: DataFrame) -> DataFrame:
    c = F.col
    return profile.withColumn(
        "suspected_bot",
        rules.suspected_bot(
            c("pageviews"), c("did_purchase"), c("event_span_s"), c("user_engagement_events"), c("events")
        ),
    )


def single_page_sessions(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions whose highest page number is 1."""
    return events.groupBy(key).agg(F.max("page_number").alias("pages")).where("pages = 1").select(key)


def page_session_counts(
    events: DataFrame, regexes: Sequence[str], first_day: Day | None = None
) -> DataFrame:
    """Sessions per date and page, for pages that match all expressions."""
    condition = in_days(F.col("event_date"), first_day)
    for pattern in regexes:
        condition = condition & F.col("page_location").rlike(pattern)
    return (
        events.where(condition)
        .groupBy("event_date", "page_location")
        .agg(F.count_distinct("session_id").alias("sessions"))
    )
