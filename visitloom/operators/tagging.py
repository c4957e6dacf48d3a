"""Browser events: which are forwarded, how they are named, what they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions import rules, text

_S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event", _S),
        T.StructField(
            "eventData",
            T.StructType(
                [
                    T.StructField("user", _struct("loginType", "customerId", "state")),
                    T.StructField("page", _struct("pageName", "pageType")),
                    T.StructField("click", _struct("clickDescription", "clickUrl")),
                ]
            ),
        ),
    ]
)


def parse_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``event`` and ``eventData`` read from the JSON text, kept as it is."""
    return df.withColumn("_e", F.from_json(payload, EVENT_SCHEMA)).select(*df.columns, "_e.*")


def forward_events(
    events: DataFrame,
    allow: Sequence[str] | None = rules.FORWARDED_EVENTS,
    block: Sequence[str] | None = None,
    prefix: str = "acdl.",
) -> DataFrame:
    """Events with an allowed name, renamed with the prefix; other columns stay.

    The block list wins, no allow list means all, unnamed events are dropped.
    """
    name = F.col("event")
    return events.where(text.name_passes(name, allow, block)).select(
        F.concat(F.lit(prefix), name).alias("event"),
        name.alias("acdl_event_name"),
        *[c for c in events.columns if c != "event"],
    )


def pageview_fields() -> list[Column]:
    user, page = "eventData.user", "eventData.page"
    return [
        text.or_unknown(F.col(f"{user}.loginType")).alias("login_status"),
        text.or_unknown(F.col(f"{user}.customerId")).alias("user_id"),
        text.or_unknown(F.col(f"{user}.state")).alias("active_state"),
        text.or_unknown(F.col(f"{page}.pageName")).alias("page_name"),
        text.or_unknown(F.col(f"{page}.pageType")).alias("page_type"),
    ]


def pageviews_with_user(events: DataFrame, name: str = "pageView") -> DataFrame:
    return events.where((F.col("event") == name) & F.col("eventData.user").isNotNull())


def first_pageview(
    events: DataFrame, page_load: str = "page_load_id", order: Sequence[str] = ("event_timestamp_utc",)
) -> DataFrame:
    """Per page load, the first page view that carries a user, as flat fields;
    missing and empty ones are 'unknown'. Ties are decided by the fields."""
    flat = pageviews_with_user(events).select(page_load, *order, *pageview_fields())
    fields = [c for c in flat.columns if c not in (page_load, *order)]
    picked = flat.groupBy(page_load).agg(F.min_by(F.struct(*fields), F.struct(*order, *fields)).alias("_first"))
    return picked.select(page_load, "_first.*")


def click_parts(events: DataFrame, fallback_url: str, click_text: str) -> DataFrame:
    """Category and subcategory of a colon-delimited click description, the
    click text, and the click URL with the page's own URL as fallback."""
    description = F.col("eventData.click.clickDescription")
    return events.withColumns(
        {
            "click_category": text.split_part_at(description, ":", 0),
            "click_subcategory": text.split_part_at(description, ":", 1),
            "click_text": F.col(click_text),
            "click_url": F.coalesce(F.nullif("eventData.click.clickUrl", F.lit("")), F.col(fallback_url)),
        }
    )
