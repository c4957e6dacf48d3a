"""Browser events: forwarding, naming and flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions import rules
from visitloom.operators import tagging
from visitloom.plans.registry import query
from visitloom.plans.views import Views, choose
from visitloom.sources.staging import new_path, stage
from visitloom.streaming import runs

NAMES = ("homeHero", "mainNavClick", "pageView", "HOMEbanner", "mainNavClickX", "", None, "homeDebug")
LOGIN = ("Soft Logged-In", "", None)
CLICKS = ("nav", "nav:top", "nav:top:wine", "nav:top:wine:red", None)
NAMES_SQL = "(['homeHero','mainNavClick','pageView','HOMEbanner','mainNavClickX','',NULL,'homeDebug'])[k % 8 + 1]"


def browser_events(events: DataFrame) -> DataFrame:
    """The given events as the page would push them: one JSON object each.

    A page load is a user's day, so it usually has several page views.
    """
    user = f"""if(k % 3 <> 0, struct({choose(LOGIN, "k")} as loginType,
        cast(user_pseudo_id as string) as customerId, if(k % 2 = 0, 'ACTIVE', null) as state), null)"""
    page = "if(k % 4 <> 0, struct(promo_code as pageName, event_class as pageType), null)"
    click = f"""struct({choose(CLICKS, "k")} as clickDescription,
        {choose(("https://c.example/a", "", None), "k")} as clickUrl)"""
    return events.selectExpr(
        "event_id",
        "session_id as page_load_id",
        "event_timestamp_utc",
        "event_label as link_text",
        "concat('https://p.example/', promo_code) as page_url",
        f"""to_json(struct({choose(NAMES, "k")} as event,
            struct({user} as user, {page} as page, {click} as click) as eventData)) as payload""",
    )


def _mentioning(events: DataFrame, names: list[str]) -> DataFrame:
    """Events whose payload mentions one of the names: a text search spares the others the parsing."""
    text = F.lower("payload")
    return events.where(reduce(lambda a, b: a | b, (text.contains(n.lower()) for n in names)))


def _stored(v: Views, names: list[str], *columns: str) -> DataFrame:
    """The payloads that mention one of the names, staged as the stored JSON they
    stand for: a payload still to be made would be made again for each filter
    """
    return stage(_mentioning(browser_events(v.events()), names).select(*columns, "payload"))


@query(
    "forwarded_events",
    f"""
WITH n AS (SELECT event_id, {NAMES_SQL} AS name FROM ev0)
SELECT event_id, 'acdl.' || name AS event, name AS acdl_event_name,
       CASE WHEN name LIKE 'home%' THEN 'homepage_click' WHEN name = 'mainNavClick' THEN 'main_navigation'
            ELSE 'other_click' END AS mapped_name
FROM n WHERE (lower(name) LIKE 'home%' OR lower(name) = 'mainnavclick') AND lower(name) <> 'homedebug'""",
)
def forwarded_events(v: Views) -> DataFrame:
    parsed = tagging.parse_events(_stored(v, ["home", "mainNavClick"], "event_id"))
    forwarded = tagging.forward_events(parsed, block=["homeDebug"])
    return forwarded.select(
        "event_id", "event", "acdl_event_name", rules.mapped_event_name(F.col("event")).alias("mapped_name")
    )


PAGEVIEWS_SQL = f"""
SELECT session_id AS page_load_id, event_id, event_timestamp_utc,
       coalesce((['Soft Logged-In', NULL, NULL])[k % 3 + 1], 'unknown') AS login_status,
       CAST(user_pseudo_id AS VARCHAR) AS user_id, CASE k % 2 WHEN 0 THEN 'ACTIVE' ELSE 'unknown' END AS active_state,
       CASE k % 4 WHEN 0 THEN 'unknown' ELSE promo_code END AS page_name,
       CASE k % 4 WHEN 0 THEN 'unknown' ELSE event_class END AS page_type
FROM ev1 WHERE {NAMES_SQL} = 'pageView' AND k % 3 <> 0"""


@query(
    "first_pageviews",
    f"""
WITH x AS ({PAGEVIEWS_SQL})
SELECT * EXCLUDE (event_id, event_timestamp_utc) FROM x
QUALIFY row_number() OVER (PARTITION BY page_load_id ORDER BY event_timestamp_utc, event_id) = 1""",
)
def first_pageviews(v: Views) -> DataFrame:
    parsed = tagging.parse_events(_stored(v, ["pageView"], "page_load_id", "event_id", "event_timestamp_utc"))
    return tagging.first_pageview(parsed, order=["event_timestamp_utc", "event_id"])


@query(
    "streamed_pageview_loads",
    f"""
WITH x AS ({PAGEVIEWS_SQL})
SELECT page_load_id, count(DISTINCT user_id) AS users FROM x GROUP BY 1""",
)
def streamed_pageview_loads(v: Views) -> DataFrame:
    """The once-per-page-load rule on a stream. Which page view arrives first is
    up to the source, so only the loads themselves are compared."""
    streamed = StreamedViews(v, v.stream("events"))
    parsed = tagging.parse_events(_mentioning(browser_events(streamed.events()), ["pageView"]))
    out = runs.write_first_pageviews(
        parsed, "page_load_id", "event_timestamp_utc", new_path(v.spark, "loads"), new_path(v.spark, "loads-log")
    )
    return out.groupBy("page_load_id").agg(F.count(F.lit(1)).alias("users"))


@query(
    "streamed_first_pageviews",
    f"""
WITH x AS ({PAGEVIEWS_SQL})
SELECT * EXCLUDE (event_id, event_timestamp_utc) FROM x
QUALIFY row_number() OVER (PARTITION BY page_load_id ORDER BY event_timestamp_utc, event_id) = 1""",
)
def streamed_first_pageviews(v: Views) -> DataFrame:
    """The same rows as ``first_pageviews``, from a stream of three batches that share their page loads."""
    streamed = StreamedViews(v, v.stream_of(v.table("events"), 3))
    parsed = tagging.parse_events(_mentioning(browser_events(streamed.events()), ["pageView"]))
    order = ["event_timestamp_utc", "event_id"]
    out = runs.write_first_pageviews(
        parsed, "page_load_id", order, new_path(v.spark, "loads"), new_path(v.spark, "loads-log")
    )
    return out.drop(*order)


class StreamedViews(Views):
    """The event view over a streaming read of the events table."""

    def __init__(self, base: Views, events: DataFrame):
        super().__init__(base.spark, base.sf_dir)
        self._events = events

    def table(self, name: str) -> DataFrame:
        return self._events if name == "events" else super().table(name)


@query(
    "click_details",
    """
SELECT event_id, CASE k % 5 WHEN 4 THEN NULL ELSE 'nav' END AS click_category,
       CASE WHEN k % 5 IN (1, 2, 3) THEN 'top' END AS click_subcategory, 'reason ' || (k % 7) AS click_text,
       CASE k % 3 WHEN 0 THEN 'https://c.example/a' ELSE 'https://p.example/P' || (k % 10) END AS click_url
FROM ev0""",
)
def click_details(v: Views) -> DataFrame:
    parsed = tagging.parse_events(browser_events(v.events()))
    parts = tagging.click_parts(parsed, "page_url", "link_text")
    return parts.select("event_id", "click_category", "click_subcategory", "click_text", "click_url")
