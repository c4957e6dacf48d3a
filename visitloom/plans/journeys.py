"""First touch, purchases and the way to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import attribution, orders
from visitloom.plans.registry import query
from visitloom.plans.views import Views

AMBIGUOUS_SQL = """SELECT user_pseudo_id FROM new_orders JOIN p_report ON transaction_id = order_id
                   GROUP BY 1 HAVING count(*) > 1"""
TOUCH_SQL = """
SELECT user_pseudo_id, num.session_id = tim.session_id AS same,
       CASE WHEN num.session_id = tim.session_id THEN num ELSE tim END AS ft
FROM (SELECT user_pseudo_id,
        first(p ORDER BY ga_session_number NULLS FIRST, session_start_timestamp_utc, session_id) AS num,
        first(p ORDER BY session_start_timestamp_utc, ga_session_number NULLS FIRST, session_id) AS tim
      FROM p_report p GROUP BY 1)"""


def _shown(table: DataFrame) -> DataFrame:
    return table.withColumn("revenue", F.round("revenue", 2))


@query(
    "first_touch_purchases",
    f"""
WITH ft AS (SELECT user_pseudo_id, first(p ORDER BY ga_session_number, date, session_id) AS f
            FROM p_report p WHERE ga_session_number IS NOT NULL GROUP BY 1)
SELECT brand, user_pseudo_id, transaction_id, min(date) AS purchase_date,
       round(sum(purchase_revenue), 2) AS revenue, min(ga_session_number) AS purchase_session_number,
       min(lnd_source_medium) AS purchase_lnd_source_medium, any_value(f.date) AS first_session_date,
       any_value(f.lnd_source_medium) AS first_session_lnd_source_medium
FROM p_report JOIN new_orders ON order_id = transaction_id JOIN ft USING (user_pseudo_id)
WHERE user_pseudo_id NOT IN ({AMBIGUOUS_SQL})
GROUP BY 1, 2, 3""",
)
def first_touch_purchases(v: Views) -> DataFrame:
    return _shown(attribution.first_touch_purchases(v.new_orders(), v.stored_report()))


@query(
    "days_to_purchase",
    f"""
WITH ft AS ({TOUCH_SQL}),
p AS (SELECT brand, user_pseudo_id, transaction_id, min(date) AS purchase_date,
        min(session_start_timestamp_utc) AS ts, round(sum(purchase_revenue), 2) AS revenue,
        min(ga_session_number) AS purchase_session_number, min(lnd_source_medium) AS purchase_lnd_source_medium,
        min(marketing_category) AS purchase_marketing_category, min(channel_category) AS purchase_channel_category
      FROM p_report JOIN new_orders ON order_id = transaction_id GROUP BY 1, 2, 3),
n AS (SELECT p.user_pseudo_id, p.transaction_id, count(DISTINCT r.session_id) AS sessions_until_purchase
      FROM p JOIN p_report r ON r.user_pseudo_id = p.user_pseudo_id AND r.session_start_timestamp_utc <= p.ts
      GROUP BY 1, 2)
SELECT p.* EXCLUDE (ts), ft.ft.date AS first_session_date, ft.ft.lnd_source_medium AS first_session_lnd_source_medium,
       ft.ft.marketing_category AS first_session_marketing_category,
       ft.ft.channel_category AS first_session_channel_category,
       CAST(purchase_date - ft.ft.date AS INTEGER) AS days_to_purchase, sessions_until_purchase,
       NOT same AS first_touch_disagrees
FROM p JOIN ft USING (user_pseudo_id) LEFT JOIN n USING (user_pseudo_id, transaction_id)
WHERE user_pseudo_id NOT IN ({AMBIGUOUS_SQL})""",
)
def days_to_purchase(v: Views) -> DataFrame:
    return _shown(attribution.days_to_purchase(v.new_orders(), v.stored_report()))


@query(
    "user_first_touch",
    f"""
WITH ft AS ({TOUCH_SQL})
SELECT user_pseudo_id, ft.session_id AS session_id, ft.date AS date, ft.lnd_source_medium AS lnd_source_medium,
       ft.channel_category AS channel_category, NOT same AS first_touch_disagrees FROM ft""",
)
def user_first_touch(v: Views) -> DataFrame:
    touch = attribution.first_touch(v.report(pages=False, geo=False, fiscal=False), ["date", "lnd_source_medium", "channel_category"])
    return touch.select("user_pseudo_id", "ft.*", "first_touch_disagrees")


@query(
    "numbered_first_session",
    """
SELECT user_pseudo_id, session_id, lnd_source_medium FROM p_sessions WHERE ga_session_number IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_pseudo_id ORDER BY ga_session_number, session_date, session_id) = 1""",
)
def numbered_first_session(v: Views) -> DataFrame:
    numbered = v.sessions(pages=False, geo=False).where("ga_session_number is not null")
    return attribution.first_by(
        numbered,
        ["user_pseudo_id"],
        ["session_id", "lnd_source_medium"],
        ["ga_session_number", "session_date", "session_id"],
    )


@query(
    "single_order_users",
    f"""
SELECT user_pseudo_id, transaction_id FROM new_orders JOIN p_report ON transaction_id = order_id
WHERE user_pseudo_id NOT IN ({AMBIGUOUS_SQL})""",
)
def single_order_users(v: Views) -> DataFrame:
    purchases = attribution.purchase_rows(v.new_orders(), v.report(pages=False, geo=False, fiscal=False)).select("user_pseudo_id", "transaction_id")
    return attribution.exclude_ambiguous(purchases, "user_pseudo_id", purchases)


@query(
    "purchase_snapshots",
    """
SELECT brand, user_pseudo_id, transaction_id, min(date) AS purchase_date,
       min(session_start_timestamp_utc) AS purchase_ts, round(sum(purchase_revenue), 2) AS revenue,
       min(channel_category) AS purchase_channel_category
FROM p_report JOIN new_orders ON order_id = transaction_id GROUP BY 1, 2, 3""",
)
def purchase_snapshots(v: Views) -> DataFrame:
    purchases = attribution.purchase_rows(v.new_orders(), v.report(pages=False, geo=False, fiscal=False))
    snapshot = attribution.purchase_snapshot(purchases, ["channel_category"])
    return snapshot.withColumn("revenue", F.round("revenue", 2))


@query(
    "sessions_until_purchase",
    """
WITH p AS (SELECT user_pseudo_id, transaction_id, min(session_start_timestamp_utc) AS ts FROM p_report
           WHERE transaction_id IS NOT NULL GROUP BY brand, 1, 2)
SELECT p.user_pseudo_id, p.transaction_id, count(DISTINCT s.session_id) AS sessions_until_purchase
FROM p JOIN p_sessions s ON s.user_pseudo_id = p.user_pseudo_id AND s.session_start_timestamp_utc <= p.ts
GROUP BY 1, 2""",
)
def sessions_until_purchase(v: Views) -> DataFrame:
    """All purchases, whatever their order says."""
    report = v.stored_report()
    snapshot = attribution.purchase_snapshot(report.where("transaction_id is not null"), [])
    return attribution.sessions_until(snapshot, report)


@query(
    "campaign_page_before_order",
    """
WITH o AS (SELECT user_pseudo_id, transaction_id, transaction_date, event_timestamp_utc AS ts FROM p_transactions
           JOIN (SELECT DISTINCT order_id FROM p_orders WHERE media IN ('1-URGENT', '2-HIGH')) ON order_id = transaction_id),
u AS (SELECT * FROM o UNION ALL SELECT * REPLACE (ts + INTERVAL 5 DAY AS ts) FROM o WHERE transaction_id % 4 <> 0)
SELECT u.user_pseudo_id, u.transaction_id, u.transaction_date,
       bool_or(regexp_matches(e.page_location, 'SALE', 'i')) AS flag,
       min(e.event_date) FILTER (regexp_matches(e.page_location, 'SALE', 'i')) AS page_visited_date
FROM u LEFT JOIN p_events e ON e.user_pseudo_id = u.user_pseudo_id AND e.event_timestamp_utc < u.ts
  AND e.event_name = 'page_view' AND e.event_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'
GROUP BY 1, 2, 3""",
)
def campaign_page_before_order(v: Views) -> DataFrame:
    # The promotion's orders come as a table of ids, as the back office sends it.
    promoted = v.orders().where(F.col("media").isin("1-URGENT", "2-HIGH")).select("order_id")
    sales = orders.match_ids(v.transactions(), "transaction_id", promoted).select(
        "user_pseudo_id", "transaction_id", "transaction_date", "event_timestamp_utc"
    )
    # Most orders are logged again when they ship, five days later.
    shipped = sales.where("transaction_id % 4 <> 0").withColumn(
        "event_timestamp_utc", F.expr("event_timestamp_utc + interval 5 days")
    )
    views = v.events(pages=True).where("event_name = 'page_view'")
    return attribution.event_before(
        sales.unionByName(shipped),
        views,
        F.col("page_location").rlike("(?i)SALE"),
        "2024-01-01",
        "2024-12-31",
        per=["user_pseudo_id", "transaction_id", "transaction_date"],
    )


@query(
    "session_attribution",
    """
SELECT session_id,
       first(source ORDER BY event_timestamp_utc, event_id) FILTER (source IS NOT NULL) AS source,
       first(medium ORDER BY event_timestamp_utc, event_id) FILTER (medium IS NOT NULL) AS medium,
       first(login_status ORDER BY event_timestamp_utc, event_id) FILTER (login_status IS NOT NULL) AS login_status
FROM p_events GROUP BY 1""",
)
def session_attribution(v: Views) -> DataFrame:
    return attribution.first_non_null(
        v.events(), ["session_id"], ["source", "medium", "login_status"], ["event_timestamp_utc", "event_id"]
    )


@query(
    "partner_click_orders",
    """
WITH i AS (SELECT session_id, first(page_location ORDER BY event_timestamp_utc, event_id) AS first_url FROM p_events
           WHERE page_location LIKE '%irpid=%' AND page_location LIKE '%clickid=%' GROUP BY 1)
SELECT brand, transaction_id, date, purchase_revenue, first_url,
       nullif(regexp_extract(first_url, 'irpid=([^&]+)', 1), '') AS irpid,
       nullif(regexp_extract(first_url, 'clickid=([^&]+)', 1), '') AS clickid,
       nullif(regexp_extract(first_url, 'afsrc=([^&]+)', 1), '') AS afsrc
FROM p_report JOIN i USING (session_id)""",
)
def partner_click_orders(v: Views) -> DataFrame:
    clicked = orders.first_url_with(
        v.events(pages=True), ["irpid", "clickid"], ["event_timestamp_utc", "event_id"]
    )
    joined = v.report(pages=False, geo=False, fiscal=False).select("session_id", "brand", "transaction_id", "date", "purchase_revenue").join(
        clicked, "session_id"
    )
    return orders.url_params(joined, "first_url", ["irpid", "clickid", "afsrc"]).drop("session_id")


@query(
    "page_url_params",
    """
SELECT page_id, nullif(regexp_extract(url, 'page=([^&]+)', 1), '') AS page,
       nullif(regexp_extract(url, 'ref=([^&]+)', 1), '') AS ref,
       nullif(regexp_extract(url, 'utm_source=([^&]+)', 1), '') AS utm_source FROM pages""",
)
def page_url_params(v: Views) -> DataFrame:
    names = ["page", "ref", "utm_source"]
    return orders.url_params(v.table("pages").select("page_id", "url"), "url", names).drop("url")
