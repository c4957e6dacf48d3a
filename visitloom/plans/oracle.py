"""The views of ``views.py`` once more, as plain SQL for the checking engine."""

from __future__ import annotations

import re

from visitloom.plans.views import ADS_CAMPAIGNS, CAMPAIGNS, MEDIUMS, PAGE_TYPES, SOURCES, URL_TAILS


def _pick(values: tuple, number: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[({number}) % {len(values)} + 1]"


VIEWS = {
    "ev0": r"""
SELECT event_id, user_id AS user_pseudo_id, user_id * 100000 + (CAST(ts AS DATE) - DATE '2000-01-01') AS session_id,
       CAST(ts AS DATE) AS event_date, ts AS event_timestamp_utc,
       CASE event_type WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'sign_up'
            WHEN 'error' THEN 'user_engagement' ELSE event_type END AS event_name,
       value, event_type, CAST(ts AS DATE) AS d, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""",
    "ev1": f"""
SELECT *, 'B' || (user_pseudo_id % 3) AS brand, 'www.b' || (user_pseudo_id % 3) || '.example' AS host,
       {_pick(("iOS", "Android", "Macintosh", "Windows"), "k")} AS device_operating_system,
       {_pick(("desktop", "Mobile", "tablet"), "k")} AS device_category,
       {_pick(("Soft Logged-In", "Hard Logged-In", "Unidentified", None, None), "k")} AS login_status,
       {_pick(SOURCES, "k")} AS source, {_pick(MEDIUMS, "k")} AS medium,
       CASE WHEN k % 6 = 0 THEN 0 ELSE CAST(floor(value * 1000) AS BIGINT) END AS engagement_time_msec,
       'P' || (k % 10) AS promo_code,
       {_pick(("CONFIRM CANCELLATION", "SUBMIT FEEDBACK", "OTHER"), "k")} AS event_category,
       CASE WHEN k % 4 < 2 THEN 'Free Shipping ' || (k % 5) ELSE 'Gift' END AS event_class,
       'reason ' || (k % 7) AS event_label, 'club ' || (user_pseudo_id % 4) AS event_order,
       '/x/' || user_pseudo_id || '/' || d AS page_fragment, k % 2 + 1 AS page_number,
       CASE WHEN event_type = 'purchase' THEN event_id END AS transaction_id
FROM ev0""",
    "p_events": f"""
SELECT e.*, u.url || {_pick(URL_TAILS, "k")} AS page_location,
       CASE k % 4 WHEN 0 THEN '/' WHEN 1 THEN '/jsp/homepage.jsp'
            ELSE regexp_replace(u.url || {_pick(URL_TAILS, "k")}, '^https?://[^/]+', '') END AS page_path,
       CASE WHEN k % 17 <> 0 THEN r_name END AS country,
       CASE WHEN k % 17 <> 0 THEN n_name END AS region,
       CASE WHEN k % 11 = 1 THEN '' WHEN k % 11 <> 0 THEN n_name END AS city
FROM ev1 e
LEFT JOIN pages u ON u.page_id = e.event_id % (SELECT count(*) FROM pages)
LEFT JOIN customer ON c_custkey = e.user_pseudo_id
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey""",
    "p_transactions": """
SELECT brand, user_pseudo_id, session_id, transaction_id, event_date AS transaction_date,
       event_timestamp_utc, value AS revenue
FROM ev1 WHERE event_name = 'purchase'""",
    "se0": """
SELECT brand, user_pseudo_id, session_id, min(event_date) AS session_date,
       min(event_timestamp_utc) AS session_start_timestamp_utc,
       date_sub('second', min(event_timestamp_utc), max(event_timestamp_utc)) AS session_duration_s,
       CAST(sum(engagement_time_msec) AS BIGINT) AS engagement_time_msec,
       first(page_location ORDER BY event_timestamp_utc, event_id) AS landing_page_location,
       first(country ORDER BY event_timestamp_utc, event_id) AS country,
       first(region ORDER BY event_timestamp_utc, event_id) AS region,
       first(city ORDER BY event_timestamp_utc, event_id) AS city,
       first(device_operating_system ORDER BY event_timestamp_utc, event_id) AS device_operating_system,
       first(source ORDER BY event_timestamp_utc, event_id) FILTER (source IS NOT NULL) AS source,
       first(medium ORDER BY event_timestamp_utc, event_id) FILTER (medium IS NOT NULL) AS medium
FROM p_events GROUP BY ALL""",
    "p_sessions": f"""
SELECT *, 'www.b' || (user_pseudo_id % 3) || '.example' AS host,
       coalesce(source, 'none') AS lnd_source, coalesce(medium, 'none') AS lnd_medium,
       coalesce(source, 'none') || ' / ' || coalesce(medium, 'none') AS lnd_source_medium,
       {_pick(CAMPAIGNS, "session_id")} AS lnd_campaign, 'content ' || (session_id % 3) AS lnd_content,
       {_pick(ADS_CAMPAIGNS, "user_pseudo_id")} AS ads_campaign_name,
       {_pick((None, "", "https://ref.example/"), "session_id")} AS landing_page_referrer,
       {_pick(PAGE_TYPES, "session_id")} AS landing_page_type,
       nullif(regexp_extract(landing_page_location, 'gclid=([^&]+)', 1), '') AS url_gclid,
       CAST(NULL AS VARCHAR) AS url_wbraid,
       nullif(regexp_extract(landing_page_location, 'fbclid=([^&]+)', 1), '') AS url_fbclid,
       CASE WHEN session_id % 4 = 0 THEN 'c1' END AS url_campaign_id,
       {_pick(("Club", "Non-Club"), "session_id")} AS order_type,
       CAST(CASE WHEN session_id % 13 = 0 THEN NULL WHEN user_pseudo_id % 7 = 0 THEN 32 - day(session_date)
            ELSE day(session_date) END AS INTEGER) AS ga_session_number,
       CASE coalesce(medium, 'none') WHEN 'cpc' THEN 'Paid Search' WHEN 'paidsocial' THEN 'Paid Social'
            WHEN 'none' THEN 'Direct' ELSE 'Other' END AS channel_category,
       CASE WHEN medium IN ('cpc', 'paidsocial') THEN 'Paid' ELSE 'Owned' END AS marketing_category
FROM se0""",
    "fiscal": """
SELECT CAST(f + CAST(i AS INTEGER) AS DATE) AS date,
       lpad(CAST(y % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS fiscal_year,
       CAST((m + 2) // 3 AS INTEGER) AS fiscal_quarter_number, CAST(m AS INTEGER) AS fiscal_month_number,
       (['July','August','September','October','November','December','January','February','March',
         'April','May','June'])[m] AS fiscal_month_name,
       CAST(i // 7 + 1 AS INTEGER) AS fiscal_week_number,
       CAST(f + CAST(i - i % 7 AS INTEGER) AS DATE) AS fiscal_week_start_date,
       CAST(f + CAST(i - i % 7 + 6 AS INTEGER) AS DATE) AS fiscal_week_end_date,
       CAST(i % 7 + 1 AS INTEGER) AS fiscal_day_of_week, CAST(i + 1 AS INTEGER) AS fiscal_day_of_year
FROM (SELECT y, f, i, CASE WHEN i >= 364 THEN 12 ELSE (i // 91) * 3
               + CASE WHEN i % 91 < 28 THEN 1 WHEN i % 91 < 56 THEN 2 ELSE 3 END END AS m
      FROM (SELECT y, f, unnest(range(0, n - f)) AS i
            FROM (SELECT y, f, lead(f) OVER (ORDER BY y) AS n
                  FROM (SELECT y, j + CAST(CASE WHEN w <= 3 THEN -w ELSE 7 - w END AS INTEGER) AS f
                        FROM (SELECT y, j, (dayofweek(j) + 1) % 7 AS w
                              FROM (SELECT y, make_date(y, 7, 1) AS j
                                    FROM (SELECT unnest(range(year(min(ts)) - 1, year(max(ts)) + 2)) AS y FROM events)))))
            WHERE n IS NOT NULL))""",
    "p_report": """
SELECT s.* EXCLUDE (session_date), s.session_date AS date, t.transaction_id, t.revenue AS purchase_revenue,
       f.* EXCLUDE (date)
FROM p_sessions s LEFT JOIN p_transactions t USING (session_id) LEFT JOIN fiscal f ON f.date = s.session_date""",
    "p_orders": """
SELECT o_orderkey * 2 AS order_id, CAST(o_orderdate AS DATE) AS order_date,
       CASE o_orderstatus WHEN 'F' THEN 'New Recruit' WHEN 'O' THEN 'Existing Customer'
            WHEN 'P' THEN 'Re-Recruit' END AS customer_status,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Canceled' ELSE 'Invoiced' END AS sales_status,
       CASE WHEN o_custkey % 2 = 0 THEN 'Wine Club' ELSE 'Non-Wine Club' END AS order_type,
       'B' || (o_custkey % 3) AS order_brand, 'R' || (o_custkey % 10) AS response_code,
       'C' || (o_orderkey % 5) AS coupon_code, 'AX' || o_orderkey AS ax_order_number,
       o_orderpriority AS media, o_orderstatus AS sales_activity, o_custkey AS customer_id,
       o_totalprice AS order_revenue
FROM orders""",
    "new_orders": """
SELECT * FROM p_orders WHERE customer_status = 'New Recruit' AND sales_status = 'Invoiced'""",
    "p_items": """
SELECT l_orderkey * 2 AS transaction_id, l_partkey AS item_id, p_name AS item_name
FROM lineitem JOIN part ON p_partkey = l_partkey""",
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name, body in VIEWS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(body, seen)
            seen.append(name)
    return seen


def full_sql(body: str) -> str:
    """The statement with the views it uses in front; it may have its own WITH."""
    names = _needed(body, [])
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = body.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
