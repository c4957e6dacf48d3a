"""Orders and their items, matched with web transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions import rules, text
from visitloom.functions.dates import period, quarter_in_year_from
from visitloom.operators import kpi, orders, properties, sessions
from visitloom.operators.calendar import with_fiscal
from visitloom.operators.joins import null_safe_join
from visitloom.plans.registry import query
from visitloom.plans.traffic import (
    CONTROL_NATIONS,
    CURRENT,
    NATION_GROUP_SQL,
    PERIOD_SQL,
    TEST_NATIONS,
)
from visitloom.plans.views import FISCAL, Views
from visitloom.sources import reports, schema, tables
from visitloom.sources.staging import new_path, stage
from visitloom.sources.lookups import channel_map

EVENT_PAGES_SQL = f"regexp_matches(page_location, '{rules.PRESALE_PAGES}') AND page_location LIKE '%N003%'"


def _order_details(v: Views, *columns: str) -> DataFrame:
    return v.orders().select(F.col("order_id").alias("transaction_id"), *columns)


@query(
    "session_order_channels",
    f"""
WITH x AS (SELECT s.*, lower(s.source) AS src, lower(s.medium) AS med, lower(landing_page_location) AS url,
                  t.transaction_id AS tid, t.revenue FROM p_sessions s LEFT JOIN p_transactions t
           ON t.session_id = s.session_id WHERE s.country = 'AMERICA')
SELECT CAST(month(session_date) AS INTEGER) AS month,
       CAST((quarter(session_date) + 1) % 4 + 1 AS INTEGER) AS quarter,
       CAST(date_trunc('month', session_date) AS DATE) AS year_month,
       {NATION_GROUP_SQL.format(c="region")} AS state_group, region AS state,
       {PERIOD_SQL.format(c="session_date")} AS period,
       user_pseudo_id, session_id, source, medium, lnd_campaign, landing_page_location, landing_page_referrer,
       tid AS transaction_id, revenue,
       CASE WHEN source IS NULL AND medium IS NULL
             AND NOT regexp_matches(coalesce(url, ''), '{rules.URL_PAID_MARKS}') THEN 'Direct'
            WHEN med = 'organic' THEN 'Organic'
            WHEN (regexp_matches(src, '{rules.URL_SEARCH_SOURCE}') AND regexp_matches(med, '{rules.URL_SEARCH_MEDIUM}'))
              OR url LIKE '%gclid%' THEN 'Paid Search'
            WHEN (regexp_matches(src || med, '{rules.URL_SOCIAL}') OR url LIKE '%fbclid%')
             AND NOT regexp_matches(coalesce(med, ''), '{rules.URL_UNPAID}') THEN 'Paid Social'
            ELSE 'Other' END AS channel,
       CASE o.customer_status WHEN 'Existing Customer' THEN 'Existing' WHEN 'New Recruit' THEN 'New'
            WHEN 'Re-Recruit' THEN 'New' END AS customer_status,
       CASE o.order_type WHEN 'Wine Club' THEN 'Club' WHEN 'Non-Wine Club' THEN 'Standard' END AS order_kind,
       o.coupon_code
FROM x LEFT JOIN p_orders o ON o.order_id = x.tid""",
)
def session_order_channels(v: Views) -> DataFrame:
    c = F.col
    sales = v.transactions().select("session_id", "transaction_id", "revenue")
    details = _order_details(
        v,
        rules.customer_status(c("customer_status")).alias("customer_status"),
        rules.order_kind(c("order_type")).alias("order_kind"),
        "coupon_code",
    )
    visits = v.sessions().where("country = 'AMERICA'")
    # Sales are what may repeat a session, so they are not the right of a left join.
    sold = null_safe_join(visits.where("purchases > 0"), sales, ["session_id"])
    rows = sold.unionByName(visits.where("purchases = 0"), allowMissingColumns=True)
    return rows.join(details, "transaction_id", "left").select(
        F.month("session_date").alias("month"),
        quarter_in_year_from(F.month("session_date"), 7).alias("quarter"),
        F.trunc("session_date", "MM").alias("year_month"),
        rules.state_group(c("region"), TEST_NATIONS, CONTROL_NATIONS).alias("state_group"),
        c("region").alias("state"),
        period(c("session_date"), CURRENT).alias("period"),
        "user_pseudo_id",
        "session_id",
        "source",
        "medium",
        "lnd_campaign",
        "landing_page_location",
        "landing_page_referrer",
        "transaction_id",
        "revenue",
        rules.channel_by_landing(c("source"), c("medium"), c("landing_page_location")).alias("channel"),
        "customer_status",
        "order_kind",
        "coupon_code",
    )


@query(
    "presale_item_buyers",
    f"""
WITH v AS (SELECT DISTINCT brand, event_date, session_id, user_pseudo_id FROM p_events WHERE {EVENT_PAGES_SQL}),
b AS (SELECT transaction_id AS bid FROM p_items WHERE item_name = 'small ring')
SELECT brand, event_date, count(DISTINCT user_pseudo_id) AS users, count(DISTINCT session_id) AS sessions,
       count(DISTINCT transaction_id) AS orders, round(sum(revenue), 2) AS revenue
FROM v LEFT JOIN (SELECT session_id, transaction_id, revenue FROM p_transactions) USING (session_id)
LEFT JOIN b ON bid = transaction_id
WHERE transaction_id IS NULL OR bid IS NOT NULL GROUP BY 1, 2""",
)
def presale_item_buyers(v: Views) -> DataFrame:
    on_page = F.col("page_location").rlike(rules.PRESALE_PAGES) & F.col("page_location").rlike("N003")
    visits = sessions.page_sessions(v.events(pages=True), where=on_page)
    sales = v.transactions().select("session_id", "transaction_id", "revenue")
    lines = v.items().select("transaction_id", F.col("item_name").alias("item_id"))
    kept = orders.buyers_of_or_non_buyers(visits, sales, lines, "small ring")
    return kept.groupBy("brand", "event_date").agg(
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("transaction_id").alias("orders"),
        F.round(F.sum("revenue"), 2).alias("revenue"),
    )


@query(
    "flagged_order_items",
    """
WITH ids AS (SELECT DISTINCT order_id FROM p_orders WHERE media IN ('1-URGENT', '3-MEDIUM')),
oi AS (SELECT i.*, t.session_id FROM p_items i JOIN ids ON order_id = transaction_id
       JOIN p_transactions t USING (transaction_id)),
fl AS (SELECT *, max(CASE WHEN item_name LIKE '%ring%' THEN 1 ELSE 0 END) OVER (PARTITION BY transaction_id) AS has FROM oi),
ad AS (SELECT DISTINCT session_id FROM p_events WHERE page_location LIKE '%sale%')
SELECT ax_order_number, session_date, transaction_id, item_id, item_name,
       regexp_replace(landing_page_location, '^https?://(?:www\\.)?ththre\\.example\\.com', '') AS landing_page_path_query,
       lnd_source_medium, CASE WHEN ad.session_id IS NULL THEN 'No' ELSE 'Yes' END AS visited_page,
       CASE has WHEN 1 THEN 'Yes' ELSE 'No' END AS purchased_item
FROM fl JOIN p_sessions s USING (session_id) LEFT JOIN ad USING (session_id)
LEFT JOIN p_orders ON order_id = transaction_id""",
)
def flagged_order_items(v: Views) -> DataFrame:
    wanted = v.orders().where(F.col("media").isin("1-URGENT", "3-MEDIUM")).select("order_id")
    sold_in = v.transactions().select("transaction_id", "session_id")
    lines = orders.match_ids(v.items(), "transaction_id", wanted).join(sold_in, "transaction_id")
    flagged = orders.flag_group_has(
        lines, "transaction_id", F.col("item_name").contains("ring"), "is_item", "has_item"
    )
    visited = sessions.sessions_any(v.events(pages=True), F.col("page_location").like("%sale%")).withColumn(
        "_visited", F.lit(True)
    )
    landed = v.sessions(geo=False).select("session_id", "session_date", "landing_page_location", "lnd_source_medium")
    yes = lambda cond: F.when(cond, "Yes").otherwise("No")
    return (
        flagged.join(landed, "session_id")
        .join(visited, "session_id", "left")
        .join(_order_details(v, "ax_order_number"), "transaction_id", "left")
        .select(
            "ax_order_number",
            "session_date",
            "transaction_id",
            "item_id",
            "item_name",
            text.strip_host(F.col("landing_page_location"), "ththre.example.com").alias("landing_page_path_query"),
            "lnd_source_medium",
            yes(F.col("_visited")).alias("visited_page"),
            yes(F.col("has_item") == 1).alias("purchased_item"),
        )
    )


@query(
    "item_flags",
    """
SELECT transaction_id, item_id, CAST(item_name LIKE 'small%' AS INTEGER) AS is_item,
       max(CAST(item_name LIKE 'small%' AS INTEGER)) OVER (PARTITION BY transaction_id) AS has_item FROM p_items""",
)
def item_flags(v: Views) -> DataFrame:
    small = F.col("item_name").startswith("small")
    return orders.flag_group_has(v.items(), "transaction_id", small, "is_item", "has_item").drop("item_name")


@query(
    "priority_order_items",
    """
SELECT i.* FROM p_items i
WHERE transaction_id IN (SELECT order_id FROM p_orders WHERE media = '1-URGENT' AND sales_activity <> 'P')""",
)
def priority_order_items(v: Views) -> DataFrame:
    """Id table in, matching lines out."""
    urgent = v.orders().where("media = '1-URGENT' and sales_activity <> 'P'").select("order_id")
    return orders.match_ids(v.items(), "transaction_id", urgent)


@query(
    "social_order_items",
    """
SELECT r.date, r.brand, r.transaction_id, i.item_id, i.item_name, landing_page_location, lnd_source_medium,
       lnd_campaign, sales_activity, media, response_code
FROM p_report r LEFT JOIN p_items i USING (transaction_id) LEFT JOIN p_orders ON order_id = r.transaction_id
WHERE (landing_page_location LIKE '%N003%' OR landing_page_location LIKE '%fbclid%') AND r.transaction_id IS NOT NULL""",
)
def social_order_items(v: Views) -> DataFrame:
    url = F.col("landing_page_location")
    coded = v.report(geo=False, fiscal=False).where((url.like("%N003%") | url.like("%fbclid%")) & F.col("transaction_id").isNotNull())
    details = _order_details(v, "sales_activity", "media", "response_code")
    return orders.order_lines(coded, v.items(), details).select(
        "date",
        "brand",
        "transaction_id",
        "item_id",
        "item_name",
        "landing_page_location",
        "lnd_source_medium",
        "lnd_campaign",
        "sales_activity",
        "media",
        "response_code",
    )


@query(
    "order_reconciliation",
    """
SELECT coalesce(t.transaction_id, o.order_id) AS transaction_id,
       coalesce(t.transaction_date, o.order_date) AS order_date,
       coalesce(o.response_code, 'not found in gms') AS gms_response_code,
       coalesce(s.lnd_source_medium, 'not found in ga4') AS source_medium,
       coalesce(s.lnd_campaign, 'not found in ga4') AS campaign,
       coalesce(s.lnd_content, 'not found in ga4') AS content
FROM p_transactions t FULL JOIN p_orders o ON o.order_id = t.transaction_id AND t.transaction_date > DATE '2024-01-05'
LEFT JOIN p_sessions s ON s.session_id = t.session_id AND s.brand = 'B1'
WHERE o.response_code IN ('R1', 'R7') OR (lnd_source_medium = 'cm_dm / postcard' AND lnd_campaign = 'club_join')""",
)
def order_reconciliation(v: Views) -> DataFrame:
    both = orders.reconcile(
        v.transactions().select("transaction_id", "transaction_date", "session_id"),
        v.orders().select("order_id", "order_date", "response_code"),
        "transaction_id",
        "order_id",
        F.col("transaction_date") > F.lit("2024-01-05").cast("date"),
    )
    landed = v.sessions(pages=False, geo=False).where("brand = 'B1'").select(
        "session_id", "lnd_source_medium", "lnd_campaign", "lnd_content"
    )
    mailed = (F.col("lnd_source_medium") == "cm_dm / postcard") & (F.col("lnd_campaign") == "club_join")
    filled = lambda c, label: F.coalesce(c, F.lit(label))
    return (
        both.join(landed, "session_id", "left")
        .where(F.col("response_code").isin("R1", "R7") | mailed)
        .select(
            F.coalesce("transaction_id", "order_id").alias("transaction_id"),
            F.coalesce("transaction_date", "order_date").alias("order_date"),
            filled("response_code", "not found in gms").alias("gms_response_code"),
            filled("lnd_source_medium", "not found in ga4").alias("source_medium"),
            filled("lnd_campaign", "not found in ga4").alias("campaign"),
            filled("lnd_content", "not found in ga4").alias("content"),
        )
    )


@query(
    "order_match_outcomes",
    """
SELECT CASE WHEN order_id IS NULL THEN 'web only' WHEN transaction_id IS NULL THEN 'office only' ELSE 'both' END
         AS outcome, count(*) AS orders, round(sum(revenue), 2) AS revenue,
       round(sum(order_revenue), 2) AS order_revenue
FROM p_transactions FULL JOIN p_orders ON order_id = transaction_id GROUP BY 1""",
)
def order_match_outcomes(v: Views) -> DataFrame:
    both = orders.reconcile(
        v.transactions().select("transaction_id", "revenue"),
        v.orders().select("order_id", "order_revenue"),
        "transaction_id",
        "order_id",
    )
    outcome = (
        F.when(F.col("order_id").isNull(), "web only")
        .when(F.col("transaction_id").isNull(), "office only")
        .otherwise("both")
    )
    return both.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.round(F.sum("revenue"), 2).alias("revenue"),
        F.round(F.sum("order_revenue"), 2).alias("order_revenue"),
    )


@query(
    "cancellation_reasons",
    """
WITH f AS (SELECT * FROM p_events WHERE country <> 'ASIA')
SELECT c.brand, c.event_order AS club, c.event_date AS date, split_part(c.page_fragment, '/', 3) AS subscription_id,
       coalesce(upper(r.event_label), 'ABANDONED') AS cancel_reason
FROM (SELECT * FROM f WHERE event_category = 'CONFIRM CANCELLATION') c
LEFT JOIN (SELECT * FROM f WHERE event_category = 'SUBMIT FEEDBACK') r
  ON r.brand = c.brand AND r.page_fragment = c.page_fragment""",
)
def cancellation_reasons(v: Views) -> DataFrame:
    return orders.cancel_reasons(_cancellation_events(v), "CONFIRM CANCELLATION", "SUBMIT FEEDBACK")


def _cancellation_events(v: Views) -> DataFrame:
    """The few events of a cancellation, with their place looked up once."""
    both = v.events().where(F.col("event_category").isin("CONFIRM CANCELLATION", "SUBMIT FEEDBACK"))
    columns = ["brand", "event_date", "event_category", "event_label", "event_order", "page_fragment"]
    return stage(v.with_geo(both).where("country <> 'ASIA'").select(*columns))


@query(
    "cancellations",
    """
WITH f AS (SELECT * FROM p_events WHERE country <> 'ASIA'),
r AS (SELECT brand, page_fragment, min(upper(event_label)) AS reason FROM f
      WHERE event_category = 'SUBMIT FEEDBACK' GROUP BY 1, 2)
SELECT c.brand, c.event_order AS club, c.event_date AS date, split_part(c.page_fragment, '/', 3) AS subscription_id,
       coalesce(reason, 'ABANDONED') AS cancel_reason
FROM f c LEFT JOIN r ON r.brand = c.brand AND r.page_fragment = c.page_fragment
WHERE event_category = 'CONFIRM CANCELLATION'""",
)
def cancellations(v: Views) -> DataFrame:
    """One row per cancellation."""
    return orders.cancel_reasons(_cancellation_events(v), "CONFIRM CANCELLATION", "SUBMIT FEEDBACK", one_row=True)


@query(
    "deduped_transactions",
    """
WITH t AS (SELECT brand, session_id % 1000 + session_id // 100 AS transaction_id, session_id, transaction_date, revenue
           FROM p_transactions)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY brand, transaction_id
                                           ORDER BY transaction_date, session_id, revenue) = 1""",
)
def deduped_transactions(v: Views) -> DataFrame:
    session = F.col("session_id")
    # Ids made to collide: the given purchases have one row each.
    repeated = v.transactions().select(
        "brand",
        (session % 1000 + F.floor(session / 100)).alias("transaction_id"),
        "session_id",
        "transaction_date",
        "revenue",
    )
    return orders.dedupe_transactions(repeated, order=["transaction_date"])


CAMPAIGN_SQL = f"""
CASE channel_category
  WHEN 'Paid Search' THEN CASE
    WHEN regexp_matches(ads, '{rules.CAMPAIGN_BRANDED}') THEN 'Branded Search'
    WHEN regexp_matches(ads, '{rules.CAMPAIGN_GENERIC}') THEN 'Generic Search'
    WHEN regexp_matches(ads, '{rules.CAMPAIGN_PMAX}') THEN 'Performance Max'
    WHEN ads LIKE '{rules.CAMPAIGN_SHOPPING}' THEN 'Shopping'
    WHEN regexp_matches(ads, '{rules.CAMPAIGN_DEMAND}') THEN 'Demand Gen' ELSE 'Other' END
  WHEN 'Paid Social' THEN CASE
    WHEN regexp_matches(lnd_campaign, '{rules.CAMPAIGN_RETARGET}') THEN 'Retargeting'
    WHEN regexp_matches(lnd_campaign, '{rules.CAMPAIGN_STANDARD}') AND NOT regexp_matches(lnd_campaign, '{rules.CAMPAIGN_NOT_CLUB}') THEN 'Standard'
    WHEN NOT regexp_matches(lnd_campaign, '{rules.CAMPAIGN_NOT_CLUB}') AND lnd_campaign <> 'none' THEN 'Club' ELSE 'Other' END
  ELSE 'General' END"""


@query(
    "enriched_sessions",
    rf"""
WITH c AS (
  SELECT session_id, session_date, lnd_source_medium, lnd_campaign, lower(ads_campaign_name) AS ads,
    CASE WHEN url_gclid IS NOT NULL OR url_wbraid IS NOT NULL OR (regexp_matches(lnd_source_medium, '{rules.WORD_ENGINE}')
              AND regexp_matches(lnd_source_medium, '{rules.WORD_SEARCH}')) THEN 'Paid Search'
         WHEN (url_fbclid IS NOT NULL OR regexp_matches(lnd_source_medium, '{rules.WORD_SOCIAL}'))
              AND NOT regexp_matches(lnd_source_medium, 'referral|organic') THEN 'Paid Social'
         WHEN lnd_source = 'none' AND lnd_medium = 'none' AND url_campaign_id IS NULL THEN 'Direct'
         ELSE 'Other' END AS channel_category,
    CASE WHEN url_gclid IS NOT NULL THEN 'Paid Search'
         WHEN url_fbclid IS NOT NULL AND NOT regexp_matches(lnd_source_medium, 'referral|organic') THEN 'Paid Social'
         WHEN lnd_source = 'none' AND lnd_medium = 'none' AND url_campaign_id IS NULL THEN 'Direct'
         ELSE 'Other' END AS literal_channel
  FROM p_sessions),
k AS (SELECT *, {CAMPAIGN_SQL} AS campaign_category FROM c)
SELECT k.* EXCLUDE (ads), fiscal_year, fiscal_quarter_number, fiscal_month_number, fiscal_month_name,
       fiscal_week_number, fiscal_week_start_date, fiscal_week_end_date,
       CASE WHEN channel_category = 'Paid Search' AND campaign_category IN ('Branded Search', 'Generic Search') THEN 'Lower'
            WHEN channel_category = 'Paid Social' AND campaign_category IN ('Standard', 'Club') THEN 'Upper'
            WHEN channel_category = 'Direct' THEN 'Lower' ELSE 'Unmapped' END AS funnel_category,
       CASE WHEN channel_category = 'Paid Search' AND campaign_category IN ('Branded Search', 'Generic Search') THEN 'Search'
            WHEN channel_category = 'Paid Social' AND campaign_category IN ('Standard', 'Club') THEN 'Social'
            WHEN channel_category = 'Direct' THEN 'Owned' ELSE 'Unmapped' END AS marketing_category,
       CASE WHEN channel_category = 'Paid Search' AND campaign_category = 'Branded Search' THEN 'G1'
            WHEN channel_category = 'Paid Search' AND campaign_category = 'Generic Search' THEN 'G2'
            WHEN channel_category = 'Paid Social' AND campaign_category = 'Standard' THEN 'G3'
            WHEN channel_category = 'Paid Social' AND campaign_category = 'Club' THEN 'G4'
            WHEN channel_category = 'Direct' THEN 'G5' END AS marketing_group_id,
       CASE WHEN channel_category = 'Paid Search' AND campaign_category IN ('Branded Search', 'Generic Search') THEN 'Always on'
            WHEN channel_category = 'Paid Social' AND campaign_category IN ('Standard', 'Club') THEN 'Flight' END
         AS campaign_group_type
FROM k LEFT JOIN fiscal ON date = session_date""",
)
def enriched_sessions(v: Views) -> DataFrame:
    c = F.col
    inputs = [
        c(n)
        for n in (
            "lnd_source", "lnd_medium", "lnd_source_medium", "url_gclid", "url_wbraid", "url_fbclid",
            "url_campaign_id",
        )
    ]
    channelled = v.sessions(geo=False).drop("channel_category", "marketing_category").withColumns(
        {
            "channel_category": rules.channel_by_click_id(*inputs, words=True),
            "literal_channel": rules.channel_by_click_id(*inputs),
        }
    )
    campaigned = channelled.withColumn(
        "campaign_category",
        rules.campaign_category(c("channel_category"), c("ads_campaign_name"), c("lnd_campaign")),
    ).select(
        "session_id",
        "session_date",
        "lnd_source_medium",
        "lnd_campaign",
        "channel_category",
        "literal_channel",
        "campaign_category",
    )
    dated = with_fiscal(campaigned, "session_date", v.fiscal, list(FISCAL))
    return properties.with_channel_map(dated, channel_map(v.spark))


@query(
    "cleaned_order_report",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS ATG_Sales_Order_Number,
       CASE WHEN o_custkey % 7 = 0 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m')
            WHEN o_custkey % 7 IN (0, 1, 2) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS OrderDate,
       CAST(CASE o_custkey % 5 WHEN 0 THEN trunc(o_totalprice / 1000) WHEN 1 THEN 100 WHEN 2 THEN 12 ELSE 0 END AS BIGINT)
         AS Bottle_Quantity,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS Customer_Status
FROM orders""",
)
def cleaned_order_report(v: Views) -> DataFrame:
    """The orders as their all-text report would bring them, faults included."""
    raw = v.table("orders")
    cust, price = F.col("o_custkey"), F.col("o_totalprice")
    landed = raw.select(
        F.col("o_orderkey").cast("string").alias("ATG Sales Order Number"),
        F.when(cust % 7 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(cust % 7 == 1, "NA")
        .when(cust % 7 == 2, F.date_format("o_orderdate", "yyyy-13-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("OrderDate"),
        F.when(cust % 5 == 0, (price / 1000).cast("string"))
        .when(cust % 5 == 1, "1e2")
        .when(cust % 5 == 2, " 12 ")
        .when(cust % 5 == 3, "x")
        .otherwise("")
        .alias("Bottle Quantity"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_orderstatus")).alias("Customer Status"),
    )
    return reports.clean_report("REC008", reports.blank_missing(landed))


REPORT_DAY = dt.date(2024, 5, 1)
REPORT_NOTE_SQL = "'said \"' || o_orderstatus || '\",' || chr(10) || 'line two'"


@query(
    "order_report_files",
    f"""
SELECT 'raw' AS copy, CAST(o_orderkey AS VARCHAR) AS order_number,
       CASE o_custkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y')
            WHEN 2 THEN strftime(o_orderdate, '%-d-%b-%Y') WHEN 3 THEN 'NA' ELSE '1996-13-01' END AS order_date,
       CASE o_custkey % 3 WHEN 0 THEN '1e2' WHEN 1 THEN ' 12 ' ELSE 'x' END AS quantity, {REPORT_NOTE_SQL} AS note FROM orders
UNION ALL
SELECT 'clean', CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END,
       CASE o_custkey % 3 WHEN 0 THEN '100' WHEN 1 THEN '12' ELSE '0' END, {REPORT_NOTE_SQL} FROM orders""",
)
def order_report_files(v: Views) -> DataFrame:
    """The orders as a landed CSV report, ingested, and both copies read back."""
    cust, day = F.col("o_custkey"), F.col("o_orderdate")
    landed = v.table("orders").select(
        F.col("o_orderkey").cast("string").alias("Order Number"),
        F.when(cust % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(cust % 5 == 1, F.date_format(day, "M/d/yyyy"))
        .when(cust % 5 == 2, F.date_format(day, "d-MMM-yyyy"))
        .when(cust % 5 == 3, "NA")
        .otherwise("1996-13-01")
        .alias("OrderDate"),
        F.when(cust % 3 == 0, "1e2").when(cust % 3 == 1, " 12 ").otherwise("x").alias("Bottle Quantity"),
        F.concat(F.lit('said "'), "o_orderstatus", F.lit('",\nline two')).alias("Note"),
    )
    landing, out = new_path(v.spark, "landing"), new_path(v.spark, "reports")
    names = reports.report_paths("REC008", REPORT_DAY)
    reports.write_csv(landed, f"{landing}/{names[0]}")
    reports.run_report(v.spark, landing, out, REPORT_DAY)
    copies = []
    for copy, name in zip(("raw", "clean"), names[1:]):
        back = reports.read_csv(v.spark, f"{out}/{name}").toDF("order_number", "order_date", "quantity", "note")
        copies.append(back.withColumn("copy", F.lit(copy)))
    return copies[0].unionByName(copies[1])


@query(
    "campaign_report_files",
    """
SELECT CAST(p_partkey AS VARCHAR) AS Campaign_ID, p_name AS Campaign_Name,
       CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS Sub_Brand FROM part""",
)
def campaign_report_files(v: Views) -> DataFrame:
    """The other report: only its header is cleaned; missing marks become NULL."""
    landed = v.table("part").select(
        F.col("p_partkey").cast("string").alias("Campaign ID"),
        F.col("p_name").alias("Campaign Name"),
        F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.col("p_brand")).alias("Sub Brand"),
    )
    landing, out = new_path(v.spark, "landing"), new_path(v.spark, "reports")
    landed_name, _, clean = reports.report_paths("REC013", REPORT_DAY)
    reports.write_csv(landed, f"{landing}/{landed_name}")
    reports.run_report(v.spark, landing, out, REPORT_DAY, "REC013")
    return reports.read_csv(v.spark, f"{out}/{clean}")


@query(
    "order_history_copy",
    """
SELECT order_id, order_date, customer_status, order_type, order_brand, order_revenue,
       CAST(date_trunc('year', order_date) AS DATE) AS order_year, CAST(NULL AS VARCHAR) AS source_system,
       CAST(NULL AS DATE) AS delivery_date
FROM p_orders WHERE order_date < DATE '1999-06-01'""",
)
def order_history_copy(v: Views) -> DataFrame:
    columns = ["order_id", "order_date", "customer_status", "order_type", "order_brand", "order_revenue"]
    # One folder a year: the given orders would make a folder a day of a few rows each.
    history = v.orders().select(*columns, F.trunc("order_date", "YEAR").alias("order_year"))
    path = new_path(v.spark, "history")
    return tables.copy_table(
        history,
        "order_history_" + path.rsplit("-", 1)[1],
        predicate=F.col("order_date") < F.lit("1999-06-01").cast("date"),
        add_nulls={"source_system": "string", "delivery_date": "date"},
        partition_by="order_year",
        cluster_by=["order_brand", "order_type", "customer_status"],
        path=path,
        description="Order details before the cut-off, by year",
    )


@query(
    "order_details_table",
    """
SELECT CAST(transaction_id AS VARCHAR) AS ATGSalesOrderNumber, transaction_date AS OrderDate, brand AS DWBRAND,
       revenue AS Revenue, CAST(NULL AS VARCHAR) AS COUPON_CODE
FROM p_transactions""",
)
def order_details_table(v: Views) -> DataFrame:
    """The order table, created by day with its cluster columns, then filled
    with the web purchases."""
    path = new_path(v.spark, "details")
    name = "order_details_" + path.rsplit("-", 1)[1]
    fields = [f for f in schema.ORDER_DETAILS if f.name != "OrderDate"] + [schema.ORDER_DETAILS["OrderDate"]]
    tables.create_table(
        v.spark, name, T.StructType(fields), partition_by="OrderDate", cluster_by=["DWBRAND", "Customer_Status"],
        path=path, description="Back-office orders",
    )
    given = {
        "ATGSalesOrderNumber": F.col("transaction_id").cast("string"),
        "OrderDate": F.col("transaction_date"),
        "DWBRAND": F.col("brand"),
        "Revenue": F.col("revenue"),
    }
    rows = v.transactions().select(*(given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))
    start = "2000-01-01"
    filled = tables.incremental_refresh(rows, name, date_col="OrderDate", start=start, checkpoint=start, path=path)
    return filled.select(*given, "COUPON_CODE")


@query(
    "brand_order_share",
    """
SELECT order_brand, order_type, count(*) AS orders,
       round(count(*) / sum(count(*)) OVER (PARTITION BY order_brand) * 100, 2) AS pct_orders
FROM p_orders GROUP BY 1, 2""",
)
def brand_order_share(v: Views) -> DataFrame:
    counted = v.orders().groupBy("order_brand", "order_type").agg(F.count(F.lit(1)).alias("orders"))
    return kpi.with_shares(counted, {"orders": "pct_orders"}, ["order_brand"])
