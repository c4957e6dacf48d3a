"""Visits, log-in groups, channels and revenue by brand, period and campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions import rules, text
from visitloom.functions.dates import (
    months_since,
    period,
    quarter_in_year_from,
    quarter_of,
)
from visitloom.functions.numbers import ratio
from visitloom.operators import distinct, kpi, properties, sessions
from visitloom.operators.calendar import WEEK_SCHEMA, expand_weeks, with_fiscal
from visitloom.plans.registry import query
from visitloom.plans.views import Views
from visitloom.sources.staging import new_path, stage
from visitloom.streaming.runs import ingest_new_files

MONTH_COLUMNS = ["fiscal_year", "fiscal_month_name", "fiscal_month_number", "fiscal_quarter_number"]
TEST_NATIONS = ("NATION_1", "NATION_6", "NATION_11", "NATION_16")
CONTROL_NATIONS = ("NATION_2", "NATION_7", "NATION_12", "NATION_17")
HOME_PATHS = ("/", "/jsp/homepage.jsp")
CLOSED_HOST = "ththre.example"
CURRENT = ("2024-01-16", "2024-01-30")
PERIOD_SQL = """CASE WHEN {c} BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' THEN 'Current Year'
            WHEN {c} BETWEEN DATE '2023-01-16' AND DATE '2023-01-30' THEN 'Previous Year' END"""
# The given events cover one month: users with an odd id stand for the year before.
YEAR_SHIFT = "if(user_pseudo_id % 2 = 1, add_months({c}, -12), {c})"
YEAR_SHIFT_SQL = "CAST(CASE WHEN user_pseudo_id % 2 = 1 THEN {c} - INTERVAL 1 YEAR ELSE {c} END AS DATE)"
DISTINCTS = """count(DISTINCT user_pseudo_id) AS users, count(DISTINCT session_id) AS sessions,
       count(DISTINCT transaction_id) AS transactions"""
IDENTIFIED = "CASE WHEN login_status IN ('Soft Logged-In', 'Hard Logged-In') THEN 1 ELSE 0 END"
GROUP_SQL = f"""CASE max({IDENTIFIED}) * 2 + max(CASE lower(login_status) WHEN 'unidentified' THEN 1 ELSE 0 END)
       WHEN 3 THEN 'Identified AND Unidentified' WHEN 2 THEN 'Identified ONLY'
       WHEN 1 THEN 'Unidentified ONLY' ELSE 'Unknown' END"""
NATION_GROUP_SQL = """CASE WHEN {c} IN ('NATION_1','NATION_6','NATION_11','NATION_16') THEN 'Test'
       WHEN {c} IN ('NATION_2','NATION_7','NATION_12','NATION_17') THEN 'Control' ELSE 'All Other' END"""
LANDING_SQL = f"""regexp_matches({{c}}, '{rules.LANDING_PAGE}')"""
CHANNEL_SQL = f"""CASE WHEN (source IS NULL AND medium IS NULL) OR medium = 'organic' THEN 'Direct and Organic'
       WHEN source IN {rules.EMAIL_SOURCES} THEN 'CM - Email'
       WHEN regexp_matches(source, '{rules.SEARCH_SOURCE}') AND regexp_matches(medium, '{rules.SEARCH_MEDIUM}')
        THEN 'RM - Paid Search'
       WHEN (regexp_matches(source, '{rules.SOCIAL}') OR regexp_matches(medium, '{rules.SOCIAL}'))
        AND NOT (regexp_matches(source, '{rules.UNPAID}') OR regexp_matches(medium, '{rules.UNPAID}'))
        THEN 'RM - Paid Social'
       WHEN source LIKE '{rules.SMS_SOURCE}' THEN 'CM - Attentive SMS'
       WHEN regexp_matches(source, '{rules.MAIL_SOURCE}') THEN 'CM - Direct Mail' ELSE 'Other' END"""


def landing_sessions(v: Views, **more) -> DataFrame:
    return sessions.page_sessions(
        v.events(pages=True, geo=True), names=["page_view"], url_regex=rules.LANDING_PAGE, **more
    )


def home_page_events(v: Views) -> DataFrame:
    return v.events(pages=True, geo=True).where(
        F.col("event_name").isin("page_view", "adobe_page_view")
        & F.col("page_path").isin(*HOME_PATHS)
        & (F.col("country") != "ASIA")
    )


def nation_group(column: str):
    return rules.state_group(F.col(column), TEST_NATIONS, CONTROL_NATIONS)


@query(
    "homepage_login_kpi",
    f"""
WITH s AS (
  SELECT CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month,
         user_pseudo_id, session_id, {GROUP_SQL} AS login_status
  FROM p_events
  WHERE event_name IN ('page_view', 'adobe_page_view') AND page_path IN ('/', '/jsp/homepage.jsp')
    AND country <> 'ASIA'
  GROUP BY 1, 2, 3, 4),
r AS (SELECT s.*, transaction_id, revenue FROM s
      LEFT JOIN (SELECT DISTINCT session_id, transaction_id, revenue FROM p_transactions) USING (session_id))
SELECT year, month, login_status, {DISTINCTS}, round(sum(coalesce(revenue, 0)), 2) AS revenue
FROM r GROUP BY year, month, login_status
UNION ALL
SELECT year, month, 'All', {DISTINCTS}, round(sum(coalesce(revenue, 0)), 2) FROM r GROUP BY year, month""",
)
def homepage_login_kpi(v: Views) -> DataFrame:
    visits = home_page_events(v).withColumns({"year": F.year("event_date"), "month": F.month("event_date")})
    groups = sessions.login_status_sessions(visits, ["year", "month", "user_pseudo_id", "session_id"])
    sales = v.transactions().select("session_id", "transaction_id", "revenue").distinct()
    return kpi.session_kpi_with_total(
        groups, sales, ["year", "month"], "login_status", join_keys=["session_id"]
    )


@query(
    "homepage_login_bitmaps",
    f"""
WITH s AS (
  SELECT CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month,
         user_pseudo_id, session_id, {GROUP_SQL} AS login_status
  FROM p_events
  WHERE event_name IN ('page_view', 'adobe_page_view') AND page_path IN ('/', '/jsp/homepage.jsp')
    AND country <> 'ASIA'
  GROUP BY 1, 2, 3, 4)
SELECT year, month, login_status, count(DISTINCT user_pseudo_id) AS users, count(DISTINCT session_id) AS sessions
FROM s GROUP BY 1, 2, 3
UNION ALL
SELECT year, month, 'All', count(DISTINCT user_pseudo_id), count(DISTINCT session_id) FROM s GROUP BY 1, 2""",
)
def homepage_login_bitmaps(v: Views) -> DataFrame:
    """Users and sessions per log-in status and their total from one set of bitmaps."""
    visits = home_page_events(v).withColumns({"year": F.year("event_date"), "month": F.month("event_date")})
    groups = stage(sessions.login_status_sessions(visits, ["year", "month", "user_pseudo_id", "session_id"]))
    counted = {"users": "user_pseudo_id", "sessions": "session_id"}
    return distinct.distinct_with_total(groups, ["year", "month"], "login_status", counted)


@query(
    "homepage_login_kpi_fiscal",
    f"""
WITH s AS (
  SELECT brand, fiscal_year, fiscal_month_name, fiscal_month_number, fiscal_quarter_number,
         user_pseudo_id, session_id, {GROUP_SQL} AS login_status
  FROM p_events JOIN fiscal ON date = event_date
  WHERE event_name IN ('page_view', 'adobe_page_view') AND page_path IN ('/', '/jsp/homepage.jsp')
    AND country <> 'ASIA'
  GROUP BY ALL),
r AS (SELECT s.*, transaction_id, revenue FROM s
      LEFT JOIN (SELECT DISTINCT brand, session_id, transaction_id, revenue FROM p_transactions)
      USING (brand, session_id)),
l AS (SELECT * FROM r UNION ALL SELECT * REPLACE ('All' AS login_status) FROM r)
SELECT brand, fiscal_year, fiscal_month_name, fiscal_month_number, fiscal_quarter_number, login_status,
       {DISTINCTS}, round(sum(coalesce(revenue, 0)), 2) AS revenue
FROM l GROUP BY 1, 2, 3, 4, 5, 6""",
)
def homepage_login_kpi_fiscal(v: Views) -> DataFrame:
    visits = with_fiscal(home_page_events(v), "event_date", v.fiscal, MONTH_COLUMNS, "inner")
    keys = ["brand", *MONTH_COLUMNS]
    groups = sessions.login_status_sessions(visits, [*keys, "user_pseudo_id", "session_id"])
    sales = v.transactions().select("brand", "session_id", "transaction_id", "revenue").distinct()
    return kpi.session_kpi_with_total(groups, sales, keys, "login_status")


@query(
    "login_groups",
    f"""
SELECT brand, event_date, user_pseudo_id, session_id, {GROUP_SQL} AS login_status
FROM p_events GROUP BY brand, event_date, user_pseudo_id, session_id""",
)
def login_groups(v: Views) -> DataFrame:
    return sessions.login_status_sessions(
        v.events(), ["brand", "event_date", "user_pseudo_id", "session_id"]
    )


@query(
    "login_status_users",
    """
SELECT CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month, login_status,
       count(DISTINCT user_pseudo_id) AS users
FROM p_events WHERE event_name = 'page_view' AND country <> 'ASIA' GROUP BY 1, 2, 3""",
)
def login_status_users(v: Views) -> DataFrame:
    views = v.events(geo=True).where("event_name = 'page_view' and country <> 'ASIA'")
    return views.groupBy(
        F.year("event_date").alias("year"), F.month("event_date").alias("month"), "login_status"
    ).agg(F.count_distinct("user_pseudo_id").alias("users"))


@query("page_view_login_status", "SELECT login_status FROM p_events WHERE event_name = 'page_view'")
def page_view_login_status(v: Views) -> DataFrame:
    return v.events().where("event_name = 'page_view'").select("login_status")


@query(
    "landing_channel_revenue",
    f"""
WITH s AS (SELECT DISTINCT brand, user_pseudo_id, session_id, event_date FROM p_events
           JOIN fiscal ON date = event_date
           WHERE event_name = 'page_view' AND country <> 'ASIA' AND {LANDING_SQL.format(c="page_location")}),
t AS (SELECT DISTINCT brand, session_id, transaction_id, revenue FROM p_transactions),
c AS (SELECT brand, session_id, {CHANNEL_SQL} AS channel,
             coalesce(source, '(none)') || ' / ' || coalesce(medium, '(none)') AS source_medium FROM p_sessions)
SELECT s.brand, fiscal_year, fiscal_month_name, fiscal_month_number, fiscal_quarter_number, channel, source_medium,
       count(DISTINCT s.user_pseudo_id) AS users, count(DISTINCT s.session_id) AS sessions,
       count(DISTINCT t.transaction_id) AS transactions, round(sum(t.revenue), 2) AS revenue
FROM s LEFT JOIN t USING (brand, session_id) LEFT JOIN c USING (brand, session_id)
LEFT JOIN fiscal ON date = event_date
GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def landing_channel_revenue(v: Views) -> DataFrame:
    visits = with_fiscal(
        landing_sessions(v, not_country="ASIA"), "event_date", v.fiscal, MONTH_COLUMNS, "inner"
    )
    source, medium = F.col("source"), F.col("medium")
    channels = v.sessions(pages=False, geo=False).select(
        "brand",
        "session_id",
        rules.channel_by_source(source, medium).alias("channel"),
        text.source_medium(source, medium, "(none)").alias("source_medium"),
    )
    tagged = visits.join(channels, ["brand", "session_id"], "left")
    sales = v.transactions().select("brand", "session_id", "transaction_id", "revenue").distinct()
    return kpi.session_kpi(tagged, sales, ["brand", *MONTH_COLUMNS, "channel", "source_medium"])


@query(
    "landing_vs_total_traffic",
    f"""
WITH s AS (
  SELECT DISTINCT brand, user_pseudo_id, session_id, event_date, 'CMLP' AS segment FROM p_events
  WHERE country = 'AMERICA' AND event_name = 'page_view' AND {LANDING_SQL.format(c="lower(page_location)")}
  UNION ALL
  SELECT DISTINCT brand, user_pseudo_id, session_id, event_date, 'Total' FROM p_events WHERE country = 'AMERICA'),
t AS (SELECT DISTINCT brand, session_id, transaction_id, revenue FROM p_transactions)
SELECT segment, brand, fiscal_year, fiscal_month_name, {DISTINCTS}, round(sum(revenue), 2) AS revenue
FROM s LEFT JOIN t USING (brand, session_id) LEFT JOIN fiscal ON date = event_date
GROUP BY 1, 2, 3, 4""",
)
def landing_vs_total_traffic(v: Views) -> DataFrame:
    hosts = {f"www.b{i}.example": f"B{i}" for i in range(3)}
    events = v.events(pages=True, geo=True).where("country = 'AMERICA'")
    branded = events.withColumn("brand", properties.brand_of_host(F.col("host"), hosts))
    on_landing_page = (F.col("event_name") == "page_view") & F.lower("page_location").rlike(rules.LANDING_PAGE)
    segments = kpi.segment_rows(branded, {"CMLP": on_landing_page, "Total": F.lit(True)})
    visits = segments.select("segment", "brand", "user_pseudo_id", "session_id", "event_date").distinct()
    dated = with_fiscal(visits, "event_date", v.fiscal, ["fiscal_year", "fiscal_month_name"])
    sales = v.transactions().select("brand", "session_id", "transaction_id", "revenue").distinct()
    return kpi.session_kpi(dated, sales, ["segment", "brand", "fiscal_year", "fiscal_month_name"])


@query(
    "landing_total_traffic",
    f"""
WITH s AS (SELECT DISTINCT user_pseudo_id, session_id FROM p_events
           WHERE event_name = 'page_view' AND country <> 'ASIA'
             AND regexp_matches(page_location, '{rules.LANDING_PAGE_OLD}')
             AND NOT regexp_matches(page_location, '{rules.LANDING_PAGE_OLD_EXCEPT}'))
SELECT {DISTINCTS.replace("user_pseudo_id", "s.user_pseudo_id").replace("session_id", "s.session_id")},
       round(sum(revenue), 2) AS revenue
FROM s LEFT JOIN p_transactions t ON t.session_id = s.session_id""",
)
def landing_total_traffic(v: Views) -> DataFrame:
    visits = sessions.page_sessions(
        v.events(pages=True, geo=True),
        names=["page_view"],
        not_country="ASIA",
        url_regex=rules.LANDING_PAGE_OLD,
        not_url_regex=rules.LANDING_PAGE_OLD_EXCEPT,
        columns=["user_pseudo_id", "session_id"],
    )
    return kpi.session_kpi(
        visits, v.transactions().select("session_id", "transaction_id", "revenue"), [], join_keys=["session_id"]
    )


@query(
    "landing_page_sessions",
    """
SELECT DISTINCT brand, user_pseudo_id, session_id, event_date FROM p_events
WHERE event_name IN ('page_view', 'click') AND country = 'EUROPE' AND host = 'www.b1.example'
  AND regexp_matches(lower(page_location), '/next/(.*-|)sale|/product')
  AND event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'""",
)
def landing_page_sessions(v: Views) -> DataFrame:
    return sessions.page_sessions(
        v.events(pages=True, geo=True),
        names=["page_view", "click"],
        country="EUROPE",
        host="www.b1.example",
        url_regex=r"/next/(.*-|)sale|/product",
        lower_url=True,
        first_day="2024-01-01",
        last_day="2024-01-30",
    )


@query(
    "property_union_daily",
    """
SELECT brand, replace(brand, 'B', 'property-') AS property_id, event_date, count(*) AS events,
       count(DISTINCT session_id) AS sessions
FROM p_events GROUP BY 1, 2, 3""",
)
def property_union_daily(v: Views) -> DataFrame:
    """Each property's events lie in a table of their own; all that exist are read."""
    folder = new_path(v.spark, "properties")
    v.events().select("brand", "event_date", "session_id").write.partitionBy("brand").parquet(folder)
    stored = v.spark.read.parquet(folder)
    brands = [r[0] for r in stored.select("brand").distinct().collect()]  # one per property
    tables = {b: v.spark.read.parquet(f"{folder}/brand={b}") for b in brands}
    ids = {b: b.replace("B", "property-") for b in tables}
    events = properties.brand_union(tables, ["event_date", "session_id"], ids)
    return events.groupBy("brand", "property_id", "event_date").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions")
    )


@query(
    "brand_month_traffic",
    f"""
SELECT brand, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, {DISTINCTS},
       round(sum(purchase_revenue), 2) AS revenue
FROM p_report WHERE brand IN ('B0', 'B1') AND date BETWEEN DATE '2024-01-01' AND DATE '2024-04-21'
GROUP BY 1, 2, 3""",
)
def brand_month_traffic(v: Views) -> DataFrame:
    report = v.report(pages=False, geo=False, fiscal=False).where(
        "brand in ('B0', 'B1') and date between date'2024-01-01' and date'2024-04-21'"
    )
    dated = report.withColumns({"month": F.month("date"), "year": F.year("date")})
    return kpi.wide_kpi(dated, ["brand", "month", "year"])


@query(
    "brand_fiscal_traffic",
    f"""
SELECT brand, fiscal_year, fiscal_month_name, fiscal_month_number, 'Total Website Traffic' AS segment,
       {DISTINCTS}, round(sum(purchase_revenue), 2) AS revenue
FROM p_report GROUP BY ALL""",
)
def brand_fiscal_traffic(v: Views) -> DataFrame:
    report = v.report(pages=False, geo=False).withColumn("segment", F.lit("Total Website Traffic"))
    return kpi.wide_kpi(
        report, ["brand", "fiscal_year", "fiscal_month_name", "fiscal_month_number", "segment"]
    )


@query(
    "club_order_revenue",
    """
SELECT brand, order_type, count(DISTINCT transaction_id) AS orders, round(sum(purchase_revenue), 2) AS revenue
FROM p_report GROUP BY 1, 2""",
)
def club_order_revenue(v: Views) -> DataFrame:
    table = kpi.wide_kpi(v.report(pages=False, geo=False, fiscal=False), ["brand", "order_type"])
    return table.select("brand", "order_type", F.col("transactions").alias("orders"), "revenue")


@query(
    "checkout_session_revenue",
    f"""
WITH s AS (SELECT session_id FROM p_events WHERE event_name = 'page_view' GROUP BY 1
           HAVING max(regexp_matches(page_location, '{rules.CLOSED_CHECKOUT}')))
SELECT brand, order_type, count(DISTINCT transaction_id) AS orders, round(sum(purchase_revenue), 2) AS revenue
FROM s JOIN p_report USING (session_id) GROUP BY 1, 2""",
)
def checkout_session_revenue(v: Views) -> DataFrame:
    views = v.events(pages=True).where("event_name = 'page_view'")
    checked_out = sessions.sessions_any(views, F.col("page_location").rlike(rules.CLOSED_CHECKOUT))
    report = v.report(pages=False, geo=False, fiscal=False).join(checked_out, "session_id", "left_semi")
    table = kpi.wide_kpi(report, ["brand", "order_type"])
    return table.select("brand", "order_type", F.col("transactions").alias("orders"), "revenue")


@query(
    "main_site_sessions",
    f"""
WITH s AS (SELECT CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month,
                  user_pseudo_id, session_id FROM p_events WHERE country <> 'ASIA' GROUP BY 1, 2, 3, 4
           HAVING count(CASE WHEN NOT regexp_matches(page_location, '{rules.CLOSED_PAGES}')
                              AND NOT contains(page_location, '{CLOSED_HOST}') THEN 1 END) > 0)
SELECT year, month, count(DISTINCT user_pseudo_id) AS users, count(DISTINCT session_id) AS sessions
FROM s GROUP BY 1, 2""",
)
def main_site_sessions(v: Views) -> DataFrame:
    events = v.events(pages=True, geo=True).where("country <> 'ASIA'")
    dated = events.withColumns({"year": F.year("event_date"), "month": F.month("event_date")})
    kept = sessions.sessions_not_only(
        dated, rules.CLOSED_PAGES, ["year", "month", "user_pseudo_id", "session_id"], hosts=[CLOSED_HOST]
    )
    return kept.groupBy("year", "month").agg(
        F.count_distinct("user_pseudo_id").alias("users"), F.count_distinct("session_id").alias("sessions")
    )


@query(
    "organic_landing_revenue",
    f"""
SELECT brand, round(sum(purchase_revenue), 2) AS revenue FROM p_report
WHERE landing_page_type IN {rules.ORGANIC_PAGE_TYPES}
  AND (lnd_medium = 'organic' OR (lnd_source_medium = 'none / none'
       AND (landing_page_location NOT LIKE '%promoCode=%' OR landing_page_location NOT LIKE '%cid=%')))
GROUP BY 1""",
)
def organic_landing_revenue(v: Views) -> DataFrame:
    return kpi.organic_revenue(v.report(geo=False, fiscal=False), rules.ORGANIC_PAGE_TYPES, mode="any")


@query(
    "organic_landing_revenue_strict",
    f"""
SELECT brand, round(sum(purchase_revenue), 2) AS revenue FROM p_report
WHERE landing_page_type IN {rules.ORGANIC_PAGE_TYPES}
  AND (lnd_medium = 'organic' OR (lnd_source_medium = 'none / none'
       AND NOT contains(landing_page_location, 'promoCode=') AND NOT contains(landing_page_location, 'cid=')))
GROUP BY 1""",
)
def organic_landing_revenue_strict(v: Views) -> DataFrame:
    return kpi.organic_revenue(v.report(geo=False, fiscal=False), rules.ORGANIC_PAGE_TYPES)


@query(
    "organic_page_revenue",
    f"""
SELECT round(sum(revenue), 2) AS revenue
FROM p_sessions s LEFT JOIN p_transactions t ON t.session_id = s.session_id
WHERE (s.medium = 'organic' OR (s.source IS NULL AND s.medium IS NULL))
  AND regexp_matches(landing_page_location, '{rules.ORGANIC_PAGES}')
  AND landing_page_location NOT LIKE '%promoCode%' AND s.country <> 'ASIA'""",
)
def organic_page_revenue(v: Views) -> DataFrame:
    url = F.col("landing_page_location")
    landed = v.sessions().where(
        ((F.col("medium") == "organic") | (F.col("source").isNull() & F.col("medium").isNull()))
        & url.rlike(rules.ORGANIC_PAGES)
        & ~url.like("%promoCode%")
        & (F.col("country") != "ASIA")
    )
    sales = v.transactions().select("session_id", "revenue")
    # Sessions without a sale add nothing to a sum, so the join can be inner.
    joined = landed.select("session_id").join(sales, "session_id")
    return joined.agg(F.round(F.sum("revenue"), 2).alias("revenue"))


@query(
    "cart_segment_kpi",
    """
WITH s AS (
  SELECT 'free shipping upsell' AS segment, * FROM p_events
  WHERE event_name = 'click' AND event_category = 'OTHER' AND event_class LIKE 'Free Shipping%'
  UNION ALL
  SELECT 'deployed', * FROM p_events WHERE event_name = 'click' AND event_category = 'SUBMIT FEEDBACK')
SELECT segment, s.brand, CAST(date_trunc('year', event_date) AS DATE) AS year,
       CAST(date_trunc('month', event_date) AS DATE) AS month,
       count(DISTINCT s.user_pseudo_id) AS users, count(DISTINCT s.session_id) AS sessions,
       count(DISTINCT t.transaction_id) AS transactions, round(sum(t.revenue), 2) AS revenue
FROM s LEFT JOIN p_transactions t ON t.session_id = s.session_id GROUP BY 1, 2, 3, 4""",
)
def cart_segment_kpi(v: Views) -> DataFrame:
    clicks = v.events().where("event_name = 'click'")
    segments = kpi.segment_rows(
        clicks,
        {
            "free shipping upsell": (F.col("event_category") == "OTHER")
            & F.col("event_class").startswith("Free Shipping"),
            "deployed": F.col("event_category") == "SUBMIT FEEDBACK",
        },
    ).withColumns({"year": F.trunc("event_date", "YEAR"), "month": F.trunc("event_date", "MM")})
    sales = v.transactions().select("session_id", "transaction_id", "revenue")
    keys = ["segment", "brand", "year", "month"]
    visits = kpi.collapse(segments, keys)
    return kpi.session_kpi(visits, sales, keys, join_keys=["session_id"], copies="copies")


@query(
    "promo_campaign_kpi",
    f"""
WITH s AS (SELECT DISTINCT user_pseudo_id, session_id, page_location, promo_code FROM p_events
           WHERE promo_code LIKE '%P%' AND page_location LIKE '%offer_temp5.jsp%')
SELECT promo_code, count(DISTINCT s.user_pseudo_id) AS users, count(DISTINCT s.session_id) AS sessions,
       count(DISTINCT transaction_id) AS transactions, round(sum(revenue), 2) AS revenue
FROM s LEFT JOIN p_transactions t ON t.session_id = s.session_id GROUP BY 1""",
)
def promo_campaign_kpi(v: Views) -> DataFrame:
    marked = F.col("promo_code").like("%P%") & F.col("page_location").like("%offer_temp5.jsp%")
    visits = sessions.page_sessions(
        v.events(pages=True),
        where=marked,
        columns=["user_pseudo_id", "session_id", "page_location", "promo_code"],
    )
    sales = v.transactions().select("session_id", "transaction_id", "revenue")
    return kpi.session_kpi(visits, sales, ["promo_code"], join_keys=["session_id"])


@query(
    "presale_page_sessions",
    f"""
SELECT event_date, page_location, count(DISTINCT session_id) AS sessions FROM p_events
WHERE regexp_matches(page_location, '{rules.PRESALE_PAGES}') AND page_location LIKE '%N003%'
GROUP BY 1, 2""",
)
def presale_page_sessions(v: Views) -> DataFrame:
    return sessions.page_session_counts(v.events(pages=True), [rules.PRESALE_PAGES, "N003"])


@query(
    "source_medium_kpi",
    """
SELECT coalesce(source, '(not set)') || ' / ' || coalesce(medium, '(not set)') AS source_medium,
       count(DISTINCT s.user_pseudo_id) AS users, count(DISTINCT s.session_id) AS sessions,
       count(DISTINCT transaction_id) AS transactions, round(coalesce(sum(revenue), 0), 2) AS revenue
FROM p_sessions s LEFT JOIN p_transactions t ON t.session_id = s.session_id GROUP BY 1""",
)
def source_medium_kpi(v: Views) -> DataFrame:
    pair = text.source_medium(F.col("source"), F.col("medium"), "(not set)")
    visits = v.sessions(pages=False, geo=False).withColumn("source_medium", pair)
    sales = v.transactions().select("session_id", "transaction_id", "revenue")
    return kpi.session_kpi(visits, sales, ["source_medium"], join_keys=["session_id"], revenue="zero")


def _state_rows(v: Views) -> DataFrame:
    orders = v.orders().select(
        F.col("order_id").alias("transaction_id"),
        rules.customer_status(F.col("customer_status")).alias("customer_status"),
        rules.order_kind(F.col("order_type")).alias("order_kind"),
    )
    return (
        v.report()
        .alias("r")
        .join(orders, "transaction_id")
        .withColumns({"state_group": nation_group("region"), "day": F.expr(YEAR_SHIFT.format(c="r.date"))})
        .withColumn("period", period(F.col("day"), CURRENT))
        .where("period is not null")
    )


STATE_ROWS_SQL = f"""
SELECT r.*, CASE customer_status WHEN 'Existing Customer' THEN 'Existing' WHEN 'New Recruit' THEN 'New'
              WHEN 'Re-Recruit' THEN 'New' END AS status,
       CASE o.order_type WHEN 'Wine Club' THEN 'Club' WHEN 'Non-Wine Club' THEN 'Standard' END AS order_kind,
       {NATION_GROUP_SQL.format(c="region")} AS state_group, {YEAR_SHIFT_SQL.format(c="r.date")} AS day,
       {PERIOD_SQL.format(c="day")} AS period
FROM p_report r JOIN p_orders o ON o.order_id = r.transaction_id WHERE period IS NOT NULL"""


@query(
    "promo_orders_by_week",
    f"""
WITH x AS ({STATE_ROWS_SQL})
SELECT period, state_group, order_kind, fiscal_week_end_date AS week_ending,
       source || ' / ' || medium AS source_medium, landing_page_location,
       count(DISTINCT transaction_id) AS orders
FROM x WHERE status = 'New' AND state_group IN ('Control', 'Test')
  AND NOT regexp_matches(landing_page_location, 'promoCode=(P4|P5)')
GROUP BY ALL""",
)
def promo_orders_by_week(v: Views) -> DataFrame:
    rows = _state_rows(v).where(
        (F.col("customer_status") == "New")
        & F.col("state_group").isin("Control", "Test")
        & ~F.col("landing_page_location").rlike("promoCode=(P4|P5)")
    )
    return (
        rows.withColumn("source_medium", text.source_medium(F.col("source"), F.col("medium")))
        .withColumnRenamed("fiscal_week_end_date", "week_ending")
        .groupBy("period", "state_group", "order_kind", "week_ending", "source_medium", "landing_page_location")
        .agg(F.count_distinct("transaction_id").alias("orders"))
    )


@query(
    "state_order_counts",
    f"""
WITH x AS ({STATE_ROWS_SQL})
SELECT CAST(month(date) AS INTEGER) AS month, status AS customer_status, state_group, order_kind,
       count(DISTINCT transaction_id) AS transactions
FROM x WHERE period = 'Current Year' GROUP BY ALL""",
)
def state_order_counts(v: Views) -> DataFrame:
    return (
        _state_rows(v)
        .where("period = 'Current Year'")
        .groupBy(F.month("date").alias("month"), "customer_status", "state_group", "order_kind")
        .agg(F.count_distinct("transaction_id").alias("transactions"))
    )


YOY_SQL = """
m AS (SELECT {keys},
  count(DISTINCT CASE WHEN cur THEN u END) AS users_current, count(DISTINCT CASE WHEN NOT cur THEN u END) AS users_previous,
  count(DISTINCT CASE WHEN cur THEN s END) AS sessions_current, count(DISTINCT CASE WHEN NOT cur THEN s END) AS sessions_previous,
  count(DISTINCT CASE WHEN cur THEN t END) AS transactions_current, count(DISTINCT CASE WHEN NOT cur THEN t END) AS transactions_previous,
  round(sum(CASE WHEN cur THEN r END), 2) AS revenue_current, round(sum(CASE WHEN NOT cur THEN r END), 2) AS revenue_previous
  FROM x GROUP BY ALL),
q AS (SELECT *, transactions_current / nullif(users_current, 0) AS cc, transactions_previous / nullif(users_previous, 0) AS cp,
        revenue_current / nullif(transactions_current, 0) AS ac, revenue_previous / nullif(transactions_previous, 0) AS ap FROM m)
SELECT {keys}, users_current, users_previous, sessions_current, sessions_previous, transactions_current,
  transactions_previous, revenue_current, revenue_previous,
  round(cc, 6) AS conversion_rate_current, round(cp, 6) AS conversion_rate_previous,
  round(ac, 4) AS average_order_value_current, round(ap, 4) AS average_order_value_previous,
  round((users_current - users_previous) / nullif(users_previous, 0) * 100, 4) AS users_yoy_change,
  round((sessions_current - sessions_previous) / nullif(sessions_previous, 0) * 100, 4) AS sessions_yoy_change,
  round((transactions_current - transactions_previous) / nullif(transactions_previous, 0) * 100, 4) AS transactions_yoy_change,
  round((revenue_current - revenue_previous) / nullif(revenue_previous, 0) * 100, 4) AS revenue_yoy_change,
  round((cc - cp) / nullif(cp, 0) * 100, 4) AS conversion_rate_yoy_change,
  round((ac - ap) / nullif(ap, 0) * 100, 4) AS average_order_value_yoy_change
FROM q"""


def _rounded_yoy(df: DataFrame) -> DataFrame:
    def digits(name: str) -> int:
        return 6 if name.startswith("conversion_rate_") and "yoy" not in name else 4

    ratios = [c for c in df.columns if c.endswith("_change") or c.startswith(("conversion", "average"))]
    return df.withColumns({c: F.round(c, digits(c)) for c in ratios})


@query(
    "state_performance_yoy",
    f"""
WITH d AS (SELECT *, {YEAR_SHIFT_SQL.format(c="session_date")} AS day FROM p_sessions),
x AS (SELECT CAST(month(day) AS INTEGER) AS month, {NATION_GROUP_SQL.format(c="region")} AS state_group,
  {PERIOD_SQL.format(c="day")} = 'Current Year' AS cur, s.user_pseudo_id AS u, s.session_id AS s,
  transaction_id AS t, revenue AS r
  FROM d s LEFT JOIN p_transactions t ON t.session_id = s.session_id WHERE country IS NOT NULL AND cur IS NOT NULL),
{YOY_SQL.format(keys="month, state_group")}""",
)
def state_performance_yoy(v: Views) -> DataFrame:
    dated = v.sessions(pages=False).where("country is not null").withColumn(
        "day", F.expr(YEAR_SHIFT.format(c="session_date"))
    )
    visits = dated.withColumns(
        {"month": F.month("day"), "state_group": nation_group("region"), "period": period(F.col("day"), CURRENT)}
    ).where("period is not null")
    sales = v.transactions().select("session_id", "transaction_id", "revenue")
    rows = kpi.session_sales(visits, sales, ["session_id"], ["month", "state_group", "period"])
    table = kpi.year_over_year(rows, ["month", "state_group"])
    ordered = table.orderBy(months_since(F.col("month"), 9), F.desc("state_group"))
    return _rounded_yoy(ordered)


@query(
    "order_kind_yoy",
    f"""
WITH x AS (SELECT CAST(month(order_date) AS INTEGER) AS month, order_type, year(order_date) = 1998 AS cur,
  customer_id AS u, order_id AS s, CASE WHEN sales_status = 'Invoiced' THEN order_id END AS t, order_revenue AS r
  FROM p_orders WHERE year(order_date) IN (1997, 1998)),
{YOY_SQL.format(keys="month, order_type")}""",
)
def order_kind_yoy(v: Views) -> DataFrame:
    rows = v.orders().select(
        F.month("order_date").alias("month"),
        "order_type",
        period(F.col("order_date"), ("1998-01-01", "1998-12-31")).alias("period"),
        F.col("customer_id").alias("user_pseudo_id"),
        F.col("order_id").alias("session_id"),
        F.when(F.col("sales_status") == "Invoiced", F.col("order_id")).alias("transaction_id"),
        F.col("order_revenue").alias("revenue"),
    )
    return _rounded_yoy(kpi.year_over_year(rows.where("period is not null"), ["month", "order_type"]))


@query(
    "fiscal_day_volume",
    """
SELECT f.*, CAST(row_number() OVER (PARTITION BY fiscal_year, fiscal_month_number ORDER BY date) AS INTEGER)
         AS fiscal_day_of_month, coalesce(n, 0) AS events
FROM fiscal f LEFT JOIN (SELECT event_date, count(*) AS n FROM ev0 GROUP BY 1) ON event_date = date""",
)
def fiscal_day_volume(v: Views) -> DataFrame:
    volume = v.events().groupBy(F.col("event_date").alias("date")).agg(F.count(F.lit(1)).alias("events"))
    joined = v.fiscal.join(volume, "date", "left")
    return joined.withColumn("events", F.coalesce("events", F.lit(0)))


@query(
    "stored_fiscal_weeks",
    """
SELECT fiscal_year, fiscal_month_name, fiscal_week_number, min(date) AS week_start, count(*) AS days,
       CAST(sum(coalesce(n, 0)) AS BIGINT) AS events
FROM fiscal LEFT JOIN (SELECT event_date, count(*) AS n FROM ev0 GROUP BY 1) ON event_date = date GROUP BY 1, 2, 3""",
)
def stored_fiscal_weeks(v: Views) -> DataFrame:
    """Week files as they land, one a year: ingested, expanded to days, looked up."""
    folder, target, log = (new_path(v.spark, n) for n in ("weeks", "calendar", "calendar-log"))
    v.fiscal_weeks().repartition("fiscal_year").write.option("header", True).csv(folder)
    calendar = expand_weeks(ingest_new_files(v.spark, folder, WEEK_SCHEMA, target, log))
    volume = v.events().groupBy(F.col("event_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return (
        calendar.join(volume, "date", "left")
        .groupBy("fiscal_year", "fiscal_month_name", "fiscal_week_number")
        .agg(
            F.min("date").alias("week_start"),
            F.count(F.lit(1)).alias("days"),
            F.sum(F.coalesce("n", F.lit(0))).alias("events"),
        )
    )


@query(
    "quarter_order_value",
    """
SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(quarter(order_date) AS INTEGER) AS quarter,
       CAST((quarter(order_date) + 1) % 4 + 1 AS INTEGER) AS fiscal_quarter,
       CAST(CASE WHEN month(order_date) >= 9 THEN month(order_date) - 8 ELSE month(order_date) + 4 END AS INTEGER)
         AS month_order,
       count(*) AS orders, round(sum(order_revenue) / count(*), 4) AS mean_value
FROM p_orders GROUP BY ALL""",
)
def quarter_order_value(v: Views) -> DataFrame:
    month = F.month("order_date")
    grouped = v.orders().groupBy(
        F.year("order_date").alias("year"),
        quarter_of(month).alias("quarter"),
        quarter_in_year_from(month, 7).alias("fiscal_quarter"),
        months_since(month, 9).alias("month_order"),
    )
    n = F.count(F.lit(1))
    return grouped.agg(n.alias("orders"), F.round(ratio(F.sum("order_revenue"), n), 4).alias("mean_value"))
