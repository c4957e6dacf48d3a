"""Bot detection: session profiles, signals, z-scores and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions import rules
from visitloom.functions.numbers import share_of_rows
from visitloom.functions.text import is_blank
from visitloom.operators import anomaly, kpi, sessions
from visitloom.operators.calendar import with_fiscal
from visitloom.plans.registry import query
from visitloom.plans.views import Views

PROFILE_SQL = """SELECT event_date AS session_date, session_id, count(*) AS events,
       count(*) FILTER (event_name = 'page_view') AS pageviews,
       count(*) FILTER (event_name = 'user_engagement') AS user_engagement_events,
       date_sub('second', min(event_timestamp_utc), max(event_timestamp_utc)) AS event_span_s,
       bool_or(event_name = 'purchase' OR transaction_id IS NOT NULL) AS did_purchase
FROM p_events GROUP BY 1, 2"""
BOT_SQL = """(pageviews = 1 AND NOT did_purchase AND event_span_s = 0 AND user_engagement_events = 0
              AND events BETWEEN 3 AND 5)"""
COHORT_SQL = f"""
WITH p AS ({PROFILE_SQL}),
j AS (SELECT p.*, engagement_time_msec AS ms, landing_page_referrer AS ref, city, lower(device_operating_system) AS os,
        CASE WHEN lnd_source = 'facebook' AND lnd_medium = 'paidsocial' THEN 'named source' ELSE 'other sources' END AS cohort
      FROM p JOIN p_sessions s USING (session_date, session_id))
SELECT cohort, count(*) AS sessions,"""


def _rate_sql(conditions: dict[str, str]) -> str:
    return ", ".join(
        f"round(count(*) FILTER ({cond}) / count(*), 6) AS {name}" for name, cond in conditions.items()
    )


def _cohort_sessions(v: Views) -> DataFrame:
    c = F.col
    named = (c("lnd_source") == "facebook") & (c("lnd_medium") == "paidsocial")
    landed = v.sessions(pages=False).select(
        "session_date",
        "session_id",
        F.when(named, "named source").otherwise("other sources").alias("cohort"),
        F.coalesce("engagement_time_msec", F.lit(0)).alias("session_engagement_time_msec"),
        c("landing_page_referrer").alias("landing_referrer"),
        c("city").alias("geo_city"),
        "device_operating_system",
    )
    return sessions.session_profile(v.events()).join(landed, ["session_date", "session_id"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("pct_")})


def _session_rates() -> dict:
    c = F.col
    system = F.lower("device_operating_system")
    return {
        "pct_session_engagement_0ms": c("session_engagement_time_msec") == 0,
        "pct_no_referrer": is_blank(c("landing_referrer")),
        "pct_no_geo_city": is_blank(c("geo_city")),
        "pct_ios": system == "ios",
        "pct_macintosh": system == "macintosh",
    }


SESSION_RATES_SQL = {
    "pct_session_engagement_0ms": "ms = 0",
    "pct_no_referrer": "coalesce(ref, '') = ''",
    "pct_no_geo_city": "coalesce(city, '') = ''",
    "pct_ios": "os = 'ios'",
    "pct_macintosh": "os = 'macintosh'",
}


@query(
    "cohort_rates_all",
    COHORT_SQL
    + _rate_sql(
        {
            "pct_session_duration_0s": "event_span_s = 0",
            "pct_no_user_engagement_event": "user_engagement_events = 0",
            "pct_no_purchase": "NOT did_purchase",
            "pct_1_pageview": "pageviews = 1",
            "pct_events_3_5": "events BETWEEN 3 AND 5",
        }
        | SESSION_RATES_SQL
    )
    + " FROM j GROUP BY 1",
)
def cohort_rates_all(v: Views) -> DataFrame:
    c = F.col
    conditions = {
        "pct_session_duration_0s": c("event_span_s") == 0,
        "pct_no_user_engagement_event": c("user_engagement_events") == 0,
        "pct_no_purchase": ~c("did_purchase"),
        "pct_1_pageview": c("pageviews") == 1,
        "pct_events_3_5": c("events").between(3, 5),
    }
    return _rounded(kpi.cohort_rates(_cohort_sessions(v), "cohort", conditions | _session_rates()))


@query(
    "cohort_rates_single_page",
    COHORT_SQL
    + _rate_sql(
        {
            "pct_span_0s": "event_span_s = 0",
            "pct_no_user_engagement_event": "user_engagement_events = 0",
            "pct_events_3_5": "events BETWEEN 3 AND 5",
        }
        | SESSION_RATES_SQL
    )
    + " FROM j WHERE pageviews = 1 AND NOT did_purchase GROUP BY 1",
)
def cohort_rates_single_page(v: Views) -> DataFrame:
    c = F.col
    conditions = {
        "pct_span_0s": c("event_span_s") == 0,
        "pct_no_user_engagement_event": c("user_engagement_events") == 0,
        "pct_events_3_5": c("events").between(3, 5),
    }
    base = _cohort_sessions(v).where("pageviews = 1 and not did_purchase")
    return _rounded(kpi.cohort_rates(base, "cohort", conditions | _session_rates()))


@query(
    "session_profiles",
    f"""
WITH p AS ({PROFILE_SQL})
SELECT session_date, session_id, events, pageviews, user_engagement_events, event_span_s, did_purchase,
       {BOT_SQL} AS suspected_bot FROM p""",
)
def session_profiles(v: Views) -> DataFrame:
    return sessions.with_suspected_bot(sessions.session_profile(v.events()))


@query(
    "daily_bot_signals",
    f"""
WITH p AS ({PROFILE_SQL}),
j AS (SELECT p.*, engagement_time_msec AS ms, s.city, lower(device_operating_system) AS os,
        CASE WHEN coalesce(landing_page_referrer, '') = '' THEN 'referrer_null' ELSE 'referrer_present' END AS referrer_group,
        pageviews = 1 AND NOT did_purchase AS b
      FROM p JOIN p_sessions s USING (session_date, session_id)
      WHERE brand IN ('B0', 'B1') AND lnd_source = 'facebook' AND lnd_medium = 'paidsocial'
        AND landing_page_location LIKE '%/jsp/offer/cm/%')
SELECT session_date, fiscal_week_end_date, referrer_group, count(*) AS total_sessions,
       count(*) FILTER (b) AS sessions_same_lp_1pv_non_purchase,
       count(*) FILTER (b AND {BOT_SQL}) AS suspected_bot_sessions,
       count(*) FILTER (b AND event_span_s = 0) AS session_duration_0s,
       count(*) FILTER (b AND event_span_s <= 3) AS session_duration_le_3s,
       count(*) FILTER (b AND user_engagement_events = 0) AS no_user_engagement_event,
       count(*) FILTER (b AND ms = 0) AS session_engagement_0ms,
       count(*) FILTER (b AND coalesce(city, '') = '') AS no_geo_city,
       count(*) FILTER (b AND os = 'ios') AS ios_sessions,
       count(*) FILTER (b AND os = 'macintosh') AS macintosh_sessions
FROM j LEFT JOIN fiscal ON date = session_date GROUP BY 1, 2, 3""",
)
def daily_bot_signals(v: Views) -> DataFrame:
    c = F.col
    campaign = (
        c("brand").isin("B0", "B1")
        & (c("lnd_source") == "facebook")
        & (c("lnd_medium") == "paidsocial")
        & c("landing_page_location").like("%/jsp/offer/cm/%")
    )
    landed = v.sessions().where(campaign).select(
        "session_date",
        "session_id",
        F.when(is_blank(c("landing_page_referrer")), "referrer_null")
        .otherwise("referrer_present")
        .alias("referrer_group"),
        F.coalesce("engagement_time_msec", F.lit(0)).alias("session_engagement_time_msec"),
        c("city").alias("geo_city"),
        "device_operating_system",
    )
    profile = sessions.with_suspected_bot(sessions.session_profile(v.events()))
    scored = profile.join(landed, ["session_date", "session_id"])
    dated = with_fiscal(scored, "session_date", v.fiscal, ["fiscal_week_end_date"])
    return kpi.daily_signals(dated, ["session_date", "fiscal_week_end_date", "referrer_group"])


@query(
    "zero_duration_share",
    """
WITH o AS (SELECT session_id FROM p_events GROUP BY 1 HAVING max(page_number) = 1)
SELECT round(count(*) FILTER (session_duration_s = 0) / count(*), 6) AS zero_duration_session_percentage
FROM p_sessions JOIN o USING (session_id)""",
)
def zero_duration_share(v: Views) -> DataFrame:
    single = sessions.single_page_sessions(v.events())
    landed = v.sessions(pages=False, geo=False).join(single, "session_id", "left_semi")
    share = share_of_rows(F.col("session_duration_s") == 0)
    return landed.agg(F.round(share, 6).alias("zero_duration_session_percentage"))


@query(
    "single_page_duration",
    """
WITH o AS (SELECT session_id FROM p_events GROUP BY 1 HAVING max(page_number) = 1)
SELECT round(avg(session_duration_s), 4) AS avg_session_duration FROM p_sessions JOIN o USING (session_id)""",
)
def single_page_duration(v: Views) -> DataFrame:
    single = sessions.single_page_sessions(v.events())
    landed = v.sessions(pages=False, geo=False).join(single, "session_id", "left_semi")
    return landed.agg(F.round(F.avg("session_duration_s"), 4).alias("avg_session_duration"))


FEATURES_SQL = """
SELECT event_date AS session_date, brand, user_pseudo_id, user_pseudo_id || '-' || session_id AS session_key,
       CASE WHEN lower(source) = 'facebook' AND lower(medium) = 'paidsocial' THEN 'facebook / paidsocial'
            ELSE 'Other' END AS traffic_type,
       lower(device_category) AS device_category, lower(device_operating_system) AS operating_system,
       lower(country) AS country, lower(region) AS region, lower(city) AS city,
       count(*) AS event_count, count(*) FILTER (event_name = 'page_view') AS pageviews,
       count(*) FILTER (event_name IN ('click', 'user_engagement', 'purchase', 'sign_up')) AS interaction_events,
       coalesce(sum(engagement_time_msec), 0) / 1000 AS engagement_seconds,
       CAST(max(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS has_conversion
FROM p_events GROUP BY ALL"""


def _z(value: str, by: str) -> str:
    return f"({value} - avg({value}) OVER (PARTITION BY {by})) / nullif(stddev_samp({value}) OVER (PARTITION BY {by}), 0)"


def _context(alias: str, name: str, keys: str, by: str) -> str:
    return f"""{alias} AS (SELECT {keys}, {_z("n", by)} AS {name}
  FROM (SELECT {keys}, count(DISTINCT session_key) AS n FROM f GROUP BY ALL))"""


SCORED_SQL = f"""
f AS ({FEATURES_SQL}),
{_context("dc", "dz", "session_date, traffic_type", "traffic_type")},
{_context("oc", "oz", "session_date, traffic_type, operating_system", "traffic_type, operating_system")},
{_context("vc", "vz", "session_date, traffic_type, device_category", "traffic_type, device_category")},
{_context("gc", "gz", "session_date, traffic_type, city", "traffic_type, city")},
{_context("uc", "uz", "session_date, traffic_type, brand, user_pseudo_id", "traffic_type, brand")},
sc AS (SELECT f.*, {_z("engagement_seconds", "traffic_type")} AS z_eng, {_z("event_count", "traffic_type")} AS z_evt,
         {_z("pageviews", "traffic_type")} AS z_pv, coalesce(dz, 0) AS daily_z_sessions, coalesce(oz, 0) AS os_z_sessions,
         coalesce(vz, 0) AS device_z_sessions, coalesce(gz, 0) AS geo_z_sessions, coalesce(uz, 0) AS user_z_sessions
       FROM f LEFT JOIN dc USING (session_date, traffic_type) LEFT JOIN oc USING (session_date, traffic_type, operating_system)
       LEFT JOIN vc USING (session_date, traffic_type, device_category) LEFT JOIN gc USING (session_date, traffic_type, city)
       LEFT JOIN uc USING (session_date, traffic_type, brand, user_pseudo_id)),
cl AS (SELECT *, CASE WHEN has_conversion = 1 THEN 'Human (Conversion Present)'
         WHEN traffic_type <> 'Other' AND daily_z_sessions > 1.5 AND operating_system LIKE '%android%'
          AND interaction_events = 0 AND engagement_seconds < 30 THEN 'High-Confidence Bot (FB Android spike, no interaction)'
         WHEN traffic_type <> 'Other' AND greatest(user_z_sessions, device_z_sessions, geo_z_sessions) > 2
           THEN 'Bot (User/Geo/Device anomaly)'
         WHEN coalesce(z_eng, -2) < -0.8 AND coalesce(z_evt, -2) < -0.4 THEN 'Bot (Low engagement)'
         WHEN coalesce(z_eng, 0) BETWEEN -1.0 AND -0.3 THEN 'Suspicious' ELSE 'Human' END AS session_class FROM sc)"""


def _features(v: Views) -> DataFrame:
    traffic = rules.named_traffic(F.col("source"), F.col("medium"), "facebook", "paidsocial")
    return sessions.session_features(v.events(geo=True), traffic)


@query("session_features", FEATURES_SQL)
def session_features(v: Views) -> DataFrame:
    return _features(v)


@query(
    "session_z_scores",
    f"""
WITH {SCORED_SQL}
SELECT session_date, session_key, operating_system, device_category, country, region, city, traffic_type,
       round(z_eng, 5) AS z_eng, round(z_evt, 5) AS z_evt, round(z_pv, 5) AS z_pv,
       round(daily_z_sessions, 5) AS daily_z_sessions, round(os_z_sessions, 5) AS os_z_sessions,
       round(device_z_sessions, 5) AS device_z_sessions, round(geo_z_sessions, 5) AS geo_z_sessions,
       round(user_z_sessions, 5) AS user_z_sessions FROM sc""",
)
def session_z_scores(v: Views) -> DataFrame:
    scored = anomaly.score_sessions(_features(v))
    scores = [c for c in scored.columns if c.startswith("z_") or "_z_" in c]
    rounded = scored.withColumns({c: F.round(c, 5) for c in scores})
    return rounded.select(
        "session_date",
        "session_key",
        "operating_system",
        "device_category",
        "country",
        "region",
        "city",
        "traffic_type",
        *scores,
    )


@query(
    "bot_session_classes",
    f"""
WITH {SCORED_SQL},
g AS (SELECT session_date, brand, traffic_type, session_class, count(DISTINCT session_key) AS sessions,
        count(DISTINCT user_pseudo_id) AS users, count(*) FILTER (has_conversion = 1) AS purchases FROM cl GROUP BY ALL)
SELECT *, round(sessions / sum(sessions) OVER w * 100, 2) AS pct_sessions_within_day,
       round(users / sum(users) OVER w * 100, 2) AS pct_users_within_day
FROM g WINDOW w AS (PARTITION BY session_date, traffic_type, brand)""",
)
def bot_session_classes(v: Views) -> DataFrame:
    scored = anomaly.score_sessions(_features(v))
    return anomaly.class_summary(anomaly.classify_sessions(scored, "facebook / paidsocial"))
