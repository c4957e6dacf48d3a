"""Ordered rule lists: the first rule that is TRUE gives the label.

NULL counts as "not TRUE" and nothing is coalesced unless a rule says so, so a
missing medium can fail both a test and its negation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[Column, str]]

# --- fixed values: word lists and patterns that results depend on -----------
EMAIL_SOURCES = ("bronto", "adobe", "curity")
SEARCH_SOURCE = (
    r"(?i)google|bing|Bing_Shopping|yahoo|\(not set\)|\(unlinked SA360 account\)"
    r"|ads\.google\.com|Search Traffic|SEM"
)
SEARCH_MEDIUM = (
    r"(?i)cpc|Web_SearchEngine|Web_Search Engine|web_search|\(unlinked SA360 account\)|SEM"
)
SOCIAL = r"(?i)facebook|instagram|paidsocial"
UNPAID = r"(?i)referral|organic"
SMS_SOURCE = "%attentive%"
MAIL_SOURCE = r"^cm_dm|advent|^QR"

URL_SEARCH_SOURCE = "google|bing|sa360|search|sem"
URL_SEARCH_MEDIUM = "cpc|web_search|sa360|sem"
URL_SOCIAL = "facebook|instagram|paidsocial|paid-social|fb"
URL_UNPAID = "referral|organic"
URL_PAID_MARKS = r"promoCode=|splash_template.jsp|gclid=|fbclid="

DELIMITED_ENGINE = r"(\d|_)(google|bing|yahoo)(\d|_)"
DELIMITED_SEARCH = r"(\d|_)(cpc|search.?engine|search|sem)(\d|_)"
DELIMITED_SOCIAL = r"\d(fb|facebook|ig|instagram|paidsocial|meta|paid[-_]?social)(\d|_)"
WORD_ENGINE = r"\b(google|bing|yahoo)\b"
WORD_SEARCH = r"\b(cpc|search.?engine|search|sem)\b"
WORD_SOCIAL = r"\b(fb|facebook|ig|instagram|paidsocial|meta|paid[-_]?social)\b"

CAMPAIGN_BRANDED = "_br|brand|-b-|- b -"
CAMPAIGN_GENERIC = "_nb|generic|-g-|- g -"
CAMPAIGN_PMAX = "pmax|performance max"
CAMPAIGN_SHOPPING = "%shopping%"
CAMPAIGN_DEMAND = "-yt-|- yt -|demand gen"
CAMPAIGN_RETARGET = "(retargeting|reengagement)"
CAMPAIGN_STANDARD = "_std"
CAMPAIGN_NOT_CLUB = "(event|sweepstakes|retargeting|reengagement)"

TEST_STATES = ("Texas", "Florida", "Illinois", "New Jersey", "Ohio")
CONTROL_STATES = ("California", "New York", "Michigan", "Massachusetts", "Virginia")

IDENTIFIED_STATUS = ("Soft Logged-In", "Hard Logged-In")
UNIDENTIFIED_STATUS = "unidentified"

LANDING_PAGE = (
    r"/jsp/offer/cm/us/common/cm_template_responsive.jsp.*date=202\d.*"
    r"(january|february|march|april|may|june|july|august|september|october|november|december).*"
    r"|/next/(.*-|)sale"
)
LANDING_PAGE_OLD = r"/cm_template_responsive|/next/sale"
LANDING_PAGE_OLD_EXCEPT = r"(?i)date=gifting"
CLOSED_PAGES = (
    r"/offer_temp(4|5|6)\.jsp|lp-redirect=|/confirmation\.jsp|/template\.jsp"
    r"|/confirmation_lp\.jsp|/template.jsp|splash_template.jsp|/jsp/ExpiryPage.jsp"
)
CLOSED_CHECKOUT = r"/checkout/.*(lp-redirect|confirmation\.jsp)"
PRESALE_PAGES = r"/newlandingpage/|/offer_temp5\.jsp"
ORGANIC_PAGES = r"/(product|wines|wine|search|wine-blog|advent|gifts)(\/.*|\?.*|\/$|$)"
ORGANIC_PAGE_TYPES = (
    "advent", "product detail", "product listing", "blog", "gifts", "wine club",
    "vineyard partners", "free shipping", "content template", "next template",
    "cmlp sale", "offer template", "cm template", "category temp1", "clp expired",
    "clp temp offer", "customer service",
)
INTERACTION_EVENTS = (
    "scroll", "click", "user_engagement", "search", "view_search_results",
    "add_to_cart", "view_item", "purchase", "target_checkout_begin",
    "main_navigation", "header_logo_click", "account_nav_click", "form_submit",
    "email_submit_attentive", "sms_submit_attentive", "sign_up",
)
# Session classes and the z-scores they start from.
HUMAN_BUYER, HUMAN, SUSPICIOUS = "Human (Conversion Present)", "Human", "Suspicious"
BOT_SPIKE = "High-Confidence Bot (FB Android spike, no interaction)"
BOT_ANOMALY, BOT_LOW = "Bot (User/Geo/Device anomaly)", "Bot (Low engagement)"
SPIKE_Z, SPIKE_SECONDS, ANOMALY_Z = 1.5, 30, 2
LOW_ENGAGEMENT_Z, LOW_EVENTS_Z, UNKNOWN_LOW_Z = -0.8, -0.4, -2.0
SUSPICIOUS_Z = (-1.0, -0.3)
FORWARDED_EVENTS = ("home*", "mainNavClick")
EVENT_NAME_RULES = ((r"^acdl\.home.*", "homepage_click"), (r"^acdl\.mainNavClick$", "main_navigation"))
# --- end of fixed values -----------------------------------------------------


def first_match(rules: Rules, default: str | None = None) -> Column:
    """CASE over the rules; ``default=None`` leaves unmatched rows NULL."""
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, label)
    return chain if default is None else chain.otherwise(default)


def channel_by_source(source: Column, medium: Column) -> Column:
    """Seven channels from source and medium of the last touch."""
    return first_match(
        [
            ((source.isNull() & medium.isNull()) | (medium == "organic"), "Direct and Organic"),
            (source.isin(*EMAIL_SOURCES), "CM - Email"),
            (source.rlike(SEARCH_SOURCE) & medium.rlike(SEARCH_MEDIUM), "RM - Paid Search"),
            (
                (source.rlike(SOCIAL) | medium.rlike(SOCIAL))
                & ~(source.rlike(UNPAID) | medium.rlike(UNPAID)),
                "RM - Paid Social",
            ),
            (source.like(SMS_SOURCE), "CM - Attentive SMS"),
            (source.rlike(MAIL_SOURCE), "CM - Direct Mail"),
        ],
        default="Other",
    )


def channel_by_landing(source: Column, medium: Column, landing_url: Column) -> Column:
    """Five channels; click ids in the landing URL count as paid.

    The URL is lower-cased before the direct test, so its ``promoCode=`` mark
    never matches. Results depend on it, hence it stays.
    """
    src, med, url = F.lower(source), F.lower(medium), F.lower(landing_url)
    filled_url, filled_med = F.coalesce(url, F.lit("")), F.coalesce(med, F.lit(""))
    return first_match(
        [
            (source.isNull() & medium.isNull() & ~filled_url.rlike(URL_PAID_MARKS), "Direct"),
            (med == "organic", "Organic"),
            (
                (src.rlike(URL_SEARCH_SOURCE) & med.rlike(URL_SEARCH_MEDIUM)) | url.contains("gclid"),
                "Paid Search",
            ),
            (
                (F.concat(src, med).rlike(URL_SOCIAL) | url.contains("fbclid"))
                & ~filled_med.rlike(URL_UNPAID),
                "Paid Social",
            ),
        ],
        default="Other",
    )


def channel_by_click_id(
    source: Column,
    medium: Column,
    pair: Column,
    gclid: Column,
    wbraid: Column,
    fbclid: Column,
    campaign_id: Column,
    *,
    words: bool = False,
) -> Column:
    """Four channels from URL click ids and the ``source / medium`` pair.

    ``words=False`` keeps the digit-or-underscore delimiters, under which
    'google / cpc' is not paid search; ``words=True`` uses word boundaries.
    """
    engine, search, social = (
        (WORD_ENGINE, WORD_SEARCH, WORD_SOCIAL)
        if words
        else (DELIMITED_ENGINE, DELIMITED_SEARCH, DELIMITED_SOCIAL)
    )
    return first_match(
        [
            (
                gclid.isNotNull() | wbraid.isNotNull() | (pair.rlike(engine) & pair.rlike(search)),
                "Paid Search",
            ),
            ((fbclid.isNotNull() | pair.rlike(social)) & ~pair.rlike("(referral|organic)"), "Paid Social"),
            ((source == "none") & (medium == "none") & campaign_id.isNull(), "Direct"),
        ],
        default="Other",
    )


def campaign_category(channel: Column, ads_campaign: Column, campaign: Column) -> Column:
    """Ten campaign labels, decided inside paid search and paid social only."""
    ads = F.lower(ads_campaign)
    search, social = channel == "Paid Search", channel == "Paid Social"
    return first_match(
        [
            (search & ads.rlike(CAMPAIGN_BRANDED), "Branded Search"),
            (search & ads.rlike(CAMPAIGN_GENERIC), "Generic Search"),
            (search & ads.rlike(CAMPAIGN_PMAX), "Performance Max"),
            (search & ads.like(CAMPAIGN_SHOPPING), "Shopping"),
            (search & ads.rlike(CAMPAIGN_DEMAND), "Demand Gen"),
            (search, "Other"),
            (social & campaign.rlike(CAMPAIGN_RETARGET), "Retargeting"),
            (social & campaign.rlike(CAMPAIGN_STANDARD) & ~campaign.rlike(CAMPAIGN_NOT_CLUB), "Standard"),
            (social & ~campaign.rlike(CAMPAIGN_NOT_CLUB) & (campaign != "none"), "Club"),
            (social, "Other"),
        ],
        default="General",
    )


def customer_status(status: Column) -> Column:
    return first_match(
        [(status == "Existing Customer", "Existing"), (status.isin("New Recruit", "Re-Recruit"), "New")]
    )


def order_kind(order_type: Column) -> Column:
    return first_match([(order_type == "Wine Club", "Club"), (order_type == "Non-Wine Club", "Standard")])


def state_group(
    state: Column,
    test: Sequence[str] = TEST_STATES,
    control: Sequence[str] = CONTROL_STATES,
    labels: tuple[str, str, str] = ("Test", "Control", "All Other"),
) -> Column:
    return first_match([(state.isin(*test), labels[0]), (state.isin(*control), labels[1])], labels[2])


def login_group(has_identified: Column, has_unidentified: Column) -> Column:
    return first_match(
        [
            (has_identified & ~has_unidentified, "Identified ONLY"),
            (~has_identified & has_unidentified, "Unidentified ONLY"),
            (has_identified & has_unidentified, "Identified AND Unidentified"),
        ],
        default="Unknown",
    )


def named_traffic(source: Column, medium: Column, wanted_source: str, wanted_medium: str) -> Column:
    """One named ``source / medium`` against everything else, case-insensitive."""
    hit = (F.lower(source) == wanted_source) & (F.lower(medium) == wanted_medium)
    return first_match([(hit, f"{wanted_source} / {wanted_medium}")], default="Other")


def suspected_bot(
    pageviews: Column, purchased: Column, span_s: Column, engagements: Column, events: Column
) -> Column:
    """One page view, no purchase, no time spent, no engagement, 3 to 5 events."""
    return (
        (pageviews == 1) & ~purchased & (span_s == 0) & (engagements == 0) & events.between(3, 5)
    )


def bot_class(spike_traffic: str) -> Column:
    """Session class from the z-scores; ``spike_traffic`` names the traffic type
    to which the day-spike and anomaly rules apply."""
    spiking = F.col("traffic_type") == spike_traffic
    eng, evt = F.col("z_eng"), F.col("z_evt")
    return first_match(
        [
            (F.col("has_conversion") == 1, HUMAN_BUYER),
            (
                spiking
                & (F.col("daily_z_sessions") > SPIKE_Z)
                & F.lower("operating_system").contains("android")
                & (F.col("interaction_events") == 0)
                & (F.col("engagement_seconds") < SPIKE_SECONDS),
                BOT_SPIKE,
            ),
            (
                spiking
                & (
                    (F.col("user_z_sessions") > ANOMALY_Z)
                    | (F.col("device_z_sessions") > ANOMALY_Z)
                    | (F.col("geo_z_sessions") > ANOMALY_Z)
                ),
                BOT_ANOMALY,
            ),
            (
                (F.coalesce(eng, F.lit(UNKNOWN_LOW_Z)) < LOW_ENGAGEMENT_Z)
                & (F.coalesce(evt, F.lit(UNKNOWN_LOW_Z)) < LOW_EVENTS_Z),
                BOT_LOW,
            ),
            (F.coalesce(eng, F.lit(0.0)).between(*SUSPICIOUS_Z), SUSPICIOUS),
        ],
        default=HUMAN,
    )


def mapped_event_name(
    name: Column, rules: Sequence[tuple[str, str]] = EVENT_NAME_RULES, default: str = "other_click"
) -> Column:
    return first_match([(name.rlike(pattern), label) for pattern, label in rules], default)
