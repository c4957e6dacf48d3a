import datetime as dt
import functools

from conftest import day, rows, ts
from pyspark.sql import functions as F

from visitloom.operators import anomaly, calendar, distinct, kpi, properties, sessions

D1, D2 = day("2024-01-01"), day("2024-01-02")


def test_country_rules_drop_missing_countries(make):
    events = make(
        "brand string, user_pseudo_id int, session_id int, event_date date, country string",
        ("B", 1, 1, D1, "US"), ("B", 1, 1, D1, "US"), ("B", 2, 2, D1, "IN"), ("B", 3, 3, D1, None),
    )
    assert rows(sessions.page_sessions(events, not_country="IN"), "session_id") == [(1,)]
    assert rows(sessions.page_sessions(events, country="IN"), "session_id") == [(2,)]
    assert sessions.page_sessions(events).count() == 3


def test_login_groups(make):
    events = make(
        "session_id int, login_status string",
        (1, "Soft Logged-In"), (1, None), (2, "UNIDENTIFIED"), (3, "Hard Logged-In"), (3, "unidentified"),
        (4, None), (5, "soft logged-in"),
    )
    assert rows(sessions.login_status_sessions(events, ["session_id"])) == [
        (1, "Identified ONLY"), (2, "Unidentified ONLY"), (3, "Identified AND Unidentified"),
        (4, "Unknown"), (5, "Unknown"),
    ]


def test_session_profile_and_membership(make):
    events = make(
        "event_date date, session_id int, event_name string, transaction_id int, event_timestamp_utc timestamp_ntz, "
        "page_location string, page_number int",
        (D1, 1, "page_view", None, ts("2024-01-01T00:00:00.1"), "/checkout/a/confirmation.jsp", 1),
        (D1, 1, "scroll", None, ts("2024-01-01T00:00:01.0"), "/offer_temp5.jsp", 1),
        (D1, 2, "page_view", 7, ts("2024-01-01T00:00:00"), "/a", 1),
        (D1, 2, "user_engagement", None, ts("2024-01-01T00:00:01"), None, 2),
        (D1, 3, "page_view", None, ts("2024-01-01T00:00:00"), None, 1),
    )
    profile = rows(
        sessions.session_profile(events),
        "session_id", "events", "pageviews", "user_engagement_events", "event_span_s", "did_purchase",
    )
    assert profile == [(1, 2, 1, 0, 0, False), (2, 2, 1, 1, 1, True), (3, 1, 1, 0, 0, False)]
    any_ = sessions.sessions_any(events, F.col("page_location").rlike("confirmation"))
    assert rows(any_) == [(1,)]
    outside = sessions.sessions_not_only(events, r"/confirmation\.jsp|/offer_temp5", ["session_id"])
    assert rows(outside) == [(2,)]
    assert rows(sessions.single_page_sessions(events)) == [(1,), (3,)]


def _facts(make):
    visits = make(
        "brand string, user_pseudo_id int, session_id int, event_date date, g string",
        ("B", 1, 1, D1, "x"), ("B", 1, 1, D2, "x"), ("B", 1, 2, D1, "y"), ("B", 2, 3, D1, "y"), ("B", 3, None, D1, "z"),
    )
    sales = make(
        "brand string, session_id int, transaction_id int, revenue double",
        ("B", 1, 10, 5.0), ("B", 1, 11, 1.0), ("B", 2, 12, 2.0), ("B", 2, 12, 2.0), ("A", 3, 13, 9.0), ("B", None, 14, 7.0),
    )
    return visits, sales


def test_kpi_equals_the_left_join(make):
    visits, sales = _facts(make)
    got = kpi.session_kpi(visits, sales, ["brand", "g"])
    joined = visits.join(sales, ["brand", "session_id"], "left")
    want = joined.groupBy("brand", "g").agg(
        F.count_distinct("user_pseudo_id"), F.count_distinct("session_id"),
        F.count_distinct("transaction_id"), F.round(F.sum("revenue"), 2),
    )
    assert rows(got) == rows(want)
    # session 1 stands twice, so its revenue does; group z has users but no session, and NULL revenue
    assert rows(got, "g", "users", "sessions", "transactions", "revenue") == [
        ("x", 1, 1, 2, 12.0), ("y", 2, 2, 1, 4.0), ("z", 1, 0, 0, None),
    ]
    zero = kpi.session_kpi(visits, sales, ["g"], revenue="zero")
    assert rows(zero.where("g = 'z'"), "revenue") == [(0.0,)]


def test_total_is_recounted_not_summed(make):
    visits, sales = _facts(make)
    got = rows(kpi.session_kpi_with_total(visits, sales, ["brand"], "g"))
    total = [r for r in got if r[1] == "All"]
    assert total == [("B", "All", 3, 3, 3, 16.0)]  # users add up to 4 over the groups
    alone = kpi.session_kpi(visits, sales, ["brand"], revenue="zero")
    assert rows(alone) == [("B", 3, 3, 3, 16.0)]
    assert kpi.session_kpi(visits, sales, []).collect()[0]["users"] == 3


def test_collapsed_rows_keep_their_weight(make):
    visits, sales = _facts(make)
    plain = kpi.session_kpi(visits, sales, ["g"], join_keys=["session_id"])
    collapsed = kpi.collapse(visits, ["g"])
    weighted = kpi.session_kpi(collapsed, sales, ["g"], join_keys=["session_id"], copies="copies")
    assert rows(plain) == rows(weighted)


def test_year_over_year_zero_and_missing_previous(make):
    df = make(
        "k int, period string, user_pseudo_id int, session_id int, transaction_id int, revenue double",
        (1, "Current Year", 1, 1, 1, 10.0), (1, "Previous Year", 1, 2, 2, 4.0), (1, "Previous Year", 2, 3, None, None),
        (2, "Current Year", 1, 1, None, None),
    )
    got = {r["k"]: r for r in kpi.year_over_year(df, ["k"]).collect()}
    assert got[1]["users_yoy_change"] == -50.0 and got[1]["revenue_yoy_change"] == 150.0
    assert got[1]["conversion_rate_yoy_change"] == 100.0
    assert got[2]["users_yoy_change"] is None and got[2]["average_order_value_current"] is None


def test_shares_and_segments(make):
    df = make("k string, c string, n int", ("a", "x", 1), ("a", "y", 3), (None, "x", 2))
    assert rows(kpi.with_shares(df, {"n": "pct"}, ["k"]), "k", "c", "pct") == [
        ("a", "x", 25.0), ("a", "y", 75.0), (None, "x", 100.0),
    ]
    both = kpi.segment_rows(df, {"all": F.lit(True), "x": F.col("c") == "x", "none": F.col("c").isNull()})
    assert both.groupBy("segment").count().orderBy("segment").collect() == [("all", 3), ("x", 2)]


def test_organic_revenue_modes(make):
    df = make(
        "brand string, landing_page_type string, lnd_medium string, lnd_source_medium string, "
        "landing_page_location string, purchase_revenue double",
        ("B", "blog", "organic", "g / organic", "/a?promoCode=1&cid=1", 1.0),
        ("B", "blog", "none", "none / none", "/a?promoCode=1", 2.0),
        ("B", "blog", "none", "none / none", "/a?promoCode=1&cid=2", 4.0),
        ("B", "home", "organic", "g / organic", "/a", 8.0),
    )
    assert rows(kpi.organic_revenue(df, ["blog"], mode="any")) == [("B", 3.0)]
    assert rows(kpi.organic_revenue(df, ["blog"])) == [("B", 1.0)]


def test_z_scores_of_single_and_constant_groups(make):
    df = make("g string, v double", ("one", 5.0), ("same", 1.0), ("same", 1.0), ("two", 1.0), ("two", 3.0))
    got = anomaly.with_z_scores(df, {"v": "z"}, ["g"])
    assert [(g, None if z is None else round(z, 4)) for g, z in rows(got, "g", "z")] == [
        ("one", None), ("same", None), ("same", None), ("two", -0.7071), ("two", 0.7071),
    ]


def test_daily_signals_count_the_base_only(make):
    df = make(
        "d int, pageviews int, did_purchase boolean, suspected_bot boolean, event_span_s int, "
        "user_engagement_events int, session_engagement_time_msec int, geo_city string, device_operating_system string",
        (1, 1, False, True, 0, 0, 0, "", "iOS"), (1, 1, False, False, 3, 1, 5, "x", "Macintosh"),
        (1, 2, False, True, 0, 0, 0, None, "ios"), (1, 1, True, True, 0, 0, 0, None, "ios"),
    )
    assert rows(kpi.daily_signals(df, ["d"])) == [(1, 4, 2, 1, 1, 2, 1, 1, 1, 1, 1)]


def test_calendar_boundaries(spark):
    weeks = calendar.weeks_445(spark, dt.date(2023, 7, 1), 2, 2023)
    days = calendar.expand_weeks(weeks)
    assert days.count() == 728 and days.select("date").distinct().count() == 728
    got = {
        r["date"].isoformat(): (r["fiscal_year"], r["fiscal_month_name"], r["fiscal_week_number"])
        for r in days.collect()
    }
    assert got["2023-08-25"][1] == "August" and got["2023-08-26"][1] == "September"
    assert got["2024-01-26"] == ("23-24", "January", 30) and got["2024-01-27"][1] == "February"
    assert got["2024-06-28"] == ("23-24", "June", 52) and got["2024-06-29"] == ("24-25", "July", 1)
    assert got["2025-03-29"][1] == "April" and got["2025-04-26"][1] == "May"


def test_with_fiscal_left_and_inner(spark, make):
    days = calendar.expand_weeks(calendar.weeks_445(spark, dt.date(2023, 7, 1), 1, 2023))
    near = calendar.weeks_near_july(spark, 2023, 2026)
    assert rows(near.groupBy("fiscal_year").count()) == [("23-24", 52), ("24-25", 52), ("25-26", 53), ("26-27", 52)]
    assert rows(near.where("fiscal_year = '23-24'")) == rows(calendar.weeks_445(spark, dt.date(2023, 7, 1), 1, 2023))
    last = calendar.expand_weeks(near).where("fiscal_week_number = 53")
    assert rows(last.selectExpr("min(date)", "max(fiscal_month_name)", "max(fiscal_day_of_month)", "max(fiscal_day_of_year)")) == [
        (dt.date(2026, 6, 27), "June", 42, 371)
    ]
    df = make("d date", (day("2023-07-01"),), (day("2020-01-01"),))
    assert rows(calendar.with_fiscal(df, "d", days, ["fiscal_month_name"])) == [
        (day("2020-01-01"), None), (day("2023-07-01"), "July"),
    ]
    assert calendar.with_fiscal(df, "d", days, ["fiscal_month_name"], "inner").count() == 1


def test_prefer_final_is_whole_and_repeatable(make):
    schema = "brand string, session_id int, d date, origin string"
    final = make(
        schema, ("B", 1, day("2024-01-01"), "f"), ("B", 2, day("2024-01-09"), "f"), ("B", 2, day("2024-01-09"), "f2")
    )
    intraday = make(
        schema,
        ("B", 2, day("2024-01-09"), "i"), ("B", 3, day("2024-01-09"), "i"), ("B", 4, day("2024-01-10"), "i"),
        ("A", 2, day("2024-01-09"), "i"), ("B", 5, day("2024-01-08"), "i"),
    )
    keys = ["brand", "session_id", "d"]
    got = properties.prefer_final(final, intraday, keys, "2024-01-10", "d")
    assert rows(got, "brand", "session_id", "origin") == [
        ("A", 2, "i"), ("B", 1, "f"), ("B", 2, "f"), ("B", 2, "f2"), ("B", 3, "i"), ("B", 4, "i"),
    ]
    by_day = properties.prefer_final(final, intraday, keys, "2024-01-10", "d", whole_days=True)
    assert rows(by_day, "session_id", "origin") == [(1, "f"), (2, "f"), (2, "f2"), (4, "i")]
    again = properties.prefer_final(got, intraday, keys, "2024-01-10", "d")
    assert rows(again) == rows(got)


def test_intraday_union_and_session_keys(make):
    table = make("event_date date, user_pseudo_id string, visit_id int", (D1, "u", 1), (D2, "u", 1), (D2, "u", 2))
    old = make("event_date date, user_pseudo_id string, visit_id int", (day("2023-12-30"), "u", 1))
    got = properties.intraday_events(
        {"A": table, "B": old}, "2024-01-02", ["event_date", "user_pseudo_id", "visit_id"], {"A": "p1", "B": "p2"}
    )
    assert rows(got, "brand", "property_id").count(("A", "p1")) == 3 == got.count()
    assert got.select("session_id").distinct().count() == 2


def test_validation_shows_both_sides(make):
    report = make("brand string, session_id int, date date", ("A", 1, D1), ("A", 1, D2), ("B", 2, D1))
    expected = make("brand string, expected_sessions long", ("A", 1), ("C", 5))
    days = make("date date", (D1,))
    assert rows(properties.validate_brand(report, expected, days)) == [
        ("A", 1, 1, 0, 1), ("B", 1, None, None, 0), ("C", None, 5, None, None),
    ]


def test_channel_map_fills_unmapped(make):
    df = make("channel_category string, campaign_category string", ("a", "b"), ("a", "x"), (None, "b"))
    table = make(
        "channel_category string, campaign_category string, funnel_category string, marketing_category string, "
        "marketing_group_id string, campaign_group_type string",
        ("a", "b", "F", "M", "G", None),
    )
    got = properties.with_channel_map(df, table)
    assert rows(got, "campaign_category", "funnel_category", "marketing_group_id") == [
        ("b", "F", "G"), ("b", "Unmapped", None), ("x", "Unmapped", None),
    ]


def test_distinct_counts_by_bitmaps_equal_plain_ones(spark, make, monkeypatch):
    """String and number ids, NULL ids, groups and keys, more ids than one bitmap and one window hold."""
    monkeypatch.setattr(distinct, "IDS", 500)
    df = spark.range(70_000).selectExpr(
        "if(id % 7 = 0, null, concat('u', id % 40000)) as user", "if(id % 5 = 0, null, id % 999 - 40) as visit",
        "if(id % 11 = 0, null, concat('g', id % 4)) as login", "id % 3 as brand",
    )
    empty = spark.createDataFrame([(None, None, "none", 9)], df.schema)
    df = df.unionByName(empty)
    got = distinct.distinct_with_total(df, ["brand"], "login", {"users": "user", "visits": "visit"})
    counts = [F.count_distinct("user").alias("users"), F.count_distinct("visit").alias("visits")]
    want = df.groupBy("brand", "login").agg(*counts).unionByName(
        df.groupBy("brand").agg(*counts).withColumn("login", F.lit("All"))
    )
    assert rows(got, "brand", "login", "users", "visits") == rows(want, "brand", "login", "users", "visits")
    numbers = distinct.dense_numbers(df.select("user"))
    assert sorted(r.number for r in numbers.collect()) == list(range(numbers.count())) and numbers.count() > 32_768


def test_bitmaps_of_several_days_merge(spark):
    """Weekly users from the days' bitmaps, the events long gone."""
    df = spark.range(3000).selectExpr("cast(id % 13 as string) as day", "id % 211 * 3 as user")
    numbers = distinct.dense_numbers(df.select("user"))
    days = [distinct.id_bitmaps(df.where(F.col("day") == str(d)), ["day"], "user", numbers) for d in range(13)]
    stored = functools.reduce(lambda a, b: a.unionByName(b), days)
    assert rows(distinct.bitmap_counts(distinct.merged_bitmaps(stored, []), [], "n")) == [(211,)]
    assert rows(distinct.bitmap_counts(stored, ["day"], "n")) == rows(df.groupBy("day").agg(F.count_distinct("user")))
