from conftest import day, rows, ts
from pyspark.sql import functions as F

from visitloom.functions import dates, numbers, rules, text
from visitloom.sources import reports


def column(make, expression, values, type_="string"):
    df = make(f"i int, v {type_}", *enumerate(values))
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_url_param_reads_anywhere_and_is_null_when_missing_or_empty(make):
    urls = ["/a?irpid=5&x=1", "/a#irpid=7", "/a?irpid=&x=1", "/a", None, "/a?irpid=1&irpid=2"]
    assert column(make, lambda c: text.url_param(c, "irpid"), urls) == ["5", "7", None, None, None, "1"]


def test_strip_host(make):
    urls = ["https://www.shop.example/a?b", "http://shop.example/", "https://other.example/a", None]
    got = column(make, lambda c: text.strip_host(c, "shop.example"), urls)
    assert got == ["/a?b", "/", "https://other.example/a", None]


def test_split_part_out_of_range_is_null(make):
    assert column(make, lambda c: text.split_part_at(c, "/", 2), ["/x/9/1", "/x", "", None]) == [
        "9", None, None, None,
    ]


def test_source_medium_fill_and_null(make):
    df = make("s string, m string", ("a", "b"), (None, "b"), ("a", None), (None, None))
    s, m = F.col("s"), F.col("m")
    filled = df.select(text.source_medium(s, m, "(none)")).collect()
    assert [r[0] for r in filled] == ["a / b", "(none) / b", "a / (none)", "(none) / (none)"]
    assert [r[0] for r in df.select(text.source_medium(s, m)).collect()] == ["a / b", None, None, None]


def test_name_lists(make):
    names = ["homeHero", "home", "HOMEx", "mainNavClick", "mainNavClickX", "", None, "a.b"]

    def passed(allow, block=None):
        return [n for n, ok in zip(names, column(make, lambda c: text.name_passes(c, allow, block), names)) if ok]

    assert passed(["home*", "mainNavClick"]) == ["homeHero", "home", "HOMEx", "mainNavClick"]
    assert passed(["home*"], ["HOMEHERO"]) == ["home", "HOMEx"]
    assert passed([]) == passed(None) == passed(["*"]) == [n for n in names if n]
    assert passed(["*"], ["*"]) == []
    assert passed(["*x", ""]) == []
    assert passed(["a.b"]) == ["a.b"] and passed(["aXb"]) == []


def test_whole_number_like_the_report_reader(make):
    values = ["2.7", "-2.7", "x", "", None, " 12 ", "1e2", "1d", "0x10", "5.", ".5", "NaN", "Infinity"]
    assert column(make, numbers.whole_number, values) == [2, -2, 0, 0, 0, 12, 100, 0, 0, 5, 0, 0, 0]


def test_parse_day_takes_listed_formats_only(make):
    values = ["2024-01-31", "", "31/12/2024", "2024-13-01", None, "2024-02-30"]
    assert column(make, dates.parse_day, values) == [day("2024-01-31"), None, None, None, None, None]
    both = column(make, lambda c: dates.parse_day(c, ("yyyy-MM-dd", "dd/MM/yyyy")), values)
    assert both[2] == day("2024-12-31")


def test_parse_day_by_shape_reads_what_each_format_reads(make):
    """Against a try of every format in order."""
    values = [
        "2024-01-31", "2024-1-31", "2024-01-31 10:11:12", "2024-01-31T10:11:12", "2024/1/5", "2024/01/05", "20240105", "1/5/2024",
        "12/31/2024 9:05", "1/5/2024 9:05:07", "1/5/2024 9:05:07 PM", "1/5/2024 9:05:07 pm", "1-5-2024", "5-Jan-2024", "5 Jan 2024",
        "Jan 5, 2024", "January 5, 2024", "May 5, 2024", "5-May-2024", "13/13/2024", " 2024-01-31", "2024-01-31 ", "x", "", None,
        "31.12.2024", "20241350", "202401051", "Sept 5, 2024", "2024-01-31T10:11", "1/5/24",
    ]
    plain = lambda c: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in reports.ORDER_DATES])
    got = column(make, lambda c: dates.parse_day(c, reports.ORDER_DATES), values)
    assert got == column(make, plain, values) and sum(g is not None for g in got) >= 16


def test_quarters_and_month_order(make):
    months = list(range(1, 13))
    quarter = column(make, dates.quarter_of, months, "int")
    fiscal = column(make, lambda c: dates.quarter_in_year_from(c, 7), months, "int")
    order = column(make, lambda c: dates.months_since(c, 9), months, "int")
    assert quarter == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]
    assert fiscal == [3, 3, 3, 4, 4, 4, 1, 1, 1, 2, 2, 2]
    assert order == [5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3, 4]


def test_year_before_leap_day():
    assert dates.year_before("2024-02-29") == day("2023-02-28")
    assert dates.year_before("2024-03-01") == day("2023-03-01")


def test_period_and_last_days(make):
    days = [day("2024-01-01"), day("2024-01-02"), day("2024-01-03"), None]
    got = column(make, lambda c: dates.period(c, ("2024-01-02", "2024-01-03")), days, "date")
    assert got == [None, "Current Year", "Current Year", None]
    earlier = [day("2023-01-01"), day("2023-01-02"), day("2022-01-02")]
    assert column(make, lambda c: dates.period(c, ("2024-01-02", "2024-01-03")), earlier, "date") == [None, "Previous Year", None]
    own = lambda c: dates.period(c, ("2024-01-02", "2024-01-03"), ("2022-01-01", "2022-12-31"))
    assert column(make, own, earlier, "date") == [None, None, "Previous Year"]
    recent = column(make, lambda c: dates.last_n_days(c, "2024-01-03"), days, "date")
    assert recent == [False, True, True, None]


def test_buckets_around_the_half_hour_and_daylight_saving(make):
    times = [ts("2024-03-10T06:59:59"), ts("2024-03-10T07:00:00"), ts("2024-01-01T10:30:00")]
    half = column(make, dates.time_bucket, times, "timestamp_ntz")
    assert half == [ts("2024-03-10T06:30:00"), ts("2024-03-10T07:00:00"), ts("2024-01-01T10:30:00")]
    local = column(make, lambda c: dates.time_bucket(c, "1 hour", "America/New_York"), times, "timestamp_ntz")
    assert local == [ts("2024-03-10T01:00:00"), ts("2024-03-10T03:00:00"), ts("2024-01-01T05:00:00")]


def test_ratio_and_change(make):
    df = make("a double, b double", (1.0, 0.0), (3.0, 2.0), (1.0, None))
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(numbers.ratio(a, b), numbers.percent_change(a, b)).collect()] == [
        (None, None), (1.5, 50.0), (None, None),
    ]


def test_channel_by_source(make):
    cases = [
        (None, None, "Direct and Organic"),
        ("google", "organic", "Direct and Organic"),
        ("bronto", "email", "CM - Email"),
        ("Google", "CPC", "RM - Paid Search"),
        ("google", None, "Other"),
        (None, "paidsocial", "Other"),  # NOT (NULL OR FALSE) is not TRUE
        ("facebook", "x", "RM - Paid Social"),
        ("facebook", None, "Other"),
        ("facebook", "referral", "Other"),
        ("x-attentive-y", "sms", "CM - Attentive SMS"),
        ("QR1", "print", "CM - Direct Mail"),
        ("qr1", "print", "Other"),
        ("bronto", "organic", "Direct and Organic"),
    ]
    df = make("s string, m string, want string", *cases)
    got = df.select(rules.channel_by_source(F.col("s"), F.col("m")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_channel_by_landing(make):
    cases = [
        (None, None, None, "Direct"),
        (None, None, "/a?promoCode=1", "Direct"),  # the mark never matches a lower-cased URL
        (None, None, "/a?GCLID=1", "Paid Search"),
        (None, "Organic", "/a", "Organic"),
        ("Bing", "cpc", "/a", "Paid Search"),
        ("fb", "story", "/a", "Paid Social"),
        ("fb", None, "/a", "Other"),
        (None, None, "/a?fbclid=1", "Paid Social"),
        ("x", "referral", "/a?fbclid=1", "Other"),
    ]
    df = make("s string, m string, u string, want string", *cases)
    got = df.select(rules.channel_by_landing(F.col("s"), F.col("m"), F.col("u")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_channel_by_click_id_literal_and_word_delimiters(make):
    df = make(
        "s string, m string, p string, g string, w string, f string, c string",
        ("google", "cpc", "google / cpc", None, None, None, None),
        ("x", "y", "x_google_cpc_1 / _cpc_", None, None, None, None),
        ("none", "none", "none / none", None, None, None, None),
        ("none", "none", "none / none", None, None, None, "c1"),
        ("facebook", "referral", "facebook / referral", None, None, "f", None),
        ("facebook", "paid", "facebook / paid", None, None, None, None),
        ("x", "y", "x / y", None, "w1", None, None),
    )
    columns = [F.col(c) for c in "smpgwfc"]
    literal = [r[0] for r in df.select(rules.channel_by_click_id(*columns)).collect()]
    words = [r[0] for r in df.select(rules.channel_by_click_id(*columns, words=True)).collect()]
    assert literal == ["Other", "Paid Search", "Direct", "Other", "Other", "Other", "Paid Search"]
    assert words == ["Paid Search", "Other", "Direct", "Other", "Other", "Paid Social", "Paid Search"]


def test_campaign_category(make):
    cases = [
        ("Paid Search", "US_BR_1", None, "Branded Search"),
        ("Paid Search", "a_NB_generic", None, "Generic Search"),
        ("Paid Search", "PMax", None, "Performance Max"),
        ("Paid Search", "Shopping all", None, "Shopping"),
        ("Paid Search", "x-YT-1", None, "Demand Gen"),
        ("Paid Search", None, None, "Other"),
        ("Paid Social", None, "retargeting_std", "Retargeting"),
        ("Paid Social", None, "a_std", "Standard"),
        ("Paid Social", None, "event_std", "Other"),
        ("Paid Social", None, "club", "Club"),
        ("Paid Social", None, "none", "Other"),
        ("Paid Social", None, None, "Other"),
        ("Direct", "brand", "club", "General"),
    ]
    df = make("ch string, ads string, c string, want string", *cases)
    got = df.select(rules.campaign_category(F.col("ch"), F.col("ads"), F.col("c")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_labels_states_and_landing_pattern(make):
    status = column(make, rules.customer_status, ["Existing Customer", "New Recruit", "Re-Recruit", "x", None])
    assert status == ["Existing", "New", "New", None, None]
    assert column(make, rules.order_kind, ["Wine Club", "Non-Wine Club", "x"]) == ["Club", "Standard", None]
    assert column(make, rules.state_group, ["Ohio", "Virginia", "Utah", None]) == [
        "Test", "Control", "All Other", "All Other",
    ]
    urls = ["/next/sale", "/next/big-sale", "/next/xsale", "/jsp/offer/cm/us/common/cm_template_responsive.jsp?date=2024may"]
    assert column(make, lambda c: c.rlike(rules.LANDING_PAGE), urls) == [True, True, False, True]


def test_event_name_mapping(make):
    got = column(make, rules.mapped_event_name, ["acdl.homeHero", "acdl.mainNavClick", "acdl.mainNavClickX"])
    assert got == ["homepage_click", "main_navigation", "other_click"]


def test_suspected_bot_limits(make):
    df = make(
        "pv int, bought boolean, span int, eng int, n int",
        (1, False, 0, 0, 2), (1, False, 0, 0, 3), (1, False, 0, 0, 5), (1, False, 0, 0, 6),
        (1, False, 1, 0, 3), (2, False, 0, 0, 3), (1, True, 0, 0, 3), (1, False, 0, 1, 3),
    )
    flag = rules.suspected_bot(*[F.col(c) for c in ("pv", "bought", "span", "eng", "n")])
    assert [r[0] for r in df.select(flag).collect()] == [False, True, True] + [False] * 5


def test_bot_rules_in_order(make):
    df = make(
        """i int, has_conversion int, traffic_type string, daily_z_sessions double, operating_system string,
        interaction_events int, engagement_seconds double, user_z_sessions double, device_z_sessions double,
        geo_z_sessions double, z_eng double, z_evt double""",
        (0, 1, "S", 9.0, "android", 0, 1.0, 9.0, 0.0, 0.0, -2.0, -2.0),
        (1, 0, "S", 1.6, "Android 12", 0, 29.0, 9.0, 0.0, 0.0, -2.0, -2.0),
        (2, 0, "S", 1.6, "ios", 0, 29.0, 0.0, 0.0, 2.1, 0.0, 0.0),
        (3, 0, "T", 9.0, "android", 0, 1.0, 9.0, 9.0, 9.0, None, None),
        (4, 0, "T", 0.0, "ios", 0, 1.0, 0.0, 0.0, 0.0, -0.3, 0.0),
        (5, 0, "T", 0.0, "ios", 0, 1.0, 0.0, 0.0, 0.0, -0.29, 0.0),
        (6, 0, "T", 0.0, "ios", 0, 1.0, 0.0, 0.0, 0.0, -1.0, -0.4),
    )
    got = [r[0] for r in df.orderBy("i").select(rules.bot_class("S")).collect()]
    assert got == [
        "Human (Conversion Present)",
        "High-Confidence Bot (FB Android spike, no interaction)",
        "Bot (User/Geo/Device anomaly)",
        "Bot (Low engagement)",
        "Suspicious",
        "Human",
        "Suspicious",
    ]


def test_blank(make):
    df = make("v string", ("",), (None,), ("x",))
    assert rows(df.where(text.is_blank(F.col("v")))) == [("",), (None,)]
