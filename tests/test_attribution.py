import random

import pytest
from conftest import day, rows, ts
from pyspark.sql import functions as F

from visitloom.operators import attribution as a

D = [day(f"2024-01-{i:02d}") for i in range(1, 10)]


def test_first_by_takes_missing_order_first(make):
    df = make("u int, n int, s int, v string", (1, 2, 1, "b"), (1, None, 2, None), (2, 1, 9, "y"), (2, 1, 3, "x"))
    assert rows(a.first_by(df, ["u"], ["v", "s"], ["n", "s"])) == [(1, None, 2), (2, "x", 3)]


def test_first_non_null_per_field(make):
    df = make(
        "s int, t int, source string, medium string", (1, 1, None, "m1"), (1, 2, "s2", None), (1, 3, "s3", "m3"), (2, 1, None, None)
    )
    assert rows(a.first_non_null(df, ["s"], ["source", "medium"], ["t"])) == [(1, "s2", "m1"), (2, None, None)]


TIMES = [None, "1969-12-31T23:59:59", "2024-01-01T00:00:00", "2024-01-01T00:00:00.000001", "9999-12-31T00:00:00"]
NUMBERS = [None, -(2**63), -5, 0, 3, 2**63 - 1]


@pytest.mark.parametrize("zone", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("number", ["bigint", "string"])
def test_first_non_null_has_one_order_for_all_types(make, zone, number):
    """Missing times and numbers come first, whichever way the order is compared."""
    rng = random.Random(5)
    picked = lambda: (rng.randrange(40), rng.choice(TIMES), rng.choice([*NUMBERS, 7, 8, 9]))
    data = [(*picked(), rng.choice([None, f"v{i}"]), rng.choice([None, "a", f"b{i}"])) for i in range(400)]
    data.append((99, None, None, "only here", None))
    if number == "string":
        data = [(s, t, None if n is None else n % 10, v, w) for s, t, n, v, w in data]
    df = make("s int, t string, n bigint, v string, w string", *data)
    df = df.selectExpr("s", f"cast(t as {zone}) as t", f"cast(n as {number}) as n", "v", "w")
    order = lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0)
    firsts = {}
    for i in (3, 4):
        for r in sorted((r for r in data if r[i] is not None), key=order):
            firsts.setdefault((r[0], i), (order(r), set()))
            if firsts[r[0], i][0] == order(r):
                firsts[r[0], i][1].add(r[i])
    got = a.first_non_null(df, ["s"], ["v", "w"], ["t", "n"]).collect()
    assert {r.s for r in got} == {r[0] for r in data}
    for r in got:
        for i, value in ((3, r.v), (4, r.w)):
            assert value in firsts.get((r.s, i), (None, {None}))[1]


def test_first_touch_prefers_the_number_only_when_time_agrees(make):
    schema = "user_pseudo_id int, session_id int, ga_session_number int, session_start_timestamp_utc timestamp_ntz"
    df = make(
        schema,
        (1, 11, 1, ts("2024-01-01T00:00:00")), (1, 12, 2, ts("2024-01-02T00:00:00")),
        (2, 21, 2, ts("2024-01-01T00:00:00")), (2, 22, 1, ts("2024-01-02T00:00:00")),
        (3, 31, 1, ts("2024-01-01T00:00:00")), (3, 32, None, ts("2024-01-02T00:00:00")),
        (4, 41, 1, None), (4, 42, 2, ts("2024-01-02T00:00:00")),
    )
    got = a.first_touch(df, []).select("user_pseudo_id", "ft.session_id", "first_touch_disagrees")
    assert rows(got) == [(1, 11, False), (2, 21, True), (3, 31, True), (4, 42, False)]


def test_ambiguous_users(make):
    df = make("u int, t int", (1, 1), (2, 2), (2, 3), (None, 4))
    assert rows(a.exclude_ambiguous(df, "u", df)) == [(1, 1), (None, 4)]
    assert rows(a.only_single(df.where("u is not null"), "u")) == [(1, 1)]


def test_snapshot_sums_and_keeps_one_row(make):
    df = make(
        "brand string, user_pseudo_id int, transaction_id int, date date, session_start_timestamp_utc timestamp_ntz, "
        "purchase_revenue double, channel string",
        ("B", 1, 1, D[1], ts("2024-01-02T00:00:00"), 2.0, "y"), ("B", 1, 1, D[0], ts("2024-01-01T00:00:00"), 3.0, "x"),
    )
    assert rows(a.purchase_snapshot(df, ["channel"])) == [
        ("B", 1, 1, D[0], ts("2024-01-01T00:00:00"), 5.0, "x")
    ]


def test_count_until_equals_the_join_with_a_hot_key(make):
    rng = random.Random(7)
    at = lambda: ts("2024-01-01T00:00:00").replace(
        hour=rng.randrange(3), minute=rng.randrange(60), second=rng.randrange(0, 60, 20)
    )
    points = make("u int, t timestamp_ntz", *[(0 if rng.random() < 0.6 else rng.randrange(5), at()) for _ in range(400)])
    anchors = make("u int, t timestamp_ntz", *[(rng.randrange(6), at()) for _ in range(80)], (1, None), (None, at()))
    got = a.count_until(points, anchors, "u", "t", "n")
    want = (
        anchors.dropna().distinct().alias("a")
        .join(points.alias("p"), (F.col("a.u") == F.col("p.u")) & (F.col("p.t") <= F.col("a.t")), "left")
        .groupBy("a.u", "a.t").agg(F.count("p.t").alias("n"))
    )
    assert rows(got) == rows(want)
    assert rows(a.count_until(points, anchors, "u", "t", "n", bucket_seconds=3600)) == rows(want)


def test_sessions_until_includes_the_purchase_time(make):
    sessions = make(
        "user_pseudo_id int, session_id int, session_start_timestamp_utc timestamp_ntz",
        (1, 1, ts("2024-01-01T00:00:00")), (1, 1, ts("2024-01-05T00:00:00")), (1, 2, ts("2024-01-02T00:00:00")),
        (1, 3, ts("2024-01-02T00:00:01")), (1, 4, None), (2, 5, ts("2024-01-09T00:00:00")),
    )
    snapshot = make(
        "user_pseudo_id int, transaction_id int, purchase_ts timestamp_ntz",
        (1, 7, ts("2024-01-02T00:00:00")), (1, 8, ts("2024-01-09T00:00:00")), (2, 9, ts("2024-01-01T00:00:00")),
    )
    assert rows(a.sessions_until(snapshot, sessions)) == [(1, 7, 2), (1, 8, 3)]


def _event_before(make, anchors, events):
    return a.event_before(
        make("user_pseudo_id int, order_id int, event_timestamp_utc timestamp_ntz", *anchors),
        make("user_pseudo_id int, event_timestamp_utc timestamp_ntz, event_date date, url string", *events),
        F.col("url").rlike("(?i)promo"),
        "2024-01-01",
        "2024-01-31",
        per=["user_pseudo_id", "order_id"],
    ).select("order_id", "flag", "page_visited_date")


def test_event_strictly_before(make):
    t = ts("2024-01-05T12:00:00")
    got = _event_before(
        make,
        [(1, 1, t), (2, 2, t), (3, 3, t), (4, 4, t), (5, 5, t), (6, 6, t)],
        [
            (1, ts("2024-01-05T11:00:00"), D[4], "/PROMO"), (1, ts("2024-01-03T11:00:00"), D[2], "/promo"),
            (2, t, D[4], "/promo"),  # at the order time: not before
            (3, ts("2024-01-04T00:00:00"), D[3], "/x"), (3, ts("2024-01-06T00:00:00"), D[5], "/promo"),
            (4, ts("2024-01-06T00:00:00"), D[5], "/promo"),
            (5, ts("2024-01-04T00:00:00"), D[3], None),
            (6, ts("2023-12-31T00:00:00"), day("2023-12-31"), "/promo"),  # outside the day range
        ],
    )
    assert rows(got) == [
        (1, True, D[2]), (2, None, None), (3, False, None), (4, None, None), (5, None, None), (6, None, None),
    ]


def test_an_order_of_several_rows_has_one_result(make):
    early, late = ts("2024-01-05T00:00:00"), ts("2024-01-09T00:00:00")
    got = _event_before(make, [(1, 1, early), (1, 1, late), (2, 2, early), (2, 2, early)],
                        [(1, ts("2024-01-04T00:00:00"), D[3], "/x"), (1, ts("2024-01-07T00:00:00"), D[6], "/promo")])
    assert rows(got) == [(1, True, D[6]), (2, None, None)]


def test_event_before_equals_the_join(make):
    rng = random.Random(3)
    at = lambda: ts("2024-01-01T00:00:00").replace(day=rng.randrange(1, 9), hour=rng.randrange(24))
    anchors = [(i % 6, i % 30, at()) for i in range(60)]
    events = []
    for _ in range(150):
        t = at()
        events.append((0 if rng.random() < 0.4 else rng.randrange(5), t, t.date(), rng.choice(["/promo", "/x", None])))
    o = make("u int, order_id int, t timestamp_ntz", *anchors)
    e = make("eu int, et timestamp_ntz, d date, url string", *events)
    hit = F.col("url").rlike("(?i)promo")
    want = (
        o.join(e, (o.u == e.eu) & (e.et < o.t), "left")
        .groupBy("order_id").agg(F.bool_or(hit), F.min(F.when(hit, F.col("d"))))
    )
    assert rows(_event_before(make, anchors, events)) == rows(want)


def test_days_to_purchase_small(make):
    report = make(
        "brand string, user_pseudo_id int, session_id int, transaction_id int, date date, "
        "session_start_timestamp_utc timestamp_ntz, purchase_revenue double, ga_session_number int, "
        "lnd_source_medium string, marketing_category string, channel_category string",
        ("B", 1, 1, None, D[0], ts("2024-01-01T00:00:00"), None, 1, "a / b", "m", "c"),
        ("B", 1, 2, 100, D[3], ts("2024-01-04T00:00:00"), 9.5, 2, "x / y", "m2", "c2"),
        ("B", 2, 3, 101, D[0], ts("2024-01-01T00:00:00"), 1.0, 1, "x / y", "m", "c"),
        ("B", 2, 4, 102, D[1], ts("2024-01-02T00:00:00"), 1.0, 2, "x / y", "m", "c"),
    )
    orders = make("order_id int", (100,), (101,), (102,), (999,))
    got = a.days_to_purchase(orders, report).collect()
    assert len(got) == 1  # user 2 has two new orders
    assert got[0]["days_to_purchase"] == 3 and got[0]["sessions_until_purchase"] == 2
    assert got[0]["first_session_lnd_source_medium"] == "a / b" and got[0]["revenue"] == 9.5
    simple = a.first_touch_purchases(orders, report).collect()
    assert [(r["user_pseudo_id"], r["first_session_date"]) for r in simple] == [(1, D[0])]
