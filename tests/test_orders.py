from conftest import day, rows
from pyspark.sql import functions as F

from visitloom.operators import joins, orders

D1, D9 = day("2024-01-01"), day("2024-01-09")


def test_reconcile_equals_the_full_join(make):
    web = make("tid int, d date, s int", (1, D9, 1), (2, D1, 2), (3, D9, 3), (None, D9, 4), (5, None, 5), (6, D9, 6), (6, D9, 7))
    office = make("oid int, code string", (1, "a"), (2, "b"), (4, None), (None, "n"), (5, "e"), (6, "f"), (6, "g"))
    condition = F.col("d") > F.lit(D1)
    got = orders.reconcile(web, office, "tid", "oid", condition).select("tid", "d", "s", "oid", "code")
    want = web.join(office, (web.tid == office.oid) & condition, "full").select("tid", "d", "s", "oid", "code")
    assert rows(got) == rows(want)
    plain = orders.reconcile(web, office, "tid", "oid").select("s", "code")
    assert rows(plain) == rows(web.join(office, web.tid == office.oid, "full").select("s", "code"))


def test_split_left_join_equals_the_left_join(make):
    left = make("k int, j int, a string", (1, 1, "x"), (1, 1, "y"), (2, 1, "z"), (None, 1, "n"), (3, None, "m"))
    right = make("k int, j int, b string", (1, 1, "p"), (1, 1, "q"), (None, 1, "r"), (3, None, "s"), (9, 9, "t"))
    got = joins.split_left_join(left, right, ["k", "j"]).select("k", "j", "a", "b")
    assert rows(got) == rows(left.join(right, ["k", "j"], "left").select("k", "j", "a", "b"))


def test_group_flag_equals_the_window(make):
    df = make("t int, item string", (1, "a"), (1, "b"), (2, "b"), (3, None), (3, "a"), (None, "a"), (None, "c"))
    got = orders.flag_group_has(df, "t", F.col("item") == "a", "is_item", "has_item")
    assert rows(got, "t", "item", "is_item", "has_item") == [
        (1, "a", 1, 1), (1, "b", 0, 1), (2, "b", 0, 0), (3, "a", 1, 1), (3, None, 0, 1), (None, "a", 1, 1), (None, "c", 0, 1),
    ]


def test_id_lists(make):
    df = make("id int, v string", (1, "a"), (2, "b"), (2, "c"), (None, "d"))
    assert rows(orders.match_ids(df, "id", [2, 7]), "v") == [("b",), ("c",)]
    ids = make("x int", (2,), (2,), (None,))
    assert rows(orders.match_ids(df, "id", ids), "v") == [("b",), ("c",)]


def test_buyers_of_the_item_and_non_buyers(make):
    visits = make("session_id int, user int", (1, 1), (2, 2), (3, 3), (4, 4), (5, 5))
    sales = make(
        "session_id int, transaction_id int, revenue double",
        (1, 10, 1.0), (2, 20, 2.0), (3, 30, 3.0), (5, None, 5.0),
    )
    items = make("transaction_id int, item_id string", (10, "A"), (10, "B"), (20, "B"), (10, "A"))
    got = orders.buyers_of_or_non_buyers(visits, sales, items, "A")
    assert rows(got, "session_id", "transaction_id", "revenue") == [
        (1, 10, 1.0), (1, 10, 1.0), (4, None, None), (5, None, 5.0),
    ]
    want = (
        visits.join(sales, "session_id", "left")
        .join(items.where("item_id = 'A'").withColumnRenamed("transaction_id", "t2"), F.col("t2") == F.col("transaction_id"), "left")
        .where("transaction_id is null or item_id = 'A'")
    )
    assert rows(got, "session_id", "revenue") == rows(want, "session_id", "revenue")


def test_first_url_with_all_parameters(make):
    events = make(
        "session_id int, t int, page_location string",
        (1, 2, "/b?irpid=2&clickid=2"), (1, 1, "/a?irpid=1"), (1, 3, "/c?clickid=3&irpid=3"), (2, 1, "/x"),
    )
    first = orders.first_url_with(events, ["irpid", "clickid"], ["t"])
    got = orders.url_params(first, "first_url", ["irpid", "clickid", "afsrc"])
    assert rows(got) == [(1, "/b?irpid=2&clickid=2", "2", "2", None)]


def test_dedupe_keeps_the_lowest_row(make):
    df = make("brand string, transaction_id int, d int, v int", ("A", 1, 2, 1), ("A", 1, 1, 9), ("A", 1, 1, 8), ("B", 1, 3, 3))
    assert rows(orders.dedupe_transactions(df, order=["d"])) == [("A", 1, 1, 8), ("B", 1, 3, 3)]


def test_cancellations(make):
    events = make(
        "brand string, event_date date, page_fragment string, event_order string, event_category string, event_label string",
        ("A", D1, "/x/9/1", "c", "CONFIRM", None), ("A", D1, "/x/8/1", "c", "CONFIRM", None),
        ("A", D1, "/x", "c", "CONFIRM", None), ("A", D1, None, "c", "CONFIRM", None),
        ("A", D1, "/x/9/1", "c", "FEEDBACK", "price"), ("A", D1, "/x/9/1", "c", "FEEDBACK", None),
        ("B", D1, "/x/8/1", "c", "FEEDBACK", "price"),
    )
    got = orders.cancel_reasons(events, "CONFIRM", "FEEDBACK")
    assert rows(got, "subscription_id", "cancel_reason") == [
        ("8", "ABANDONED"), ("9", "ABANDONED"), ("9", "PRICE"), (None, "ABANDONED"), (None, "ABANDONED"),
    ]


def test_reconcile_splits_hot_ids(spark, make):
    """One id on half of each side, one hot on one side only, NULLs and failing rows: as one full join."""
    web = [(i % 2 and 7 or i, i, i % 5) for i in range(200)] + [(500, i, 1) for i in range(60)] + [(None, 1, 1), (None, 2, None)]
    office = [(i % 2 and 7 or i + 100, f"o{i}") for i in range(200)] + [(501, f"p{i}") for i in range(60)] + [(None, "q")]
    w = make("t int, n int, c int", *web)
    o = make("o bigint, v string", *office)
    for condition in (None, F.col("c") > 0):
        got = [orders.reconcile(w, o, "t", "o", condition, heavy=h) for h in (50, 10**6)]
        assert rows(got[0]) == rows(got[1])
        on = (F.col("t") == F.col("o")) & (F.lit(True) if condition is None else condition)
        assert rows(got[0], "t", "n", "c", "o", "v") == rows(w.join(o, on, "full"))
    plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Join FullOuter" in plan
    assert "Join Inner" not in got[1]._jdf.queryExecution().optimizedPlan().toString()
