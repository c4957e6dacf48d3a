import json
import random

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from visitloom.operators import tagging
from visitloom.streaming import runs
from visitloom.streaming.store import MergedStore


def event(name, **data):
    return json.dumps({"event": name, "eventData": data})


def test_forwarding_keeps_the_payload(make):
    payloads = [event("homeHero", click={"clickUrl": "u"}), event("other"), '{"eventData": {}}', event("MAINNAVCLICK"), "not json"]
    df = tagging.parse_events(make("i int, payload string", *enumerate(payloads)))
    got = tagging.forward_events(df)
    assert rows(got, "i", "event", "acdl_event_name", "payload") == [
        (0, "acdl.homeHero", "homeHero", payloads[0]), (3, "acdl.MAINNAVCLICK", "MAINNAVCLICK", payloads[3]),
    ]
    assert rows(tagging.forward_events(df, allow=None, block=["home*"]), "i") == [(1,), (3,)]


PAGEVIEWS = [
    (1, "2024-01-01T00:00:00", event("pageView")),  # no user
    (1, "2024-01-01T00:00:02", event("pageView", user={"loginType": "Hard", "customerId": "7"}, page={"pageName": "p2"})),
    (1, "2024-01-01T00:00:01", event("pageView", user={"loginType": "", "state": "A"})),
    (2, "2024-01-01T00:00:00", event("click", user={"loginType": "x"})),
    (3, "2024-01-01T00:00:00", event("pageView", user={})),
]


def test_first_pageview_per_load(make):
    df = make("page_load_id int, t string, payload string", *PAGEVIEWS)
    df = df.selectExpr("page_load_id", "cast(t as timestamp_ntz) as event_timestamp_utc", "payload")
    got = tagging.first_pageview(tagging.parse_events(df))
    unknown = "unknown"
    assert rows(got) == [
        (1, unknown, unknown, "A", unknown, unknown), (3, unknown, unknown, unknown, unknown, unknown),
    ]


def test_stream_keeps_one_pageview_per_load_however_late(spark, tmp_path):
    folder, args = tmp_path / "in", ("page_load_id", "t", str(tmp_path / "out"), str(tmp_path / "log"))
    folder.mkdir()
    land = lambda name, *rows_: (folder / name).write_text(
        "\n".join(json.dumps({"page_load_id": p, "t": t, "payload": e}) for p, t, e in rows_)
    )
    stream = lambda: tagging.parse_events(
        spark.readStream.schema("page_load_id int, t timestamp, payload string").option("maxFileAge", runs.EVERY_AGE).json(str(folder))
    )
    land("a.json", *PAGEVIEWS)
    got = runs.write_first_pageviews(stream(), *args)
    assert rows(got, "page_load_id", "active_state") == [(1, "A"), (3, "unknown")]
    user = event("pageView", user={"state": "late"})
    land("b.json", (1, "2024-01-01T00:00:00", user), (4, "2023-12-25T00:00:00", user), (4, "2023-12-25T00:00:00", user))
    got = runs.write_first_pageviews(stream(), *args)
    # an earlier page view of a known load that lands later is its first one, as in the batch form
    assert rows(got, "page_load_id", "active_state") == [(1, "late"), (3, "unknown"), (4, "late")]
    land("c.json", (9, "2024-01-02T00:00:00", event("click")))
    assert runs.write_first_pageviews(stream(), *args).count() == 3
    batch = tagging.parse_events(spark.read.schema("page_load_id int, t timestamp, payload string").json(str(folder)))
    assert rows(tagging.first_pageview(batch, order=["t"]), "page_load_id") == [(1,), (3,), (4,)]


def landed(spark, folder, data, size):
    """The page views as files of ``size`` rows, read as a stream one file at a time."""
    folder.mkdir()
    for i in range(0, len(data), size):
        lines = [json.dumps({"page_load_id": p, "t": t, "payload": e}) for p, t, e in data[i : i + size]]
        (folder / f"{i:05d}.json").write_text("\n".join(lines))
    schema = "page_load_id int, t timestamp, payload string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    return tagging.parse_events(stream), tagging.parse_events(spark.read.schema(schema).json(str(folder)))


@pytest.mark.parametrize("size", [2, 9, 100])
def test_any_split_into_batches_gives_the_batch_result(spark, tmp_path, size):
    """Loads without a time, weeks old, repeated in every batch, and whole batches without a time."""
    rng = random.Random(size)
    times = [None, "2024-01-01T00:00:00", "2024-01-01T00:00:05", "2024-01-20T00:00:00", "2023-06-01T00:00:00"]
    user = lambda: event("pageView", user={"state": rng.choice("ABC"), "loginType": rng.choice(["", "x"])})
    data = [(rng.choice([1, 2, 3, 4, None, rng.randrange(90)]), None, user()) for _ in range(6)]
    data += [(rng.choice([1, 2, 3, None, rng.randrange(90)]), rng.choice(times), user()) for _ in range(24)]
    stream, batch = landed(spark, tmp_path / "in", data, size)
    target = str(tmp_path / "out")
    got = runs.write_first_pageviews(stream, "page_load_id", "t", target, str(tmp_path / "log"))
    want = rows(tagging.first_pageview(batch, order=["t"]))
    assert rows(got.drop("t")) == want
    store = runs.pageviews_store(batch, "page_load_id", ["t"], target)
    for _ in range(2):
        store.compact()
        assert rows(store.read().drop("t")) == want
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("upto=")]) == 1


def test_compaction_leaves_running_readers_their_files(spark, make, tmp_path):
    store = MergedStore(spark, str(tmp_path / "s"), make("k int, n long").schema, lambda d: d.groupBy("k").agg(F.sum("n").alias("n")))
    assert store.read().collect() == []
    store.compact()
    for number in range(3):
        store.write(make("k int, n long", (1, 1), (number, 5)), number)
    store.write(make("k int, n long", (1, 1), (2, 5)), 2)  # a repeated batch replaces its own rows
    before, want = store.read(), [(0, 5), (1, 8), (2, 5)]
    store.compact()
    assert rows(before) == want == rows(store.read())
    store.write(make("k int, n long", (7, 1)), 3)
    store.compact()
    assert rows(store.read()) == [*want, (7, 1)]
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["batch=3", "upto=2", "upto=3"]
    broken = MergedStore(spark, store.target, store.schema, lambda d: d.withColumn("n", F.raise_error(F.lit("broken")).cast("long")))
    store.write(make("k int, n long", (7, 1)), 4)
    with pytest.raises(Exception, match="broken"):
        broken.compact()
    assert rows(store.read()) == [*want, (7, 2)]


def test_window_figures_of_a_stream_equal_the_batch(spark, make, tmp_path):
    """Users and orders that come back in later batches, late ones, rows without id or time."""
    rng = random.Random(4)
    at = lambda: rng.choice([None, ts("2023-12-01T00:10:00"), *[ts(f"2024-01-01T0{h}:{m}:59") for h in range(3) for m in (10, 29, 30)]])
    data = [(at(), rng.choice(["a", "b", None]), rng.choice([None, 1, rng.randrange(30)]), rng.choice([None, "o1", f"o{i}"]),
             rng.choice([None, 1.5, 2.0])) for i in range(300)]
    df = make("event_timestamp_utc timestamp_ntz, brand string, u long, o string, value double", *data)
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    counted, summed = {"users": "u", "orders": "o"}, {"revenue": "value"}
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = runs.write_window_figures(stream, ["brand"], str(tmp_path / "out"), str(tmp_path / "log"), counted, summed)
    want = batch.where("event_timestamp_utc is not null").groupBy(
        F.window(F.col("event_timestamp_utc").cast("timestamp"), "30 minutes").getField("start").cast("timestamp_ntz").alias("w"), "brand"
    ).agg(F.count_distinct("u"), F.count_distinct("o"), F.sum("value"))
    assert rows(got) == rows(want) and want.count() > 15
    store = runs.figures_store(batch, ["brand"], str(tmp_path / "out"), counted, summed)
    store.compact()
    assert rows(runs.window_figures(store.read(), ["brand"], counted, summed)) == rows(want)


def test_click_parts_by_number_of_colons(make):
    cases = [
        event("c", click={"clickDescription": "a", "clickUrl": "u"}), event("c", click={"clickDescription": "a:b"}),
        event("c", click={"clickDescription": "a:b:c:d", "clickUrl": ""}), event("c"),
    ]
    df = make("i int, page_url string, text string, payload string", *[(i, "p", "t", c) for i, c in enumerate(cases)])
    got = tagging.click_parts(tagging.parse_events(df), "page_url", "text")
    assert rows(got, "i", "click_category", "click_subcategory", "click_text", "click_url") == [
        (0, "a", None, "t", "u"), (1, "a", "b", "t", "p"), (2, "a", "b", "t", "p"), (3, None, None, "t", "p"),
    ]


def test_bucket_totals_batch_equals_stream(spark, make, tmp_path):
    data = [(ts(f"2024-01-01T{h:02d}:{m:02d}:59"), b, float(h)) for h in range(5) for m in (0, 29, 30) for b in "ab"]
    make("event_timestamp_utc timestamp_ntz, brand string, value double", *data).repartition(6).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    zone = "America/New_York"
    got = runs.write_totals(stream, ["brand"], str(tmp_path / "out"), str(tmp_path / "log"), zone=zone)
    want = runs.bucket_totals(batch, ["brand"], zone=zone)
    assert rows(got) == rows(want) and want.count() == 20
    # an event that lands weeks late in a later run counts too
    make("event_timestamp_utc timestamp_ntz, brand string, value double", (ts("2023-12-01T00:00:00"), "a", 5.0),
         (data[0][0], "a", 1.0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = runs.write_totals(stream, ["brand"], str(tmp_path / "out"), str(tmp_path / "log"), zone=zone)
    spark.catalog.refreshByPath(str(tmp_path / "in"))
    assert rows(got) == rows(runs.bucket_totals(spark.read.parquet(str(tmp_path / "in")), ["brand"], zone=zone))
    assert got.count() == 21
