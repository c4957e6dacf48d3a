import datetime as dt
import os
import re
import threading
from types import SimpleNamespace

import pytest
from conftest import day, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.operators import properties
from visitloom.sources import files, lookups, reports, schema, shards, staging, tables
from visitloom.streaming import runs


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_order_report_end_to_end(spark, tmp_path):
    landed = tmp_path / "in" / "REC008 Website Order Type And Customer Type Report-2024-05-01.csv"
    write(
        landed,
        "ATG Order,OrderDate,Bottle Quantity,Note",
        'a,2024-01-31,2.7,"x, y"', "b,12.31.2024,-2.7,NA", "c,2024-13-01,x,", "d,,, n ", "e,NA,1e2,null", "f,2024-02-29, 12 ,ok",
    )
    got = reports.run_report(spark, str(tmp_path / "in"), str(tmp_path / "out"), day("2024-05-01"))
    assert rows(got) == [
        ("a", "2024-01-31", 2, "x, y"), ("b", None, -2, None), ("c", None, 0, None),
        ("d", None, 0, " n "), ("e", None, 100, None), ("f", "2024-02-29", 12, "ok"),
    ]
    assert got.columns == ["ATG_Order", "OrderDate", "Bottle_Quantity", "Note"]
    raw = reports.read_csv(spark, str(tmp_path / "out/REC008/raw/REC008_2024-05-01.csv"))
    assert raw.count() == 6 and ("12.31.2024",) in rows(raw, "OrderDate") and ("NA",) in rows(raw, "Note")
    clean = reports.read_text_csv(spark, str(tmp_path / "out/REC008/clean/REC008_2024-05-01.csv"))
    assert clean.count() == 6 and clean.columns == got.columns


def test_cells_with_line_breaks_and_dates_in_several_forms(spark, tmp_path):
    landed = tmp_path / "in" / "REC008 Website Order Type And Customer Type Report-2024-05-01.csv"
    write(landed, "Order,OrderDate,Note", 'a,06/01/2024,"two', 'lines, ""quoted"""', "b,2024-06-02 10:11:12,x", 'c,"Jun 3, 2024",', "d,13/13/2024,y")
    for _ in range(2):  # a rerun replaces
        got = reports.run_report(spark, str(tmp_path / "in"), str(tmp_path / "out"), day("2024-05-01"))
    note = 'two\nlines, "quoted"'
    assert rows(got) == [("a", "2024-06-01", note), ("b", "2024-06-02", "x"), ("c", "2024-06-03", None), ("d", None, "y")]
    raw = reports.read_csv(spark, str(tmp_path / "out/REC008/raw/REC008_2024-05-01.csv"))
    assert rows(raw)[0] == ("a", "06/01/2024", note) and raw.count() == 4
    own = {"REC008": lambda df: reports.clean_orders(df, ["dd.MM.yyyy"])}
    assert rows(reports.clean_report("REC008", raw, own), "OrderDate") == [(None,)] * 4


def test_a_raw_copy_in_many_parts_reads_back_complete(spark, tmp_path):
    many = spark.range(300).selectExpr("cast(id as string) as `a b`", "concat('x', id) as c").repartition(7)
    reports.write_csv(many, str(tmp_path / "raw"))
    assert rows(reports.read_csv(spark, str(tmp_path / "raw"))) == rows(many)


def test_other_reports(spark, make, tmp_path):
    df = reports.clean_report("REC013", make("`a b` string, OrderDate string", ("x", "bad")))
    assert df.columns == ["a_b", "OrderDate"] and rows(df) == [("x", "bad")]
    assert reports.clean_report("REC008", make("`a b` string", ("x",))).columns == ["a_b"]
    with pytest.raises(ValueError, match="REC999"):
        reports.clean_report("REC999", df)
    assert reports.report_paths("REC013", dt.date(2024, 5, 1))[0] == "REC013-Campaign IDs Report-2024-05-01.csv"
    assert reports.report_paths("X", dt.date(2024, 5, 1)) == (
        "X-2024-05-01.csv", "X/raw/X_2024-05-01.csv", "X/clean/X_2024-05-01.csv",
    )
    write(tmp_path / "in" / "X-2024-05-01.csv", "a", "1")
    with pytest.raises(ValueError):
        reports.run_report(spark, str(tmp_path / "in"), str(tmp_path / "out"), day("2024-05-01"), "X")
    assert os.path.isdir(tmp_path / "out/X/raw/X_2024-05-01.csv")  # raw copy survives the failure


def test_ingest_takes_each_file_once(spark, tmp_path):
    weeks = T.StructType([T.StructField("week_start", T.DateType()), T.StructField("week", T.IntegerType())])
    folder, target, log = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "log")
    run = lambda: rows(runs.ingest_new_files(spark, str(folder), weeks, target, log))
    write(folder / "a.csv", "week_start,week", "2024-06-29,1", "2024-07-06,2")
    assert run() == [(day("2024-06-29"), 1), (day("2024-07-06"), 2)]
    assert len(run()) == 2
    write(folder / "b.csv", "week_start,week", "2024-07-13,3")
    write(folder / "c.csv", "week_start,week")
    assert len(run()) == 3 and len(run()) == 3
    write(folder / "old.csv", "week_start,week", "2023-07-01,1")
    os.utime(folder / "old.csv", (1700000000, 1700000000))  # far older than the newest file read
    assert len(run()) == 4
    assert (folder / "a.csv").exists()


def test_backfill_tags_rows_with_their_file(spark, tmp_path):
    write(tmp_path / "in" / "A b.csv", "v", "1", "2")
    write(tmp_path / "in" / "c.d.csv", "v", "3")
    os.utime(tmp_path / "in" / "c.d.csv", (1714564800, 1714564800))  # 2024-05-01 12:00 UTC
    got = files.backfill_all(spark, str(tmp_path / "in"), schema=schema.all_strings("v"))
    names = dict(rows(got, "v", "stamped_name"))
    assert names["3"] == "c.d__20240501_120000.csv"
    assert re.fullmatch(r"A(%20| )b__\d{8}_\d{6}\.csv", names["1"]) and names["1"] == names["2"]
    bare = spark.sql("select 'noext' n, timestamp'2024-05-01 12:00:00' t")
    assert bare.select(files.stamped_name(F.col("n"), F.col("t"))).first()[0] == "noext__20240501_120000"


def test_refresh_replaces_from_the_checkpoint(spark, make, tmp_path):
    s = "session_id int, d date, is_final boolean"
    first = make(s, (1, day("2024-01-01"), True), (2, day("2024-01-02"), True), (3, day("2024-01-03"), False), (4, day("2024-01-04"), False))
    args = dict(date_col="d", start="2024-01-01")
    tables.incremental_refresh(first, "r1", **args)
    second = make(s, (9, day("2024-01-02"), True), (5, day("2024-01-03"), True), (6, day("2024-01-05"), False))
    want = [(1, day("2024-01-01"), True), (2, day("2024-01-02"), True), (5, day("2024-01-03"), True), (6, day("2024-01-05"), False)]
    for _ in range(2):  # a rerun changes nothing
        assert rows(tables.incremental_refresh(second, "r1", **args), "session_id", "d", "is_final") == want
    back = tables.incremental_refresh(second, "r1", checkpoint="2024-01-02", **args)
    assert rows(back, "session_id") == [(1,), (5,), (6,), (9,)]
    late = tables.incremental_refresh(first.limit(0), "r1", checkpoint="2024-01-03", **args)
    assert rows(late, "session_id") == [(1,), (9,)]


def files_under(folder):
    return sorted({str(p.relative_to(folder)).split("/")[0] for p in folder.rglob("*.parquet")})


def test_refresh_leaves_no_stale_files_and_survives_a_failure(spark, make, tmp_path):
    s = "session_id int, d date, is_final boolean"
    args = dict(date_col="d", start="2024-01-01", path=str(tmp_path / "t"), cluster_by=["session_id"])
    first = make(s, (1, day("2024-01-01"), True), (2, day("2024-01-02"), False), (3, day("2024-01-03"), False))
    tables.incremental_refresh(first, "r2", **args)
    failing = first.withColumn("session_id", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        tables.incremental_refresh(failing, "r2", **args)
    assert rows(spark.table("r2"), "session_id") == [(1,), (2,), (3,)]
    got = tables.incremental_refresh(make(s, (9, day("2024-01-02"), True)), "r2", **args)
    assert rows(got, "session_id", "d") == [(1, day("2024-01-01")), (9, day("2024-01-02"))]
    assert files_under(tmp_path / "t") == ["d=2024-01-01", "d=2024-01-02"]
    assert tables.table_checkpoint(spark, "r2", "d", "is_final", "2024-01-01") == day("2024-01-03")


def test_upsert_replaces_rows_by_key_within_the_open_days(spark, make):
    s = "k int, v string, d date, is_final boolean"
    d1, d2, d3 = (day(f"2024-01-0{i}") for i in (1, 2, 3))
    tables.incremental_refresh(make(s, (1, "a", d1, True), (2, "b", d2, False), (None, "n", d2, False)), "u1", date_col="d", start=d1)
    new = make(s, (2, "B", d2, False), (None, "N", d2, False), (7, "g", d3, False), (1, "late", d1, False))
    for _ in range(2):
        got = tables.upsert(new, "u1", keys=["k"], date_col="d", days=[d2, d3])
        assert rows(got, "k", "v", "d") == [(1, "a", d1), (2, "B", d2), (7, "g", d3), (None, "N", d2)]


def test_copy_keeps_the_old_table_when_it_fails_and_may_read_it(spark, make, tmp_path):
    df = make("id int, d date", (1, day("2024-01-01")), (2, day("2024-01-02")))
    args = dict(partition_by="d", cluster_by=["id"], path=str(tmp_path / "c"))
    tables.copy_table(df, "c1", **args)
    with pytest.raises(Exception, match="broken"):
        tables.copy_table(df.withColumn("id", F.raise_error(F.lit("broken")).cast("int")), "c1", **args)
    with pytest.raises(Exception, match="no d"):
        tables.copy_table(make("id int, d date", (1, None)), "c1", **args)
    assert rows(spark.table("c1"), "id") == [(1,), (2,)]
    got = tables.copy_table(spark.table("c1"), "c1", predicate=F.col("id") == 2, **args)
    assert rows(got) == [(2, day("2024-01-02"))]
    assert tables._cluster_columns(spark, "c1") == ["id"]


def test_a_reader_sees_the_old_or_the_new_copy(spark, make, tmp_path):
    """Polled all the while a table is copied five times over."""
    args = dict(partition_by="d", path=str(tmp_path / "p"))
    copy = lambda n: tables.copy_table(
        make("id int, d date", *[(n, day(f"2024-01-{i + 1:02d}")) for i in range(20)]), "polled", **args
    )
    copy(0)
    seen, stop = [], threading.Event()

    def poll():
        while not stop.is_set():
            try:
                seen.append(rows(spark.table("polled").groupBy("id").count()))
            except Exception as e:  # noqa: BLE001
                seen.append(str(e)[:300])

    reader = threading.Thread(target=poll)
    reader.start()
    for n in range(1, 6):
        copy(n)
    stop.set()
    reader.join()
    assert set(map(str, seen)) <= {str([(n, 20)]) for n in range(6)} and len(seen) > 5
    assert rows(spark.table("polled").groupBy("id").count()) == [(5, 20)]
    versions = [r.tableName for r in spark.sql("show tables like 'polled__*'").collect()]
    assert len(versions) == 2 and len(list((tmp_path / "p").iterdir())) == 2


STEPS = ["_write_days", "create_table", "_add_days", "_switch", "_drop_versions"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_copy_that_fails_at_any_step(spark, make, tmp_path, monkeypatch, step, after):
    """Old rows up to the switch, new ones from there on, and the next copy cleans up."""
    name = f"f_{step}_{after}".lower()
    args = dict(partition_by="d", path=str(tmp_path / "f"))
    tables.copy_table(make("id int, d date", (1, day("2024-01-01"))), name, **args)
    right = getattr(tables, step)

    def broken(*a, **k):
        if after:
            right(*a, **k)
        raise OSError("lost")

    monkeypatch.setattr(tables, step, broken)
    with pytest.raises(OSError, match="lost"):
        tables.copy_table(make("id int, d date", (2, day("2024-01-02"))), name, **args)
    done = (step == "_switch" and after) or step == "_drop_versions"
    assert rows(spark.table(name), "id") == [(2 if done else 1,)]
    monkeypatch.undo()
    tables.copy_table(make("id int, d date", (3, day("2024-01-02"))), name, **args)
    assert rows(spark.table(name)) == [(3, day("2024-01-02"))]
    assert len(spark.sql(f"show tables like '{name}__*'").collect()) == 2


def test_copy_over_a_plain_table_and_refresh_of_a_copy(spark, make):
    s = "id int, d date, is_final boolean"
    first = make(s, (1, day("2024-01-01"), True), (2, day("2024-01-02"), False))
    tables.incremental_refresh(first, "plain1", date_col="d", start="2024-01-01")
    tables.copy_table(make(s, (7, day("2024-01-05"), True), (8, day("2024-01-06"), False)), "plain1", partition_by="d", cluster_by=["id"])
    assert rows(spark.table("plain1"), "id") == [(7,), (8,)]
    assert tables.landed_days(spark, "plain1") == [day("2024-01-06"), day("2024-01-05")]
    got = tables.incremental_refresh(make(s, (9, day("2024-01-07"), False)), "plain1", date_col="d", start="2024-01-01")
    assert rows(got, "id", "d") == [(7, day("2024-01-05")), (9, day("2024-01-07"))]
    got = tables.upsert(make(s, (9, day("2024-01-07"), True)), "plain1", keys=["id"], date_col="d", days=["2024-01-07"])
    assert rows(got, "id", "is_final") == [(7, True), (9, True)]


@pytest.mark.parametrize("values", [("int", 2023, 2024), ("string", "a b", "c")])
def test_copy_by_partitions_of_other_types(make, values):
    kind, *parts = values
    got = tables.copy_table(make(f"id int, p {kind}", (1, parts[0]), (2, parts[1])), f"by_{kind}", partition_by="p")
    assert rows(got) == [(1, parts[0]), (2, parts[1])] and dict(got.dtypes)["p"] == kind
    with pytest.raises(Exception, match="cannot name"):
        tables.copy_table(make("id int, p string", (1, "a/b")), "by_odd", partition_by="p")


def test_checkpoint_of_tables_with_rows_without_a_day_or_a_final_row(spark, make):
    s = "k int, is_final boolean, d date"
    tables.create_table(spark, "cp", make(s).schema, partition_by="d")
    days = [day(f"2024-01-{i:02d}") for i in range(1, 10)]
    make(s, (1, True, None), *[(i, False, d) for i, d in enumerate(days)]).write.insertInto("cp")
    assert tables.table_checkpoint(spark, "cp", "d", "is_final", "2023-12-01") == day("2023-12-01")
    assert tables.landed_days(spark, "cp") == days[::-1]
    make(s, (1, True, days[1])).write.insertInto("cp")
    assert tables.table_checkpoint(spark, "cp", "d", "is_final", "2023-12-01") == days[2]


def test_versioned_upsert_takes_the_latest_in_any_order_of_batches(spark, make):
    s = "k int, v int, x string, d date, is_final boolean"
    d1, d2 = day("2024-01-01"), day("2024-01-02")
    batches = [
        [(1, 1, "a", d1, False), (2, 5, "b", d2, False), (None, 1, "n", d1, False)],
        [(1, 3, "c", d1, False), (1, 2, "old", d1, False), (2, 4, "older", d2, False)],
        [(1, None, "unknown", d1, False), (None, 2, "m", d1, False), (3, 1, "z", d2, False)],
    ]
    want = [(1, 3, "c"), (2, 5, "b"), (3, 1, "z"), (None, 2, "m")]
    for i, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 0, 2, 1, 0)]):
        name = f"versions{i}"
        tables.create_table(spark, name, make(s).schema, partition_by="d")
        for n in order:
            got = tables.upsert(make(s, *batches[n]), name, keys=["k"], date_col="d", days=[d1, d2], version="v")
        assert rows(got, "k", "v", "x") == want


def test_bucketed_tables_join_and_group_without_an_exchange(spark, make):
    visits = make("session_id long, brand string", *[(i, f"B{i % 3}") for i in range(200)])
    sales = make("session_id long, revenue double", *[(i // 2, 1.0) for i in range(100)])
    a = tables.write_bucketed(visits, "visits_bucketed", ["session_id"], buckets=4)
    b = tables.write_bucketed(sales, "sales_bucketed", ["session_id"], buckets=4)
    joined = a.join(b.hint("merge"), "session_id").groupBy("session_id").agg(F.sum("revenue").alias("r"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert rows(joined) == rows(visits.join(sales, "session_id").groupBy("session_id").agg(F.sum("revenue")))


def test_shards_are_picked_by_name(spark, make, tmp_path):
    folder = str(tmp_path / "b0")
    s = "id int, event_date date"
    days = [day(f"2024-01-{i:02d}") for i in range(1, 31)]
    df = make(s, *[(i, d) for i, d in enumerate(days)])
    shards.write_shards(df, folder, shards.INTRADAY, "event_date")
    shards.write_shards(df.where("id < 28"), folder, shards.FINAL, "event_date")
    got = shards.intraday_shards(spark, folder, "2024-01-30", df.schema)
    assert rows(got, "id", "shard_day") == [(28, days[28]), (29, days[29])]
    assert {f.split("/")[-2] for f in got.inputFiles()} == {"events_intraday_20240129", "events_intraday_20240130"}
    shards.write_shards(df.where("id = 28"), folder, shards.FINAL, "event_date")
    assert rows(shards.intraday_shards(spark, folder, "2024-01-30", df.schema), "id") == [(29,)]
    assert rows(shards.read_shards(spark, folder, shards.FINAL, ["2024-01-29", "2024-01-30"], df.schema), "id") == [(28,)]
    # a shard is replaced whole, others stay; no shard, no rows; no day, no shard
    shards.write_shards(make(s, (99, days[29])), folder, shards.INTRADAY, "event_date")
    assert rows(shards.intraday_shards(spark, folder, "2024-01-30", df.schema), "id") == [(99,)]
    assert shards.intraday_shards(spark, folder, "2025-01-30", df.schema).collect() == []
    with pytest.raises(Exception, match="no event_date"):
        shards.write_shards(make(s, (1, None)), folder, shards.FINAL, "event_date")


def test_checked_csv_keeps_all_rows_somewhere(spark, tmp_path):
    s = T.StructType.fromDDL("id int, d date, note string")
    folder = tmp_path / "in"
    args = (str(folder), s, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "log"))
    write(folder / "a.csv", "id,d,note", "1,2024-01-01,x", '2,,"say ""hi"", all"', ",2024-01-02,", "z,2024-01-01,y")
    write(folder / "moved.csv", "d,id,note", "2024-01-01,5,m")
    write(folder / "none.csv", "6,2024-01-01,n")
    write(folder / "wide.csv", "id,d,note,more", "7,2024-01-01,n,w")
    write(folder / "short.csv", "id,d,note", "8,2024-01-01", "9,2024-02-30,b", "10, 2024-01-01 ,b", "11,2024-01-01,b,extra")
    want = [(1, day("2024-01-01"), "x"), (10, day("2024-01-01"), "b"), (2, None, 'say "hi", all'), (None, day("2024-01-02"), None)]
    for _ in range(2):
        good, bad = runs.ingest_checked_csv(spark, *args)
        assert rows(good) == want
        found = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in bad.collect())
        assert found == sorted(
            [("a.csv", "value"), ("short.csv", "value"), *[("short.csv", "cells")] * 2, *[("moved.csv", "header")] * 2,
             ("none.csv", "header"), *[("wide.csv", "header")] * 2]
        )
    write(folder / "late.csv", "id,d,note", "12,2024-01-03,")
    good, bad = runs.ingest_checked_csv(spark, *args)
    assert good.count() == 5 and bad.count() == 9


def test_upsert_from_a_stream_whatever_the_order(spark, make, tmp_path):
    s = "k int, v int, x string, d date"
    d1, d2 = day("2024-01-01"), day("2024-01-02")
    schema = make(s).schema
    for i, order in enumerate([(0, 1, 2), (2, 1, 0)]):
        batches = [[(1, 1, "a", d1), (2, 9, "b", d2)], [(1, 2, "c", d1)], [(1, 0, "z", d1), (3, 1, "n", d2)]]
        folder = tmp_path / f"in{i}"
        for n, number in enumerate(order):
            make(s, *batches[number]).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(schema).parquet(str(folder))
            if n == 0:
                tables.create_table(spark, f"us{i}", schema, partition_by="d")
            got = runs.upsert_stream(stream, f"us{i}", str(tmp_path / f"log{i}"), keys=["k"], date_col="d", version="v")
        again = runs.upsert_stream(stream, f"us{i}", str(tmp_path / f"replay{i}"), keys=["k"], date_col="d", version="v")
        assert rows(got, "k", "v", "x") == rows(again, "k", "v", "x") == [(1, 2, "c"), (2, 9, "b"), (3, 1, "n")]
    make(s, (1, 1, "x", None)).write.parquet(str(tmp_path / "undated"))
    undated = spark.readStream.schema(schema).parquet(str(tmp_path / "undated"))
    with pytest.raises(Exception, match="no d"):
        runs.upsert_stream(undated, "us0", str(tmp_path / "log-u"), keys=["k"], date_col="d", version="v")


def test_prefer_landed_takes_whole_days(make):
    s = "id int, d date"
    days = [day(f"2024-01-{i:02d}") for i in range(1, 5)]
    final, intraday = make(s, (1, days[0]), (2, days[2])), make(s, *[(10 + i, d) for i, d in enumerate(days)])
    take = lambda landed: rows(properties.prefer_landed(final, intraday, landed, "2024-01-04", "d"), "id")
    assert take([days[0], days[2]]) == [(1,), (13,), (2,)]
    assert take([]) == [(1,), (12,), (13,), (2,)]
    assert take(days) == [(1,), (2,)]


def test_released_staging_is_gone(spark, make):
    with staging.released(spark):
        path = staging.new_path(spark, "x")
        make("a int", (1,)).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_checkpoint_rule(make):
    s = "d date, is_final boolean"
    start = "2024-01-01"
    assert tables.refresh_checkpoint(None, "d", "is_final", start) == day(start)
    assert tables.refresh_checkpoint(make(s, (day("2024-02-01"), False)), "d", "is_final", start) == day(start)
    df = make(s, (day("2024-02-01"), True), (day("2024-02-03"), False))
    assert tables.refresh_checkpoint(df, "d", "is_final", start) == day("2024-02-02")


def test_copy_and_create(spark, make):
    df = make(
        "id int, d date, b string", (1, day("2024-01-01"), "x"), (2, day("2024-01-02"), "y"), (3, day("2024-06-01"), "z")
    )
    for _ in range(2):
        copy = tables.copy_table(
            df, "copied", predicate=F.col("d") < F.lit(day("2024-06-01")), add_nulls={"source_system": "string"},
            partition_by="d", cluster_by=["b", "id"], description="it's a copy",
        )
        assert rows(copy) == [(1, day("2024-01-01"), "x", None), (2, day("2024-01-02"), "y", None)]
    assert {r[0] for r in spark.sql(f"show partitions {tables.version_of(spark, 'copied')}").collect()} == {"d=2024-01-01", "d=2024-01-02"}
    tables.create_table(spark, "orders_new", schema.ORDER_DETAILS, partition_by="OrderDate", description="it's new")
    created = spark.table("orders_new")
    assert created.count() == 0 and dict(created.dtypes) == {
        f.name: f.dataType.simpleString() for f in schema.ORDER_DETAILS
    }


class FakeSession:
    """Stands for a session on a cluster; the setting is fixed at its start."""

    def __init__(self, folder=None):
        self.conf = SimpleNamespace(get=lambda key, default: folder or default)
        self.sparkContext = SimpleNamespace(master="spark://host:7077", applicationId="app-1")


def test_staging_needs_a_shared_folder_only_on_a_cluster(spark, make):
    df = make("a int", (1,), (2,))
    assert rows(staging.stage(df)) == [(1,), (2,)]
    assert staging.shared_folder(FakeSession("hdfs://shared/")) == "hdfs://shared"
    assert staging.new_path(spark, "x").startswith(staging.shared_folder(spark) + "/visitloom-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(FakeSession())


def test_literal_table_is_known_to_be_small(spark):
    table = lookups.channel_map(spark)
    assert table.count() == len(lookups.CHANNEL_MAP)
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10 * 1024 * 1024
