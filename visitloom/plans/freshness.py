"""Intraday freshness, incremental tables, ingestion and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.dates import time_bucket
from visitloom.operators import properties
from visitloom.plans.registry import query
from visitloom.plans.tagging import StreamedViews
from visitloom.plans.views import Views
from visitloom.sources import files, shards, tables
from visitloom.sources.staging import new_path, stage
from visitloom.streaming import runs

TODAY = "2024-01-30"


@query(
    "intraday_sessions",
    """
SELECT brand, replace(brand, 'B', 'property-') AS property_id, event_date, count(DISTINCT session_id) AS sessions,
       count(*) AS events FROM p_events
WHERE event_date IN (DATE '2024-01-29', DATE '2024-01-30') GROUP BY 1, 2, 3""",
)
def intraday_sessions(v: Views) -> DataFrame:
    events = v.events().withColumn("visit_id", F.unix_date("event_date"))
    recent = properties.recent_events(events, TODAY).withColumn("property_id", F.replace("brand", F.lit("B"), F.lit("property-")))
    return recent.groupBy("brand", "property_id", "event_date").agg(
        F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("events")
    )


@query(
    "fresh_sessions",
    """
SELECT brand, session_id, session_date, session_duration_s, 'final' AS origin FROM p_sessions
WHERE session_date < DATE '2024-01-29' OR (session_date = DATE '2024-01-29' AND brand <> 'B2')
UNION ALL
SELECT brand, session_id, session_date, session_duration_s, 'intraday' FROM p_sessions
WHERE session_date = DATE '2024-01-30' OR (session_date = DATE '2024-01-29' AND brand = 'B2')""",
)
def fresh_sessions(v: Views) -> DataFrame:
    """Yesterday's export has landed for two of three brands, today's for none."""
    columns = ["brand", "session_id", "session_date", "session_duration_s"]
    sessions = stage(v.sessions(pages=False, geo=False).select(*columns))
    landed = "session_date < date'2024-01-29' or (session_date = date'2024-01-29' and brand <> 'B2')"
    final = sessions.where(landed).withColumn("origin", F.lit("final"))
    intraday = sessions.withColumn("origin", F.lit("intraday"))
    return properties.prefer_final(
        final, intraday, ["brand", "session_id", "session_date"], TODAY, "session_date"
    )


@query(
    "fresh_transactions",
    """
SELECT brand, transaction_id, transaction_date, revenue FROM p_transactions""",
)
def fresh_transactions(v: Views) -> DataFrame:
    sales = v.transactions().select("brand", "transaction_id", "transaction_date", "revenue")
    final = sales.where("transaction_date < date'2024-01-30'")
    return properties.prefer_final(
        final, sales, ["brand", "transaction_id", "transaction_date"], TODAY, "transaction_date"
    )


@query(
    "session_start_buckets",
    """
SELECT brand, date_trunc('hour', session_start_timestamp_utc) AS hour_utc,
       time_bucket(INTERVAL 30 MINUTE, timezone('America/New_York',
         timezone('UTC', session_start_timestamp_utc))) AS half_hour_local, count(*) AS sessions
FROM p_sessions GROUP BY 1, 2, 3""",
)
def session_start_buckets(v: Views) -> DataFrame:
    start = F.col("session_start_timestamp_utc")
    bucketed = v.sessions(pages=False, geo=False).withColumn("hour_utc", time_bucket(start, "1 hour")).withColumn(
        "half_hour_local", time_bucket(start, "30 minutes", "America/New_York")
    )
    return bucketed.groupBy("brand", "hour_utc", "half_hour_local").agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "streamed_bucket_totals",
    """
SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bucket_start, event_type, count(*) AS events, round(sum(value), 2) AS value
FROM events GROUP BY 1, 2""",
)
def streamed_bucket_totals(v: Views) -> DataFrame:
    """The events as a stream of files, run to the end."""
    out, log = new_path(v.spark, "totals"), new_path(v.spark, "totals-log")
    result = runs.write_totals(v.stream("events"), ["event_type"], out, log, ts="ts")
    return result.withColumn("value", F.round("value", 2))


@query(
    "ingested_events",
    "SELECT event_type, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
)
def ingested_events(v: Views) -> DataFrame:
    """Two runs over the same files: the second one adds nothing."""
    schema = v.table("events").schema
    target, log = new_path(v.spark, "ingest"), new_path(v.spark, "ingest-log")
    for _ in range(2):
        rows = runs.ingest_new_files(
            v.spark, v.files("events"), schema, target, log, file_format="parquet"
        )
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "backfilled_files",
    """
SELECT 'orders.parquet' AS file_name, true AS is_stamped, count(*) AS row_count, min(o_orderkey) AS first_key FROM orders""",
)
def backfilled_files(v: Views) -> DataFrame:
    rows = files.backfill_all(v.spark, v.path("orders"), "parquet", v.table("orders").schema)
    return rows.groupBy("file_name").agg(
        F.min(F.col("stamped_name").rlike(r"^orders__\d{8}_\d{6}\.parquet$")).alias("is_stamped"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("o_orderkey").alias("first_key"),
    )


@query(
    "refreshed_sessions",
    """
SELECT session_id, session_duration_s, session_date, session_date <= DATE '2024-01-28' AS is_final,
       CASE WHEN session_date <= DATE '2024-01-20' THEN 1 ELSE 2 END AS run FROM p_sessions""",
)
def refreshed_sessions(v: Views) -> DataFrame:
    """A first build up to the 22nd (final to the 20th), then a refresh."""
    path = new_path(v.spark, "refresh")
    table = "refresh_" + path.rsplit("-", 1)[1]
    sessions = stage(v.sessions(pages=False, geo=False).select("session_id", "session_duration_s", "session_date"))

    def run(number: int, last: str, final: str) -> DataFrame:
        rows = sessions.where(F.col("session_date") <= F.lit(last).cast("date")).withColumns(
            {"is_final": F.col("session_date") <= F.lit(final).cast("date"), "run": F.lit(number)}
        )
        return tables.incremental_refresh(rows, table, date_col="session_date", start="2024-01-01", path=path)

    run(1, "2024-01-22", "2024-01-20")
    return run(2, TODAY, "2024-01-28")


@query(
    "brand_validation",
    """
WITH a AS (SELECT brand, count(DISTINCT session_id) AS sessions,
             count(*) FILTER (fiscal_year IS NULL) AS rows_without_fiscal_date FROM p_report GROUP BY 1),
e AS (SELECT 'B' || (user_id % 3) AS brand, count(DISTINCT user_id * 100000 + (CAST(ts AS DATE) - DATE '2000-01-01')) AS expected_sessions
      FROM events GROUP BY 1)
SELECT brand, sessions, expected_sessions, sessions - expected_sessions AS difference, rows_without_fiscal_date
FROM a FULL JOIN e USING (brand)""",
)
def brand_validation(v: Views) -> DataFrame:
    expected = v.events().groupBy("brand").agg(F.count_distinct("session_id").alias("expected_sessions"))
    return properties.validate_brand(v.report(pages=False, geo=False, fiscal=False), expected, v.fiscal)


def _table_name(path: str) -> str:
    """A name of its own for a table in that folder."""
    kind, number = path.rsplit("/", 1)[1].split("-", 1)
    return f"{kind}_{number}"


COUNTED = {"users": "user_pseudo_id", "sessions": "session_id", "transactions": "transaction_id"}


@query(
    "streamed_window_figures",
    """
SELECT time_bucket(INTERVAL 30 MINUTE, event_timestamp_utc) AS window_start, brand, count(DISTINCT user_pseudo_id) AS users,
       count(DISTINCT session_id) AS sessions, count(DISTINCT transaction_id) AS transactions,
       round(sum(CASE WHEN event_name = 'purchase' THEN value END), 2) AS revenue
FROM ev1 GROUP BY 1, 2""",
)
def streamed_window_figures(v: Views) -> DataFrame:
    """Key figures per half hour from a stream of three batches: users and sessions of several count once."""
    events = StreamedViews(v, v.stream_of(v.table("events"), 3)).events()
    sold = events.withColumn("revenue", F.when(F.col("event_name") == "purchase", F.col("value")))
    out = runs.write_window_figures(
        sold, ["brand"], new_path(v.spark, "figures"), new_path(v.spark, "figures-log"), COUNTED, {"revenue": "revenue"}
    )
    return out.withColumn("revenue", F.round("revenue", 2))


@query(
    "hourly_intraday_table",
    """
SELECT brand, event_date, event_name, count(*) AS events, count(DISTINCT session_id) AS sessions FROM ev1
WHERE event_date IN (DATE '2024-01-29', DATE '2024-01-30') GROUP BY 1, 2, 3""",
)
def hourly_intraday_table(v: Views) -> DataFrame:
    """Full refresh of yesterday and today, at noon and in the evening: each replaces the table in one step."""
    path = new_path(v.spark, "intraday")
    events = v.events().select("brand", "event_name", "user_pseudo_id", "event_timestamp_utc", "event_date")
    recent = properties.recent_events(events.withColumn("visit_id", F.unix_date("event_date")), TODAY)
    for hour in (12, 24):
        so_far = recent.where((F.col("event_date") < F.lit(TODAY).cast("date")) | (F.hour("event_timestamp_utc") < hour))
        table = tables.copy_table(
            so_far, _table_name(path), partition_by="event_date", cluster_by=["event_name", "session_id"], path=path
        )
    return table.groupBy("brand", "event_date", "event_name").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions")
    )


@query(
    "catalog_fresh_sessions",
    """
SELECT brand, session_id, session_date, session_duration_s,
       CASE WHEN session_date = DATE '2024-01-30' THEN 'intraday' ELSE 'final' END AS origin
FROM p_sessions WHERE session_date <= DATE '2024-01-30'""",
)
def catalog_fresh_sessions(v: Views) -> DataFrame:
    """Whole days from intraday where the final table has no such day yet, as its catalog says; yesterday's landed."""
    columns = ["brand", "session_id", "session_duration_s", "session_date"]
    sessions = stage(v.sessions(pages=False, geo=False).select(*columns))
    path = new_path(v.spark, "final")
    name = _table_name(path)
    final = tables.copy_table(sessions.where("session_date < date'2024-01-30'"), name, partition_by="session_date", path=path)
    return properties.prefer_landed(
        final.withColumn("origin", F.lit("final")),
        sessions.withColumn("origin", F.lit("intraday")),
        tables.landed_days(v.spark, name),
        TODAY,
        "session_date",
    )


@query(
    "sharded_intraday_sessions",
    """
SELECT brand, event_date AS shard_day, count(DISTINCT session_id) AS sessions, count(*) AS events FROM ev1
WHERE event_date = DATE '2024-01-30' OR (event_date = DATE '2024-01-29' AND brand <> 'B0') GROUP BY 1, 2""",
)
def sharded_intraday_sessions(v: Views) -> DataFrame:
    """A folder per property with a shard per day; of yesterday only B0's final shard is there."""
    events = stage(v.events().select("brand", "event_date", "session_id", "event_name"))
    base = new_path(v.spark, "shards")
    found = {}
    for brand in ("B0", "B1", "B2"):
        folder = f"{base}/{brand}"
        own = events.where(F.col("brand") == brand).drop("brand")
        shards.write_shards(own, folder, shards.INTRADAY, "event_date")
        if brand == "B0":
            shards.write_shards(own.where("event_date < date'2024-01-30'"), folder, shards.FINAL, "event_date")
        found[brand] = shards.intraday_shards(v.spark, folder, TODAY, own.schema)
    recent = properties.brand_union(found, ["session_id", "shard_day"])
    return recent.groupBy("brand", "shard_day").agg(
        F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("events")
    )


@query(
    "upserted_sessions",
    """
SELECT brand, session_id, session_date, session_duration_s, 2 AS version FROM p_sessions""",
)
def upserted_sessions(v: Views) -> DataFrame:
    """Sessions as first seen and as they ended, mixed in two batches of a stream."""
    path = new_path(v.spark, "upserts")
    ended = v.sessions(pages=False, geo=False).select(
        "brand", "session_id", "session_duration_s", F.lit(2).alias("version"), "session_date"
    )
    both = ended.withColumn("times", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns(
        {"version": F.col("times"), "session_duration_s": F.when(F.col("times") == 2, F.col("session_duration_s")).otherwise(0)}
    )
    rows = v.stream_of(both.drop("times"), 2)
    name = _table_name(path)
    tables.create_table(v.spark, name, rows.schema, partition_by="session_date", path=path)
    keys = ["brand", "session_id"]
    return runs.upsert_stream(rows, name, new_path(v.spark, "upserts-log"), keys=keys, date_col="session_date", version="version")


@query(
    "bucketed_session_revenue",
    """
SELECT brand, session_id, session_duration_s, count(*) AS transactions, round(sum(t.revenue), 2) AS revenue
FROM p_sessions JOIN p_transactions t USING (brand, session_id) GROUP BY 1, 2, 3""",
)
def bucketed_session_revenue(v: Views) -> DataFrame:
    """Sessions and transactions as tables bucketed by session: joined and grouped where they lie."""
    keys = ["brand", "session_id"]
    visits, sales = new_path(v.spark, "visits"), new_path(v.spark, "sales")
    sessions = v.sessions(pages=False, geo=False).select(*keys, "session_duration_s")
    a = tables.write_bucketed(sessions, _table_name(visits), keys, buckets=8, path=visits)
    b = tables.write_bucketed(v.transactions().select(*keys, "revenue"), _table_name(sales), keys, buckets=8, path=sales)
    return a.join(b, keys).groupBy(*keys, "session_duration_s").agg(
        F.count(F.lit(1)).alias("transactions"), F.round(F.sum("revenue"), 2).alias("revenue")
    )


@query(
    "checked_csv_orders",
    """
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'header' WHEN o_orderkey % 5 = 0 THEN 'value' ELSE 'good' END AS outcome,
       count(*) AS orders FROM orders GROUP BY 1""",
)
def checked_csv_orders(v: Views) -> DataFrame:
    """Orders as CSV files: some with moved columns, some with a price that is no number."""
    folder = new_path(v.spark, "landing")
    rows = v.table("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    moved = rows.where("o_orderkey % 7 = 0").select("o_totalprice", "o_orderkey", "o_orderdate")
    price = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    kept = rows.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", price)
    for part in (kept, moved):
        part.write.mode("append").option("header", True).csv(folder)
    paths = [new_path(v.spark, n) for n in ("good", "rejected", "checked-log")]
    good, bad = runs.ingest_checked_csv(v.spark, folder, rows.schema, *paths, glob="*.csv")
    bad = bad.where(~F.array_contains("cells", "o_orderkey"))  # the header lines of rejected files
    counted = good.groupBy(F.lit("good").alias("outcome")).agg(F.count(F.lit(1)).alias("orders"))
    return counted.unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("orders")))
