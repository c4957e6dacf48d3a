"""Bounded streaming runs: process what is there, remember it, stop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from visitloom.functions.dates import local_time
from visitloom.operators.tagging import pageview_fields, pageviews_with_user
from visitloom.sources.staging import stage
from visitloom.sources.tables import upsert
from visitloom.streaming.store import MergedStore


#: The file source forgets files this much older than the newest one; by default after a week.
EVERY_AGE = "36500d"


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    *,
    file_format: str = "csv",
    glob: str | None = None,
) -> DataFrame:
    """Appends the files that no earlier run has seen, however old; sources are kept.

    The checkpoint lists what was read, and the sink commits each batch once,
    so a run that dies half-way is repeated without duplicates.
    """
    reader = spark.readStream.format(file_format).schema(schema).option("maxFileAge", EVERY_AGE)
    if file_format == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    _drain(reader.load(folder).writeStream.format("parquet").option("path", target), checkpoint)
    return spark.read.schema(schema).parquet(target)


def ingest_checked_csv(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    rejected: str,
    checkpoint: str,
    *,
    glob: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Appends the CSV files that no earlier run has seen, if their header is the schema's; good and rejected rows.

    A plain read takes columns by place: a file with moved columns would be
    misread. Here cells are read as text. A file without a line of exactly the
    schema's names goes to ``rejected`` whole, and so does a row that has
    another number of cells, or a cell that is no value of its column's type:
    with its file, its cells, the raw line where it could not be cut, and the
    reason. Blank cells are NULL but in text columns. Nothing is lost, and a
    batch that is repeated replaces what it wrote. Lines that repeat the header
    are dropped.
    """
    names = [f"_{i}" for i in range(len(schema))]
    raw = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_bad", T.StringType())])
    reader = spark.readStream.schema(raw).option("maxFileAge", EVERY_AGE).option("encoding", "UTF-8")
    reader = reader.option("columnNameOfCorruptRecord", "_bad").option("escape", '"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.csv(folder).select("*", F.col("_metadata.file_path").alias("_file"))
    header = F.col("_bad").isNull()
    for n, field in zip(names, schema):
        header = header & F.col(n).eqNullSafe(F.lit(field.name))
    values, wrong = [], F.lit(False)
    for n, field in zip(names, schema):
        text = F.col(n) if isinstance(field.dataType, T.StringType) else F.nullif(F.trim(n), F.lit(""))
        value = text.try_cast(field.dataType)
        values.append(value.alias(field.name))
        wrong = wrong | (text.isNotNull() & value.isNull())
    side = "file string, cells array<string>, line string, reason string"

    def write(batch: DataFrame, number: int) -> None:
        rows = stage(batch)
        known = rows.where(header).select(F.col("_file").alias("_known")).distinct()
        marked = rows.where(~header).join(known, F.col("_file") == F.col("_known"), "left")
        reason = F.when(F.col("_known").isNull(), "header").when(F.col("_bad").isNotNull(), "cells").when(wrong, "value")
        marked = marked.withColumn("_reason", reason)
        marked.where("_reason is null").select(*values).write.mode("overwrite").parquet(f"{target}/batch={number}")
        marked.where("_reason is not null").select(
            F.col("_file").alias("file"), F.array(*names).alias("cells"), F.col("_bad").alias("line"),
            F.col("_reason").alias("reason"),
        ).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    # The first folders exist before any batch, so that a run without files can be read.
    for rows, to in ((spark.createDataFrame([], schema), target), (spark.createDataFrame([], side), rejected)):
        rows.write.mode("overwrite").parquet(f"{to}/batch=-1")
    _drain(lines.writeStream.foreachBatch(write), checkpoint)
    read = lambda kind, path: spark.read.schema(kind).option("recursiveFileLookup", True).parquet(path)
    return read(schema, target), read(side, rejected)


def upsert_stream(
    rows: DataFrame, table: str, checkpoint: str, *, keys: Sequence[str], date_col: str, version: str
) -> DataFrame:
    """Keyed refresh of a partitioned table from a stream, run to the end of its input.

    Each batch reads and rewrites the days it has. The row with the greatest
    ``version`` of a key wins, so batches may come in any order and again. Rows
    without a day raise.
    """

    def write(batch: DataFrame, _: int) -> None:
        undated = F.raise_error(F.lit(f"{table}: a row has no {date_col}")).cast("date")
        ready = stage(batch.withColumn(date_col, F.coalesce(date_col, undated)))
        days = [r[0] for r in ready.select(date_col).distinct().collect()]
        if days:
            upsert(ready, table, keys=keys, date_col=date_col, days=days, version=version)

    _drain(rows.writeStream.foreachBatch(write), checkpoint)
    return rows.sparkSession.table(table)


def bucket_totals(
    events: DataFrame,
    keys: list[str],
    *,
    ts: str = "event_timestamp_utc",
    width: str = "30 minutes",
    zone: str | None = None,
    late: str = "1 hour",
) -> DataFrame:
    """Events and value per tumbling bucket; batch and streaming alike.

    On a stream the watermark lets closed buckets leave the state; it needs an
    instant, so the zone-less clock is read in the session's zone and back.
    """
    timed = events.withColumn("_t", local_time(F.col(ts), zone).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    return (
        timed.groupBy(F.window("_t", width).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("bucket_start"), *keys, "events", "value")
    )


def totals_store(
    events: DataFrame,
    keys: list[str],
    target: str,
    *,
    ts: str = "event_timestamp_utc",
    width: str = "30 minutes",
    zone: str | None = None,
) -> MergedStore:
    """Bucket totals of the batches; they add up."""
    empty = events.sparkSession.createDataFrame([], events.schema)
    schema = bucket_totals(empty, keys, ts=ts, width=width, zone=zone).schema

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("bucket_start", *keys).agg(F.sum("events").alias("events"), F.sum("value").alias("value"))

    return MergedStore(events.sparkSession, target, schema, merge)


def write_totals(
    events: DataFrame,
    keys: list[str],
    target: str,
    checkpoint: str,
    *,
    ts: str = "event_timestamp_utc",
    width: str = "30 minutes",
    zone: str | None = None,
) -> DataFrame:
    """Runs a stream of events to the end of its input and gives its bucket totals.

    Each batch writes its own totals and the result adds them up, so no state
    is kept and events of any lateness count. ``totals_store(...).compact()``
    brings the batches of a long-lived stream together.
    """
    store = totals_store(events, keys, target, ts=ts, width=width, zone=zone)

    def write(batch: DataFrame, number: int) -> None:
        store.write(bucket_totals(batch, keys, ts=ts, width=width, zone=zone), number)

    _drain(events.writeStream.foreachBatch(write), checkpoint)
    return store.read()


def figure_parts(
    rows: DataFrame,
    keys: list[str],
    counted: Mapping[str, str],
    summed: Mapping[str, str],
    *,
    ts: str = "event_timestamp_utc",
    width: str = "30 minutes",
    zone: str | None = None,
) -> DataFrame:
    """Window, keys, and one row per distinct value of each counted column (``figure``, ``id``), with the sums
    of the others on a row without id. Distinct rows and sums merge."""
    timed = rows.withColumn("_t", local_time(F.col(ts), zone).cast("timestamp"))
    start = F.window("_t", width).getField("start").cast("timestamp_ntz").alias("window_start")
    ids = [F.struct(F.lit(name).alias("figure"), F.col(c).cast("string").alias("id")) for name, c in counted.items()]
    ids.append(F.struct(F.lit(None).cast("string").alias("figure"), F.lit(None).cast("string").alias("id")))
    long = timed.select(start, *keys, *summed.values(), F.explode(F.array(*ids)).alias("_f"))
    long = long.select("window_start", *keys, "_f.*", *summed.values()).where("figure is null or id is not null")
    sums = [F.sum(F.when(F.col("figure").isNull(), F.col(c).cast("double"))).alias(n) for n, c in summed.items()]
    return long.groupBy("window_start", *keys, "figure", "id").agg(F.count(F.lit(1)).alias("seen"), *sums)


def window_figures(parts: DataFrame, keys: list[str], counted: Mapping[str, str], summed: Mapping[str, str]) -> DataFrame:
    """The figures per window and keys from merged ``figure_parts``."""
    return parts.groupBy("window_start", *keys).agg(
        *[F.count_if(F.col("figure") == name).alias(name) for name in counted], *[F.sum(n).alias(n) for n in summed]
    )


def figures_store(
    rows: DataFrame,
    keys: list[str],
    target: str,
    counted: Mapping[str, str],
    summed: Mapping[str, str],
    *,
    ts: str = "event_timestamp_utc",
    width: str = "30 minutes",
    zone: str | None = None,
) -> MergedStore:
    """Figure parts of the batches: equal ones become one row, sums add up."""
    empty = rows.sparkSession.createDataFrame([], rows.schema)
    schema = figure_parts(empty, keys, counted, summed, ts=ts, width=width, zone=zone).schema
    sums = [F.sum(c).alias(c) for c in ("seen", *summed)]
    return MergedStore(
        rows.sparkSession, target, schema, lambda parts: parts.groupBy("window_start", *keys, "figure", "id").agg(*sums)
    )


def write_window_figures(
    rows: DataFrame,
    keys: list[str],
    target: str,
    checkpoint: str,
    counted: Mapping[str, str],
    summed: Mapping[str, str],
    *,
    ts: str = "event_timestamp_utc",
    width: str = "30 minutes",
    zone: str | None = None,
) -> DataFrame:
    """Exact distinct counts and sums per window of a stream, run to the end of its input.

    Counts do not add up over batches, the distinct values do: a batch writes
    each value once per window and keys, and the result counts the values of
    all batches. No event is too late for its window, whose values stay stored;
    rows without a time have no window and are left out, as in the batch form.
    A hot window or key is spread by value. ``counted`` and ``summed`` map names
    of figures to columns. NULL values do not count; a sum without any is NULL.
    """
    how = dict(ts=ts, width=width, zone=zone)
    store = figures_store(rows, keys, target, counted, summed, **how)

    def write(batch: DataFrame, number: int) -> None:
        store.write(figure_parts(batch, keys, counted, summed, **how), number)

    _drain(rows.writeStream.foreachBatch(write), checkpoint)
    return window_figures(store.read(), keys, counted, summed)


def _drain(writer: DataStreamWriter, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pageviews_store(events: DataFrame, page_load: str, order: Sequence[str], target: str) -> MergedStore:
    """Earliest page view per load of the batches; the earliest of all is the earliest of these."""
    flat = _flat_pageviews(events, page_load, order)
    fields = [c for c in flat.columns if c != page_load]

    def merge(parts: DataFrame) -> DataFrame:
        first = parts.groupBy(page_load).agg(F.min_by(F.struct(*fields), F.struct(*order, *fields)).alias("_first"))
        return first.select(page_load, "_first.*")

    return MergedStore(events.sparkSession, target, flat.schema, merge)


def _flat_pageviews(events: DataFrame, page_load: str, order: Sequence[str]) -> DataFrame:
    return pageviews_with_user(events).select(page_load, *order, *pageview_fields())


def write_first_pageviews(
    events: DataFrame, page_load: str, order: str | Sequence[str], target: str, checkpoint: str
) -> DataFrame:
    """Streaming form of ``first_pageview``: one page view per load, the earliest by ``order``, NULL first, ties
    by the fields.

    Each batch writes the earliest of its own loads and the result takes the
    earliest over all batches. So a load has one row however late or often it
    comes back and whether or not it has a time, and batch and stream give the
    same rows for any split of the input. ``pageviews_store(...).compact()``
    keeps one row per load of a long-lived stream.
    """
    order = [order] if isinstance(order, str) else list(order)
    store = pageviews_store(events, page_load, order, target)
    flat = _flat_pageviews(events, page_load, order)
    _drain(flat.writeStream.foreachBatch(lambda batch, number: store.write(store.merge(batch), number)), checkpoint)
    return store.read()
