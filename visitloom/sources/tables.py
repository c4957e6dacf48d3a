"""Table copies, recreation and incremental refresh on plain Parquet tables.

New rows are written first and put in place after, so a job that fails half-way
leaves the table as it was. A copied table is a view over its newest version,
which one step in the catalog replaces; the other functions take its name too.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions.dates import Day, day
from visitloom.sources.staging import remove_folder, stage

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
CLUSTER_PROPERTY = "visitloom.cluster_by"
VERSION_PROPERTY = "visitloom.version"
NO_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Newest days that are asked for final rows one by one.
NEWEST = 3


def clustered(df: DataFrame, partition_by: str, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Rows brought together by partition and sorted by the cluster columns.

    A rebalance, not a repartition: AQE joins small days into one task and cuts
    a busy day into several, so no day is written by a single task. Sorted files
    have the narrow min/max ranges by which Parquet row groups are skipped.
    """
    return df.hint("rebalance", partition_by).sortWithinPartitions(partition_by, *cluster_by)


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    *,
    partition_by: str,
    cluster_by: Sequence[str] = (),
    path: str | None = None,
    description: str = "",
) -> None:
    """Drops the table if it exists and creates it empty with the schema.

    The cluster columns are kept with the table; later writes sort by them.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    comment = f" COMMENT '{_quoted(description)}'" if description else ""
    location = f" LOCATION '{_quoted(path)}'" if path else ""
    kept = f" TBLPROPERTIES ('{CLUSTER_PROPERTY}' = '{','.join(cluster_by)}')"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (`{partition_by}`){location}{comment}{kept}"
    )


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def version_of(spark: SparkSession, table: str) -> str:
    """The table that holds the rows: the newest version of a copied table, else the table itself."""
    return _properties(spark, table).get(VERSION_PROPERTY, table)


def _cluster_columns(spark: SparkSession, table: str) -> list[str]:
    return [c for c in _properties(spark, version_of(spark, table)).get(CLUSTER_PROPERTY, "").split(",") if c]


def _details(spark: SparkSession, table: str) -> dict[str, str]:
    return {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}


def _write_days(rows: DataFrame, folder: str, partition_by: str, cluster_by: Sequence[str]) -> dict[str, str]:
    """Writes the rows by partition; partition name to folder, one per day."""
    clustered(rows, partition_by, cluster_by).write.partitionBy(partition_by).parquet(folder)
    back = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    names = [r[0] for r in back.select(F.col(partition_by).cast("string")).distinct().collect()]
    return {n: f"{folder}/{partition_by}={n}" for n in names if n is not None}


def _partition(column: str, name: str) -> str:
    """A partition as SQL; the text is cast to the column's type."""
    if not re.fullmatch(r"[\w .:+-]+", name):
        raise ValueError(f"{column}: {name!r} cannot name a partition folder")
    return f"PARTITION (`{column}` = '{name}')"


def _add_days(spark: SparkSession, table: str, partition_by: str, folders: Mapping[str, str]) -> None:
    """All partitions in one statement."""
    listed = " ".join(f"{_partition(partition_by, d)} LOCATION '{_quoted(f)}'" for d, f in sorted(folders.items()))
    if listed:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {listed}")


def _base(spark: SparkSession, table: str, path: str | None) -> str:
    """Folder of a copied table's versions; not that of a plain table of the same name, which moves with it."""
    return path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table.replace('.', '/')}__versions"


def copy_table(
    source: DataFrame,
    table: str,
    *,
    predicate: Column | None = None,
    add_nulls: Mapping[str, str] | None = None,
    partition_by: str,
    cluster_by: Sequence[str] = (),
    path: str | None = None,
    description: str = "",
) -> DataFrame:
    """Replaces ``table`` by the (filtered) source, with typed NULL columns for
    fields the source does not have yet. Eager; returns the new table.

    The rows go into a table of their own, a new version, with its partitions;
    ``table`` is a view over the newest version, and replacing that view is one
    step. So readers see all old rows or all new ones, and what fails before
    that step changes nothing. The version before stays for readers that had
    begun; older ones, and what failed copies left, go with the next copy.
    (A plain table of that name is renamed to become the first version before,
    once, with a moment in which the name is missing.)

    Rows without a partition value cannot be kept by day and raise. The source
    may read the table itself.
    """
    spark = source.sparkSession
    rows = source if predicate is None else source.where(predicate)
    for name, type_ in (add_nulls or {}).items():
        rows = rows.withColumn(name, F.lit(None).cast(type_))
    kind = rows.schema[partition_by].dataType.simpleString()
    undated = F.raise_error(F.lit(f"{table}: a row has no {partition_by}")).cast(kind)
    checked = rows.withColumn(partition_by, F.coalesce(partition_by, undated))
    mark = uuid.uuid4().hex
    folder, version = f"{_base(spark, table, path)}/write-{mark}", f"{table}__{mark}"
    folders = _write_days(checked, folder, partition_by, cluster_by)
    fields = [f for f in rows.schema.fields if f.name != partition_by]
    schema = T.StructType([*fields, rows.schema[partition_by]])
    create_table(
        spark, version, schema, partition_by=partition_by, cluster_by=cluster_by, path=folder, description=description
    )
    _add_days(spark, version, partition_by, folders)
    before = _switch(spark, table, version, description)
    _drop_versions(spark, table, {version, before})
    return spark.table(table).select(*rows.columns)


def _switch(spark: SparkSession, table: str, version: str, description: str) -> str | None:
    """Lets ``table`` stand for the version; the one it stood for before."""
    before = None
    plain = False
    if spark.catalog.tableExists(table):
        before = version_of(spark, table)
        plain = before == table
    if plain:
        before = f"{table}__{uuid.uuid4().hex}"
        spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
    comment = f" COMMENT '{_quoted(description)}'" if description else ""
    try:
        spark.sql(
            f"CREATE OR REPLACE VIEW {table}{comment} TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version}')"
            f" AS SELECT * FROM {version}"
        )
    except Exception:
        if plain:
            spark.sql(f"ALTER TABLE {before} RENAME TO {table}")
        raise
    return before


def _drop_versions(spark: SparkSession, table: str, kept: set[str | None]) -> None:
    """Removes the versions of a copied table but the given ones, with their files."""
    *space, name = table.split(".")
    where = f" IN {'.'.join(space)}" if space else ""
    for row in spark.sql(f"SHOW TABLES{where} LIKE '{name}__*'").collect():
        if not re.fullmatch(rf"{re.escape(name.lower())}__[0-9a-f]{{32}}", row["tableName"]):
            continue
        full = ".".join([*space, row["tableName"]])
        if full.lower() in {k.lower() for k in kept if k}:
            continue
        folder = _details(spark, full).get("Location")
        spark.sql(f"DROP TABLE IF EXISTS {full}")
        if folder and "/write-" in folder:
            remove_folder(spark, folder)


def refresh_checkpoint(
    target: DataFrame | None, date_col: str, final_col: str, start: Day
) -> dt.date:
    """First day to rebuild: the day after the last final one, else ``start``."""
    if target is None:
        return day(start)
    last = target.where(F.col(final_col)).agg(F.max(date_col)).first()[0]
    return day(start) if last is None else last + dt.timedelta(days=1)


def _days(spark: SparkSession, table: str) -> list[str]:
    """Partition names, one per day, newest first; the one for rows without a day is left out."""
    names = (r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {version_of(spark, table)}").collect())
    return sorted((n for n in names if n != NO_PARTITION), reverse=True)


def landed_days(spark: SparkSession, table: str) -> list[dt.date]:
    """Days that the table has, by the catalog alone: no file is listed or read."""
    return [day(n) for n in _days(spark, table)]


def table_checkpoint(spark: SparkSession, table: str, date_col: str, final_col: str, start: Day) -> dt.date:
    """``refresh_checkpoint`` of a partitioned table: the newest days are looked at one by one back to the first
    that has a final row, so old ones are not read; where none of these has any, all others in one job."""
    names = _days(spark, table)
    rows = spark.table(table).where(F.col(final_col))
    for name in names[:NEWEST]:
        if rows.where(F.col(date_col) == F.lit(day(name))).limit(1).count():
            return day(name) + dt.timedelta(days=1)
    if names[NEWEST:]:
        return refresh_checkpoint(rows.where(F.col(date_col) <= F.lit(day(names[NEWEST]))), date_col, final_col, start)
    return day(start)


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Overwrites touch only the partitions they write. ``insertInto`` heeds the
    session setting and not the writer's option; the default empties the table."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def _replace_days(rows: DataFrame, table: str, date_col: str) -> set[str]:
    """Puts the rows in place of the days they have; names of those days.

    The rows are computed and staged before the table is touched. What follows
    is a copy: Spark writes it beside the table and moves whole days at the end.
    """
    spark = rows.sparkSession
    ready = stage(rows.select(*spark.table(table).columns))
    stored = version_of(spark, table)
    with _dynamic_overwrite(spark):
        clustered(ready, date_col, _cluster_columns(spark, table)).write.mode("overwrite").insertInto(stored)
    spark.catalog.refreshTable(stored)
    return {r[0] for r in ready.select(F.col(date_col).cast("string")).distinct().collect()}


def incremental_refresh(
    source: DataFrame,
    table: str,
    *,
    date_col: str,
    final_col: str = "is_final",
    start: Day,
    checkpoint: Day | None = None,
    path: str | None = None,
    cluster_by: Sequence[str] = (),
) -> DataFrame:
    """Rebuilds all days from the checkpoint on and leaves earlier ones alone.

    ``checkpoint`` overrides the computed day (to backfill late inputs). Days
    that the source no longer has are dropped, all in one statement and with
    their files, after the others are in place: readers never miss a day that
    is only replaced. A run that fails while computing changes nothing, and any
    run can simply be repeated.
    """
    spark = source.sparkSession
    if not spark.catalog.tableExists(table):
        fields = [f for f in source.schema.fields if f.name != date_col]
        schema = T.StructType([*fields, source.schema[date_col]])
        create_table(spark, table, schema, partition_by=date_col, cluster_by=cluster_by, path=path)
    if checkpoint is None:
        checkpoint = table_checkpoint(spark, table, date_col, final_col, start)
    first = day(checkpoint)
    written = _replace_days(source.where(F.col(date_col) >= F.lit(first)), table, date_col)
    gone = [d for d in _days(spark, table) if d >= first.isoformat() and d not in written]
    if gone:
        stored = version_of(spark, table)
        folder = _details(spark, stored)["Location"].rstrip("/")
        listed = ", ".join(_partition(date_col, d) for d in gone)
        spark.sql(f"ALTER TABLE {stored} DROP IF EXISTS {listed}")
        for d in gone:
            remove_folder(spark, f"{folder}/{date_col}={d}")
        spark.catalog.refreshTable(stored)
    return spark.table(table)


def upsert(
    source: DataFrame,
    table: str,
    *,
    keys: Sequence[str],
    date_col: str,
    days: Sequence[Day],
    version: str | None = None,
) -> DataFrame:
    """Keyed refresh of the open days: source rows replace the table's rows of
    the same keys, the table's other rows of those days stay.

    Keys are compared with NULL equal to NULL. Without ``version`` all source
    rows of equal keys are kept. With it, a key has one row: the one with the
    greatest version, NULL lowest, of the source and the table (ties: the
    source's, then by all columns); an older row that comes late, or a batch
    that comes again, changes nothing. Only the named days are read and
    rewritten; a key stays on its day.
    """
    spark = source.sparkSession
    columns = spark.table(table).columns
    open_days = F.col(date_col).isin(*(day(d) for d in days))
    new = source.where(open_days).select(*columns)
    old = spark.table(table).where(open_days)
    if version is not None:
        both = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        rank = F.struct(version, "_new", *(c for c in columns if c not in (*keys, version)))
        rest = F.struct(*(c for c in columns if c not in keys))
        latest = both.groupBy(*keys).agg(F.max_by(rest, rank).alias("_row"))
        merged = latest.select(*keys, "_row.*")
    else:
        given = new.select(*keys).distinct().withColumnsRenamed({k: f"_n_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & old[k].eqNullSafe(given[f"_n_{k}"])
        merged = old.join(given, same, "left_anti").unionByName(new)
    _replace_days(merged, table, date_col)
    return spark.table(table)


def write_bucketed(
    df: DataFrame, table: str, keys: Sequence[str], *, buckets: int, path: str | None = None
) -> DataFrame:
    """Writes the rows as a table bucketed and sorted by the keys; returns it.

    Two such tables with equal keys and numbers of buckets are joined on the
    keys, and grouped by them, without an exchange. Rows are first brought
    together by bucket, so a bucket is one file; a key with very many rows makes
    its bucket's file large, so bucket by ids, not by categories.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, *keys).write.format("parquet").mode("overwrite")
    writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return spark.table(table)
