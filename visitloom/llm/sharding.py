"""Sharding: a two-pass external shuffle into shards of equal counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import free_name
from visitloom.sources.staging import stage

#: Bytes that a bucket should hold: one bucket is one array in a task.
BUCKET_BYTES = 8 << 20
#: Tasks that shuffle buckets; with more buckets a task has several, one after the other.
MOST_TASKS = 1 << 16
#: Buckets whose rows are counted up by one task on the way to the offsets.
RUN = 4096


def external_shuffle(
    rows: DataFrame,
    shards: int = 8,
    seed: int = 42,
    bytes_of: Column | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``rows`` in a random order, with ``shard`` and ``slot``.

    Shards differ by one row at most and are filled without gaps from slot 0.
    Pass one gives each row a bucket by a seeded hash of its place in the input
    and writes it down: a place is unique, so neither repeated rows nor a hot
    key can fill a bucket. Buckets hold about ``bucket_bytes`` of
    ``bytes_of`` (default: 64 a row). Pass two shuffles each bucket as an array
    in one task (Fisher-Yates, seeded); the buckets one after the other are the
    shuffled table, which is cut into shards.

    Buckets are dealt to as many tasks as there are buckets (``MOST_TASKS`` at
    most), whatever the session's settings, and stand sorted in their task. The
    generator of a task is seeded by its number, so the same input files and
    seed give the same order, also where a task runs again. All rows stay, repeated and null ones too; no rows give no rows. Columns named like the two
    new ones are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    place, bucket = free_name(rows, "place"), free_name(rows, "bucket")
    size = bytes_of if bytes_of is not None else F.lit(64)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    buckets = max(1, -(-int(total["bytes"] or 0) // bucket_bytes))
    placed = rows.select(*(F.col(f"`{c}`") for c in kept)).withColumn(place, F.monotonically_increasing_id())
    scattered = stage(placed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(place)), F.lit(buckets))))

    counts = scattered.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    runs = counts.groupBy("run").agg(F.sum("n").alias("m"))
    earlier = F.sum("m").over(Window.orderBy("run")) - F.col("m")
    offsets = counts.select("bucket", "run", before.alias("before")).join(
        runs.select("run", earlier.alias("earlier")), "run"
    )
    offsets = offsets.select(F.col("bucket").alias(bucket), (F.col("before") + F.col("earlier")).alias("offset"))

    whole = F.struct(F.col(place), *(F.col(f"`{c}`") for c in kept))
    dealt = scattered.repartition(min(buckets, MOST_TASKS), bucket)
    arrays = dealt.groupBy(bucket).agg(F.sort_array(F.collect_list(whole)).alias("all")).sortWithinPartitions(bucket)
    orders = arrays.select(bucket, F.shuffle("all", seed).alias("all"))
    shuffled = orders.join(offsets, bucket).select("offset", F.posexplode("all").alias("pos", "row"))
    at, n = F.col("at"), max(1, total["n"])
    numbered = shuffled.select((F.col("offset") + F.col("pos")).alias("at"), "row").select(
        at, "row", F.expr(f"cast(at * {shards} div {n} as int)").alias("shard")
    )
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return numbered.select(
        *(F.col("row").getField(c).alias(c) for c in kept), "shard", (at - first).cast("long").alias("slot")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder per shard; the rows of a file are in the order of their slots.

    All rows and columns are written as they are, nulls and repeated rows too;
    no rows give a folder without shards.
    """
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
