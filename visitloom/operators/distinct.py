"""Exact distinct counts that merge: bitmaps over dense numbers of the ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.operators.joins import null_safe_join
from visitloom.sources.staging import stage

#: Ids that are numbered in one window, about.
IDS = 1 << 16


def dense_numbers(ids: DataFrame) -> DataFrame:
    """``id`` and ``number`` from 0 without gaps, for the distinct values but NULL of the only column, of any type.

    Numbers are dealt in two steps, within buckets of ids by hash and over the
    buckets, so no task numbers them all. They hold for one run: bitmaps of two
    runs merge only if they used the same numbers, so stage them.
    """
    ids = stage(ids.toDF("id").where(F.col("id").isNotNull()).distinct())
    buckets = max(1, -(-ids.count() // IDS))
    dealt = ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    offsets = sizes.select("bucket", before.alias("offset"))
    return stage(dealt.withColumn("inner", inner).join(offsets, "bucket").select("id", (F.col("inner") + F.col("offset")).alias("number")))


def id_bitmaps(df: DataFrame, keys: Sequence[str], column: str, numbers: DataFrame | None = None) -> DataFrame:
    """Per keys and range of 32,768 numbers a bitmap (``bits``) of the ids that occur; NULL ids do not.

    Rows first shrink to distinct keys and ids. A bitmap is 4 kB whatever it
    was made of: this is the form to keep and to merge.
    """
    numbers = numbers if numbers is not None else dense_numbers(df.select(column))
    pairs = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("id")).distinct()
    numbered = pairs.join(numbers, "id")
    return numbered.groupBy(*keys, F.bitmap_bucket_number("number").alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of fewer keys, from those of more keys or of several runs."""
    return bitmaps.groupBy(*keys, "range").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_counts(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def distinct_with_total(
    df: DataFrame, keys: Sequence[str], group: str, counted: Mapping[str, str], total: str = "All"
) -> DataFrame:
    """Distinct values of the counted columns per (keys, group), and one ``total`` row per keys.

    The groups' bitmaps are made once from the rows and merged into the total's,
    so no row is counted for two levels. A group without any value counts 0.
    """
    present = df.select(*keys, group).distinct()
    labels = present.unionByName(present.select(*keys, F.lit(total).alias(group)).distinct())
    for name, column in counted.items():
        bitmaps = stage(id_bitmaps(df, [*keys, group], column))
        own = bitmap_counts(bitmaps, [*keys, group], name)
        whole = bitmap_counts(merged_bitmaps(bitmaps, keys), keys, name).withColumn(group, F.lit(total))
        labels = null_safe_join(labels, own.unionByName(whole), [*keys, group], "left")
        labels = labels.withColumn(name, F.coalesce(name, F.lit(0)))
    return labels
