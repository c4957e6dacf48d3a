"""Laws of the shards: equal counts, gapless slots, all rows, a random order that repeats."""

import pytest
from made import documents  # noqa: F401
from pyspark.sql import functions as F

from visitloom.llm import sharding


@pytest.mark.parametrize(("n", "shards", "bucket"), [(1003, 8, 2000), (1003, 7, 1 << 30), (5, 8, 1), (1, 1, 1), (16, 8, 64)])
def test_laws(spark, n, shards, bucket):
    rows = spark.range(n).select("id", F.lit("x").alias("slot"), F.lit(1).alias("place"))
    out = sharding.external_shuffle(rows, shards, bucket_bytes=bucket).collect()
    assert sorted(r.id for r in out) == list(range(n))
    own = {s: sorted(r.slot for r in out if r.shard == s) for s in range(shards)}
    assert all(slots == list(range(len(slots))) for slots in own.values())
    assert max(map(len, own.values())) - min(map(len, own.values())) <= 1
    assert all(r.place == 1 for r in out)


def test_order_is_seeded_and_random(spark):
    rows = spark.range(4000, numPartitions=3)
    order = lambda seed: [r.id for r in sharding.external_shuffle(rows, 4, seed, bucket_bytes=20_000).orderBy("shard", "slot").collect()]
    first = order(1)
    assert first == order(1) and first != order(2)
    ascending = sum(a < b for a, b in zip(first, first[1:]))
    assert 1850 < ascending < 2150
    assert 1850 < sum(first[:2000]) / 2000 < 2150


def test_a_hot_row_does_not_fill_a_bucket(documents):
    docs = documents(*[(7, "the same")] * 900, *[(None, None)] * 300)
    out = sharding.external_shuffle(docs, 8, bytes_of=F.lit(100), bucket_bytes=6_000)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sizes == [150] * 8
    assert out.where("doc_id is null").count() == 300
    mixed = [r["n"] for r in out.where("doc_id is null").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(mixed) == 8 and max(mixed) < 80


def test_no_rows_and_files(spark, documents, tmp_path):
    assert sharding.external_shuffle(documents()).collect() == []
    out = sharding.external_shuffle(spark.range(100), 4, bucket_bytes=1000)
    sharding.write_shards(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(s, i) for s in range(4) for i in range(25)]


def test_order_does_not_depend_on_the_number_of_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("id as doc_id", "repeat('x', 20) as text").repartition(3).write.parquet(f"{tmp_path}/d")
    settings = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.enabled": None}
    old = {k: spark.conf.get(k) for k in settings}
    orders = []
    try:
        for parts, adaptive in (("2", "true"), ("7", "false"), ("2", "false"), ("13", "true")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            docs = spark.read.parquet(f"{tmp_path}/d")
            out = sharding.external_shuffle(docs, shards=3, bucket_bytes=4096)
            orders.append(sorted((r.shard, r.slot, r.doc_id) for r in out.collect()))
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert all(o == orders[0] for o in orders) and len(orders[0]) == 3000
    other = sharding.external_shuffle(spark.read.parquet(f"{tmp_path}/d"), shards=3, bucket_bytes=4096, seed=1)
    assert sorted((r.shard, r.slot, r.doc_id) for r in other.collect()) != orders[0]
