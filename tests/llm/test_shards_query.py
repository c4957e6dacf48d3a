"""What the shard query says of a text comes from the shuffled rows."""

import zlib

from pyspark.sql import functions as F

from visitloom.llm import queries, sharding


def test_size_and_digest_are_those_of_the_text_that_arrives(spark, monkeypatch, tmp_path):
    docs = [(i, "é" * 70_000 if i == 3 else None if i == 4 else f"text {i}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = sharding.external_shuffle
    asked = {r.doc_id: (r.size, r.text_crc32) for r in queries.shards(spark, str(tmp_path)).collect()}
    texts = {i: (t or "").encode() for i, t in docs}
    assert asked == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    monkeypatch.setattr(
        sharding, "external_shuffle", lambda *a, **k: plain(*a, **k).withColumn("text", F.concat(F.lit("x"), "text"))
    )
    for r in queries.shards(spark, str(tmp_path)).collect():
        if r.doc_id != 4:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 2, zlib.crc32(b"x" + texts[r.doc_id]))
