"""The rule ensemble: held-out accuracy, rules and columns that agree, and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from made import PROSE, documents  # noqa: F401
from pyspark.sql import functions as F

from visitloom.llm import quality, trees


def corpus(n=400):
    rnd = random.Random(12)
    words = PROSE.split()
    docs, labels = [], []
    for i in range(n):
        own = rnd.choices(words, k=rnd.choice([20, 60, 150]))
        good = rnd.random() < 0.7
        if not good:
            own = rnd.choice([[w.upper() + "!!" for w in own], [w + rnd.choice(["$$$", "###", "&&&"]) for w in own], [x for w in own for x in (w, "|")]])
        docs.append((i, " ".join(own)))
        labels.append((i, int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    return docs, labels, quality.fit(docs, labels.where(~quality.held_out()))


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_the_model_is_sparse_and_its_columns_equal_its_rules(fitted):
    docs, _, model = fitted
    assert 0 < len(model.rules) < 150 and all(w for w, _ in model.rules)
    names = {s: s for s in quality.STATISTICS}
    rows = quality.add_statistics(docs.limit(60)).withColumn("s", model.score(names)).collect()
    for r in rows:
        total = model.bias
        for weight, bounds in model.rules:
            total += weight * all((r[n] > b) if above else (r[n] <= b) for n, above, b in bounds)
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-12)


def test_statistics_count_what_they_name():
    texts = ["One TWO!! a$b\nOne", "", None, "ééé", " \n ", "x" * 30]
    got = dict(zip(quality.STATISTICS, quality.statistics(pa.array(texts))))
    assert got["log_words"].tolist() == pytest.approx(np.log1p([4, 0, 0, 1, 0, 1]))
    assert got["distinct_words"][0] == 0.75 and got["capital_words"][0] == 0.25
    assert got["symbol_words"][0] == 0.25 and got["end_marks"][0] == 0.25
    assert got["beyond_ascii"][3] == 1 and got["long_words"][5] == 1 and got["lines"][0] == 0.5
    assert all(np.isfinite(v).all() for v in got.values())


def test_paths_of_a_description():
    text = """GBT
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 1 <= 3.0E-4)
      Predict: -1.0
     Else (feature 1 > 3.0E-4)
      Predict: 0.5
    Else (feature 2 > 0.5)
     Predict: 1.0
  Tree 1 (weight 0.1):
    If (feature 2 <= 0.7)
     If (feature 2 <= 0.2)
      Predict: 2.0
     Else (feature 2 > 0.2)
      Predict: 3.0
    Else (feature 2 > 0.7)
     Predict: -4.0
"""
    leaves = [(b, round(v, 6)) for b, v in trees.paths(text) if v is not None]
    assert leaves == [
        (((1, False, 3e-4), (2, False, 0.5)), -1.0), (((1, True, 3e-4), (2, False, 0.5)), 0.5), (((2, True, 0.5),), 1.0),
        (((2, False, 0.2),), 0.2), (((2, False, 0.7), (2, True, 0.2)), 0.3), (((2, True, 0.7),), -0.4),
    ]
    assert len(quality.tree_rules(text)) == 8


def test_edge_rows(spark, documents, fitted):
    _, labels, model = fitted
    odd = [(9001, None), (9001, None), (None, ""), (9002, " ".join(PROSE.split() * 4)), (9003, "LOUD!! WORDS!! ONLY!! " * 30)]
    docs = documents(*odd, (9004, PROSE * 3000), *corpus()[0], score="s", stat_upper="u")
    scored = quality.score(docs, model)
    assert scored.where("score is null or predicted is null").count() == 0 and scored.count() == 406
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 9002 in ids and 9003 not in ids
    assert quality.score(documents(), model).collect() == []


def test_without_labels_the_score_is_constant(spark, documents):
    docs, labels = documents((1, "a"), (2, PROSE)), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, one)).collect()} == {round(2 / 3, 6)}


def test_held_out_is_the_checksum(spark):
    rows = spark.range(200).select("id", quality.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert not spark.range(1).select(F.lit(None).cast("long").alias("x")).select(quality.held_out("x").alias("h")).first().h


def test_equal_inputs_give_equal_models(spark, fitted):
    docs, labels, model = fitted
    again = quality.fit(docs.repartition(5), labels.repartition(3).where(~quality.held_out()))
    assert again == model
