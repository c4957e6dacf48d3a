"""Targets against sharing step by step; copies against the laws of dependent rounding."""

import math
import random

import pytest
from pyspark.sql import functions as F

from visitloom.llm import mixing, queries


def slow_targets(sizes):
    """Share by weight, cut at the cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, spare, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while spare > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += spare * weight[s] / total
        spare = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                spare += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 5, "b": 1000, "c": 7, None: 900, "d": 0},
    {"only": 50},
    {None: 3},
    {"é": 10, "z": 400, "Z": 90, "日": 1, "": 77},
    {"a": 0, "b": 0},
]


@pytest.mark.parametrize("sizes", CASES + [{f"s{i}": random.Random(i * 7 + j).randrange(900) for i in range(40)} for j in range(3)])
def test_targets_equal_step_by_step_sharing(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    wanted = slow_targets(sizes)
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[s], wanted[s], rel_tol=1e-9, abs_tol=1e-9) for s in wanted)


def made(n, seed=1):
    rnd = random.Random(seed)
    sources = ["hot"] * 5 + ["a", "b", "c", None]
    return [(i, rnd.choice(sources), rnd.choice([0, 1, 5, 30, rnd.randrange(400), None]), "x") for i in range(n)]


SCHEMA = "doc_id long, source string, size long, target string"


@pytest.mark.parametrize("fan", [4, 1024])
def test_words_come_near_their_target(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = made(600)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in out) == list(range(600))
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    wanted = slow_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        ratio = wanted[s] / sizes[s]
        assert {r.copies for r in mine} <= {math.floor(ratio + 1e-9), math.ceil(ratio - 1e-9)}
        assert all(r.source_size == sizes[s] and math.isclose(r.target, wanted[s], rel_tol=1e-9) for r in mine)
        taken = sum(r.copies * (r.size or 0) for r in mine)
        assert abs(taken - wanted[s]) <= max(15, 0.01 * wanted[s]), s


def test_few_large_rows_among_small_ones(spark):
    """Half of the words in five rows: the others make up for whichever are taken."""
    rows = [(i, "a", 2000, "") for i in range(5)] + [(100 + i, "a", 1 + i % 40, "") for i in range(500)] + [(9, "b", 20_000, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    times = []
    for seed in range(6):
        out = mixing.mix(docs, weights=(1, 1), share=0.35, seed=seed).where("source = 'a'").collect()
        assert abs(sum(r.copies * r.size for r in out) - out[0].target) <= 20.5
        times.append(sum(r.copies for r in out if r.size == 2000))
    assert len(set(times)) > 1


def test_one_row_alone_is_rounded(spark):
    docs = spark.createDataFrame([(1, "a", 100, ""), (2, "b", 900, ""), (3, "c", 1, "")], SCHEMA)
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all(abs(r.copies - r.target / r.size) <= 0.5 + 1e-9 for r in out.values())


def test_reruns_agree_whatever_the_tasks(spark):
    docs = spark.createDataFrame(made(300) * 2, SCHEMA)
    results = []
    for parts in (1, 7):
        out = mixing.mix(docs.repartition(parts).orderBy(F.rand(parts)))
        results.append(sorted((r.doc_id, r.copies) for r in out.collect()))
    assert results[0] == results[1]
    other = mixing.mix(docs, seed=7).collect()
    assert sorted((r.doc_id, r.copies) for r in other) != results[0]


def test_each_row_has_its_chance(spark):
    """Over many seeds a row is taken as often as its source's ratio says."""
    docs = spark.createDataFrame([(i, "a", n, "") for i, n in enumerate([1, 2, 3, 10, 50, 4, 4])] + [(9, "b", 74, "")], SCHEMA)
    times, seeds = {}, 16
    for seed in range(seeds):
        for r in mixing.mix(docs, weights=(1, 1), share=0.9, seed=seed).collect():
            times[r.doc_id] = times.get(r.doc_id, 0) + r.copies
    # 0.9 of each of two equal sources
    small = [times[i] / seeds for i in range(7)]
    assert all(0.5 <= t <= 1 for t in small) and 0.8 <= sum(small) / 7 <= 0.98


def test_equal_rows_share_their_copies(spark):
    """A thousand rows alike, keys null: the tree spreads them and gives the right number of copies."""
    docs = spark.createDataFrame([(None, "a", 3, None)] * 1000 + [(1, "b", 1, None)], SCHEMA).repartition(5)
    out = mixing.mix(docs)
    total = out.where("source = 'a'").agg(F.sum("copies")).first()[0]
    assert out.count() == 1001 and abs(total - out.where("source = 'a'").first().target / 3) <= 0.5


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, None, None, "x"), (None, "a", 0, "x")], SCHEMA)).collect()
    assert [(r.target, r.copies) for r in out] == [(0.0, 0)] * 2


def test_the_mix_repeats_rows(spark):
    mixed = spark.createDataFrame([(1, 2, "u"), (2, 0, "v"), (3, 1, "w")], "doc_id long, copies int, number string")
    assert sorted(tuple(r) for r in mixing.repeated(mixed).collect()) == [(1, "u"), (1, "u"), (3, "w")]


def test_query_counts_words(spark, tmp_path):
    rows = [(1, " a b\x0bc\n", "s"), (2, None, "s"), (3, "d\u00a0e f", "t"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as size", "1 as copies")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op11_pivotal_mix"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = {r.doc_id: r for r in out.collect()}
    # 7.5 words in all: the null source has none to give, so 3 to 1
    assert {i: (r.size, r.source_size, r.target) for i, r in got.items()} == {
        1: (3, 3, 5.625), 2: (0, 3, 5.625), 3: (2, 2, 1.875), 4: (0, 0, 0.0)
    }
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got.values())
