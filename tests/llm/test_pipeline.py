"""The stages one after the other, against plain Python on each stage's own input."""

import hashlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_decontaminate import slow as slow_hits
from test_secrets import slow as slow_secrets
from test_simhash import slow_components, slow_print

import corpus_pipeline
import __spark_entry__ as entry
from visitloom.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(step(spark, out[-1], SF).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns_of_documents(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_drops_labelled_junk_and_keeps_the_rest(steps):
    labels = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{SF}/labels.parquet' GROUP BY 1").fetchall())
    kept = texts(steps[1])
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.95
    assert kept.items() <= texts(steps[0]).items()


def test_one_document_of_each_group_stays(steps):
    before = texts(steps[1])
    roots = slow_components({i: slow_print(t) for i, t in before.items()})
    assert texts(steps[2]) == {i: t for i, t in before.items() if roots[i] == i}


def test_contaminated_documents_go(steps):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    before = texts(steps[2])
    hits = slow_hits(list(before.items()), items)
    assert texts(steps[3]) == {i: t for i, t in before.items() if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])}


def test_secrets_are_replaced_and_ids_decode(steps):
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (text == after[i]) == (not slow_secrets(text)) and not slow_secrets(after[i])
    for r in steps[5].collect():
        ids = library.encode_ordinary(after[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((after[r.doc_id] or "").encode()).hexdigest()


def test_run_gives_the_rows_of_the_last_stage(spark, steps):
    rows = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows == {r.doc_id: r.ids_sha256 for r in steps[-1].collect()}


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
