"""Every query over odd tables: nulls anywhere, repeated and long rows, extra columns, no rows at all."""

import hashlib
import zlib

import pytest
from made import PROSE

import corpus_pipeline
from visitloom.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn int, role string, text string",
}
ROWS = {
    "documents": [
        (1, PROSE, "en", "s", 9), (1, PROSE, "en", "s", 9), (2, None, None, None, None), (None, "", "en", None, 0),
        (None, None, None, None, None), (4, "x" * 30_000, "en", "s", 1), (5, PROSE * 300, "en", "s", 1),
        (6, "token = 'abcdefgh12345' mail a@b.cd 4111 1111 1111 1111", "en", "s", 1), (7, " \n\t ", "", "", -1),
        (8, "Ü" * 40 + " 日本語。" * 50, "ja", "s", 0), (9, PROSE, "en", "t", 9),
    ],
    "labels": [(1, 1, 0), (1, 1, None), (4, 0, 0), (None, 1, 1), (5, None, None), (999, 0, 0)],
    "benchmark": [(1, PROSE), (2, None), (None, "short one"), (3, ""), (1, PROSE)],
    "pages": [(1, "http://a.net/", "<p>"), (1, "http://a.net/", "<p>"), (None, None, None), (3, "", ""), (4, "://", None)],
    "embeddings": [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], None), (None, [1.0, 0.01], 1), (5, [], 1)],
    "conversations": [(100, 1, "user", PROSE), (100, 1, "user", PROSE), (100, None, None, None), (200, 0, "", "x" * 30_000),
                      (None, 1, "a", "b")],
}
READS = {"op2": "pages", "op10": "embeddings"}
CLASHING = {"rank": "int", "row": "string", "key": "string", "k": "int", "fingerprint": "string", "spans": "string",
            "n_words": "int", "score": "double", "component_id": "string", "host": "string", "shard": "string", "ids": "string",
            "removed": "string", "base": "string", "p": "string", "t": "string", "__in": "string"}


@pytest.fixture(scope="module", params=["odd", "clashing", "empty"])
def tables(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    for name, schema in TABLES.items():
        df = spark.createDataFrame([] if request.param == "empty" else ROWS[name], schema)
        if request.param == "clashing":
            df = df.selectExpr("*", *(f"cast(null as {t}) as `{c}`" for c, t in CLASHING.items()))
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return request.param, str(folder)


@pytest.fixture(scope="module")
def results():
    """Rows of each query by the kind of its tables, as they come."""
    return {}


def exact(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def sha256(data=b""):
    return hashlib.sha256(data).hexdigest()


#: What the odd rows must give: columns, and values by id where the id is unique.
VALUES = {
    "op1_winnowing": (["n_words", "n_hit", "contaminated"], {2: (0, 0, False), 4: (1, 0, False), 7: (0, 0, False), 9: (49, 49, True)}),
    "op3_byte_bpe": (["n_tokens", "ids_sha256", "decoded_sha256"], {2: (0, sha256(), sha256())}),
    "op4_secret_scan": (["n_assign", "n_access", "n_hex", "spans"], {2: (0, 0, 0, ""), 6: (1, 0, 0, "assign:0:22"), 9: (0, 0, 0, "")}),
    "op5_external_shuffle": (["size", "text_crc32", "law"], {2: (1, 0, "rows"), 4: (30_001, zlib.crc32(b"x" * 30_000), "rows")}),
    "op7_boosted_pii": (["n_email", "n_ip", "n_card", "n_phone"], {2: (0, 0, 0, 0), 6: (1, 0, 1, 0), 9: (0, 0, 0, 0)}),
    "op8_simhash_near_dedup": (["fingerprint", "component_id"], {2: ("0" * 16, 2), 7: ("0" * 16, 2)}),
    "op11_pivotal_mix": (["size"], {2: (0,), 4: (1,), 9: (49,), 8: (51,)}),
    "op12_periodic_runs": (["n_runs", "period", "collapsed_sha256"], {2: (0, None, sha256()), 7: (0, None, sha256()),
                           8: (1, 1, sha256(("Ü" * 40 + " 日本語。").encode()))}),
}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("pipeline", "op13_conversation_trie")])
def test_a_row_for_each_row(spark, tables, results, name):
    """Further columns of any name change nothing."""
    kind, folder = tables
    got = queries.queries()[name](spark, folder)
    found = exact(got)
    assert got.columns and len(found) == (0 if kind == "empty" else len(ROWS[READS.get(name.split("_")[0], "documents")]))
    if kind != "empty":
        # the shuffle goes by the place of a row in its files, which differ
        assert name == "op5_external_shuffle" or results.setdefault(name, found) == found
        columns, values = VALUES.get(name, ([], {}))
        rows = {r.doc_id: tuple(r[c] for c in columns) for r in got.collect()} if values else {}
        assert {i: rows[i] for i in values} == values


def test_the_trie_has_a_node_per_sequence(spark, tables):
    kind, folder = tables
    got = queries.queries()["op13_conversation_trie"](spark, folder).collect()
    # the root, three turns of one conversation, one of the other
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in got) == (
        [] if kind == "empty" else [(100, 0, 2), (100, 1, 1), (100, 2, 1), (100, 3, 1), (200, 1, 1)]
    )


def test_the_pipeline_runs_on_them(spark, tables):
    kind, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, folder).cache()
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    assert docs.count() == 0 if kind == "empty" else docs.count() > 0
