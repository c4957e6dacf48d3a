"""Winnowing against a look-up of every window."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from made import documents  # noqa: F401

from visitloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - 12) if own else 0):
            windows.setdefault(tuple(own[i : i + 13]), set()).add(item)
    out = {}
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    found |= windows[tuple(own[i : i + size])]
                    hit |= set(range(i, i + size))
        out[doc] = (len(own), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def cases():
    rnd = random.Random(8)
    vocabulary = ["the", "of", "a", "Ünï", "x1", "day", "to", "日本"]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, prose(n)) for i, n in enumerate([13, 14, 40, 60, 12, 7, 3, 1, 0, 25, 30, 13])]
    items += [(12, None), (13, items[2][1]), (14, "of, OF; of-of " * 10), (2, items[2][1]), (None, prose(20))]
    docs = [(i, prose(n)) for i, n in enumerate([0, 1, 5, 12, 13, 14, 50, 300, 3000])]
    for i, (_, text) in enumerate(items):
        own = (text or "").split(" ")
        docs.append((100 + i, f"{prose(9)} {' '.join(own[1:])}! {prose(30)}"))
        docs.append((200 + i, (text or "").upper().replace(" ", " -- ")))
        docs.append((300 + i, " ".join(own[:13]) + " zz " + " ".join(own[13:26])))
    return [*docs, (400, None), (401, docs[9][1])], items


@pytest.mark.parametrize("short", [True, False])
def test_hits_equal_brute_force(spark, documents, short):
    docs, items = cases()
    items = [x for x in items if short or len(words(x[1])) >= 13]
    table = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.mark(documents(*docs, items="old", prints="p"), table)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in marked.collect()}
    assert got == slow(docs, items)
    for r in marked.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_clean_keeps_rows_and_columns(spark, documents):
    passage = " ".join(f"p{i}" for i in range(20))
    table = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rest = " ".join(f"q{i}" for i in range(381))
    docs = documents((1, passage), (2, "free"), (2, "free"), (None, None), (3, f"{passage} {rest}"),
                     (4, f"{rest[:0]}{passage} {' '.join(rest.split()[:380])}"), spans="s", row_number="n")
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2, 3]
    assert decontaminate.clean(docs, table.limit(0)).count() == 6
    assert decontaminate.clean(documents(), table).collect() == []


def test_texts_hit_all_over_keep_bounded_batches(spark, documents, monkeypatch):
    rnd = random.Random(5)
    passage = rnd.choices([f"word{i}" for i in range(50)], k=40)
    items = [(n, " ".join(passage[:n])) for n in range(1, 14)] + [(40, " ".join(passage))]
    docs = [(1, " ".join(passage * 20)), (2, "free"), (3, " ".join(passage).upper()), (4, None)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    words_ = decontaminate.Grams(pa.array([text for _, text in docs]))
    bits = np.full(decontaminate.FILTER_BITS // 64, -1, dtype=np.int64)
    parts = [columns for _, columns in decontaminate._found(words_, list(range(1, 14)), bits)]
    assert sum(len(p[0]) for p in parts) > 5000
    assert max(sum(c.nbytes for c in p) for p in parts) < 3 * 4000
    table = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.mark(documents(*docs), table)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in marked.collect()} == slow(docs, items)
