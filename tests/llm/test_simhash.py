"""SimHash against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import rows

from made import documents  # noqa: F401

from visitloom.llm import simhash
from visitloom.llm.common import components


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints, distance=4):
    """Smallest key reachable, by comparing all pairs."""
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if root[b] < root[a] and (prints[a] ^ prints[b]).bit_count() <= distance:
                    root[a], changed = root[b], True
    return root


def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = ["", None, "  \t ", "One", "one", "two words", "a b c", "a b c d", "A B c D", "É é", "long " * 900]
    base = [" ".join(rnd.choices(words, k=rnd.choice([30, 200]))) for _ in range(6)]
    for text in base:
        out += [text, text, text.upper()]
        for _ in range(6):
            own = text.split()
            for _ in range(rnd.choice([1, 1, 2, 8])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("most", [2048, 2])
def test_groups_equal_brute_force(documents, monkeypatch, most):
    given = dict(enumerate(texts()))
    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda p, d: links(p, d, most=most))
    got = simhash.duplicate_groups(documents(*given.items(), fingerprint="other", row_number="x"))
    prints = {k: slow_print(t) for k, t in given.items()}
    wanted = slow_components(prints)
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in got.collect()} == prints
    assert {r.doc_id: r.component_id for r in got.collect()} == wanted


def test_trie_join_spans_the_links_of_all_pairs():
    rnd = np.random.default_rng(4)
    values = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [v ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, k, replace=False))) for v in values for k in (1, 4, 5, 7)]
    values = np.unique(np.concatenate((values, near)))
    a, b = simhash.trie_links(np.zeros(len(values), dtype=int), values, 4)
    joined = {int(v): int(v) for v in values}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        joined[root(max(x, y))] = root(min(x, y))
    slow = slow_components({int(v): int(v) for v in values})
    groups = {}
    for v in values.tolist():
        groups.setdefault(slow[v], set()).add(root(v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_first_with_nulls_repeats_and_clashing_names(documents):
    docs = documents((5, "same words here and there"), (2, "Same words here and there"), (None, "other text is here now"),
                     (7, None), (9, ""), (2, "Same words here and there"), fingerprint="mine")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "fingerprint") == [(2, "mine"), (7, "mine"), (None, "mine")]


def test_empty_table(documents):
    assert simhash.duplicate_groups(documents()).collect() == []
    assert simhash.keep_first(documents()).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
