"""Runs of words against a search of all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from made import documents  # noqa: F401

from visitloom.llm import periods, queries


def slow(words):
    """Maximal stretches per period by plain scanning; the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            length = stop + q - start
            if length >= max(6, 4 * q):
                best.setdefault((start, length), q)
            start = stop + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def texts():
    rnd = random.Random(8)
    out = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a " * 700, "a b " * 4, "x a b a b a b a b a y", "A a " * 9,
           "a b c " * 5 + "a b", "a a a a a a b " * 6, "é é é é é é é", "a\x0bb\x0ca\rb a b a b"]
    for _ in range(150):
        base = rnd.choices("abc"[: rnd.choice([1, 2, 3])], k=rnd.randrange(1, 12))
        words = rnd.choices("abcde", k=rnd.randrange(20)) + base * rnd.randrange(1, 9) + rnd.choices("ab", k=rnd.randrange(9))
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = "z"
        out.append(rnd.choice([" ", "\n", "  "]).join(words * rnd.choice([1, 1, 4])))
    long = [f"w{rnd.randrange(900)}" for _ in range(3000)]
    out.append(" ".join(long[:300] + long[1000:1400] * 5 + ["q"] + long[50:90] * 30))
    return out


def expected(text):
    words = text.encode().split() if text else []
    found = slow(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return words, found, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


@pytest.mark.parametrize("block", [None, 200])
def test_runs_equal_brute_force(documents, monkeypatch, block):
    if block:
        monkeypatch.setattr("visitloom.llm.common.BLOCK_BYTES", block)
        monkeypatch.setattr(periods, "CHUNK", 50)
    given = texts()
    got = periods.collapse_runs(documents(*enumerate(given), runs="old", n_words="x")).collect()
    assert len(got) == len(given)
    for row in got:
        words, found, left = expected(given[row.doc_id])
        assert [tuple(r) for r in row.runs] == found, given[row.doc_id]
        assert (row.n_words, row.text) == (len(words), left)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (tuple(row.strongest) if row.strongest else None) == best


def test_extensions_equal_plain_comparison():
    rnd = np.random.default_rng(1)
    words = np.concatenate([rnd.integers(0, 2, 500), np.tile(rnd.integers(0, 3, 7), 90), np.zeros(300, int)])
    fence = np.zeros(len(words) + 2, bool)
    fence[[0, -1]] = True
    fenced = np.concatenate(([10], words, [11]))
    levels = periods.grammar(fenced, fence)
    assert len(levels) > 10 and len(levels[-1].start) < 20
    i = rnd.integers(1, len(words) - 50, 3000)
    j = i + rnd.integers(1, 50, 3000)
    back = periods.backwards(levels, len(fenced))
    for a, b, ahead, behind in zip(i, j, periods.common(levels, i, j), periods.common(back, len(fenced) - i, len(fenced) - j)):
        k = 0
        while fenced[a + k] == fenced[b + k]:
            k += 1
        assert ahead == k
        k = 0
        while fenced[a - 1 - k] == fenced[b - 1 - k]:
            k += 1
        assert behind == k


def test_ties_by_ratio():
    assert periods.strongest([(9, 8, 2), (4, 16, 4), (4, 12, 3)]) == (4, 12, 3)
    assert periods.strongest([(0, 401, 100), (500, 9, 2)]) == (500, 9, 2)


def test_empty_table(documents):
    assert periods.collapse_runs(documents()).collect() == []


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, documents, tmp_path):
    rnd = random.Random(5)
    given = {i: t for i, t in enumerate(texts())}
    given |= {1000 + i: " ".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 300))) for i in range(150)}
    documents(*given.items(), runs="x").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got.keys() == given.keys()
    planted = 0
    for i, text in given.items():
        words = text.encode().split() if text else []
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        _, found, left = expected(b" ".join(words).decode())
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        row = got[i]
        assert row.n_runs == len(found)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == sha256("".join(f"{s},{k},{q}\n" for s, k, q in found))
        assert row.collapsed_sha256 == sha256(left)
    assert planted > 10
