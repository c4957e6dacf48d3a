"""Sentence runs against a walk over the documents in order."""

import random
import re

import numpy as np
import pytest
from made import documents  # noqa: F401

from visitloom.llm import sentences
from visitloom.llm.words import BASE

MASK = (1 << 64) - 1


def word_hash(word):
    h, power = 0, 1
    for b in word:
        h, power = (h + (b + 1) * power) & MASK, power * BASE & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def units(text):
    """Words of the text and the words of each sentence or part, by the rule: in sentences of over 16 words the least
    word hash of each 8 words in a row, the last of equal ones, ends a part."""
    data = (text or "").lower().encode() if (text or "").isascii() else (text or "").encode().lower()
    own = [(m.start(), m.end()) for m in re.finditer(rb"[^\x09-\x0d\x20]+", data)]
    whole, now = [], []
    for i, (_, end) in enumerate(own):
        now.append(i)
        behind = data[end : own[i + 1][0]] if i + 1 < len(own) else b"\n"
        if data[end - 1 : end] in (b".", b"!", b"?") or b"\n" in behind:
            whole.append(now)
            now = []
    out = []
    for sentence in whole:
        ends = {sentence[-1]}
        if len(sentence) > 16:
            hashes = [word_hash(data[slice(*own[i])]) for i in sentence]
            for i in range(len(sentence) - 7):
                least = min(hashes[i : i + 8])
                ends.add(sentence[max(j for j in range(i, i + 8) if hashes[j] == least)])
        part = []
        for i in sentence:
            part.append(i)
            if i in ends:
                out.append(part)
                part = []
    return data, own, out


def slow(docs):
    """Every run of 3 or more sentences and 20 or more words of every document, in the order of the keys."""
    seen, out = {}, {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        data, own, parts = units(text)
        gone, mine = set(), {}
        for i in range(len(parts)):
            for stop in range(i + 3, len(parts) + 1):
                run = tuple(data[slice(*own[w])] for part in parts[i:stop] for w in part)
                if len(run) >= 20:
                    if run in seen or run in mine:
                        gone |= set(range(i, stop))
                    mine.setdefault(run, key)
        seen = {**mine, **seen}
        raw = (text or "").encode()
        starts = [own[p[0]][0] for p in parts] + [len(raw)]
        left = raw[: starts[0]] + b"".join(raw[starts[i] : starts[i + 1]] for i in range(len(parts)) if i not in gone)
        out[key] = (left.decode(), len(gone))
    return out


def cases():
    rnd = random.Random(6)
    vocabulary = ["Éa", "the", "of", "river", "Stone", "a", "light", "was", "ooo"]

    def prose(n):
        out = []
        while n > 0:
            size = rnd.choice([1, 4, 9, 30])
            out.append(" ".join(rnd.choices(vocabulary, k=size)) + rnd.choice([".", "!", "?", ",\n", "\n"]))
            n -= size
        return " ".join(out)

    shared = [prose(60) for _ in range(4)]
    docs = [(i, f"{prose(20)} {rnd.choice(shared)} {prose(25)} {rnd.choice(shared)}{prose(9)}") for i in range(40)]
    docs += [(50, docs[3][1]), (51, "Short. One. Text."), (52, "Short. One. Text."), (53, ""), (54, "  \n "), (55, "word " * 120)]
    return docs


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_cut_texts_equal_brute_force(documents, monkeypatch, bits):
    """Whatever the filters let pass."""
    monkeypatch.setattr(sentences, "FILTER_BITS", bits)
    docs = cases()
    out = sentences.remove_repeats(documents(*docs, removed="old", spans="x"))
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got == slow(docs)
    old = dict(docs)
    for r in out.collect():
        rest, at = [], 0
        for span in r.removed:
            rest.append(old[r.doc_id][at : span.start])
            at = span.end
        assert "".join([*rest, old[r.doc_id][at:]]) == r.text
        assert bool(r.copies_of) == bool(r.n_removed)


def test_a_long_passage_goes_wherever_it_stands(documents):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    passage = [". ".join(" ".join(word() for _ in range(n)).capitalize() for n in (9, 12, 8, 10, 9, 8)) + "." for _ in range(5)]
    own = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{own(7)}. {own(5)}\n{passage[i % 5]}\n{own(6)}. {own(4)}") for i in range(20)]
    out = {r.doc_id: r for r in sentences.remove_repeats(documents(*docs)).collect()}
    for i in range(20):
        assert (passage[i % 5] in out[i].text) == (i < 5)
        assert out[i].copies_of == ([] if i < 5 else [i % 5])


def test_null_keys_repeated_rows_and_no_rows(documents):
    text = cases()[0][1]
    out = sentences.remove_repeats(documents((None, text), (4, text), (4, text), (1, None)))
    sizes = sorted((r.doc_id or 0, len(r.text or ""), r.n_removed > 0) for r in out.collect())
    assert [(k, gone) for k, _, gone in sizes] == [(0, True), (1, False), (4, False), (4, True)] or [
        (k, gone) for k, _, gone in sizes
    ] == [(0, True), (1, False), (4, True), (4, False)]
    assert sentences.remove_repeats(documents()).collect() == []


def test_hash_of_a_run_is_that_of_its_words():
    import pyarrow as pa

    one = sentences.Sentences(pa.array(["x y. " + "Alpha beta. " * 12, "alpha BETA. " * 12])).runs()
    assert len(np.unique(one[3][one[0] == 1])) == 1 and one[3][one[0] == 1][0] in one[3][one[0] == 0]
