"""Every run of 3 or more sentences and 20 or more words, not only the shortest ones."""

import random

import pyarrow as pa
from made import documents  # noqa: F401
from test_sentences import cases

from visitloom.llm import sentences


def split(text):
    """Words of each sentence, and the byte where each begins."""
    if not text.split():
        return [], []
    units = sentences.Sentences(pa.array([text], pa.string()))
    words = [bytes(units.bytes[a:b]) for a, b in zip(units.start, units.stop)]
    edges = units.sentence.tolist()
    return [words[a:b] for a, b in zip(edges, edges[1:])], [int(units.start[e]) for e in edges[:-1]]


def slow(docs):
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        parts, starts = split(text)
        gone, mine = set(), set()
        for i in range(len(parts)):
            for stop in range(i + 3, len(parts) + 1):
                run = tuple(w for part in parts[i:stop] for w in part)
                if len(run) < 20:
                    continue
                if run in seen or run in mine:
                    gone |= set(range(i, stop))
                mine.add(run)
        seen |= mine
        raw = text.encode()
        starts = [*starts, len(raw)]
        left = raw[: starts[0]] + b"".join(raw[starts[i] : starts[i + 1]] for i in range(len(parts)) if i not in gone)
        out[key] = (left.decode(), len(gone))
    return out


def test_cut_texts_equal_brute_force_over_every_run(documents):
    docs = [(i, t) for i, t in cases() if len(t) < 5000]
    got = {r.doc_id: (r.text, r.n_removed) for r in sentences.remove_repeats(documents(*docs)).collect()}
    assert got == slow(docs)


def test_nothing_is_left_of_a_copy(documents):
    rnd = random.Random(2)
    sizes = [9, 2, 14, 3, 16, 16, 16, 1, 1]
    text = " ".join(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) + "." for n in sizes)
    out = {r.doc_id: r for r in sentences.remove_repeats(documents((1, text), (2, text))).collect()}
    assert out[1].text == text and out[2].text == "" and out[2].n_removed == len(sizes)
    assert out[2].copies_of == [1]
