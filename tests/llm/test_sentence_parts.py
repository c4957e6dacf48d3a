"""Long passages in mid-sentence: the cuts of a long sentence depend on its words alone."""

import random

import numpy as np
import pyarrow as pa
from made import documents  # noqa: F401

from visitloom.llm import sentences


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))


def test_no_part_of_a_long_sentence_is_long():
    rnd = random.Random(1)
    texts = [words(rnd, n) for n in (17, 51, 3000)] + ["Orre " * 5184, "a b " * 500]
    units = sentences.Sentences(pa.array(texts))
    assert np.diff(units.sentence).max() <= sentences.PART


def test_a_passage_of_51_words_in_mid_sentence_goes(documents):
    rnd = random.Random(8)
    passages = [words(rnd, 51) for _ in range(60)]
    docs = [(i, f"{words(rnd, rnd.randrange(1, 30))} {passages[i % 60]} {words(rnd, rnd.randrange(1, 30))}") for i in range(120)]
    out = {r.doc_id: r for r in sentences.remove_repeats(documents(*docs)).collect()}
    for i in range(60):
        assert out[i].n_removed == 0 and out[i + 60].copies_of == [i]
        left = set(out[i + 60].text.split()) & set(passages[i].split())
        assert len(left) < 2 * sentences.PART


def test_a_word_said_over_and_over_goes_with_its_copy(documents):
    out = {r.doc_id: r for r in sentences.remove_repeats(documents((1, "Orre " * 60), (2, "Orre " * 60))).collect()}
    assert out[2].text == "" and out[2].copies_of[0] == 1
